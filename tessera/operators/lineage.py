"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a fresh folder where it is unset and all tasks run on this machine, as in tests; else raises."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[.*\])?\Z", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = getattr(spark, "_tessera_dir", None)
        if path is None:
            path = spark._tessera_dir = "file://" + tempfile.mkdtemp(prefix="tessera-")
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, what: str = "step", after: DataFrame | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, so that a lost executor costs a re-read and plans stay short.

    after: an earlier table of written() that df was made from and that nothing else will read; it is deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables(spark).append(path)
    if after is not None:
        release(after)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def _tables(spark: SparkSession) -> list[str]:
    """Paths of the session's tables that are not deleted yet."""
    if getattr(spark, "_tessera_tables", None) is None:
        spark._tessera_tables = []
    return spark._tessera_tables


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    gone = set(paths)
    spark._tessera_tables = [p for p in _tables(spark) if p not in gone]


def release(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, [t._tessera_path])


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes, at its end, all tables that operators wrote within it: for a job that saves its results inside.

    Tables are read until a result is saved, so operators themselves delete only what their own next step replaces.
    """
    before = set(_tables(spark))
    try:
        yield
    finally:
        _delete(spark, [p for p in _tables(spark) if p not in before])
