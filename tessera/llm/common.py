"""Shared plumbing: table readers and hot-key block splitting; lineage cuts come from the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import release, scratch, shared_dir, written

__all__ = ["free_name", "join_hot", "release", "scratch", "shared_dir", "shuffle_parts", "split_blocks", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken, name = {c.lower() for c in df.columns}, f"_{base}"
    while name.lower() in taken:
        name += "_"
    return name


def join_hot(rows: DataFrame, found: DataFrame, keys: list[str], weight: str, parts: int = 256) -> DataFrame:
    """Left join of rows with found, unique by keys, whose column `weight` counts the rows of each key.

    Keys with more than 1 / parts of all rows are fewer than `parts`, so their part of found is broadcast whatever the size of the
    table; their rows are dealt out by a hash of all their columns over the shuffle for the others, the same in every attempt of a task. Keys must not be null.
    """
    total = found.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    values = [c for c in found.columns if c not in (*keys, weight)]
    hot = found.where(F.col(weight) * parts > total).select(*keys, F.struct(*values).alias("_hot"))
    cold = found.where(F.col(weight) * parts <= total).select(
        *[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], F.lit(0).alias("_spread"), F.struct(*values).alias("_cold")
    )
    dealt = rows.join(F.broadcast(hot), keys, "left")
    # Rows that are answered already get a number that no row of found has, spread evenly.
    own = F.xxhash64(*[F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind])
    dealt = dealt.withColumn("_at", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(own, F.lit(9973))).cast("int"))
    on = [F.col(k) == F.col(f"_c{i}") for i, k in enumerate(keys)] + [F.col("_at") == F.col("_spread")]
    both = dealt.join(cold, on, "left")
    return both.select(*rows.columns, *[F.coalesce(f"_hot.{v}", f"_cold.{v}").alias(v) for v in values])


def split_blocks(df: DataFrame, keys: list[str], id_col: str, block_rows: int) -> DataFrame:
    """Deals the rows of each key into block pairs of bounded size.

    A key with at most block_rows rows stays one block. A larger key is cut into
    S = ceil(n / block_rows) sub-blocks by a hash of id_col, and each row goes to
    the S block pairs that hold its sub-block. So any two rows of one key meet in
    exactly one pair: in (s, t) if their sub-blocks differ, in (s, s) if they are
    the same. Adds `_side` (own sub-block), `_bi`, `_bj` with _bi <= _bj.
    Rows that are in (s, t), s < t, must be compared across sides only.
    """
    hot = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > block_rows)
        .select(*keys, F.ceil(F.col("_n") / block_rows).cast("int").alias("_s"))
    )
    s = F.coalesce(F.col("_s"), F.lit(1))
    return (
        df.join(hot, keys, "left")
        .withColumn("_side", F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), s).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), s - 1)))
        .withColumn("_bi", F.least("_side", "_other"))
        .withColumn("_bj", F.greatest("_side", "_other"))
        .drop("_s", "_other")
    )
