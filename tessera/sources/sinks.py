"""Writers: Parquet in tiles, NDJSON, and tables of packed layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiled_parquet(df: DataFrame, path: str, x: str, y: str, size: float, files_per_tile: int = 1) -> None:
    """Parquet partitioned by square tiles; a tile with many rows is salted over files_per_tile tasks."""
    tile = F.concat_ws("_", F.floor(F.col(x) / size), F.floor(F.col(y) / size))
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_tile))
    df.withColumn("tile", tile).withColumn("_salt", salt).repartition("tile", "_salt").drop("_salt").write.partitionBy("tile").parquet(path)


def ndjson(df: DataFrame, path: str, sort: str | None = None) -> None:
    """One JSON text per row, nulls left out; sorted over all files by a column if asked for."""
    (df.orderBy(sort) if sort else df).write.json(path)


def packed_layers(grid: DataFrame, rows: int, cols: int, layers: list[str]) -> DataFrame:
    """(layer, r, bytes): each row of a grid of bytes as one binary, absent cells 255. A line of the grid is the largest group."""
    cells = F.collect_list(F.struct("c", "v"))
    long = grid.select("r", "c", F.explode(F.array(*[F.struct(F.lit(l).alias("layer"), F.col(l).cast("int").alias("v")) for l in layers])).alias("l")).select("r", "c", "l.layer", "l.v")
    lines = long.groupBy("layer", "r").agg(F.map_from_entries(cells).alias("m"))
    hexes = F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: F.lpad(F.hex(F.coalesce(F.try_element_at("m", c), F.lit(255)).cast("long")), 2, "0"))
    return lines.where((F.col("r") >= 0) & (F.col("r") < rows)).select("layer", "r", F.unhex(F.array_join(hexes, "")).alias("bytes"))
