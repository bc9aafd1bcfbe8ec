"""Integrity reports: constraint columns, licence rules, hashes and staleness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def problems(df: DataFrame, key: str, checks: Mapping[str, Column]) -> DataFrame:
    """(key, problem) of every check that does not hold; a check that is null does not hold."""
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
    return df.select(key, F.explode(bad).alias("problem"))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def licence_problems(uses: DataFrame, sources: DataFrame, block: str, source: str, licence: str, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """(block, source, problem): sources that are unknown, or whose licence the block's own does not admit.

    allowed: block licence -> licences of sources that may go into it. uses has block, block_licence and source.
    """
    pairs = F.array(*[F.lit(f"{b}<{s}") for b, ss in allowed.items() for s in ss])
    joined = uses.join(sources.select(source, F.col(licence).alias("_l")), source, "left")
    fits = F.array_contains(pairs, F.concat_ws("<", "block_licence", "_l"))
    problem = F.when(F.col("_l").isNull(), "unknown source").when(~fits, F.concat(F.lit("licence "), F.col("_l")))
    return joined.withColumn("problem", problem).where("problem is not null").select(block, source, "problem").distinct()


def row_hash(*columns: str) -> Column:
    """SHA-256 of columns in the given order; null and empty differ."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]), 256)


def table_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(n, hash) of all rows whatever their order: sums of four parts of the row hashes, so nothing is gathered or sorted."""
    h = row_hash(*columns)
    parts = [F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)])
    return sums.select("n", F.sha2(F.concat_ws(":", *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) for i in range(4)]), 256).alias("hash"))


def stale(found: DataFrame, recorded: DataFrame, key: str, value: str = "sha256") -> DataFrame:
    """(key, why): inputs that changed, went or came since a product was made."""
    a, b = found.select(key, F.col(value).alias("_now")), recorded.select(key, F.col(value).alias("_then"))
    why = F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "gone").when(F.col("_now") != F.col("_then"), "changed")
    return a.join(b, key, "full_outer").withColumn("why", why).where("why is not null").select(key, "why")
