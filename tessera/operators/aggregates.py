"""Aggregations with exact tie and rounding rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def largest_remainder(counts: DataFrame, group: Sequence[str], plane: str, n: str, whole: int = 100) -> DataFrame:
    """Adds `percent`: shares of each group in whole units that sum to `whole`; ties go to the lower plane; empty groups get 0.

    Remainders are compared as integers, so the result does not depend on rounding. The window is over a group's planes.
    """
    g = Window.partitionBy(*group)
    total = F.sum(n).over(g)
    scaled = F.col(n) * whole
    base = counts.withColumn("_t", total).withColumn("_floor", F.when(F.col("_t") > 0, F.floor(scaled / F.col("_t"))).otherwise(0).cast("long"))
    base = base.withColumn("_rest", scaled - F.col("_floor") * F.col("_t"))
    rank = F.row_number().over(g.orderBy(F.desc("_rest"), plane))
    base = base.withColumn("_left", F.lit(whole) - F.sum("_floor").over(g)).withColumn("_rank", rank)
    plus = ((F.col("_rank") <= F.col("_left")) & (F.col("_t") > 0)).cast("long")
    return base.withColumn("percent", F.col("_floor") + plus).drop("_t", "_floor", "_rest", "_left", "_rank")


def origin_fit(df: DataFrame, group: Sequence[str], x: Column, y: Column) -> DataFrame:
    """Least squares through the origin per group: (group, slope, n); null slope if all x are 0."""
    sxx = F.sum(x * x)
    return df.groupBy(*group).agg(F.when(sxx != 0, F.sum(x * y) / sxx).alias("slope"), F.count(F.lit(1)).alias("n"))


def nearest_rank(df: DataFrame, group: Sequence[str], value: str, q: float) -> DataFrame:
    """(group, value): the value at place floor(q * n), counted from 0 and at most n - 1; no interpolation.

    Values are counted first, so the window holds a group's distinct values and not its rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group)
    seen = counts.withColumn("_upto", F.sum("_n").over(w.orderBy(value))).withColumn("_all", F.sum("_n").over(w))
    place = F.least(F.col("_all") - 1, F.floor(F.lit(q) * F.col("_all")))
    return seen.where(F.col("_upto") > place).groupBy(*group).agg(F.min(value).alias(value))


def longest_name(lengths: DataFrame, key: str, name: str, length: str) -> DataFrame:
    """(key, name) with the most total length; ties alphabetical; rows without a name don't count."""
    sums = lengths.where(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(key, name).agg(F.sum(length).alias("_l"))
    return sums.groupBy(key).agg(F.min(F.struct((-F.col("_l")).alias("_l"), F.col(name))).alias("_b")).select(key, F.col(f"_b.{name}").alias(name))


def merged_pieces(pieces: DataFrame, group: str, piece: str, size: str, attributes: Sequence[str]) -> DataFrame:
    """Pieces of one group summed; the biggest (then lowest piece) gives the attributes; a null group is its own piece."""
    key = F.coalesce(F.concat(F.lit("g:"), F.col(group).cast("string")), F.concat(F.lit("p:"), F.col(piece).cast("string")))
    best = F.min(F.struct((-F.col(size)).alias("_s"), F.col(piece), *[F.col(a) for a in attributes])).alias("_b")
    rows = pieces.groupBy(key.alias("merged_key")).agg(F.round(F.sum(size), 2).alias(size), F.count(F.lit(1)).alias("n_pieces"), best)
    return rows.select("merged_key", size, "n_pieces", F.col(f"_b.{piece}").alias(piece), *[F.col(f"_b.{a}").alias(a) for a in attributes])


def masked_spread(df: DataFrame, group: Sequence[str], value: Column, mask: Column) -> DataFrame:
    """Mean and population deviation of the values where the mask holds."""
    v = F.when(mask, value)
    return df.groupBy(*group).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.count(v).alias("n"))


def standardised(rows: DataFrame, group: list[str], value: str, like: str, out: str) -> DataFrame:
    """Adds `out`: value shifted and scaled within its group to the mean and deviation of `like`; null where value doesn't vary."""
    m = lambda f, c, n: f(c).alias(n)
    stats = rows.groupBy(*group).agg(m(F.avg, value, "_m"), m(F.stddev_pop, value, "_d"), m(F.avg, like, "_lm"), m(F.stddev_pop, like, "_ld"))
    scaled = F.col("_lm") + (F.col(value) - F.col("_m")) / F.nullif(F.col("_d"), F.lit(0.0)) * F.col("_ld")
    return rows.join(stats, group).withColumn(out, scaled).drop("_m", "_d", "_lm", "_ld")
