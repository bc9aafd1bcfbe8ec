"""Joins with preference, precedence, validation and repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefer_match(candidates: DataFrame, key: str, preferred: Column, rank: str, keep: Sequence[str]) -> DataFrame:
    """One candidate per key: preferred ones first, then the lowest rank; by one partially aggregated minimum."""
    best = F.min(F.struct((~F.coalesce(preferred, F.lit(False))).alias("_p"), F.col(rank), *[F.col(c) for c in keep if c != rank])).alias("_b")
    return candidates.groupBy(key).agg(best).select(key, *[F.col(f"_b.{c}").alias(c) for c in keep])


def last_of_list(lookup: DataFrame, key: str, position: str) -> DataFrame:
    """A lookup list in which later entries of a key replace earlier ones."""
    others = [c for c in lookup.columns if c != key]
    return lookup.groupBy(key).agg(F.max_by(F.struct(*others), position).alias("_l")).select(key, *[F.col(f"_l.{c}").alias(c) for c in others])


def cascade(*rules: tuple[Column, str, str], default: tuple[str, str]) -> Column:
    """Struct (verdict, why) of the first rule (condition, verdict, why) that holds."""
    out = F.struct(F.lit(default[0]).alias("verdict"), F.lit(default[1]).alias("why"))
    for condition, verdict, why in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(verdict).alias("verdict"), F.lit(why).alias("why"))).otherwise(out)
    return out


def mismatches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every violation of a one-to-one match on key at once: (key, n_left, n_right, problem)."""
    l = left.groupBy(key).agg(F.count(F.lit(1)).alias("n_left"))
    r = right.groupBy(key).agg(F.count(F.lit(1)).alias("n_right"))
    both = l.join(r, key, "full_outer").select(key, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    problem = (
        F.when(F.col("n_right") == 0, "unmatched").when(F.col("n_left") == 0, "unused").when(F.col("n_left") > 1, "repeated").when(F.col("n_right") > 1, "matched twice")
    )
    return both.withColumn("problem", problem).where("problem is not null")


def or_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) of rows that match on any of several equalities: a union of hash joins, each pair once.

    An id brings the sets of its values of all keys along, so that a join leaves out what an earlier one gives: pairs are never gathered to tell repeats apart.
    """

    def sides(df: DataFrame, id_col: str, keys: list[str], mark: str) -> DataFrame:
        return df.groupBy(id_col).agg(*[F.collect_set(k).alias(f"{mark}{i}") for i, k in enumerate(keys)])

    l, r = sides(left, left_id, [a for a, _ in pairs], "_l"), sides(right, right_id, [b for _, b in pairs], "_r")
    out = None
    for i in range(len(pairs)):
        held = lambda m: [f"{m}{j}" for j in range(i + 1)]  # noqa: E731, B023
        met = l.select(left_id, *held("_l"), F.explode(f"_l{i}").alias("_k")).join(r.select(right_id, *held("_r"), F.explode(f"_r{i}").alias("_k")), "_k")
        for j in range(i):
            met = met.where(~F.arrays_overlap(f"_l{j}", f"_r{j}"))
        # Ids that share several values of one key meet by the smallest of them alone.
        once = (F.size(f"_l{i}") == 1) | (F.size(f"_r{i}") == 1) | (F.array_min(F.array_intersect(f"_l{i}", f"_r{i}")) == F.col("_k"))
        part = met.where(once).select(left_id, right_id)
        out = part if out is None else out.unionByName(part)
    return out


def not_matched_once(pairs: DataFrame, left: DataFrame, left_id: str, right_id: str, unique: bool = False) -> DataFrame:
    """(left_id, n) of the rows of left that the pairs of a join give no partner or several, for joins that must give exactly one. A null id has none.

    unique: no pair is there twice, as in those of or_join(), so that they are counted as they come.
    """
    n = pairs.groupBy(left_id).agg((F.count if unique else F.count_distinct)(right_id).alias("n"))
    counted = left.select(left_id).join(n, left_id, "left").select(left_id, F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return counted.where("n <> 1")


def repaired(df: DataFrame, fixes: DataFrame, columns: Sequence[str], wrong: str = "wrong", right: str = "right") -> DataFrame:
    """df with the values of columns replaced by the list of fixes; one join per column, small lists are broadcast by size."""
    for c in columns:
        f = fixes.select(F.col(wrong).alias(c), F.col(right).alias("_fix"))
        df = df.join(f, c, "left").withColumn(c, F.coalesce("_fix", c)).drop("_fix")
    return df


def unused(fixes: DataFrame, df: DataFrame, wrong: str, column: str) -> DataFrame:
    """Fixes that no row needs."""
    return fixes.join(df.select(F.col(column).alias(wrong)), wrong, "left_anti")


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of points with the ranges [low, high) they fall in, by an equi join on buckets of `width`.

    A range is repeated once for each bucket it touches; the residual comparison keeps exact matches, each once.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    r = ranges.withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    p = points.withColumn("_bucket", bucket(at))
    return p.join(r, "_bucket").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_bucket")
