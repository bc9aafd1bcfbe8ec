"""Features made of pieces: splitting lines, rolling pieces up, merging answers, checking timelines, nested areas."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_at_mask(points: DataFrame, line: str, order: Sequence[str], inside: Column) -> DataFrame:
    """(line, part, first, last, inside, hits): each line cut at its first and last point inside a mask, points numbered from 1.

    Parts before and after share an end with the part inside; a mask that holds one point takes the next one too, at the end of a line the one
    before. A line outside, or of one point, is one part. Only the numbers of the points are grouped, by partial aggregation.
    """
    w = Window.partitionBy(line).orderBy(*order)
    p = points.withColumn("_n", F.row_number().over(w).cast("long")).withColumn("_in", inside)
    hit = F.when(F.col("_in"), F.col("_n"))
    ends = p.groupBy(line).agg(F.count(F.lit(1)).alias("n"), F.min(hit).alias("f"), F.max(hit).alias("l"), F.count(hit).alias("hits"))
    one = F.col("f") == F.col("l")
    first = F.when(one & (F.col("l") == F.col("n")), F.col("f") - 1).otherwise(F.col("f"))
    last = F.when(one & (F.col("l") < F.col("n")), F.col("l") + 1).otherwise(F.col("l"))
    part = lambda k, a, b: F.struct(F.lit(k).alias("part"), a.cast("long").alias("first"), b.cast("long").alias("last"), F.lit(k == 1).alias("inside"))
    whole = F.array(part(0, F.lit(1), F.col("n")))
    cut = F.array(F.when(first > 1, part(0, F.lit(1), first)), part(1, first, last), F.when(last < F.col("n"), part(2, last, F.col("n"))))
    parts = F.when(F.col("f").isNull() | (F.col("n") < 2), whole).otherwise(F.array_compact(cut))
    return ends.select(line, "hits", F.explode(parts).alias("p")).select(line, "p.*", "hits")


def roll_up(pieces: DataFrame, group: str, id_col: str, size: str, names: str) -> DataFrame:
    """(group, lang, v, total): the sum of the pieces' sizes and, by key of their maps, the value of the largest piece that has the key.

    Of pieces of one size the smallest id counts. Keys are exploded before the grouping, so that no group is held as one list.
    """
    each = pieces.select(group, id_col, size, F.explode(names).alias("lang", "v"))
    best = each.groupBy(group, "lang").agg(F.min_by("v", F.struct(-F.col(size), F.col(id_col))).alias("v"))
    return best.join(pieces.groupBy(group).agg(F.sum(size).alias("total")), group)


def merged_elements(answers: Sequence[DataFrame], keys: Sequence[str], version: str) -> DataFrame:
    """Union of answers with each element once, by its keys the one of the largest version."""
    both = reduce(DataFrame.unionByName, answers)
    rest = [c for c in both.columns if c not in (*keys, version)]
    return both.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("_x")).select(*keys, "_x.*")


def timeline_report(intervals: DataFrame, key: str, id_col: str, start: str, end: str) -> DataFrame:
    """(id, problem) of intervals [start, end) that are empty, overlap the one before them or leave a gap after it."""
    w = Window.partitionBy(key).orderBy(start, id_col)
    before = F.lag(end).over(w)
    problem = F.when(F.col(start) >= F.col(end), "empty").when(before > F.col(start), "overlap").when(before < F.col(start), "gap")
    return intervals.select(F.col(id_col), problem.alias("problem")).where("problem is not null")


def repaired_by_keys(rows: DataFrame, fixes: DataFrame, keys: Sequence[str], column: str, fixed: str) -> DataFrame:
    """rows with the column put right where all keys are those of a fix; fixes are unique by their keys."""
    f = fixes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(fixed).alias("_fixed"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys])
    return rows.join(f, same, "left").withColumn(column, F.coalesce("_fixed", column)).drop("_fixed", *[f"_{k}" for k in keys])
