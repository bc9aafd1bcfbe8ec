"""As-of state, change data and validity intervals over event tables."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot(events: DataFrame, key: str, at: str, value: str, when, tie: str | None = None, base: DataFrame | None = None, default=None) -> DataFrame:
    """(key, value): the last event of each key up to and including `when`; with base, all its keys, else `default`.

    One partially aggregated maximum, so a hot key is summed before the shuffle. Ties in time go to the larger `tie`.
    """
    order = F.struct(at, tie) if tie else F.col(at)
    state = events.where(F.col(at) <= when).groupBy(key).agg(F.max_by(value, order).alias(value))
    if base is None:
        return state
    return base.select(key).join(state, key, "left").select(key, F.coalesce(F.col(value), F.lit(default)).alias(value))


def delta(events: DataFrame, key: str, at: str, value: str, start, end, tie: str | None = None) -> DataFrame:
    """(key, before, after) of the keys whose state differs between two moments.

    Only keys with an event in (start, end] can differ; their state at `start` is looked up in the same pass.
    """
    order = F.struct(at, tie) if tie else F.col(at)
    old = F.when(F.col(at) <= start, order)
    state = events.where(F.col(at) <= end).groupBy(key).agg(
        F.max_by(value, old).alias("before"), F.max_by(value, order).alias("after"), F.max(at).alias("_last")
    )
    return state.where((F.col("_last") > start) & ~F.col("before").eqNullSafe(F.col("after"))).drop("_last")


def apply_delta(state: DataFrame, change: DataFrame, key: str, value: str) -> DataFrame:
    """The later snapshot from the earlier one and the change between them."""
    new = change.select(key, F.col("after").alias("_new"), F.lit(True).alias("_hit"))
    return state.join(new, key, "full_outer").select(key, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(value)).alias(value))


def intervals(events: DataFrame, key: str, at: str, order: Sequence[str]) -> DataFrame:
    """events with `valid_to`: the time of the key's next event, null for the last; [at, valid_to) is half-open."""
    w = Window.partitionBy(key).orderBy(at, *order)
    return events.withColumn("valid_to", F.lead(at).over(w))


def active_at(start: Column, end: Column, when) -> Column:
    """Half-open: start <= when < end; null ends are open."""
    return F.coalesce(start <= when, F.lit(True)) & F.coalesce(F.lit(when) < end if not isinstance(when, Column) else when < end, F.lit(True))


def event_rows(timeline: DataFrame, key: str, low: str, high: str, share: Column) -> DataFrame:
    """Adds `switch`: the whole step in [low, high) that a share of the way through falls in."""
    span = F.col(high) - F.col(low)
    return timeline.withColumn("switch", F.col(low) + F.least(span - 1, F.greatest(F.lit(0), F.floor(share * span))))


def paced_share(rows: DataFrame, block: str, band: str, hash_: Column) -> DataFrame:
    """Adds `share`: bands switch in order, each cell within its band by its hash, in proportion to the block's counts.

    Counts are per (block, band); the running total is over a block's few bands.
    """
    counts = rows.groupBy(block, band).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(block)
    run = w.orderBy(band).rowsBetween(Window.unboundedPreceding, -1)
    paced = counts.withColumn("_start", F.coalesce(F.sum("_n").over(run), F.lit(0))).withColumn("_total", F.sum("_n").over(w))
    return rows.join(paced, [block, band]).withColumn("share", (F.col("_start") + hash_ * F.col("_n")) / F.col("_total")).drop("_n", "_start", "_total")


def overridden(state: DataFrame, overrides: DataFrame, key: str, value: str, when) -> DataFrame:
    """Overrides (key, switch, hold, value): `before` holds the value until its switch, `after` from it on."""
    o = overrides.select(key, F.col("switch").alias("_s"), F.col("hold").alias("_h"), F.col(value).alias("_v"))
    holds = ((F.col("_h") == "before") & (F.lit(when) < F.col("_s"))) | ((F.col("_h") == "after") & (F.lit(when) >= F.col("_s")))
    return state.join(o, key, "left").withColumn(value, F.when(holds, F.col("_v")).otherwise(F.col(value))).drop("_s", "_h", "_v")


def merge_ranges(ranges: DataFrame, group: str, start: str, end: str, gap) -> DataFrame:
    """(group, start, end, n): ranges of a group merged where the next begins at most `gap` after all before have ended."""
    w = Window.partitionBy(group).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)
    marked = ranges.withColumn("_new", fresh)
    island = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(group, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_island")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str, tie: str) -> DataFrame:
    """left with the right value of the last right row of its key at or before left_at, by one union and one window.

    A window per key: keys are spread over tasks; a key that outgrows one wants a coarser time bucket in `key`.
    """
    l = left.select("*", F.col(left_at).alias("_at"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    r = right.select(key, F.col(right_at).alias("_at"), F.col(tie).alias("_tie"), F.lit(0).alias("_side"), F.struct(value).alias("_s"), F.col(value).alias("_v"))
    both = l.withColumn("_s", F.lit(None).cast(r.schema["_s"].dataType)).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_s", ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*left.columns, F.col(f"_last.{value}").alias(value))


def change_plane(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, old, new) of the cells that differ between two snapshots; a cell that only one has counts as null in the other."""
    a = before.select(*keys, F.col(value).alias("old"))
    b = after.select(*keys, F.col(value).alias("new"))
    return a.join(b, keys, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))


def streamed(rows: DataFrame, group: str, order: list[str], kernel, schema: str) -> DataFrame:
    """Rows of each group in order through a kernel that keeps a little state, sorted by Spark and never gathered.

    kernel() gives (feed, end): feed(group, *row) yields rows for what a row settles, end() for what is open at a group's end.
    """

    def apply(batches):
        now, feed, end = None, None, None
        names = [c.split()[0] for c in schema.split(", ")]
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if feed is None or row[0] != now:
                    if feed is not None:
                        out += end()
                    now, (feed, end) = row[0], kernel()
                out += feed(*row)
            yield pd.DataFrame(out, columns=names)
        if feed is not None:
            yield pd.DataFrame(end(), columns=names)

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.where(F.col(group).isNotNull()).repartition(parts, group).sortWithinPartitions(group, *order).mapInPandas(apply, schema)


def capped_ranges(ranges: DataFrame, group: str, start: str, end: str, gap: int, cap: int) -> DataFrame:
    """(group, start, end, n) like merge_ranges, but a merged range never grows over `cap`: each step depends on the one before. Null groups are left out."""

    def kernel():
        open_: list = []

        def feed(g, s, e):
            if open_ and s - open_[2] <= gap and max(e, open_[2]) - open_[1] <= cap:
                open_[2:] = [max(open_[2], e), open_[3] + 1]
                return []
            done = close()
            open_[:] = [g, s, e, 1]
            return done

        def close():
            return [tuple(open_)] if open_ else []

        return feed, close

    types = dict(ranges.dtypes)
    schema = f"{group} {types[group]}, {start} {types[start]}, {end} {types[end]}, n bigint"
    return streamed(ranges.select(group, start, end), group, [start, end], kernel, schema)


def debounced(events: DataFrame, group: str, at: str, gap: int, tie: str | None = None) -> DataFrame:
    """Events that fire when the last one that fired is at least `gap` ago; of events at one time the first by `tie`. Null groups are left out."""

    def kernel():
        last: list = []

        def feed(*row):
            if last and row[1] - last[0] < gap:
                return []
            last[:] = [row[1]]
            return [row]

        return feed, lambda: []

    rest = [c for c in events.columns if c not in (group, at)]
    types = dict(events.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in (group, at, *rest))
    return streamed(events.select(group, at, *rest), group, [at, *([tie] if tie else [])], kernel, schema).select(*events.columns)


def fixed_steps(frames: DataFrame, group: str, at: str, elapsed: str, step: float, most: int, longest: float, tie: str | None = None) -> DataFrame:
    """(group, at, steps, carry): how many steps of a fixed length each frame makes, the rest carried on to the next.

    A frame counts for `longest` at most, and makes `most` steps at most; what is beyond is dropped, so that a long pause is not made up for.
    """

    def kernel():
        carry = [0.0]

        def feed(g, t, e, *_):
            total = carry[0] + min(max(e, 0.0), longest)
            n = int(total // step)
            made = min(n, most)
            carry[0] = total - n * step
            return [(g, t, made, carry[0])]

        return feed, lambda: []

    types = dict(frames.dtypes)
    cols = [group, at, elapsed, *([tie] if tie else [])]
    return streamed(frames.select(*cols), group, [at, *([tie] if tie else [])], kernel, f"{group} {types[group]}, {at} {types[at]}, steps bigint, carry double")
