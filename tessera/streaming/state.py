"""Streaming forms of the as-of and sequential operators: what a group carries from one batch to the next is its state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark, path: str) -> DataFrame:
    """Parquet event files as a stream, with their fixed schema."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str, lateness: str) -> DataFrame:
    """(event_type, start, n) per tumbling window; rows later than `lateness` behind the newest are dropped, so state is bounded."""
    w = events.withWatermark("ts", lateness).groupBy("event_type", F.window("ts", size).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("event_type", F.col("w.start").alias("start"), "n")


def current_state(events: DataFrame) -> DataFrame:
    """(user_id, event_type, ts): the last event of each user so far, for the update output mode."""
    return events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e")).select("user_id", "e.event_type", "e.ts")


def sessions(events: DataFrame, gap: str, lateness: str) -> DataFrame:
    """(user_id, start, end, n) of sessions that a gap ends, once the watermark has passed them."""
    s = events.withWatermark("ts", lateness).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _in_order(frames: Iterator[pd.DataFrame], at: str, tie: str) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values([at, tie], kind="stable")


def debounced_stream(events: DataFrame, group: str, at: str, tie: str, gap: int) -> DataFrame:
    """(group, at, tie) of events that fire when the last one that fired is at least `gap` ago, as operators.temporal.debounced() in batch.

    The state of a group is one number. Events of a batch are taken in order; one older than the last that fired, which an
    earlier batch has let through, doesn't fire. A group's rows of one batch are held at a time.
    """
    types = dict(events.dtypes)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = _in_order(frames, at, tie)
        fired = []
        for t in rows[at].tolist():
            fires = last is None or t - last >= gap
            last = t if fires else last
            fired.append(fires)
        state.update((last,))
        yield rows.loc[fired, [group, at, tie]]

    schema = ", ".join(f"{c} {types[c]}" for c in (group, at, tie))
    return events.where(F.col(group).isNotNull()).select(group, at, tie).groupBy(group).applyInPandasWithState(step, schema, f"last {types[at]}", "append", GroupStateTimeout.NoTimeout)


def fixed_steps_stream(frames: DataFrame, group: str, at: str, elapsed: str, step: float, most: int, longest: float) -> DataFrame:
    """(group, at, steps, carry) as operators.temporal.fixed_steps(); what is left of a step is the state of a group."""
    types = dict(frames.dtypes)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carry, out = state.get[0] if state.exists else 0.0, []
        for t, e in _in_order(batches, at, elapsed)[[at, elapsed]].itertuples(index=False):
            total = carry + min(max(e, 0.0), longest)
            n = int(total // step)
            carry = total - n * step
            out.append((key[0], t, min(n, most), carry))
        state.update((carry,))
        yield pd.DataFrame(out, columns=[group, at, "steps", "carry"])

    schema = f"{group} {types[group]}, {at} {types[at]}, steps long, carry double"
    return frames.where(F.col(group).isNotNull()).select(group, at, elapsed).groupBy(group).applyInPandasWithState(run, schema, "carry double", "append", GroupStateTimeout.NoTimeout)


def latest_changes(events: DataFrame, group: str, at: str, tie: str, value: str) -> DataFrame:
    """(group, at, old, new) whenever a group's value changes: a snapshot advanced batch by batch touches only what changed.

    The state of a group is its value and the place in time of the event that set it; an event older than that changes nothing.
    """
    types = dict(events.dtypes)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t0, k0, now = state.get if state.exists else (None, None, None)
        rows = _in_order(frames, at, tie)
        t, k, v = rows.iloc[-1][[at, tie, value]]
        if t0 is None or (t, k) > (t0, k0):
            state.update((t, k, v))
            if v != now:
                yield pd.DataFrame([(key[0], t, now, v)], columns=[group, at, "old", "new"])

    schema = f"{group} {types[group]}, {at} {types[at]}, old {types[value]}, new {types[value]}"
    held = f"t {types[at]}, k {types[tie]}, v {types[value]}"
    return events.where(F.col(group).isNotNull()).select(group, at, tie, value).groupBy(group).applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.NoTimeout)
