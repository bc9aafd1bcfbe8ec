from pyspark.sql import functions as F

from tessera.operators.temporal import debounced, fixed_steps
from tessera.streaming.state import current_state, debounced_stream, event_stream, fixed_steps_stream, latest_changes, sessions, windowed_counts


def drained(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_stream_equals_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    counts = drained(windowed_counts(event_stream(spark, f"{tmp_path}/in"), "1 day", "60 days"), "counts", "complete", tmp_path)
    want = batch.groupBy("event_type", F.to_date("ts").alias("d")).count()
    assert sorted((r.event_type, str(r.start)[:10], r.n) for r in counts.collect()) == sorted((r.event_type, str(r.d), r["count"]) for r in want.collect())
    state = drained(current_state(event_stream(spark, f"{tmp_path}/in")), "state", "complete", tmp_path)
    last = batch.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("t"))
    assert sorted((r.user_id, r.event_type) for r in state.collect()) == sorted((r.user_id, r.t) for r in last.collect())


def test_sessions_close_behind_the_watermark(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(f"{tmp_path}/in")
    got = drained(sessions(event_stream(spark, f"{tmp_path}/in"), "2 hours", "1 hour"), "closed", "append", tmp_path)
    assert got.count() > 0 and got.where("end < start or n < 1").count() == 0


def ordered_files(spark, sf, path, n=3):
    """Events in n files in order of time, with a column t of whole seconds."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "event_type", "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    rows = [(*r, k) for k, r in enumerate(e.orderBy("t", "event_id").collect())]
    e = spark.createDataFrame(rows, "user_id long, event_id long, event_type string, value double, t long, seq long")
    for k in range(n):
        e.where((F.col("seq") >= k * len(rows) // n) & (F.col("seq") < (k + 1) * len(rows) // n)).coalesce(1).write.mode("append").parquet(path)
    return e, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_debounce_and_steps_over_batches_equal_one_batch(spark, sf, tmp_path):
    batch, stream = ordered_files(spark, sf, f"{tmp_path}/in")
    got = drained(debounced_stream(stream, "user_id", "t", "event_id", 7200), "fired", "append", tmp_path)
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in debounced(batch, "user_id", "t", 7200, "event_id").collect())
    frames = lambda df: df.select("user_id", "seq", F.col("value").alias("ms"))
    steps = drained(fixed_steps_stream(frames(stream), "user_id", "seq", "ms", 16.0, 5, 120.0), "steps", "append", tmp_path)
    want = fixed_steps(frames(batch), "user_id", "seq", "ms", 16.0, 5, 120.0)
    of = lambda df: sorted((r.user_id, r.seq, r.steps, round(r.carry, 6)) for r in df.collect())
    assert of(steps) == of(want)


def test_changes_add_up_to_the_last_state(spark, sf, tmp_path):
    batch, stream = ordered_files(spark, sf, f"{tmp_path}/in")
    rows = drained(latest_changes(stream, "user_id", "t", "event_id", "event_type"), "changes", "append", tmp_path).collect()
    last = {}
    for r in sorted(rows, key=lambda r: r.t):
        assert r.old == last.get(r.user_id) and r.new != r.old
        last[r.user_id] = r.new
    assert last == {r.user_id: r.v for r in batch.groupBy("user_id").agg(F.max_by("event_type", F.struct("t", "event_id")).alias("v")).collect()}
