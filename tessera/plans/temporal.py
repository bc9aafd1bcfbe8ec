"""As-of state, change data, intervals and calendars on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import day_of_date, era_of, format_day, is_first_of_month, map_year, month_of_day, year_of_day
from ..functions.hashing import hash01
from ..operators import temporal as tm
from .registry import query, table

T0, T1 = "1998-01-01", "1998-07-01"


def _orders(spark, sf):
    return table(spark, sf, "orders")


def _at(text):
    return F.lit(text).cast("timestamp_ntz")


@query(f"""
SELECT c_custkey AS o_custkey, coalesce(arg_max(o_orderstatus, row(o_orderdate, o_orderkey)), 'none') AS o_orderstatus
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate <= TIMESTAMP '{T0}' GROUP BY c_custkey
""")
def asof_snapshot(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return tm.snapshot(_orders(spark, sf), "o_custkey", "o_orderdate", "o_orderstatus", _at(T0), "o_orderkey", base, "none")


@query(f"""
WITH s AS (
  SELECT o_custkey, arg_max(o_orderstatus, row(o_orderdate, o_orderkey)) FILTER (o_orderdate <= TIMESTAMP '{T0}') AS before,
    arg_max(o_orderstatus, row(o_orderdate, o_orderkey)) AS after
  FROM orders WHERE o_orderdate <= TIMESTAMP '{T1}' GROUP BY o_custkey
) SELECT * FROM s WHERE before IS DISTINCT FROM after
""")
def asof_delta(spark, sf):
    return tm.delta(_orders(spark, sf), "o_custkey", "o_orderdate", "o_orderstatus", _at(T0), _at(T1), "o_orderkey")


@query(f"""
WITH i AS (SELECT o_orderkey, o_custkey, o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders)
SELECT o_orderkey, o_custkey FROM i WHERE o_orderdate <= TIMESTAMP '{T0}' AND (valid_to IS NULL OR TIMESTAMP '{T0}' < valid_to)
""")
def validity_active(spark, sf):
    i = tm.intervals(_orders(spark, sf).select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", "o_orderdate", ["o_orderkey"])
    return i.where(tm.active_at(F.col("o_orderdate"), F.col("valid_to"), _at(T0))).select("o_orderkey", "o_custkey")


TAGS = (("click", 1, 15), ("purchase", 10, None), ("view", None, 20))


@query("""
WITH tags(tag, lo, hi) AS (VALUES ('click', 1, 15), ('purchase', 10, NULL), ('view', NULL, 20)),
e AS (SELECT event_id, event_type, day(ts) AS d FROM events)
SELECT event_id, CASE WHEN tag IS NOT NULL THEN (lo IS NULL OR lo <= d) AND (hi IS NULL OR d < hi)
  WHEN starts_with(event_type, 's') THEN d >= 5 ELSE FALSE END AS shown
FROM e LEFT JOIN tags ON tag = event_type
""")
def tag_on(spark, sf):
    tags = spark.createDataFrame(TAGS, "tag string, lo int, hi int")
    e = table(spark, sf, "events").select("event_id", "event_type", F.dayofmonth("ts").alias("d"))
    own = tm.active_at(F.col("lo"), F.col("hi"), F.col("d"))
    rule = F.when(F.startswith("event_type", F.lit("s")), F.col("d") >= 5).otherwise(F.lit(False))
    return e.join(tags, e.event_type == tags.tag, "left").select("event_id", F.when(F.col("tag").isNotNull(), own).otherwise(rule).alias("shown"))




def _mul(x: str, k: int) -> str:
    """DuckDB text for the low 32 bits of x times a constant."""
    k = k - (1 << 32) if k >= 1 << 31 else k
    low = f"(({x}) & 4294967295)"
    return f"(((CASE WHEN {low} >= 2147483648 THEN {low} - 4294967296 ELSE {low} END) * ({k})::BIGINT) & 4294967295)"


def hash_sql(x: str, y: str, seed: int, name: str = "h", rest: str = "", table_: str = "") -> str:
    """A chain of DuckDB subqueries that adds hash01(x, y, seed) as a column."""
    return f"""(SELECT * EXCLUDE (h3), ((h3 # (h3 >> 16)) & 4294967295)::DOUBLE / 4294967296.0 AS {name} FROM
      (SELECT * EXCLUDE (h2), {_mul('xor(h2, h2 >> 13)', 0xC2B2AE35)} AS h3 FROM
      (SELECT * EXCLUDE (h1), {_mul('xor(h1, h1 >> 15)', 0x85EBCA6B)} AS h2 FROM
      (SELECT *, xor(xor({_mul(f'({x})::BIGINT', 0x27D4EB2D)}, {_mul(f'({y})::BIGINT', 0x165667B1)}), {_mul(f'{seed}::BIGINT', 0x9E3779B1)}) AS h1 FROM {table_}))))""".replace(
        "h3 # (h3 >> 16)", "xor(h3, h3 >> 16)"
    )


@query(f"SELECT l_orderkey, l_linenumber, h FROM {hash_sql('l_orderkey', 'l_linenumber', 7, 'h', table_='lineitem')} WHERE h < 0.25")
def hash01_sample(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return l.withColumn("h", hash01(F.col("l_orderkey"), F.col("l_linenumber"), 7)).where("h < 0.25")


@query(f"""
WITH e AS (SELECT event_id, user_id % 8 AS block, hour(ts) AS band, event_id % 1000 AS x FROM events),
n AS (SELECT block, band, count(*) AS n FROM e GROUP BY ALL),
p AS (SELECT block, band, n, coalesce(sum(n) OVER (PARTITION BY block ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
  sum(n) OVER (PARTITION BY block) AS t FROM n)
SELECT event_id, round((s + h * n) / t, 9) AS share, 1219 + least(799, greatest(0, floor((s + h * n) / t * 800)))::BIGINT AS switch
FROM {hash_sql('event_id', 'x', 3, 'h', table_='e')} JOIN p USING (block, band)
""")
def event_paced_switch(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") % 8).alias("block"), F.hour("ts").alias("band"), (F.col("event_id") % 1000).alias("x"))
    paced = tm.paced_share(e, "block", "band", hash01(F.col("event_id"), F.col("x"), 3)).withColumn("lo", F.lit(1219)).withColumn("hi", F.lit(2019))
    return tm.event_rows(paced, "event_id", "lo", "hi", F.col("share")).select("event_id", F.round("share", 9).alias("share"), F.col("switch").cast("long").alias("switch"))


@query("""
WITH d AS (SELECT o_orderkey, (year(o_orderdate) - 3 * (o_orderkey % 1000)) AS y0, month(o_orderdate) AS m, least(day(o_orderdate), 28) AS d FROM orders),
e AS (SELECT *, CASE WHEN y0 = 0 THEN 1 ELSE y0 END AS y FROM d),
f AS (SELECT o_orderkey, ((CASE WHEN y > 0 THEN y - 1 ELSE y END) * 365 + list_extract([0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334], m) + d - 1)::BIGINT AS day, y, m, d FROM e)
SELECT o_orderkey, day, y::BIGINT AS year, m::INT AS month, (d = 1) AS first_of_month, greatest(y, 1219)::BIGINT AS shown, y < 1219 AS no_data,
  d::VARCHAR || ' ' || list_extract(['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'], m)
  || ' ' || CASE WHEN y > 0 THEN y::VARCHAR ELSE (-y)::VARCHAR || ' BC' END AS text
FROM f
""")
def calendar_365(spark, sf):
    """Dates moved up to 3,000 years back, to day counts and back."""
    y = F.year("o_orderdate") - 3 * (F.col("o_orderkey") % 1000)
    o = _orders(spark, sf).select("o_orderkey", F.when(y == 0, 1).otherwise(y).alias("y"), F.month("o_orderdate").alias("m"), F.least(F.dayofmonth("o_orderdate"), F.lit(28)).alias("d"))
    o = o.select("o_orderkey", day_of_date(F.col("y"), F.col("m"), F.col("d")).alias("day"))
    year = year_of_day(F.col("day")).cast("long")
    return o.select(
        "o_orderkey", "day", year.alias("year"), month_of_day(F.col("day")).alias("month"), is_first_of_month(F.col("day")).alias("first_of_month"),
        map_year(F.col("day")).cast("long").alias("shown"), era_of(year)["no_data"].alias("no_data"), format_day(F.col("day")).alias("text"),
    )


@query("""
WITH r AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 1800 AS e FROM events),
m AS (SELECT *, CASE WHEN s > max(e) OVER w + 3600 OR max(e) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM r
  WINDOW w AS (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM i GROUP BY user_id, island
""")
def range_merge(spark, sf):
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    e = table(spark, sf, "events").select("user_id", t.alias("s"), (t + 1800).alias("e"))
    return tm.merge_ranges(e, "user_id", "s", "e", 3600)


@query("""
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view')
SELECT p.event_id, p.user_id, max(v.event_id) FILTER (v.ts = m.t) AS last_view FROM p
LEFT JOIN (SELECT p.event_id, max(v.ts) AS t FROM p JOIN v ON v.user_id = p.user_id AND v.ts <= p.ts GROUP BY 1) m ON m.event_id = p.event_id
LEFT JOIN v ON v.user_id = p.user_id AND v.ts = m.t GROUP BY 1, 2
""")
def beyond_asof_join(spark, sf):
    """Each purchase with the user's last view before it. Beyond the surveyed operators."""
    e = table(spark, sf, "events")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("vts"), F.col("event_id").alias("last_view"))
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return tm.asof_join(bought, views.withColumn("tie", F.col("last_view")), "user_id", "ts", "vts", "last_view", "tie").select("event_id", "user_id", "last_view")


@query(f"""
WITH o AS (SELECT o_custkey, o_orderstatus, year(o_orderdate) AS y, o_orderkey FROM orders),
s AS (SELECT o_custkey, arg_max(o_orderstatus, row(y, o_orderkey)) AS st FROM o WHERE y <= 1998 GROUP BY 1)
SELECT o_custkey, CASE WHEN o_custkey % 7 = 0 AND 1998 < 1990 + o_custkey % 20 THEN 'held' WHEN o_custkey % 7 = 1 AND 1998 >= 1990 + o_custkey % 20 THEN 'set' ELSE st END AS o_orderstatus FROM s
""")
def override_snapshot(spark, sf):
    o = _orders(spark, sf).withColumn("y", F.year("o_orderdate"))
    state = tm.snapshot(o, "o_custkey", "y", "o_orderstatus", 1998, "o_orderkey")
    k = F.col("c_custkey")
    over = table(spark, sf, "customer").where(k % 7 <= 1).select(
        k.alias("o_custkey"), (1990 + k % 20).alias("switch"), F.when(k % 7 == 0, "before").otherwise("after").alias("hold"),
        F.when(k % 7 == 0, "held").otherwise("set").alias("o_orderstatus"),
    )
    return tm.overridden(state, over, "o_custkey", "o_orderstatus", 1998)
