"""Further surveyed computations: pieces, reports, shores, changes and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import grid as gd
from ..operators import temporal as tm
from .registry import query, table
from .spatial import CLASS_SQL, FOUR_SQL, GRID_SQL, TRACK_SQL, WIDE, _classes, _grid, _tracks


@query("SELECT page_id, len(regexp_extract_all(html, 'https?://[^\\s\"''<>]+'))::INT AS addresses, contains(lower(html), '</script') AS breaks FROM pages")
def network_uses(spark, sf):
    """Network addresses and early script ends in built pages."""
    hits = F.regexp_extract_all("html", F.lit(r"https?://[^\s\"'<>]+"), F.lit(0))
    return table(spark, sf, "pages").select("page_id", F.size(hits).alias("addresses"), F.contains(F.lower("html"), F.lit("</script")).alias("breaks"))


@query(f"""
WITH t AS (SELECT user_id, x, y, n - 1 AS i FROM ({TRACK_SQL})), p AS (SELECT user_id, (i // 47)::BIGINT AS piece, x, y FROM t UNION ALL SELECT user_id, (i // 47 - 1)::BIGINT, x, y FROM t WHERE i % 47 = 0 AND i > 0)
SELECT user_id, piece, count(*) AS points, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM p GROUP BY ALL HAVING count(*) > 1
""")
def line_pieces(spark, sf):
    """Lines cut into pieces of at most 48 points that share their ends, with the box of each."""
    t = _tracks(spark, sf).select("user_id", F.posexplode("line").alias("i", "p"))
    piece = F.floor(F.col("i") / 47)
    twice = F.when((F.col("i") % 47 == 0) & (F.col("i") > 0), F.array(piece, piece - 1)).otherwise(F.array(piece))
    boxes = t.select("user_id", F.explode(twice).alias("piece"), "p.x", "p.y").groupBy("user_id", "piece")
    return boxes.agg(F.count(F.lit(1)).alias("points"), F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax")).where("points > 1")


@query(f"""
WITH g AS ({GRID_SQL}), o AS (SELECT i, j FROM range(-3, 4) a(i), range(-3, 4) b(j) WHERE i * i + j * j <= 9), p AS (SELECT r * {WIDE} + c AS id, r, c FROM g)
SELECT id, round(avg(q), 6) AS mean, count(q) AS n FROM p, o JOIN g ON g.r = p.r + i AND g.c = p.c + j GROUP BY 1
""")
def disc_mean(spark, sf):
    g = _grid(spark, sf)
    p = g.select((F.col("r") * WIDE + F.col("c")).alias("id"), "r", "c")
    return gd.disc_mean(g, p, "id", "q", 3.0, "mean").select("id", F.round("mean", 6).alias("mean"), "n")


@query(f"""
WITH g AS (SELECT *, {CLASS_SQL} AS cls FROM ({GRID_SQL})) SELECT a.c % 6 = 0 AS seam, count(*) AS n, round(avg((a.cls <> b.cls)::INT), 9) AS rate FROM g a JOIN g b ON a.r = b.r AND a.c = b.c + 1 GROUP BY 1
""")
def seam_test(spark, sf):
    return gd.seam_rates(_classes(spark, sf), "cls", 6).withColumn("rate", F.round("rate", 9))


@query(f"""
WITH g AS (SELECT *, r * {WIDE} + c AS id, {CLASS_SQL} AS cls FROM ({GRID_SQL})), {FOUR_SQL} SELECT r, c FROM g WHERE id NOT IN (SELECT a FROM n WHERE acls = bcls)
""")
def speckle_test(spark, sf):
    return gd.lone_cells(_classes(spark, sf), "cls").select("r", "c")


@query("""
WITH h AS (SELECT l_suppkey % 10 AS g, l_quantity::INT AS code, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY g) AS t, sum(n) OVER (PARTITION BY g ORDER BY code RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS s FROM h)
SELECT g, round(max(n / t), 9) AS worst_step, round(max(s / t), 9) AS worst_span FROM r GROUP BY 1
""")
def jump_report(spark, sf):
    l = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("g"), F.col("l_quantity").cast("int").alias("code"))
    return gd.jump_report(l, ["g"], "code", 5).select("g", F.round("worst_step", 9).alias("worst_step"), F.round("worst_span", 9).alias("worst_span"))


@query(f"""
WITH a AS ({GRID_SQL}), b AS (SELECT r, c, q + CASE WHEN (r + c) % 4 = 0 THEN r ELSE 0 END AS q FROM a WHERE q % 5 <> 1)
SELECT count(*) AS n, round(avg(a.q - b.q), 9) AS mean, max(abs(a.q - b.q))::BIGINT AS worst, round(avg((a.q <> b.q)::INT), 9) AS changed FROM a JOIN b USING (r, c)
""")
def compare_grids(spark, sf):
    a = _grid(spark, sf)
    b = a.where("q % 5 <> 1").withColumn("q", F.col("q") + F.when((F.col("r") + F.col("c")) % 4 == 0, F.col("r")).otherwise(0))
    d = gd.compare(a, b, ["r", "c"], "q")
    return d.select("n", F.round("mean", 9).alias("mean"), F.col("worst").cast("long").alias("worst"), F.round("changed", 9).alias("changed"))


@query("""
WITH a AS (SELECT o_custkey, arg_max(o_orderstatus, row(o_orderdate, o_orderkey)) AS s FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01' GROUP BY 1),
b AS (SELECT o_custkey, arg_max(o_orderstatus, row(o_orderdate, o_orderkey)) AS s FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT o_custkey, a.s AS old, b.s AS new FROM a FULL JOIN b USING (o_custkey) WHERE a.s IS DISTINCT FROM b.s
""")
def change_plane(spark, sf):
    o = table(spark, sf, "orders")
    snap = lambda t: tm.snapshot(o, "o_custkey", "o_orderdate", "o_orderstatus", F.lit(t).cast("timestamp_ntz"), "o_orderkey")
    return tm.change_plane(snap("1997-01-01"), snap("1998-01-01"), ["o_custkey"], "o_orderstatus")


@query(f"""
WITH g AS (SELECT *, floor(avg(q) OVER ()) + 0.5 AS v FROM ({GRID_SQL})),
k AS (SELECT a.r, a.c, a.v, [a.q, b.q, e.q, d.q] AS q, [a.q > a.v, b.q > a.v, e.q > a.v, d.q > a.v] AS up FROM g a JOIN g b ON b.r = a.r AND b.c = a.c + 1 JOIN g d ON d.r = a.r + 1 AND d.c = a.c JOIN g e ON e.r = a.r + 1 AND e.c = a.c + 1),
s AS (SELECT k.r, k.c, i, (v - q[i]) / (q[i % 4 + 1] - q[i]) AS t, up[1] = up[3] AND up[2] = up[4] AS saddle FROM k, range(1, 5) o(i) WHERE up[i] <> up[i % 4 + 1]),
x AS (SELECT r, c, saddle, CASE i WHEN 1 THEN c + t WHEN 2 THEN c + 1 WHEN 3 THEN c + 1 - t ELSE c END AS x, CASE i WHEN 1 THEN r WHEN 2 THEN r + t WHEN 3 THEN r + 1 ELSE r + 1 - t END AS y FROM s)
SELECT r, c, count(*) // 2 AS segments, round(sum(x), 6) AS sum_x, round(sum(y), 6) AS sum_y FROM x GROUP BY ALL
""")
def shore_squares(spark, sf):
    """Squares that the shore at the mean level runs through, with its segments and the sums of their ends."""
    g = _grid(spark, sf)
    s = gd.shore(g, "q", float(g.agg(F.floor(F.avg("q"))).first()[0]) + 0.5)
    ends = lambda k: F.round(F.sum(F.col(f"{k}0") + F.col(f"{k}1")), 6).alias(f"sum_{k}")
    return s.groupBy("r", "c").agg(F.count(F.lit(1)).alias("segments"), ends("x"), ends("y"))


@query(f"""
WITH RECURSIVE g AS MATERIALIZED (SELECT r, c, q, r * {WIDE} + c AS id, 0 AS cls FROM ({GRID_SQL}) WHERE q % 5 <> 0), {FOUR_SQL}, t(id, d) USING KEY (id) AS (SELECT id, 0 FROM g WHERE c = 0
  UNION SELECT n.b, min(t.d) + 1 FROM t JOIN n ON n.a = t.id LEFT JOIN recurring.t o ON o.id = n.b WHERE o.id IS NULL GROUP BY n.b)
SELECT id, d::INT AS hops FROM t
""")
def shortest_hops(spark, sf):
    """Least steps over open cells from the first column."""
    g = _grid(spark, sf).where("q % 5 <> 0").select("r", "c", (F.col("r") * WIDE + F.col("c")).alias("id"))
    return gd.distance_field(g, F.col("c") == 0, 1.0, None, "hops").where("hops is not null").select("id", F.col("hops").cast("int").alias("hops"))


@query("""
WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT l_suppkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem), f AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
t(id, hops) USING KEY (id) AS (SELECT min(a), 0 FROM e UNION SELECT f.b, min(t.hops) + 1 FROM t JOIN f ON f.a = t.id LEFT JOIN recurring.t o ON o.id = f.b WHERE o.id IS NULL GROUP BY f.b)
SELECT t.id, t.hops::INT AS hops, (SELECT min(f.b) FROM f JOIN t u ON u.id = f.b WHERE f.a = t.id AND u.hops = t.hops - 1) AS via FROM t
""")
def trade_hops(spark, sf):
    """Suppliers and parts by how many sales they are away from the first supplier, and the way back."""
    e = table(spark, sf, "lineitem").select((F.col("l_suppkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")).distinct()
    nodes = e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id"))).distinct()
    return gr.shortest_hops(nodes, e, "id", e.agg(F.min("a").alias("id")))


def _absorb_sql(rounds: int) -> str:
    """Rounds over tables g0, g1, ...: components of one value, their sizes, small ones flipped."""
    out = [f"g0 AS MATERIALIZED (SELECT r, c, r * {WIDE} + c AS id, q % 2 = 0 AS v FROM ({GRID_SQL}))",
           f"n AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM g0 a, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dr, dc) JOIN g0 b ON b.r = a.r + dr AND b.c = a.c + dc)"]
    for k in range(rounds):
        out += [
            f"e{k} AS MATERIALIZED (SELECT a, b FROM n JOIN g{k} x ON x.id = a JOIN g{k} y ON y.id = b WHERE x.v = y.v)",
            f"t{k}(id, root) USING KEY (id) AS (SELECT id, id FROM g{k} UNION SELECT e.b, min(t.root) FROM t{k} t JOIN e{k} e ON e.a = t.id JOIN recurring.t{k} o ON o.id = e.b GROUP BY e.b, o.root HAVING min(t.root) < o.root)",
            f"s{k} AS MATERIALIZED (SELECT root FROM t{k} GROUP BY root HAVING count(*) < 4)",
            f"g{k + 1} AS MATERIALIZED (SELECT r, c, g.id, v <> (t.root IN (FROM s{k})) AS v FROM g{k} g JOIN t{k} t ON t.id = g.id)",
        ]
    return f"WITH RECURSIVE {', '.join(out)} SELECT r, c, v AS chosen FROM g{rounds}"


@query(_absorb_sql(4))
def absorbed_patches(spark, sf):
    """A yes/no grid without patches of under four cells, after four rounds at most."""
    g = _grid(spark, sf).select("r", "c", (F.col("r") * WIDE + F.col("c")).alias("id"), (F.col("q") % 2 == 0).alias("chosen"))
    return gr.absorb_small(g, "id", "chosen", 4, lambda x: gd.patches(x, "id", "chosen", "_part", size="_size")).select("r", "c", "chosen")


@query("""
WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 1800 AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
w(user_id, n, k, s, e) AS (SELECT user_id, n, 1, s, e FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, CASE WHEN e.s - w.e <= 3600 AND greatest(e.e, w.e) - w.s <= 10800 THEN k ELSE k + 1 END,
  CASE WHEN e.s - w.e <= 3600 AND greatest(e.e, w.e) - w.s <= 10800 THEN w.s ELSE e.s END, CASE WHEN e.s - w.e <= 3600 AND greatest(e.e, w.e) - w.s <= 10800 THEN greatest(e.e, w.e) ELSE e.e END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM w GROUP BY user_id, k
""")
def capped_ranges(spark, sf):
    """Half-hour ranges of events merged up to a cap of three hours."""
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    e = table(spark, sf, "events").select("user_id", t.alias("s"), (t + 1800).alias("e"))
    return tm.capped_ranges(e, "user_id", "s", "e", 3600, 3 * 3600)


@query("""
WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT, event_id) AS n FROM events),
w(user_id, n, last, fired) AS (SELECT user_id, n, t, event_id FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, CASE WHEN e.t - last >= 7200 THEN e.t ELSE last END, CASE WHEN e.t - last >= 7200 THEN event_id END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, fired AS event_id, last AS t FROM w WHERE fired IS NOT NULL
""")
def debounced_events(spark, sf):
    """Events of a user at least two hours after the last one that counted."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    return tm.debounced(e, "user_id", "t", 7200, "event_id")


@query("""
WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, least(floor(value)::BIGINT, 120) AS d FROM events),
w(user_id, n, event_id, steps, carry) AS (SELECT user_id, 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT user_id FROM events) UNION ALL
  SELECT e.user_id, e.n, e.event_id, least((carry + d) // 16, 5), (carry + d) % 16 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, event_id, steps, carry::DOUBLE AS carry FROM w WHERE n > 0
""")
def fixed_steps(spark, sf):
    """Steps of a fixed length that each frame makes, the rest carried on, long frames cut."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.floor("value").cast("double").alias("d"))
    return tm.fixed_steps(e, "user_id", "event_id", "d", 16.0, 5, 120.0)


_LINE = f"t AS MATERIALIZED (SELECT user_id, n::BIGINT AS n, x, y FROM ({TRACK_SQL}))"


@query(f"""
WITH RECURSIVE {_LINE}, m AS (SELECT user_id, count(*) AS points FROM t GROUP BY 1),
w(user_id, a, b) AS (SELECT user_id, 1::BIGINT, points FROM m WHERE points > 2 UNION ALL SELECT user_id, unnest([a, k]), unnest([k, b]) FROM (
  SELECT w.user_id, w.a, w.b, arg_max(t.n, row(d, -t.n)) AS k, max(d) AS d FROM w JOIN t p ON p.user_id = w.user_id AND p.n = w.a JOIN t q ON q.user_id = w.user_id AND q.n = w.b JOIN t ON t.user_id = w.user_id AND t.n > w.a AND t.n < w.b,
  LATERAL (SELECT (q.x - p.x) ** 2 + (q.y - p.y) ** 2 AS l), LATERAL (SELECT CASE WHEN l > 0 THEN greatest(0, least(1, ((t.x - p.x) * (q.x - p.x) + (t.y - p.y) * (q.y - p.y)) / l)) ELSE 0 END AS u),
  LATERAL (SELECT sqrt((t.x - p.x - u * (q.x - p.x)) ** 2 + (t.y - p.y - u * (q.y - p.y)) ** 2) AS d) GROUP BY ALL) WHERE d > 40),
k AS (SELECT user_id, a AS n FROM w UNION SELECT user_id, b FROM w UNION SELECT user_id, 1 FROM m UNION SELECT user_id, points FROM m)
SELECT user_id, points::INT AS points, (SELECT count(*) FROM k WHERE k.user_id = m.user_id)::INT AS "left" FROM m
""")
def simplified_tracks(spark, sf):
    """Tracks without points that stray little."""
    from ..functions.kernels import simplified

    return _tracks(spark, sf).select("user_id", F.size("line").alias("points"), F.size(simplified(F.col("line"), 40.0)).alias("left"))
