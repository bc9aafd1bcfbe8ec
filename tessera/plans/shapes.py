"""Drawn shapes against the map: a triangle a customer, a quadrangle of land a supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shapes as sh
from .registry import query, table
from .spatial import GRID_SQL, _grid, _size

SHAPES_SQL = """s AS (SELECT c_custkey, 3 + c_nationkey % 7 + c_acctbal / 2500 AS w, (c_custkey * 37 % 211)::DOUBLE AS x, (c_custkey * 91 % 173)::DOUBLE AS y FROM customer),
e AS MATERIALIZED (SELECT c_custkey, x + w * dx AS ax, y + w * dy AS ay, x + w * ex AS bx, y + w * ey AS yb FROM s, (VALUES (-1.0, -0.6, 1.3, -0.4), (1.3, -0.4, 0.2, 1.1), (0.2, 1.1, -1.0, -0.6)) o(dx, dy, ex, ey) WHERE w > 0)"""


def _shapes(spark, sf):
    w, x, y = 3 + F.col("c_nationkey") % 7 + F.col("c_acctbal") / 2500, (F.col("c_custkey") * 37 % 211).cast("double"), (F.col("c_custkey") * 91 % 173).cast("double")
    p = lambda dx, dy: F.struct((x + w * dx).alias("x"), (y + w * dy).alias("y"))
    return table(spark, sf, "customer").where(w > 0).select("c_custkey", F.array(F.array(p(-1.0, -0.6), p(1.3, -0.4), p(0.2, 1.1))).alias("rings"))


@query(f"""
WITH {SHAPES_SQL}, b AS (SELECT *, greatest(0.2, greatest(x1 - x0, y1 - y0) / 16) AS step FROM (SELECT c_custkey, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM e GROUP BY 1)),
n AS (SELECT c_custkey, x0 + i * step AS px, y0 + j * step AS py FROM b, LATERAL unnest(range(floor((x1 - x0) / step)::BIGINT + 1)) a(i), LATERAL unnest(range(floor((y1 - y0) / step)::BIGINT + 1)) d(j)),
i AS MATERIALIZED (SELECT n.c_custkey, px, py FROM n JOIN e USING (c_custkey) GROUP BY ALL HAVING sum(((ay > py) <> (yb > py) AND px < (bx - ax) * (py - ay) / nullif(yb - ay, 0) + ax)::INT) % 2 = 1),
f AS (SELECT (s_suppkey * 53 % 211)::DOUBLE AS x, (s_suppkey * 29 % 173)::DOUBLE AS y, 9 + s_nationkey % 11 + s_acctbal / 5000 AS w FROM supplier),
l AS MATERIALIZED (SELECT x + w * dx AS ax, y + w * dy AS ay, x + w * ex AS bx, y + w * ey AS yb FROM f, (VALUES (-1.0, -0.9, 1.1, -0.7), (1.1, -0.7, 0.8, 1.0), (0.8, 1.0, -0.9, 0.6), (-0.9, 0.6, -1.0, -0.9)) o(dx, dy, ex, ey) WHERE w > 0),
h AS (SELECT c_custkey, px, py, count(*) % 2 = 1 AS land FROM i JOIN l ON (ay > py) <> (yb > py) AND px < (bx - ax) * (py - ay) / nullif(yb - ay, 0) + ax GROUP BY ALL),
k AS (SELECT c_custkey, count(*) AS inside, sum(((c_custkey % 3 = 0) <> coalesce(land, FALSE))::INT) AS changed FROM i LEFT JOIN h USING (c_custkey, px, py) GROUP BY 1)
SELECT c_custkey, coalesce(inside, 0)::BIGINT AS inside, coalesce(changed, 0)::BIGINT AS changed FROM b LEFT JOIN k USING (c_custkey)
""")
def shape_effect(spark, sf):
    """How many sampled points of each customer's triangle lie on a supplier's land, or off it for every third."""
    w, x, y = 9 + F.col("s_nationkey") % 11 + F.col("s_acctbal") / 5000, (F.col("s_suppkey") * 53 % 211).cast("double"), (F.col("s_suppkey") * 29 % 173).cast("double")
    p = lambda dx, dy: F.struct((x + w * dx).alias("x"), (y + w * dy).alias("y"))
    land = table(spark, sf, "supplier").where(w > 0).select("s_suppkey", F.array(F.array(p(-1.0, -0.9), p(1.1, -0.7), p(0.8, 1.0), p(-0.9, 0.6))).alias("rings"))
    return sh.shape_effect(_shapes(spark, sf), land, "c_custkey", "s_suppkey", F.col("c_custkey") % 3 == 0, 20.0, 0.2, 16)


@query(f"""
WITH {SHAPES_SQL}, g AS MATERIALIZED ({GRID_SQL}), z AS (SELECT max(r) AS lr, max(c) AS lc FROM g),
n AS (SELECT c_custkey, r, c, least(lr, greatest(0, (r + 0.5) * 2.5 / 4 - 0.5)) AS fr, least(lc, greatest(0, (c + 0.5) * 2.5 / 4 - 0.5)) AS fc FROM e, (SELECT r, c FROM g WHERE q % 4 <> 1) k, z
  GROUP BY ALL HAVING sum(((ay > (r + 0.5) * 2.5) <> (yb > (r + 0.5) * 2.5) AND (c + 0.5) * 2.5 < (bx - ax) * ((r + 0.5) * 2.5 - ay) / nullif(yb - ay, 0) + ax)::INT) % 2 = 1),
w AS (SELECT n.*, (CASE i WHEN 1 THEN fr - floor(fr) ELSE 1 - fr + floor(fr) END) * (CASE j WHEN 1 THEN fc - floor(fc) ELSE 1 - fc + floor(fc) END) AS w, floor(fr)::BIGINT + i AS gr, floor(fc)::BIGINT + j AS gc FROM n, range(2) a(i), range(2) b(j)),
h AS (SELECT c_custkey, w.r, w.c, sum(w * (q % 16 - 7)) / sum(w) AS h FROM w JOIN g ON g.r = gr AND g.c = gc WHERE w > 0 GROUP BY ALL)
SELECT c_custkey, r, c, CASE WHEN h > 0 THEN 1 ELSE 2 END::INT AS wave, greatest(0, least(31, floor(CASE WHEN h > 0 THEN (5 - h) / 5 ELSE -h / 2.5 END * 31 + 0.5)))::INT AS band FROM h WHERE h <= 5
""")
def height_waves(spark, sf):
    """The cells of each customer's triangle that are land and low, in two waves by height."""
    g, q = _grid(spark, sf), F.col("q")
    heights = g.select("r", "c", (q % 16 - 7).cast("double").alias("h"))
    return sh.height_waves(_shapes(spark, sf), g.where(q % 4 != 1), heights, "c_custkey", "rings", "h", 2.5, 4.0, _size(spark, sf), 5.0, 0.0)
