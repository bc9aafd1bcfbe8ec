"""Scores and first classes over the whole grid of quantities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.hashing import cell_noise
from ..operators import scoring as sg
from ..operators.anchors import DIAGONAL, layered_distances
from ..operators.grid import Near, carried_blurs
from .dated import ROOT_SQL
from .registry import query
from .spatial import GRID_SQL, WIDE, _grid, _noise_sql, _size
from .temporal import hash_sql

#: Every cell of the rectangle as table g with its features; where nothing was sold there is no land.
LAND_SQL = f"""q AS ({GRID_SQL}), z AS (SELECT max(r) + 1 AS rows, max(c) + 1 AS cols FROM q),
g AS MATERIALIZED (SELECT n.r, n.c, n.r * {WIDE} + n.c AS id, q, q % 13 <> 1 AS land, q % 101 AS tree, q * 7 % 101 AS crop, q * 3 % 41 AS built, q % 300 AS height, q % 31 AS rough, q % 61 AS wet, q % 17 / 16.0 AS pollen
  FROM (SELECT r, c FROM z, LATERAL unnest(range(rows)) a(r), LATERAL unnest(range(cols)) b(c)) n LEFT JOIN q ON q.r = n.r AND q.c = n.c),
s AS (SELECT 0 AS k, id FROM g WHERE q % 11 = 0 UNION ALL SELECT 1, id FROM g WHERE NOT land OR land IS NULL), {ROOT_SQL}"""


def _noise(seed: int) -> str:
    return f"SELECT r, c, 0.65 * a.noise + 0.3 * b.noise + 0.05 * h - 0.5 AS noise FROM ({_noise_sql(12, seed)}) a JOIN ({_noise_sql(4, seed + 1)}) b USING (r, c) JOIN {hash_sql('c', 'r', seed + 2, 'h', table_='(SELECT r, c FROM g)')} e USING (r, c)"


def _smoothed(seed: int) -> str:
    """Table v(r, c, raw) of the masked cells -> r, c, score over g."""
    return f"""one AS MATERIALIZED (SELECT a.r, a.c, a.raw, avg(b.raw) AS x FROM v a JOIN v b ON abs(a.r - b.r) <= 3 AND abs(a.c - b.c) <= 3 GROUP BY ALL),
two AS MATERIALIZED (SELECT a.r, a.c, a.raw, avg(b.x) AS x FROM one a JOIN one b ON abs(a.r - b.r) <= 3 AND abs(a.c - b.c) <= 3 GROUP BY ALL),
m AS (SELECT avg(raw) AS m, stddev_pop(raw) AS d, avg(x) AS sm, stddev_pop(x) AS sd FROM two), f AS ({_noise(seed)})
SELECT r, c, round(CASE WHEN x IS NULL THEN 0 ELSE m + (x - sm) * d / sd + 0.25 * noise END, 6) AS score FROM g LEFT JOIN two USING (r, c) JOIN f USING (r, c), m"""


#: All distances count up to 10 cells at most.
REACH = 10
#: Side of the tiles in which the rectangle is filled.
TILE = 256


def _over_all(spark, sf, scored):
    """Scores of the rectangle, 0 where there is none: tiles with scores are filled one by one, the others' cells are made in place; only scores are shuffled."""
    rows, cols = _size(spark, sf)
    at = [F.floor(F.col(k) / TILE).alias(n) for k, n in (("r", "ti"), ("c", "tj"))]

    def filled(pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(pdf["ti"].iloc[0]) * TILE, int(pdf["tj"].iloc[0]) * TILE
        score = np.zeros((min(TILE, rows - top), min(TILE, cols - left)))
        score[pdf["r"].to_numpy() - top, pdf["c"].to_numpy() - left] = pdf["score"].to_numpy()
        r, c = np.indices(score.shape)
        return pd.DataFrame({"r": r.ravel() + top, "c": c.ravel() + left, "score": score.ravel()})

    scored = scored.select("r", "c", F.round("score", 6).alias("score"), *at)
    some = scored.groupBy("ti", "tj").applyInPandas(filled, "r long, c long, score double")
    wide = (cols - 1) // TILE + 1
    every = spark.range(((rows - 1) // TILE + 1) * wide).select(F.floor(F.col("id") / wide).alias("ti"), (F.col("id") % wide).alias("tj"))
    along = lambda k, n, most: F.explode(F.sequence(F.col(n) * TILE, F.least(F.lit(most), (F.col(n) + 1) * TILE) - 1)).alias(k)
    none = every.join(scored.select("ti", "tj").distinct(), ["ti", "tj"], "left_anti").select("tj", along("r", "ti", rows)).select("r", along("c", "tj", cols))
    return some.unionByName(none.withColumn("score", F.lit(0.0)))


def _land(spark, sf):
    """Cells that are land, with their quantity and their distances, exact up to REACH, from rivers and from what is no land, through all cells of the rectangle."""
    q = F.col("q")
    sources = {"river_km": q % 11 == 0, "sea_km": q % 13 == 1}
    far = layered_distances(_grid(spark, sf), sources, 1.0, DIAGONAL, near=Near(REACH, *_size(spark, sf), ["sea_km"]))
    return far.where(q % 13 != 1)


def _features(g):
    q = F.col("q")
    named = {"tree": q % 101, "crop": q * 7 % 101, "built": q * 3 % 41, "height": q % 300, "rough": q % 31, "wet": q % 61, "pollen": q % 17 / 16}
    return g.select("*", *[v.cast("double").alias(k) for k, v in named.items()])


def _scores(spark, sf, raw, smooth, noise, seed):
    """Scores over the rectangle from raw(r, c, raw), smoothed, with noise by cell."""
    soft = sg.smoothed(raw, "raw", smooth, "score")
    return _over_all(spark, sf, soft.withColumn("score", F.col("score") + noise * cell_noise(F.col("c"), F.col("r"), seed)))


@query(f"""
WITH RECURSIVE {LAND_SQL}, near AS (SELECT a.r, a.c, avg(b.tree) AS tree, avg(b.crop) AS crop FROM g a JOIN g b ON b.land AND abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 WHERE a.land GROUP BY ALL),
v AS MATERIALIZED (SELECT g.r, g.c, 3 * (g.tree + near.tree) / 200 - 1.5 * (g.crop + near.crop) / 200 - 2 * built / 100 + 0.4 * least(1, height / 250) + 0.4 * least(1, rough / 25) + 0.6 * least(1, coalesce(d, 1e9) / 10) + 0.5 * wet / 100 + pollen AS raw
  FROM g JOIN near USING (r, c) LEFT JOIN t ON t.k = 0 AND t.id = g.id WHERE land AND q % 7 <> 3), {_smoothed(1219)}
""")
def forest_scores(spark, sf):
    """How likely each eligible cell was forest."""
    g = carried_blurs(_features(_land(spark, sf)), {"near_tree": "tree", "near_crop": "crop"}, 2, ["q", "river_km", "sea_km"])
    g = _features(g.where(F.col("q") % 7 != 3)).select("r", "c", sg.forest_rule("near_tree", "near_crop").alias("raw"))
    return _scores(spark, sf, g, 3, 0.25, 1219)


@query(f"""
WITH RECURSIVE {LAND_SQL}, v AS MATERIALIZED (SELECT g.r, g.c, greatest(0, 1 - height / 120) * greatest(0, 1 - rough / 15) * greatest(greatest(0, 1 - coalesce(b.d, 1e9) / 4), least(1, coalesce(a.d, 1e9) / 5)) + 0.8 * wet / 100 + 0.3 * least(1, greatest(0, (50 + 0.1 * g.r - 54) / 6)) + pollen AS raw
  FROM g LEFT JOIN t a ON a.k = 0 AND a.id = g.id LEFT JOIN t b ON b.k = 1 AND b.id = g.id WHERE land AND q % 3 <> 0), {_smoothed(1220)}
""")
def conifer_scores(spark, sf):
    """How likely each forest cell was conifer."""
    g = _features(_land(spark, sf).where(F.col("q") % 3 != 0)).withColumn("lat", 50 + 0.1 * F.col("r"))
    return _scores(spark, sf, g.select("r", "c", sg.conifer_rule(120.0, 4.0, 5.0).alias("raw")), 3, 0.25, 1220)


LIMITS = sg.Ground(marsh=50, dune_bare=20, dune_sea=5, heath=40, heath_height=300, heath_moss=10)


@query(f"""
WITH g AS (SELECT r, c, q % 67 AS marsh, q % 31 AS bare, q % 23 AS moss, q % 400 AS height, c % 9 AS sea FROM ({GRID_SQL}))
SELECT r, c, CASE WHEN marsh >= 50 THEN 'marsh' WHEN bare >= 20 AND sea <= 5 THEN 'heath' WHEN bare + moss >= 40 AND (height >= 300 OR moss >= 10) THEN 'heath' ELSE 'open' END AS cls FROM g
""")
def ground_classes(spark, sf):
    q = F.col("q")
    cls = sg.ground_class(q % 67, q % 31, q % 23, q % 400, F.col("c") % 9, LIMITS)
    return _grid(spark, sf).select("r", "c", cls.alias("cls"))
