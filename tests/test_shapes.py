import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import grid as gd
from tessera.operators import scoring as sg
from tessera.operators import shapes as sh
from tessera.operators.joins import not_matched_once

RINGS = "array<array<struct<x:double,y:double>>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def box(x, y, w, h=None):
    h = w if h is None else h
    return ring((x - w, y - h), (x + w, y - h), (x + w, y + h), (x - w, y + h))


def inside(x, y, rings):
    n = 0
    for r in rings:
        for a, b in zip(r, r[1:] + r[:1]):
            n += (a["y"] > y) != (b["y"] > y) and x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]
    return n % 2 == 1


def test_effect_of_shapes(spark):
    rng = random.Random(2)
    star = lambda x, y: ring(*[(x + rng.uniform(1, 6) * math.cos(k / 9 * 2 * math.pi), y + rng.uniform(1, 6) * math.sin(k / 9 * 2 * math.pi)) for k in range(9)])
    shapes = [(k, [star(rng.uniform(-30, 30), rng.uniform(-30, 30))], k % 2 == 0) for k in range(40)]
    shapes += [(100, [box(0, 0, 8), box(0, 0, 3)], False), (101, [box(0, 0, 5)], None), (102, [box(500, 0, 2)], True), (103, [], False), (104, None, True), (105, [ring((1, 1))], False), (106, [ring((0, 0), (4, 0))], False)]
    land = [(k, [star(rng.uniform(-30, 30), rng.uniform(-30, 30))]) for k in range(25)] + [(90, [box(-20, 0, 1, 60), box(15, 0, 60, 2)]), (91, [box(0, 0, 1000), box(0, 0, 900)]), (92, None), (93, [])]
    s = spark.createDataFrame(shapes, f"id long, rings {RINGS}, sea boolean").withColumn("xmin", F.lit("clash"))
    l = spark.createDataFrame(land, f"lid long, rings {RINGS}")
    got = {r.id: (r.inside, r.changed) for r in sh.shape_effect(s, l, "id", "lid", F.col("sea"), 7.0, 0.3, 24).collect()}
    assert set(got) == {i for i, _, _ in shapes}
    ground = [r for _, rings in land for r in rings or []]
    for i, rings, sea in shapes:
        p = [q for r in rings or [] for q in r]
        n = changed = 0
        if p:
            x0, y0, x1, y1 = min(q["x"] for q in p), min(q["y"] for q in p), max(q["x"] for q in p), max(q["y"] for q in p)
            step = max(0.3, max(x1 - x0, y1 - y0) / 24)
            for a in range(math.floor((x1 - x0) / step) + 1):
                for b in range(math.floor((y1 - y0) / step) + 1):
                    x, y = x0 + a * step, y0 + b * step
                    if inside(x, y, rings):
                        n += 1
                        changed += inside(x, y, ground) != bool(sea)
        assert got[i] == (n, changed), i
    assert got[102][0] == got[102][1] > 0 and got[104] == got[106] == (0, 0)
    none = {r.id: (r.inside, r.changed) for r in sh.shape_effect(s, l.limit(0), "id", "lid", F.col("sea"), 7.0, 0.3, 24).collect()}
    assert none[100][0] == got[100][0] and none[100][1] == 0
    assert sh.shape_effect(s.limit(0), l, "id", "lid", F.col("sea"), 7.0).count() == 0


def test_waves_by_height(spark):
    shape = spark.createDataFrame([(1, [box(4, 2, 4, 2)]), (2, None), (3, [])], f"id long, rings {RINGS}")
    land = spark.createDataFrame([(r, c) for r in range(4) for c in range(8) if c != 5] + [(0, 0)], "r int, c int")
    heights = spark.createDataFrame([(r, c, [6.0, 4.0, 1.0, -1.0, -2.0, -9.0, -1.0, None][c]) for r in range(4) for c in range(8)], "r long, c long, h double")
    got = {(x.r, x.c): (x.wave, x.band) for x in sh.height_waves(shape, land, heights, "id", "rings", "h", 1.0, 1.0, (4, 8), 5.0, 0.0).collect()}
    assert got == {(r, c): v for r in range(4) for c, v in {1: (1, 6), 2: (1, 25), 3: (2, 12), 4: (2, 25), 6: (2, 12)}.items()}
    assert sh.height_waves(shape, land, heights.limit(0), "id", "rings", "h", 1.0, 1.0, (4, 8), 5.0, 0.0).count() == 0


def test_smoothed_scores_keep_their_spread(spark):
    rng = random.Random(4)
    cells = [(r, c, rng.choice([None, rng.uniform(0, 9), rng.uniform(0, 9)]), rng.choice([True, True, False, None])) for r in range(12) for c in range(14)]
    df = spark.createDataFrame(cells, "r long, c long, v double, m boolean")
    got = {(x.r, x.c): x.s for x in sg.smoothed_with_noise(df, "v", F.col("m"), 2, 0.0, 7, "s").collect()}
    raw = {(r, c): v for r, c, v, m in cells if m and v is not None}
    mean = lambda of: {p: np.mean([v for q, v in of.items() if max(abs(p[0] - q[0]), abs(p[1] - q[1])) <= 2]) for p in of}
    soft = mean(mean(raw))
    m, d, sm, sd = np.mean(list(raw.values())), np.std(list(raw.values())), np.mean(list(soft.values())), np.std(list(soft.values()))
    for r, c, v, inside_ in cells:
        assert got[r, c] == pytest.approx(m + (soft[r, c] - sm) * d / sd if (r, c) in soft else 0.0)
    flat = sg.smoothed_with_noise(df.withColumn("v", F.lit(3.0)), "v", F.col("m"), 2, 0.0, 7, "s").where("m")
    assert {round(x.s, 9) for x in flat.collect()} == {3.0}
    plain = {(x.r, x.c): x.s for x in sg.smoothed_with_noise(df, "v", F.col("m"), 0, 0.0, 7, "s").collect()}
    assert all(plain[p] == raw.get(p, 0.0) for p in plain)
    noisy = sg.smoothed_with_noise(df, "v", F.lit(True), 0, 0.5, 7, "s").where("v is null").select("s").distinct().count()
    assert noisy > 1
    assert sg.smoothed_with_noise(df.limit(0), "v", F.col("m"), 2, 0.1, 7, "s").count() == 0


def test_first_classes(spark):
    rows = [(50, 0, 0, 0, 9), (None, 20, 0, 0, 3), (0, 20, 0, 0, 4), (0, 30, 10, 0, 9), (0, 38, 2, 300, 9), (0, 38, 2, 299, 9), (0, 38, None, 900, 9), (0, None, 40, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "marsh int, bare int, moss int, height int, sea int")
    cls = sg.ground_class(*map(F.col, df.columns), sg.Ground(50, 20, 3, 40, 300, 10))
    assert [x.k for x in df.select(cls.alias("k")).collect()] == ["marsh", "heath", "open", "heath", "heath", "open", "open", "heath", "open"]


def test_missing_features_add_nothing(spark):
    names = "tree crop built height rough river_km sea_km wet pollen lat".split()
    rows = [(0, c, *([None] * 10 if c % 2 else [50.0, 20.0, 10.0, 125.0, 5.0, 5.0, 1.0, 20.0, 0.5, 57.0])) for c in range(6)]
    df = spark.createDataFrame(rows, "r long, c long, " + ", ".join(f"{n} double" for n in names))
    f = {x.c: x.s for x in sg.forest_scores(df, F.lit(True), F.lit(True), 0, 0, 0.0, 1, "s").collect()}
    assert f[0] == pytest.approx(3 * 0.5 - 1.5 * 0.2 - 0.2 + 0.4 * 0.5 + 0.4 * 0.2 + 0.6 * 0.5 + 0.1 + 0.5) and f[1] == pytest.approx(0.6)
    k = {x.c: x.s for x in sg.conifer_scores(df, F.lit(True), 250.0, 2.0, 10.0, 0, 0.0, 1, "s").collect()}
    assert k[0] == pytest.approx(0.5 * (2 / 3) * 0.5 + 0.16 + 0.15 + 0.5) and k[1] == 0.0


def test_faded_pull(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.5, 0.0), (3, 0.999999, 0.0), (4, 5.0, 5.0), (5, None, 0.0), (6, 2.0, 0.0)], "id long, x double, y double").withColumn("_v", F.lit("clash"))
    s = spark.createDataFrame([(1, 0.0, 0.0, 3.0), (2, 0.0, 0.0, 9.0), (3, 0.5, 0.5, 2.0), (4, None, 0.0, 99.0), (5, 0.5, 0.0, None), (6, -7.0, 0.0, 4.0)], "sid long, x double, y double, v double")
    got = {r.id: r.f for r in gd.faded_pull(p, s, "id", "sid", "v", 1.0, 1.0, "f").collect()}
    w = (0.75**2) / 0.25
    assert got[1] == 3.0 and got[4] == got[5] == got[6] == 1.0
    assert got[2] == pytest.approx(1 + (w * 2 + w * 8 + w * 1) / (3 * w) * 0.75**2)
    d = 0.499999**2 + 0.25
    assert got[3] == pytest.approx(1 + 1 * (1 - d) ** 2, abs=1e-4)
    assert gd.faded_pull(p, s.limit(0), "id", "sid", "v", 1.0, 1.0, "f").where("f <> 1").count() == 0


def test_hill_shade(spark):
    g = spark.createDataFrame([(0, 0, 10.0), (0, 1, -50.0), (0, 2, None), (1, 0, 30.0), (9, 9, 7.0)], "r long, c long, h double").withColumn("_own", F.lit(1)).drop("_own")
    got = {(r.r, r.c): r.s for r in gd.hill_shade(g, "h", 0.01, 0.25, "s").collect()}
    assert got == {(0, 0): pytest.approx(1 - 0.25), (0, 1): pytest.approx(0.9), (0, 2): 1.0, (1, 0): pytest.approx(0.8), (9, 9): 1.0}
    assert gd.hill_shade(g.limit(0), "h", 0.01, 0.25, "s").count() == 0


def test_matched_once(spark):
    left = spark.createDataFrame([(1,), (2,), (3,), (None,)], "a long")
    pairs = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (2, 8)], "a long, b long")
    assert sorted((r.a or 0, r.n) for r in not_matched_once(pairs, left, "a", "b").collect()) == [(0, 0), (2, 2), (3, 0)]
