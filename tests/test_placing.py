import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import alloc, placing, tiles
from tessera.operators.grid import patch_edges


def test_greedy_equals_the_order(spark):
    rng = random.Random(1)
    beats = {(a, b) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(500)) if a < b} | {(k, k + 1) for k in range(200, 230)}
    kept = []
    for i in range(300):
        if not any((k, i) in beats for k in kept):
            kept.append(i)
    df = spark.createDataFrame([(a, b) for a, b in beats] + [next(iter(beats))], "a long, b long")
    got = {r.id: r.kept for r in placing.greedy_kept(spark.range(300), df, "id").collect()}
    assert got == {i: i in kept for i in range(300)}
    assert placing.greedy_kept(spark.range(0), df.limit(0), "id").count() == 0
    with pytest.raises(ValueError):
        placing.greedy_kept(spark.range(3), spark.createDataFrame([(1, 2), (2, 1)], "a long, b long"), "id")


def test_nested_shapes(spark):
    box = lambda x, y, w: [[{"x": float(a), "y": float(b)} for a, b in ((x - w, y - w), (x + w, y - w), (x + w, y + w), (x - w, y + w))]]
    hole = lambda x, y, w, v: box(x, y, w) + box(x, y, v)
    rows = [
        (1, box(0, 0, 100), 40_000.0), (2, box(0, 0, 50), 10_000.0), (3, box(0, 0, 20), 1600.0),  # 3 lies in 2, which is dropped, and in 1, which is kept
        (4, box(120, 0, 30), 3600.0),  # across the rim of 1
        (5, hole(400, 0, 80, 40), 19_200.0), (6, box(400, 0, 30), 3600.0),  # in the hole of 5
        (7, box(800, 0, 10), 400.0), (8, box(800, 0, 10), 400.0),  # the same twice: the smaller id stays
        (9, [], 5.0), (10, None, 5.0), (11, [[{"x": 1.0, "y": 1.0}]], 1.0),
    ]
    df = spark.createDataFrame(rows, "id long, rings array<array<struct<x:double,y:double>>>, size double").withColumn("box", F.lit("clash"))
    got = {r.id: (r.kept, r.outer) for r in placing.without_nested(df, "id", "rings", "size", 50.0).collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (False, 1), 4: (True, None), 5: (True, None), 6: (True, None), 7: (True, None), 8: (False, 7), 9: (True, None), 10: (True, None), 11: (True, None)}


def slow_placed(labels, most):
    out, taken = [], []
    for i, _, discs in sorted(labels, key=lambda l: (l[1], l[0])):
        if all((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 >= (a[2] + b[2]) ** 2 for d in taken for a in discs for b in d):
            taken.append(discs)
            out.append(i)
    return out[:most]


@pytest.mark.parametrize("seed,crowd", [(1, 300), (2, 30)])
def test_labels_equal_the_order(spark, seed, crowd):
    rng, rows, want = random.Random(seed), [], {}
    for frame in range(5):
        labels = []
        for k in range(90):
            x, y, w, s = rng.uniform(0, crowd), rng.uniform(0, crowd), rng.uniform(1, 60), rng.choice([10.0, 14.0])
            n = max(1, math.ceil(w / (s * 0.9)))
            a = rng.choice([0.0, 0.5])
            discs = [(x + (-w / 2 + w * t / n) * math.cos(a), y + (-w / 2 + w * t / n) * math.sin(a), s * 0.62 + 2) for t in range(n + 1)]
            labels.append((k, rng.randrange(20), discs))
            rows.append((frame, k, labels[-1][1], x, y, a, w, s))
        want[frame] = sorted(slow_placed(labels, 12))
    df = spark.createDataFrame(rows, "frame long, id long, rank long, x double, y double, a double, w double, s double")
    df = df.withColumn("discs", placing.label_discs(*map(F.col, ("x", "y", "a", "w", "s"))))
    got = placing.placed(df, "frame", "id", [F.col("rank"), F.col("id")], "discs", 30.0, 12).groupBy("frame").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()
    assert {r.frame: r.ids for r in got} == want
    odd = df.limit(1).withColumn("discs", F.lit(None).cast("array<struct<x:double,y:double,r:double>>"))
    assert placing.placed(odd, "frame", "id", [F.col("id")], "discs", 30.0).count() == 0


def test_labels_keep_out_and_off_the_edge(spark):
    rows = [(1, 50.0, 50.0), (2, 5.0, 50.0), (3, -60.0, 50.0), (4, 200.0, 120.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double").withColumn("d", placing.label_discs(F.col("x"), F.col("y"), F.lit(0.0), F.lit(30.0), F.lit(10.0)))
    ok = {r.id for r in df.where(placing.clear_of(F.col("d"), [(190.0, 110.0, 260.0, 140.0)], (0.0, 0.0, 480.0, 360.0))).collect()}
    assert ok == {1, 3}


def cells_of(spark, n=48, side=16, seed=3):
    rng = np.random.default_rng(seed)
    smooth = np.cumsum(np.cumsum(rng.normal(size=(n, n)), 0), 1)
    smooth = (smooth - smooth.mean()) / smooth.std()
    ok = rng.random((n, n)) < 0.8
    ok[:side, :side] = False
    rows = [(r, c, r * 1000 + c, (r // side) * (n // side) + c // side, float(smooth[r, c] + 0.1 * rng.random()), bool(ok[r, c])) for r in range(n) for c in range(n)]
    df = spark.createDataFrame(rows, "r long, c long, id long, node int, score double, ok boolean")
    return df.withColumn("corners", tiles.blend_corners(F.col("r"), F.col("c"), side, n // side, n // side)), rng.uniform(0.1, 0.9, (n // side, n // side)), ok


def test_quota_meets_every_share_without_edges(spark):
    cells, target, ok = cells_of(spark)
    target[0, 0] = np.nan
    q = alloc.solve_quota(cells, "node", "corners", "score", F.col("ok"), F.lit(True), target)
    nodes = {r.node: r for r in q.nodes.collect()}
    got = {r.node: r.k for r in q.cells.groupBy("node").agg(F.count_if("chosen").alias("k")).collect()}
    assert q.worst <= 0.005 and q.rounds <= 60
    for g, r in nodes.items():
        able = int(ok[(g // 3) * 16 : (g // 3) * 16 + 16, (g % 3) * 16 : (g % 3) * 16 + 16].sum())
        t = np.nan_to_num(target).ravel()[g]
        assert (r.cells, r.eligible, r.want) == (256, able, min(able, math.floor(t * 256 + 0.5))) and abs(got[g] - r.want) <= 1 + 0.005 * 256
    assert got[0] == 0 and q.cells.where("chosen and not ok").count() == 0
    # One rule decides everywhere: a cell is chosen where its score beats the blend of the thresholds.
    t = [nodes[g].threshold for g in range(9)]
    for r in q.cells.where("ok").collect():
        assert r.chosen == (r.score > sum(k["w"] * t[k["node"]] for k in r.corners))


def test_tidied_quota_has_no_small_patches_and_meets_the_shares(spark):
    cells, target, _ = cells_of(spark, seed=8)
    first, final = alloc.tidy_quota(cells, "node", "corners", "score", F.col("ok"), F.lit(True), target, "id", 4, tolerance=0.02)
    assert first.worst <= 0.02 and final.worst <= 0.02

    def small(q):
        from tessera.operators.graph import labelled

        able = q.cells.where("ok").select("r", "c", "id", "chosen")
        return labelled(able, patch_edges(able, "id", "chosen"), "id").groupBy("component").count().where("count < 4").count()

    assert small(final) < small(first)


def test_quota_of_odd_cells(spark):
    df = spark.createDataFrame([(0, None, None), (0, 1.0, True), (1, 2.0, False)], "node int, score double, ok boolean").withColumn("corners", F.array(F.struct(F.col("node"), F.lit(1.0).alias("w"))))
    q = alloc.solve_quota(df, "node", "corners", "score", F.col("ok"), F.lit(True), np.array([[0.5, 0.5]]))
    assert [(r.node, r.cells, r.eligible, r.want) for r in q.nodes.orderBy("node").collect()] == [(0, 2, 1, 1), (1, 1, 0, 0)]
    assert q.cells.where("chosen").count() == 1
    assert alloc.solve_quota(df.limit(0), "node", "corners", "score", F.col("ok"), F.lit(True), np.array([[0.5, 0.5]])).cells.count() == 0
    with pytest.raises(ValueError):
        alloc.solve_quota(df, "node", "corners", "score", F.col("ok"), F.lit(True), np.zeros((400, 400)))


def test_filling_outwards():
    v = np.array([[1.0, 0, 0], [0, 0, 0]])
    out = alloc.filled_outwards(v, np.array([[True, False, False], [False, False, False]]))
    assert out.tolist() == [[1, 1, 1], [1, 1, 1]]
    assert alloc.filled_outwards(v, np.zeros((2, 3), bool)).tolist() == v.tolist()


def test_tiles_split_where_points_crowd(spark):
    rng = random.Random(2)
    pts = [(rng.uniform(0, 1), rng.uniform(0, 1)) for _ in range(200)] + [(0.3 + rng.uniform(0, 1e-3), 0.7) for _ in range(150)] + [(0.5, 0.5)] * 40 + [(None, 0.1), (float("nan"), 0.1), (1.0, 1.0), (5.0, -3.0)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pts)], "id long, x double, y double")
    got = {(r.level, r.i, r.j): (r.n, r.over) for r in tiles.adaptive_tiles(df, "x", "y", 0.0, 0.0, 1.0, 30, 6).collect()}
    real = [(min(max(x, 0), 1 - 1e-9), min(max(y, 0), 1 - 1e-9)) for x, y in pts if x is not None and x == x]
    want = {}

    def split(level, i, j, inside):
        if len(inside) <= 30 or level == 6:
            if inside:
                want[level, i, j] = (len(inside), len(inside) > 30)
            return
        for a in (0, 1):
            for b in (0, 1):
                n = 2 ** (level + 1)
                split(level + 1, 2 * i + a, 2 * j + b, [p for p in inside if int(p[0] * n) == 2 * i + a and int(p[1] * n) == 2 * j + b])

    split(0, 0, 0, real)
    assert got == want and sum(n for n, _ in got.values()) == len(real)
    near = {r.id: r.near for r in tiles.near_counts(df, "id", "x", "y", 0.05, 0.0, 0.0, 1.0, 30, 6).collect()}
    for k, (x, y) in enumerate(pts):
        if x is not None and x == x:
            assert near[k] == sum((x - a) ** 2 + (y - b) ** 2 <= 0.05 * 0.05 for a, b in pts if a is not None and a == a)
    ring = F.array(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((0.0, 0.0), (0.4, 0.0), (0.0, 0.4))]))
    few = tiles.tiles_touching(tiles.adaptive_tiles(df, "x", "y", 0.0, 0.0, 1.0, 30, 6), ring, 0.0, 0.0, 1.0)
    assert 0 < few.count() < len(got)
    assert tiles.adaptive_tiles(df.limit(0), "x", "y", 0.0, 0.0, 1.0, 30, 6).count() == 0
