import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.kernels import clip_ring, clipped, inside, label_point, labelled_at, levels, simplified, simplify, simplify_ring, stitch
from tessera.operators.grid import shore
from tessera.operators.temporal import capped_ranges, debounced, fixed_steps

line = st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=2, max_size=40).map(lambda p: np.array(p, float))


def stray(p, a, b):
    v = b - a
    t = 0.0 if not v @ v else min(1.0, max(0.0, (p - a) @ v / (v @ v)))
    return np.hypot(*(p - a - t * v))


@settings(max_examples=60, deadline=None)
@given(line, st.floats(0.5, 30))
def test_simplified_lines_stay_within_the_tolerance(pts, tolerance):
    kept = simplify(pts, tolerance)
    assert kept[0] == 0 and kept[-1] == len(pts) - 1
    for a, b in zip(kept, kept[1:]):
        assert all(stray(pts[k], pts[a], pts[b]) <= tolerance + 1e-9 for k in range(a, b))
    lv = levels(pts, [40.0, 10.0, 1.0])
    assert lv[0] == lv[-1] == 0 and len(lv) == len(pts)


@settings(max_examples=60, deadline=None)
@given(line)
def test_clipped_rings_lie_in_the_box(pts):
    out = clip_ring(pts, 20.0, 30.0)
    assert not len(out) or ((out >= 0).all() and (out[:, 0] <= 20).all() and (out[:, 1] <= 30).all())
    whole = clip_ring(np.abs(pts) / 5, 20.0, 30.0)
    assert np.array_equal(whole, np.abs(pts) / 5)


def test_rings_labels_and_stitches():
    square = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)
    assert np.allclose(label_point([square]), [5, 5], atol=0.2)
    hole = np.array([[3, 3], [7, 3], [7, 7], [3, 7]], float)
    p = label_point([square, hole])
    assert inside(p[None], [square, hole])[0]
    assert label_point([np.array([[0, 0], [1, 1], [2, 2]], float)]) is None
    assert simplify_ring(np.array([[0, 0], [5, 0.1], [10, 0], [10, 10], [0, 10]], float), 1.0).tolist() == [0, 2, 3, 4]
    a, b, c, d = (np.array(x, float) for x in ([[0, 0], [5, 0]], [[9, 0], [5, 0]], [[0, 0], [-1, 0]], [[20, 0], [21, 0]]))
    got = stitch([a, b, c, d])
    assert [g[:, 0].tolist() for g in got] == [[-1, 0, 5, 9], [20, 21]]


def test_columns(spark):
    pt = lambda x, y: {"x": float(x), "y": float(y)}
    df = spark.createDataFrame([([pt(0, 0), pt(5, 0.1), pt(10, 0)],), (None,)], "l array<struct<x:double,y:double>>")
    rows = df.select(simplified(F.col("l"), 1.0).alias("s"), clipped(F.col("l"), 8.0, 9.0).alias("c")).collect()
    assert len(rows[0].s) == 2 and rows[1].s is None and all(p.x <= 8 for p in rows[0].c)
    sq = spark.createDataFrame([([[pt(0, 0), pt(10, 0), pt(10, 10), pt(0, 10)]],)], "r array<array<struct<x:double,y:double>>>")
    assert abs(sq.select(labelled_at(F.col("r")).alias("p")).first().p.x - 5) < 0.2


def test_shore_of_a_round_island(spark):
    g = spark.range(41 * 41).select(F.floor(F.col("id") / 41).alias("r"), (F.col("id") % 41).alias("c"))
    g = g.withColumn("v", 12.0 - F.hypot(F.col("r") - 20.0, F.col("c") - 20.0))
    s = shore(g, "v", 0.0).collect()
    length = sum(np.hypot(r.x1 - r.x0, r.y1 - r.y0) for r in s)
    assert abs(length - 2 * np.pi * 12) < 1.0
    ends = {}
    for r in s:
        for p in ((round(r.x0, 6), round(r.y0, 6)), (round(r.x1, 6), round(r.y1, 6))):
            ends[p] = ends.get(p, 0) + 1
    assert set(ends.values()) == {2}  # the shore is closed


def test_sequential_rules(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 12, 20), (1, 22, 30), (2, 0, 1)], "g int, s int, e int")
    assert sorted((r.g, r.s, r.e, r.n) for r in capped_ranges(df, "g", "s", "e", 5, 25).collect()) == [(1, 0, 20, 2), (1, 22, 30, 1), (2, 0, 1, 1)]
    ev = spark.createDataFrame([(1, t) for t in (0, 5, 10, 11, 25)], "g int, t int")
    assert sorted(r.t for r in debounced(ev, "g", "t", 10).collect()) == [0, 10, 25]


def test_streamed_groups_keep_their_state_apart(spark):
    rows = [(g, t, t * 10 + (g or 0)) for t in range(300) for g in (1, 2, None, 3)]
    ev = spark.createDataFrame(rows, "g long, t long, id long").repartition(7)
    got = sorted((r.g, r.t, r.id) for r in debounced(ev, "g", "t", 7, "id").collect())
    assert got == sorted((g, t, t * 10 + g) for g in (1, 2, 3) for t in range(0, 300, 7))
    frames = spark.createDataFrame([(1, 0, 10.0), (1, 1, 10.0), (1, 2, 500.0), (1, 3, -5.0), (2, 0, 16.0)], "g long, t long, ms double")
    assert sorted(tuple(r) for r in fixed_steps(frames, "g", "t", "ms", 16.0, 3, 100.0).collect()) == [(1, 0, 0, 10.0), (1, 1, 1, 4.0), (1, 2, 3, 8.0), (1, 3, 0, 8.0), (2, 0, 1, 0.0)]
    assert capped_ranges(spark.createDataFrame([], "g long, s long, e long"), "g", "s", "e", 5, 25).count() == 0


def test_long_lists_make_no_object_a_point(spark, monkeypatch):
    import pyarrow as pa

    from tessera.functions import codecs

    pt = lambda x, y: {"x": x, "y": y}
    rows = [(k, None if k % 7 == 3 else [pt(3 * i % (k + 2), i) for i in range(k % 5)]) for k in range(30)]
    df = spark.createDataFrame(rows, "k long, l array<struct<x:long,y:long>>").repartition(3)
    some = df.where("l is not null")
    one = some.select("l", codecs.packed_points(F.col("l")).alias("b")).withColumn("u", codecs.unpacked_points("b")).collect()
    two = some.select("l", codecs.packed_shapes(F.array("l", "l")).alias("b")).withColumn("u", codecs.unpacked_shapes("b")).collect()
    assert len(one) == len(two) == sum(l is not None for _, l in rows) and all(r.u == r.l for r in one) and all(r.u == [r.l, r.l] for r in two)
    # The batches are Arrow arrays, whose points stay numbers.
    for udf in (codecs.unpacked_uints, codecs.unpacked_points, codecs.unpacked_shapes):
        assert udf.func.__annotations__["data"] in (pa.Array, "pa.Array")
    doubles = df.select("k", F.transform("l", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("l"))
    slim = {r.k: r.s for r in doubles.select("k", simplified(F.col("l"), 0.5).alias("s")).collect()}
    for k, l in rows:
        want = None if l is None else [(l[i]["x"], l[i]["y"]) for i in simplify(np.array([(p["x"], p["y"]) for p in l], float).reshape(-1, 2), 0.5)]
        assert (slim[k] if slim[k] is None else [tuple(p) for p in slim[k]]) == want
