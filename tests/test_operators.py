import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import calendar as cal
from tessera.functions import names as nm
from tessera.functions.hashing import hash01
from tessera.functions.projections import laea, laea_inverse, transverse_mercator
from tessera.operators import graph, temporal
from tessera.operators.aggregates import largest_remainder
from tessera.operators.grid import residual, restored
from tessera.operators.integrity import table_hash
from tessera.operators.spatial import length_inside


def slow_hash(x, y, seed):
    m = 0xFFFFFFFF
    h = (x * 0x27D4EB2D ^ y * 0x165667B1 ^ seed * 0x9E3779B1) & m
    h = (h ^ h >> 15) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return (h ^ h >> 16) / 2**32


def test_hash_equals_plain_integers(spark):
    rng = random.Random(0)
    rows = [(rng.randrange(-(2**31), 2**31), rng.randrange(-(2**31), 2**31)) for _ in range(300)] + [(0, 0), (-1, 2**31 - 1)]
    df = spark.createDataFrame(rows, "x long, y long").withColumn("h", hash01(F.col("x"), F.col("y"), 12345))
    assert all(r.h == slow_hash(r.x, r.y, 12345) for r in df.collect())


def test_delta_applied_to_a_snapshot_is_the_later_snapshot(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumn("o_orderstatus", F.concat("o_orderstatus", (F.col("o_orderkey") % 2).cast("string")))
    at = [F.lit(t).cast("timestamp_ntz") for t in ("1996-01-01", "1998-06-01")]
    snap = [temporal.snapshot(o, "o_custkey", "o_orderdate", "o_orderstatus", t, "o_orderkey") for t in at]
    change = temporal.delta(o, "o_custkey", "o_orderdate", "o_orderstatus", *at, "o_orderkey")
    got = temporal.apply_delta(snap[0], change, "o_custkey", "o_orderstatus")
    assert sorted(got.collect()) == sorted(snap[1].collect()) and change.count() > 10
    again = temporal.snapshot(o.repartition(13), "o_custkey", "o_orderdate", "o_orderstatus", at[1], "o_orderkey")
    assert sorted(again.collect()) == sorted(snap[1].collect())


def test_calendar_round_trip_and_bad_dates(spark):
    df = spark.range(-3000, 3000, 7).withColumn("d", cal.day_of_date(cal.year_of_day(F.col("id")), cal.month_of_day(F.col("id")), cal.day_in_month(F.col("id"))))
    assert df.where("id <> d").count() == 0
    texts = {r.id: r.t for r in spark.createDataFrame([(0,), (-1,), (364,), (365,)], "id long").select("id", cal.format_day(F.col("id")).alias("t")).collect()}
    assert texts == {0: "1 January 1", -1: "31 December 1 BC", 364: "31 December 1", 365: "1 January 2"}
    bad = spark.createDataFrame([(0, 1, 1), (5, 13, 1), (5, 2, 29), (5, 2, 0)], "y int, m int, d int")
    assert bad.select(cal.day_of_date(F.col("y"), F.col("m"), F.col("d"), strict=False).alias("x")).where("x is not null").count() == 0
    with pytest.raises(Exception):
        bad.select(cal.day_of_date(F.col("y"), F.col("m"), F.col("d"))).collect()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), min_size=1, max_size=5), min_size=1, max_size=6))
def test_largest_remainder_sums_to_the_whole(spark, groups):
    rows = [(g, p, n) for g, ns in enumerate(groups) for p, n in enumerate(ns)]
    got = largest_remainder(spark.createDataFrame(rows, "g int, p int, n long"), ["g"], "p", "n").collect()
    for g, ns in enumerate(groups):
        part = {r.p: r.percent for r in got if r.g == g}
        assert sum(part.values()) == (100 if sum(ns) else 0)
        assert all(abs(part[p] - 100 * n / max(1, sum(ns))) < 1 for p, n in enumerate(ns))


def test_residuals_restore_the_grid(spark):
    rng = random.Random(1)
    g = spark.createDataFrame([(r, c, rng.randrange(-9, 99)) for r in range(9) for c in range(7) if (r, c) not in ((2, 3), (4, 4), (5, 1))], "r int, c int, v int")
    for tile in (4, 256):
        assert sorted(restored(residual(g, "v", "d", tile).drop("v"), "d", "v", tile).collect()) == sorted((*x,) for x in g.collect())
    d = {(r.r, r.c): r.d for r in residual(spark.createDataFrame([(0, 0, 5), (0, 1, 9), (1, 0, 2), (1, 1, 1)], "r int, c int, v int"), "v", "d").collect()}
    assert d == {(0, 0): 5, (0, 1): 4, (1, 0): -3, (1, 1): 1 - 6}  # 9 + 2 - 5 lies between 2 and 9


def test_constrained_groups_never_mix(spark):
    rng = random.Random(2)
    items = [(i, rng.choice([None, "a", "b"]), rng.choice([None, None, "x", "y"])) for i in range(60)]
    links = [(rng.randrange(3), rng.randrange(60), rng.randrange(60)) for _ in range(90)]
    got = graph.constrained_groups(spark.createDataFrame(items, "id long, t string, u string"), spark.createDataFrame(links, "priority int, a long, b long"), "id", ("t", "u")).collect()
    assert sorted(r.id for r in got) == list(range(60))
    for k in (1, 2):
        for g in {r.grp for r in got}:
            assert len({items[r.id][k] for r in got if r.grp == g} - {None}) <= 1
    assert len({r.grp for r in got}) < 50


def test_names(spark):
    tags = spark.createDataFrame([({"name": "Pond reservoir", "name:be": "Сажалка", "alt_name": "x", "alt_name:en": "y", "start_date": "1950"},)], "t map<string,string>")
    r = tags.select(nm.keyword_hits(F.col("t")).alias("k"), nm.names_of(F.col("t")).alias("n"), nm.other_names_of(F.col("t")).alias("o")).first()
    assert r.k == ["reservoir", "пруд", "start_date"] and r.n == {"be": "Сажалка"} and set(r.o) == {"alt_name", "alt_name:en"}
    ids = spark.createDataFrame([("w12@3",), ("r5",), ("x1",)], "i string").select(nm.record_id(F.col("i")).alias("r")).collect()
    assert [x.r and tuple(x.r) for x in ids] == [("way", 12), ("relation", 5), None]
    assert spark.createDataFrame([("Ežėras Ž",)], "t string").select(nm.folded("t")).first()[0] == "ezeras z"
    assert spark.createDataFrame([("abcd", "abx"), ("", "a"), ("ab", "abc")], "a string, b string").select(nm.shared_prefix(F.col("a"), F.col("b")).alias("n")).collect() == [(2,), (0,), (2,)]
    assert nm.spell("Мар'янівка ЩО Єва", "uk") == "Marianivka SHCHO Yeva" and nm.spell("Ёлка объезд Жёлтое", "ru") == "Yëlka obyezd Zhëltoye"


def test_projections(spark):
    df = spark.createDataFrame([(5.0, 50.0), (10.0, 52.0), (30.0, 60.0)], "lon double, lat double")
    x, y = laea(F.col("lon"), F.col("lat"), 10, 52, 4321000, 3210000)
    rows = df.select("lon", "lat", x.alias("x"), y.alias("y"), *[c.alias(n) for c, n in zip(laea_inverse(x, y, 10, 52, 4321000, 3210000), "uv")]).collect()
    assert abs(rows[0].x - 3962799.45) < 0.01 and abs(rows[0].y - 2999718.85) < 0.01  # the published check point of EPSG:3035
    assert (rows[1].x, rows[1].y) == (4321000, 3210000)
    assert all(abs(r.u - r.lon) < 1e-8 and abs(r.v - r.lat) < 1e-8 for r in rows)
    e, n = transverse_mercator(F.lit(15.0), F.lit(0.0), 15, 0.9996, 500000, 0)
    assert df.select(e, n).first() == (500000.0, 0.0)


def test_length_inside_a_square_with_a_hole(spark):
    ring = lambda a, b: [{"x": a, "y": a}, {"x": b, "y": a}, {"x": b, "y": b}, {"x": a, "y": b}]
    polygons = spark.createDataFrame([("p", [ring(0.0, 10.0), ring(4.0, 6.0)])], "pid string, rings array<array<struct<x:double,y:double>>>")
    lines = spark.createDataFrame([(1, [{"x": -5.0, "y": 5.0}, {"x": 15.0, "y": 5.0}]), (2, [{"x": 1.0, "y": 1.0}, {"x": 1.0, "y": 2.0}, {"x": 1.0, "y": 12.0}]), (3, [{"x": 20.0, "y": 0.0}, {"x": 21.0, "y": 0.0}])], "lid int, line array<struct<x:double,y:double>>")
    got = {r.lid: r.length for r in length_inside(lines, polygons, 3.0, "lid", "pid").collect()}
    assert got[1] == pytest.approx(8.0) and got[2] == pytest.approx(9.0) and got.get(3, 0.0) == 0.0


def test_table_hash_ignores_order_and_sees_changes(spark):
    df = spark.range(50).withColumn("t", F.when(F.col("id") % 5 > 0, F.col("id").cast("string")))
    a, b, c = (table_hash(x, ["id", "t"]).first() for x in (df, df.repartition(7), df.where("id <> 3")))
    assert a == b and a != c


def test_asof_join_and_components_keep_to_spark(spark, sf):
    e = graph.connected_components(spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long"))
    assert sorted((r.node, r.component) for r in e.collect()) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]
