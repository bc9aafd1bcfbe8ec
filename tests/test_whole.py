"""Queries that once read a part of their tables read all of them."""

import heapq

import pytest

import __spark_entry__
from tessera.plans import ORACLES, QUERIES
from tessera.plans.spatial import BLOCK


def test_no_grid_query_leaves_lines_out():
    assert not [n for n, sql in ORACLES.items() if "l_orderkey %" in sql or "q % 9" in sql]
    assert not [n for n in QUERIES if n.endswith("_all") and not n.startswith("beyond_")]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_all_lines_are_summed_on_a_grid_that_grows(spark, size):
    d = f"/root/testdata/{size}"
    l = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("cast(sum(l_quantity) as long) s", f"count(distinct struct(l_suppkey, l_partkey div {BLOCK})) n").first()
    got = QUERIES["grid_hash"](spark, d).selectExpr("cast(sum(q) as long) s", "count(*) n").first()
    assert got == l and got.n >= {"sf0.001": 90, "sf0.01": 9000, "sf0.1": 100_000}[size]


def test_distance_field_has_no_bound(spark, tmp_path):
    # One source in a corner, and two cells missing.
    rows = [(r * 24 + c, r, c, 11.0 if r == c == 0 else 1.0) for r in range(20) for c in range(24) if (r, c) not in ((0, 1), (5, 5))]
    lines = [(k, r, c * BLOCK, q) for k, r, c, q in rows]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    cells, best, heap = {(r, c) for _, r, c, _ in rows}, {}, [(0, (0, 0))]
    while heap:
        d, at = heapq.heappop(heap)
        if at in best:
            continue
        best[at] = d
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                to = (at[0] + dr, at[1] + dc)
                if to in cells and to not in best:
                    heapq.heappush(heap, (d + (4 if dr and dc else 3), to))
    got = {(r.r, r.c): r.dist for r in __spark_entry__.queries()["distance_field"](spark, str(tmp_path)).collect()}
    assert got == {k: pytest.approx(d / 3, abs=1e-6) for k, d in best.items()} and max(best.values()) > 60


def test_constrained_groups_take_every_part(spark):
    d = "/root/testdata/sf0.01"
    assert QUERIES["constrained_groups"](spark, d).count() == spark.read.parquet(f"{d}/part.parquet").count() > 400


def test_names_after_character_200(spark, tmp_path):
    spark.createDataFrame([(1, "a" * 300 + " / Tail 1900")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    r = QUERIES["name_split"](spark, str(tmp_path)).first()
    assert r.parts == ["a" * 300, "Tail 1900"] and r.two and r.year == 1900
