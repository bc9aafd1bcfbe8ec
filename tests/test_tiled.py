"""Neighbourhoods by tiles: cells far apart need no rectangle between them, and nothing changes at the rim of a tile."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import grid as gd
from tessera.operators import raster as rs
from tessera.operators import reports as rp
from tessera.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def far_cells(spark, tmp_path_factory):
    """Lines on both sides of the rims of tiles, some of them millions of rows and columns away."""
    rng, rows = random.Random(3), []
    for r0, c0 in ((250, 250), (3_000_000, 2_900_000)):
        rows += [((c0 + rng.randrange(14)) * 20 + rng.randrange(20), r0 + rng.randrange(14), float(rng.randrange(1, 51))) for _ in range(150)]
    path = tmp_path_factory.mktemp("far")
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def rows_of(spark, path, name):
    df = QUERIES[name](spark, path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/lineitem.parquet/*.parquet'")
    rel = con.sql(ORACLES[name])
    return sorted(map(tuple, df.select(*rel.columns).collect())), sorted(rel.fetchall())


@pytest.mark.parametrize("name", ["grid_residual", "square_min", "masked_blur", "roughness3"])
def test_far_cells_equal_sql(spark, far_cells, name):
    got, want = rows_of(spark, far_cells, name)
    assert got == want and want


def plain(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_places_meet_cells_in_tiles(spark):
    rng = random.Random(4)
    cells = {(rng.randrange(240, 272), rng.randrange(240, 272)): rng.choice([None, *range(30)]) for _ in range(3000)}
    places = [(k, rng.randrange(236, 276), rng.randrange(236, 276)) for k in range(80)] + [(80, 250, 250), (81, 250, 250), (82, -500, 9)]
    g = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "r long, c long, v int")
    p = spark.createDataFrame(places, "id long, r long, c long")
    near = lambda r, c, d: {k: v for k, v in cells.items() if (k[0] - r) ** 2 + (k[1] - c) ** 2 <= d * d}
    mean = lambda vs: sum(vs) / len(vs) if vs else None
    known = lambda r, c, d: [v for v in near(r, c, d).values() if v is not None]

    found = gd.disc_mean(g, p, "id", "v", 3.0, "mean")
    assert {r.id: (r.mean, r.n) for r in found.collect()} == {k: (mean(known(r, c, 3)), len(known(r, c, 3))) for k, r, c in places if near(r, c, 3)}

    report = rp.place_report(g, p, "id", F.col("v") % 4 == 0, 4.0)
    want = {}
    for k, r, c in places:
        if n := near(r, c, 4):
            yes = [((y - r) ** 2 + (x - c) ** 2) ** 0.5 for (y, x), v in n.items() if v is not None and v % 4 == 0]
            want[k] = (len(n), mean([v % 4 == 0 for v in known(r, c, 4)]), min(yes, default=None))
    assert {r.id: (r.n, r.share, r.nearest) for r in report.collect()} == want

    block = lambda r, c: [cells.get((r + i, c + j)) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    means = {k: sum(block(*k)) / 9 for k in cells if None not in block(*k)}
    assert {(r.r, r.c): r.m for r in rs.block_means(g, "v", 3, "m").collect()} == means and means
    for sign, highest in ((-1, True), (1, False)):
        got = {r.id: (r.best, r.r, r.c) for r in rs.best_blocks(g, p, "id", "v", 5.0, 3, highest).collect()}
        best = {k: min(((sign * m, *at) for at, m in means.items() if (at[0] - r) ** 2 + (at[1] - c) ** 2 <= 25), default=None) for k, r, c in places}
        assert got == {k: (sign * b[0], b[1], b[2]) for k, b in best.items() if b}
    # No cell or place is multiplied by the places around it: both meet in the tiles.
    for df in (found, report, rs.block_means(g, "v", 3, "m"), rs.best_blocks(g, p, "id", "v", 5.0, 3)):
        assert "FlatMapGroupsInPandas" in plain(df)
