"""Work that follows the cells, rows and nodes there are, with the results of the SQL."""

import random

import duckdb
import pytest

from tessera.plans import ORACLES, QUERIES


def both(spark, path, name, tables=("lineitem",)):
    df, con = QUERIES[name](spark, path), duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    rel = con.sql(ORACLES[name])
    order = lambda r: tuple((v is None, v) for v in r if v is not None)
    return sorted(map(tuple, df.select(*rel.columns).collect()), key=order), sorted(rel.fetchall(), key=order)


def lines(spark, path, corners, side=20, n=250, seed=5):
    """Sales on some squares of the grid, far from each other."""
    rng = random.Random(seed)
    rows = [((c + rng.randrange(side)) * 20 + rng.randrange(20), r + rng.randrange(side), float(rng.randrange(1, 51))) for r, c in corners for _ in range(n)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["forest_scores", "conifer_scores"])
def test_scores_make_the_rest_of_the_rectangle_in_place(spark, tmp_path, monkeypatch, name):
    from tessera.operators import grid as gd

    path, flooded, real = lines(spark, tmp_path, [(5, 3), (60, 150)]), [], gd.flooded_layers
    monkeypatch.setattr(gd, "flooded_layers", lambda grid, *a: flooded.append(grid.count()) or real(grid, *a))
    got, want = both(spark, path, name)
    assert len(got) == len(want) > 10_000 and [g[:2] for g in got] == [w[:2] for w in want]
    assert all(g[2] == pytest.approx(w[2], abs=2e-6) for g, w in zip(got, want))
    assert flooded[0] < len(got)


@pytest.mark.parametrize("name", ["forest_scores", "conifer_scores"])
def test_scores_flood_what_is_near_without_joins(spark, tmp_path, monkeypatch, name):
    from tessera.operators import grid as gd

    # Over a rim of tiles, at the edges of the rectangle, and alone.
    path, flooded, real = lines(spark, tmp_path, [(0, 0), (246, 250), (255, 300)], side=14, n=120), [], gd.flooded_layers
    monkeypatch.setattr(gd, "flooded_layers", lambda grid, *a: flooded.append(grid.count()) or real(grid, *a))
    got, want = both(spark, path, name)
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(g[2] == pytest.approx(w[2], abs=2e-6) for g, w in zip(got, want))
    # Only cells where something was sold are flooded, and cells are joined to nothing.
    assert flooded[0] <= 3 * 120 and plan_of(QUERIES[name](spark, path)).count("Join") == 1


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_or_join_gives_each_pair_once_without_gathering_pairs(spark, sf):
    from tessera.operators.joins import not_matched_once, or_join

    rng = random.Random(6)
    make = lambda n: [(rng.choice([None, *range(n)]), rng.choice([None, *range(4)]), rng.choice([None, *range(5)]), rng.randrange(9)) for _ in range(3 * n)]
    a, b = make(12), make(10)
    l, r = spark.createDataFrame(a, "x long, k long, m long, o long"), spark.createDataFrame(b, "y long, k long, m long, o long")
    found = or_join(l, r, [("k", "k"), ("m", "m"), ("o", "o")], "x", "y")
    want = {(p[0], q[0]) for p in a for q in b if any(p[i] == q[i] and p[i] is not None for i in (1, 2, 3))}
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counts = {x: len({y for z, y in want if z == x and y is not None}) for x in {p[0] for p in a if p[0] is not None}}
    misses = {x.x: x.n for x in not_matched_once(found, l.select("x").distinct(), "x", "y").collect() if x.x is not None}
    assert misses == {x: n for x, n in counts.items() if n != 1}
    # Nothing is gathered above the joins.
    assert plan_of(QUERIES["or_join"](spark, sf)).split("Join")[0].count("Aggregate") == 0


def test_tiles_make_the_finer_grid(spark, tmp_path):
    from tessera.operators.reports import upsampled

    path = lines(spark, tmp_path, [(0, 0), (260, 250), (9000, 9100)])
    got, want = both(spark, lines(spark, f"{tmp_path}/b", [(0, 0), (250, 262)]), "upsampled_grid")
    assert got == want and want
    # No fine cell is shuffled to be summed.
    assert "FlatMapGroupsInPandas" in plan_of(QUERIES["upsampled_grid"](spark, path))
    rng = random.Random(8)
    cells = {(r, c): rng.choice([None, 1.0, 5.0]) for r in range(9) for c in range(7) if rng.random() < 0.6}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "r long, c long, v double")
    found = {(x.r, x.c): x.v for x in upsampled(df, "v", 2, 9, 7, tile=2).collect()}
    near = lambda k, n: ((lo := max(0, min(n - 2, int((k + 0.5) // 2 - (1 if (k + 0.5) / 2 % 1 < 0.5 else 0)))), max(0.0, min(1.0, (k + 0.5) / 2 - 0.5 - lo))))
    plain = {}
    for r in range(18):
        for c in range(14):
            (r0, tr), (c0, tc) = near(r, 9), near(c, 7)
            at = [((r0 + i, c0 + j), (tr if i else 1 - tr) * (tc if j else 1 - tc)) for i in (0, 1) for j in (0, 1)]
            at = [(cells[k], w) for k, w in at if k in cells and w > 0]
            if at:
                known = [(v, w) for v, w in at if v is not None]
                plain[r, c] = sum(v * w for v, w in known) / sum(w for _, w in at) if known else None
    assert found == {k: v if v is None else pytest.approx(v) for k, v in plain.items()} and None in plain.values()


def test_votes_are_counted_in_tiles(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.operators.grid import majority_disc

    got, want = both(spark, lines(spark, tmp_path, [(248, 250), (9000, 3)]), "majority_disc")
    assert got == want and want
    assert "FlatMapGroupsInPandas" in plan_of(QUERIES["majority_disc"](spark, str(tmp_path)))
    rng = random.Random(9)
    cells = {(r, c): (rng.choice(["b", "a", "z", "y", None]), rng.choice([True, False, None])) for r in range(9) for c in range(7) if rng.random() < 0.7}
    df = spark.createDataFrame([(*k, *v) for k, v in cells.items()], "r long, c long, k string, v boolean")
    found = {(x.r, x.c): x.won for x in majority_disc(df, "k", 2.0, ["b", "a"], "won", F.col("v"), tile=3).collect()}
    rank = ["y", "z", None, "b", "a"]
    for (r, c), _ in cells.items():
        votes = [k for (y, x), (k, v) in cells.items() if v and (y - r) ** 2 + (x - c) ** 2 <= 4]
        assert found[r, c] == (min(set(votes), key=lambda k: (-votes.count(k), rank.index(k))) if votes else None)


def test_near_votes_ask_a_place_once(spark, tmp_path, monkeypatch):
    from tessera.operators import spatial as sp

    rng, rows, asked, real = random.Random(11), [], {}, sp.written

    def counted(df, what="step", after=None):
        table = real(df, what, after)
        asked.setdefault(what, []).append(table.count())
        return table

    monkeypatch.setattr(sp, "written", counted)
    # A crowd, copies of one place, loners, and points without a place.
    for k in range(1500):
        x, y = (rng.gauss(0, 0.01), rng.gauss(0, 0.01)) if k < 900 else (0.2, 0.2) if k < 1200 else (rng.uniform(-0.5, 0.5), rng.uniform(-0.5, 0.5))
        rows.append((k, [x, y] if k % 97 else None, rng.randrange(4)))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = both(spark, str(tmp_path), "knn_vote", ("embeddings",))
    key = lambda r: (r[0], r[1] is None, r[1] or 0)
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) == 1500
    assert asked["known"] < [1250] and asked["places"][0] < 1250 and len(asked["votes"]) > 2


def test_links_pass_in_order_and_are_not_held(spark, sf, monkeypatch):
    from tessera.operators import graph as gr

    rng, n, big = random.Random(12), 80, 1 << 60
    items = [(big + i, rng.choice([None, None, "a", "b"]), rng.choice([None, None, 7, 8])) for i in range(n)]
    links = [(rng.choice([None, 0, 1, 2]), big + rng.randrange(n - 4), big + rng.randrange(n - 4)) for _ in range(160)]
    root, tag = {i: i for i, *_ in items}, {i: list(t) for i, *t in items}

    def find(x):
        return x if root[x] == x else find(root[x])

    for _, a, b in sorted(links, key=lambda k: (k[0] is None, k[0] or 0, k[1], k[2])):
        a, b = sorted((find(a), find(b)))
        if a != b and not any(x is not None and y is not None and x != y for x, y in zip(tag[a], tag[b])):
            root[b], tag[a] = a, [y if x is None else x for x, y in zip(tag[a], tag[b])]
    args = (spark.createDataFrame(items, "i long, t string, u int"), spark.createDataFrame(links, "priority int, a long, b long"), "i", ("t", "u"))
    # Batches smaller than a component.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.i: r.grp for r in gr.constrained_groups(*args).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: find(i) for i, *_ in items} and 4 < len(set(got.values())) < n
    assert "FlatMapGroups" not in plan_of(QUERIES["constrained_groups"](spark, sf))


def test_what_is_repeated_for_salt_is_not_broadcast(spark):
    from tessera.operators.chains import SALT, salted

    rows = spark.createDataFrame([(k, k % 3) for k in range(50)], "id long, chain long")
    df = salted(rows, rows.groupBy("chain").count(), ["chain"], "id")
    assert sorted(map(tuple, df.select("id", "count").collect())) == [(k, 17 if k % 3 < 2 else 16) for k in range(50)] and SALT > 1
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_segment_ends_at_the_sum_of_its_start_and_step(spark, tmp_path):
    import datetime

    # 100 lies on the edge of a box, but 253.59 and the way from there to 100 add up to more than it; 27.68 lies inside.
    at = datetime.datetime(2024, 1, 1, 8)
    values = [(1, 253.59), (1, 100.0), (2, 27.68), (2, 100.0), (3, 100.0), (3, 253.59)]
    rows = [(k, at, u, "view", v, "{}") for k, (u, v) in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got, want = both(spark, str(tmp_path), "length_inside", ("events",))
    assert got == want and want


def test_sides_of_polygons_are_exact_differences(spark, tmp_path):
    import datetime

    # Tracks through corners of the polygons, where the last place of a side decides whether they are cut.
    tracks = [[(23, 111.36), (15, 54.4)], [(18, 0.0), (19, 45.0)], [(18, 0.0), (23, 225.0)], [(4, 100.0)]]
    rows = [(10 * u + k, datetime.datetime(2024, 1, 1 + k, h), u, "view", v, "{}") for u, track in enumerate(tracks) for k, (h, v) in enumerate(track)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got, want = both(spark, str(tmp_path), "length_inside", ("events",))
    assert got == want and len(want) > 2


def test_quota_looks_only_at_nodes_with_cells(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.operators import alloc

    # 563 x 563 squares around the grid, far above MOST_NODES, and cells in some of them.
    path = lines(spark, tmp_path, [(0, 0), (20, 16), (8990, 8990)], n=400)
    for name in ("quota_shares", "tidy_quota_shares"):
        got, want = both(spark, path, name)
        assert got == want and len(want) > 8
    df = spark.createDataFrame([(0, None, None), (0, 1.0, True), (1, 2.0, False)], "node int, score double, ok boolean").withColumn("corners", F.array(F.struct(F.col("node"), F.lit(1.0).alias("w"))))
    q = alloc.solve_quota_by_node(df, "node", "corners", "score", F.col("ok"), F.lit(True), F.lit(0.5), (1, 2))
    assert [(r.node, r.cells, r.eligible, r.want) for r in q.nodes.orderBy("node").collect()] == [(0, 2, 1, 1), (1, 1, 0, 0)]
    assert q.cells.where("chosen").count() == 1
    t = {r.node: r.threshold for r in q.nodes.collect()}
    assert all(r.chosen == (bool(r.ok) and r.score > t[r.node]) for r in q.cells.where("score is not null").collect())
    none = alloc.solve_quota_by_node(df.limit(0), "node", "corners", "score", F.col("ok"), F.lit(True), F.lit(0.5), (1, 2))
    assert none.cells.count() == none.nodes.count() == 0


def test_quota_leaves_nothing_of_its_rounds_on_the_driver(spark, tmp_path, monkeypatch):
    made, real = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, v: made.append(real(self, v)) or made[-1])
    path = lines(spark, tmp_path, [(0, 0), (20, 16)], n=400)
    for name in ("quota_shares", "tidy_quota_shares"):
        got, want = both(spark, path, name)
        assert got == want and want
    assert len(made) > 6 and not any(b._jbroadcast.isValid() for b in made)


def test_shapes_in_kept_ones_form_no_pairs(spark, sf, monkeypatch):
    from tessera.operators import placing

    seen, real, shapes = [], placing.nested, {}
    monkeypatch.setattr(placing, "nested", lambda s, *a, **k: seen.append(s.count()) or real(s, *a, **k))
    whole = placing.without_nested
    monkeypatch.setattr(placing, "without_nested", lambda s, *a, **k: shapes.setdefault("n", s.count()) and whole(s, *a, first=6, **k))
    got, want = both_of_one_file(spark, sf, "nested_shapes", "customer")
    assert got == want and len(seen) > 3 and sum(seen) < shapes["n"]


def both_of_one_file(spark, path, name, t):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    rel = con.sql(ORACLES[name])
    order = lambda r: tuple((v is None, v or 0) for v in r)
    return sorted(map(tuple, QUERIES[name](spark, path).select(*rel.columns).collect()), key=order), sorted(rel.fetchall(), key=order)


def test_shapes_and_land_never_meet_in_pairs(spark, sf, monkeypatch):
    from pyspark.sql import functions as F

    from tessera.operators import shapes as sh

    # Every shape lies on every land; bands are far lower than either.
    monkeypatch.setattr(sh, "RUNS_OF_BAND", 20)
    rng, ring = random.Random(13), lambda x, y, w: [{"x": x + dx * w, "y": y + dy * w} for dx, dy in ((-1.0, -0.9), (1.1, -0.7), (0.8, 1.0), (-0.9, 0.6))]
    make = lambda n: [(k, [ring(float(rng.randrange(-3, 4)), float(rng.randrange(-3, 4)), rng.choice([4.0, 5.0, rng.uniform(4, 9)]))]) for k in range(n)]
    rings = "id long, rings array<array<struct<x:double,y:double>>>"
    shapes, land = make(60), make(80)
    inside = lambda x, y, of: sum((a["y"] > y) != (b["y"] > y) and x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"] for r in of for a, b in zip(r, r[1:] + r[:1])) % 2 == 1
    want, ground = {}, [r for _, of in land for r in of]
    for i, of in shapes:
        xs, ys = [q["x"] for q in of[0]], [q["y"] for q in of[0]]
        step = max(0.5, max(max(xs) - min(xs), max(ys) - min(ys)) / 16)
        at = [(min(xs) + a * step, min(ys) + b * step) for a in range(18) for b in range(18)]
        at = [(x, y) for x, y in at if x <= max(xs) and y <= max(ys) and inside(x, y, of)]
        want[i] = (len(at), sum(inside(*q, ground) for q in at))
    df = sh.shape_effect(spark.createDataFrame(shapes, rings), spark.createDataFrame(land, rings), "id", "id", F.lit(False), 20.0, 0.5, 16)
    assert {r.id: (r.inside, r.changed) for r in df.collect()} == want
    plan = plan_of(QUERIES["shape_effect"](spark, sf))
    assert "FlatMapCoGroupsInPandas" in plan and plan.count("Join") == 1


def test_only_patches_at_a_rim_are_joined(spark, sf, monkeypatch):
    from tessera.operators import chains, graph
    from tessera.operators.grid import patches

    joined, real = [], chains.salted
    monkeypatch.setattr(chains, "salted", lambda rows, *a: joined.append(rows.count()) or real(rows, *a))
    rng = random.Random(14)
    cells = {(r, c): rng.choice("aab") for r in range(24) for c in range(24) if rng.random() < 0.6}
    # A column of another kind passes through as it is.
    rows = [(r, c, r * 100 + c, k, None if c % 2 else [2**60 + 1]) for (r, c), k in cells.items()]
    df = spark.createDataFrame(rows, "r long, c long, id long, k string, more array<long>")
    got = patches(df, "id", "k", "p", 12, size="n").collect()
    whole = {}
    for at in sorted(cells):
        if at not in whole:
            todo, seen = [at], {at}
            while todo:
                r, c = todo.pop()
                for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                    if q not in seen and cells.get(q) == cells[at]:
                        seen.add(q)
                        todo.append(q)
            whole |= {q: (at[0] * 100 + at[1], len(seen)) for q in seen}
    assert {(x.r, x.c): (x.p, x.n) for x in got} == whole and 0 < joined[0] < len(cells)
    assert all(x.more == (None if x.c % 2 else [2**60 + 1]) for x in got)
    # Sizes come with the patches, so absorbing counts and joins nothing more.
    yes = df.selectExpr("r", "c", "id", "k = 'a' AS v")
    asked, written = [], graph.written
    monkeypatch.setattr(graph, "written", lambda d, what="step", after=None: asked.append(what) or written(d, what, after))
    by = lambda size: {(x.r, x.c): x.v for x in graph.absorb_small(yes, "id", "v", 4, lambda x: patches(x, "id", "v", "_part", 12, size=size)).collect()}
    assert by("_size") == by(None) and "grid" not in asked


def test_squares_of_a_shore_are_made_in_tiles(spark, sf):
    from pyspark.sql import functions as F

    from tessera.operators.grid import shore_fill

    rng = random.Random(15)
    # Over the corner of four tiles, with nulls, holes and open cells.
    cells = {(r, c): (rng.choice([None, 1, 5, 9, 9]), rng.random() < 0.05) for r in range(250, 262) for c in range(248, 262) if rng.random() < 0.95}
    df = spark.createDataFrame([(*k, *v) for k, v in cells.items()], "r long, c long, v long, o boolean")
    want = set()
    for r, c in cells:
        of = [cells.get(k, (None, False)) for k in ((r, c), (r, c + 1), (r + 1, c + 1), (r + 1, c))]
        if all(v is not None and not o for v, o in of) and any(v > 4 for v, _ in of):
            want.add((r, c))
    got = [(x.r, x.c + k) for x in shore_fill(df, "v", 4.5, F.col("o")).where("part = 0").collect() for k in range(x.squares)]
    assert len(got) == len(set(got)) and set(got) == want and want
    plan = plan_of(QUERIES["shore_squares"](spark, sf))
    assert "FlatMapGroupsInPandas" in plan and "v00" in plan and plan.count("Aggregate") == 2
