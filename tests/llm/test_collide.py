import random

import duckdb
import numpy as np
import pytest

from tessera.llm.collide import calibrated_count, collision_probability, embedding_groups
from tessera.llm.queries import OP1_SQL
from tests.llm.test_simhash import components


def brute(rows):
    """(id, vector, label) -> {id: (n_links, component)}."""
    good = [(i, np.array(v, float), l) for i, v, l in rows if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n_links, pairs = {i: 0 for i, *_ in rows}, []
    for x, (i, v, l) in enumerate(good):
        for y, (j, w, k) in enumerate(good[:x]):
            if l == k and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                n_links[i] += 1
                n_links[j] += 1
                pairs.append((x, y))
    order = sorted(range(len(good)), key=lambda x: good[x][0])
    at = {x: n for n, x in enumerate(order)}
    comp = components(len(good), [(at[x], at[y]) for x, y in pairs])
    return {i: (n_links[i], i) for i, *_ in rows} | {good[x][0]: (n_links[good[x][0]], good[order[comp[at[x]]]][0]) for x in range(len(good))}


@pytest.mark.parametrize("block_rows", [40, 2048])
def test_equal_to_brute_force_on_clouds(spark, block_rows):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 32))
    rows = []
    for i in range(400):
        v = centres[i % 12] + rng.standard_normal(32) * rng.choice([0, 0.1, 0.2, 0.25, 0.3])
        rows.append((int(i * 7 % 401), [float(x) for x in v.astype(np.float32)], int(i % 12 % 3)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(7)
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_groups(df, block_rows=block_rows).collect()}
    links = sum(n for n, _ in want.values())
    assert sum(n for n, _ in got.values()) >= 0.999 * links and links > 2000
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


def test_table_equals_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    rows = embedding_groups(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in rows} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
        assert sorted(c.sql(OP1_SQL).fetchall()) == sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1),
        (8, [1.0, nan], 1), (9, [inf, 1.0], 1), (10, [1.0, None], 1), (11, [1.0, 0.0, 0.0], 1), (12, [], 1), (13, [-1.0, 0.0], 1), (14, [1.0, -0.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as h", "2 as v")
    want = {i: (0, i) for i, *_ in rows} | {i: (3, 1) for i in (1, 2, 3, 14)}
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_groups(df).collect()} == want
    assert embedding_groups(df.limit(0)).count() == 0
    extra = spark.createDataFrame([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in embedding_groups(extra).collect()) == [(0, 0, None), (1, 1, 1), (1, 1, 1)]


def test_calibration_matches_simulation():
    rng = np.random.default_rng(1)
    c, d, window = 0.93, 64, 3.3 * np.sqrt(0.14)
    a = rng.standard_normal((4000, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((4000, d))
    b -= (b * a).sum(1, keepdims=True) * a
    b = c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b, axis=1, keepdims=True)
    hit = np.abs((a - b) @ rng.standard_normal((d, 16))) <= window
    assert abs(hit.mean() - collision_probability(c, window)) < 0.002
    need = calibrated_count(c, window, 16, 0.9995)
    assert (hit.sum(1) >= need).mean() >= 0.998 and need >= 12


def test_extreme_sizes_link_by_their_direction(spark):
    rows = [(1, [1e-200, 0.0], 1), (2, [1e-200, 1e-205], 1), (3, [1e200, 0.0], 1), (4, [1e200, 1e190], 1), (5, [0.0, 1e-300], 1), (6, [0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_groups(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6)}
