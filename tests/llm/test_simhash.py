import collections
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm.graph import Forest, connected_components
from tessera.llm.common import join_hot
from tessera.llm.simhash import block_keys, block_tables, fingerprint, keep_leads, like_enough, likeness_groups, links, simhash_groups


def slow_fingerprint(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low:
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    words += [word] * bool(word)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "a B c", "É a\xa0b c d e f", "x " * 500, "a b c d", "A b c D e\x1cf g"])
def test_fingerprint_equals_slow_one(text):
    for width in (4, 5):
        assert fingerprint(text, width) == slow_fingerprint(text, width)


def test_fingerprint_agrees_with_spark_xxhash64(spark):
    from pyspark.sql import functions as F

    s = "über den Wolken 123 mit langen Wörtern"
    assert spark.range(1).select(F.xxhash64(F.lit(s))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(s.encode(), 42)


def test_masks_lose_no_pair():
    masks = block_tables(6, 4)
    rng = random.Random(1)
    for _ in range(2000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_groups_equal_brute_force_on_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    fp = [slow_fingerprint(t, 4) for _, t in rows]
    want = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_groups(docs, width=4, distance=4).collect()}
    assert got == {d: (f"{fp[i]:016x}", rows[want[i]][0]) for i, (d, _) in enumerate(rows)}
    assert len({c for _, c in got.values()}) < len(rows)


def test_links_over_split_blocks_equal_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = set(base)
    for b in base:  # chains and clouds around three centres, so that keys are hot
        for _ in range(80):
            x = b
            for k in rng.sample(range(64), 3):
                x ^= 1 << k
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([((f - (1 << 64)) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, node long").selectExpr("fp", "0L as fp2", "node")
    want = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    for block_rows in (7, 4096):
        got = {r.node: r.component for r in connected_components(links(df, block_keys(F.col("fp"), 4, 6), 4, block_rows)).collect()}
        assert [got.get(i, i) for i in range(len(fps))] == want


def test_odd_rows(spark):
    rows = [(3, None, 1), (1, "", 1), (2, "same text here now", 1), (2, "same text here now", 2), (9, "same TEXT here now", 3), (None, "", 4), (5, "y " * 200_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int").withColumnRenamed("component_id", "fp")
    got = collections.Counter((r.doc_id, r.component_id) for r in simhash_groups(df, width=4, distance=4).collect())
    assert got == {(3, 1): 1, (1, 1): 1, (2, 2): 2, (9, 2): 1, (None, None): 1, (5, 5): 1}
    assert simhash_groups(df.limit(0)).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    for n, m in ((60, 40), (60, 59), (300, 200)):
        pairs = [(i, i + 1) for i in range(n - 1)] if m == n - 1 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        df = spark.createDataFrame(pairs + [(1, 1), (None, 2)], "a long, b long")
        got = {r.node: r.component for r in connected_components(df).collect()}
        assert [got.get(i, i) for i in range(n)] == components(n, pairs)
    assert connected_components(df.limit(0)).count() == 0


def test_forest_spans():
    rng = np.random.default_rng(0)
    for n in (5, 200):
        i, j = rng.integers(0, n, 300), rng.integers(0, n, 300)
        f = Forest(n)
        kept = np.concatenate([f.add(i[:150], j[:150]), 150 + f.add(i[150:], j[150:])]).astype(int)
        assert components(n, zip(i, j)) == components(n, zip(i[kept], j[kept]))
        assert len(kept) < n


def test_links_of_two_fingerprints_equal_brute_force_over_long_runs(spark):
    rng = random.Random(8)
    base = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(20)]
    prints = set()
    for k in range(700):
        x, y = base[k % 20]
        for b in rng.sample(range(128), rng.randint(0, 22)):
            x, y = (x ^ (1 << b), y) if b < 64 else (x, y ^ (1 << b - 64))
        prints.add((x, y))
    prints = sorted(prints)
    sign = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(sign(x), sign(y), i) for i, (x, y) in enumerate(prints)], "fp long, fp2 long, node long")
    near = lambda a, b: (a[0] ^ b[0]).bit_count() + (a[1] ^ b[1]).bit_count() <= 26
    want = components(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if near(prints[i], prints[j])])
    for block_rows in (60, 2048):
        found = connected_components(links(df, F.array(F.lit(0)), 26, block_rows))
        got = {r.node: r.component for r in found.collect()}
        assert [got.get(i, i) for i in range(len(prints))] == want


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({b" ".join(words)} if words else set())


def near_copies(n=90, seed=4):
    """Texts of several lengths with copies of one to many changed words, some of the pairs above 0.8 and some below."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8)))
    out = []
    for _ in range(n):
        base = [word() for _ in range(rng.choice([6, 40, 150, 600]))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


def test_likeness_groups_equal_brute_force(spark):
    texts = near_copies()
    sets = [shingles(t) for t in texts]
    alike = lambda a, b: len(a & b) >= 0.8 * (len(a) * len(b)) ** 0.5
    want = components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for block_rows in (16, 1024):
        rows = likeness_groups(df, block_rows=block_rows).collect()
        assert {r.id: r.component_id for r in rows} == dict(enumerate(want))
        assert {r.id for r in rows if r.leads} == set(want)
    assert 20 < len(set(want)) < len(texts)


def clusters_at_the_threshold(n, size, seed):
    """Clusters of texts about the threshold: changes of one text, and chains in which each text changes the one before."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    out = []
    for k in range(n):
        base = [word() for _ in range(60)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(1, 3)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
            base = copy if k % 2 else base
    return out


@pytest.mark.parametrize("size,tile_rows,tile_hashes", [(8, 512, 1 << 21), (8, 3, 1 << 21), (8, 512, 120), (40, 5, 1 << 21)])
def test_no_link_is_lost_with_an_edge_that_fails(spark, size, tile_rows, tile_hashes):
    texts = clusters_at_the_threshold(600 // size, size, size)
    sets = [shingles(t) for t in texts]
    alike = lambda a, b: len(a & b) >= 0.8 * (len(a) * len(b)) ** 0.5
    pairs = [(i, j) for at in range(0, len(texts), size) for i in range(at, at + size) for j in range(at, i) if alike(sets[i], sets[j])]
    want = components(len(texts), pairs)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    # All texts of a cluster share a key here, so that every pair is a candidate and nothing but the forest could lose links.
    got = {r.id: r.component_id for r in likeness_groups(df, bands=60, band_rows=1, limit=128, tile_rows=tile_rows, tile_hashes=tile_hashes).collect()}
    assert got == dict(enumerate(want))
    trees = components(len(texts), [(at, i) for at in range(0, len(texts), size) for i in range(at, at + size)])
    assert len(set(trees)) < len(set(want))


def test_a_star_and_one_leader_of_most_edges(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    base = [word() for _ in range(80)]
    texts = [" ".join(base)]
    for k in range(900):
        copy = list(base)
        at = rng.randrange(10, 70)
        copy[at : at + 1 + k % 3] = [word() for _ in range(1 + k % 3)]
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r.component_id for r in likeness_groups(df).collect()} == {0}
    edges = spark.createDataFrame([(0, k) for k in range(1, 900)], "a long, b long")
    sets = spark.createDataFrame([(k, 80, list(range(80 - k % 40))) for k in range(900)], "node long, size long, shingles array<long>")
    assert {r.b for r in like_enough(edges, sets, 0.8, share=16).collect()} == {k for k in range(1, 900) if 80 - k % 40 >= 0.64 * 80}


def test_join_hot_deals_rows_out_alike_in_every_attempt(spark):
    rows = spark.createDataFrame([(0 if k < 900 else k, k, {"m": k}) for k in range(1000)], "k long, v long, m map<string,int>")
    found = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    for parts in (1, 4):
        got = {r.v: r.top for r in join_hot(rows.repartition(parts), found, ["k"], "n").collect()}
        assert got == {k: 899 if k < 900 else k for k in range(1000)}
    plan = join_hot(rows, found, ["k"], "n")._jdf.queryExecution().toString()
    assert "monotonically_increasing_id" not in plan


def test_likeness_of_odd_rows(spark):
    base = " ".join(f"word{i}" for i in range(60))
    near, far = base.replace("word7 ", "other "), "quite another text that no one has copied from " + "z " * 9
    rows = [
        (1, base), (2, base.upper()), (3, near), (2, far), (None, base), (None, None), (4, None), (5, ""), (6, " \n"), (7, "one"), (8, "ONE"), (9, "y " * 300_000), (1, base),
        (10, "x y " * 200_000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _gone", "2 as _KEY", "3 as component_id", "4 as id", "5 as key")
    got = collections.Counter((r.doc_id, (r.text or "")[:40]) for r in keep_leads(df).collect())
    # Of id 2 the copy goes and the other text stays; rows that repeat a leader stay, as do those without an id.
    assert got == {
        (1, base[:40]): 2, (2, far[:40]): 1, (None, base[:40]): 1, (None, ""): 1, (4, ""): 1, (7, "one"): 1, (9, ("y " * 20)): 1, (10, "x y " * 10): 1,
    }
    assert keep_leads(df).columns == df.columns
    assert keep_leads(df.limit(0)).count() == 0
