import hashlib
import random

import numpy as np
import pytest
import xxhash

from tessera.llm.queries import op9_document_fingerprints
from tessera.llm.sketch import K, containment, distinct_count, from_text, merge, neighbour_fingerprints, resemblance, sketch, sketches, to_text


def shingles(text):
    w = [x for x in text.lower().replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow(text):
    return sorted({xxhash.xxh64_intdigest(s.encode()) for s in shingles(text or "")})[:K]


def check(rows, got):
    """rows: (id, text) in descending id."""
    assert [g.doc_id for g in got] == [i for i, _ in rows]
    for n, ((_, text), g) in enumerate(zip(rows, got)):
        nxt = rows[(n + 1) % len(rows)][1] or ""
        text = text or ""
        m = len(text) // 3
        new = text[: len(text) - m] + nxt[:m]
        a, b, c = slow(text), slow(new), slow(nxt)
        assert (g.n_chars, g.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert from_text(g.fingerprint).tolist() == a and from_text(g.edited_fingerprint).tolist() == b
        for near, other in ((g.near_edited, b), (g.near_next, c)):
            union = sorted({*a, *other})[:K]
            assert near == pytest.approx(len({*union} & {*a} & {*other}) / len(union) if union else 1.0)
        size = lambda x: len(x) if len(x) < K else (K - 1) / ((x[-1] + 1) / 2**64)
        assert g.shingles == pytest.approx(size(a))
        for held, near, other in ((g.in_edited, g.near_edited, b), (g.in_next, g.near_next, c)):
            assert held == pytest.approx(min(1.0, near * size(sorted({*a, *other})[:K]) / size(a)) if a else 1.0)


def test_query_equals_brute_force(spark, sf):
    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    check(rows, sorted(op9_document_fingerprints(spark, sf).collect(), key=lambda r: -r.doc_id))


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_order_across_ranges_and_odd_rows(spark, ranges):
    rng = random.Random(ranges)
    ids = rng.sample(range(-500, 10**6), 40)
    rows = [(i, rng.choice([None, "", "é", "One two three", " ".join(rng.choice("abcdef") for _ in range(rng.randrange(60)))])) for i in ids]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, part string").repartition(5)
    check(sorted(rows, reverse=True), sorted(neighbour_fingerprints(df, ranges=ranges).collect(), key=lambda r: -r.doc_id))


def test_single_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(7, "a b c d e f g")], "doc_id long, text string")
    (r,) = neighbour_fingerprints(df).collect()
    assert r.near_next == 1.0
    assert neighbour_fingerprints(df.limit(0)).count() == 0
    df = spark.createDataFrame([(7, "x y"), (7, "x y"), (None, "q"), (None, None), (3, "z")], "doc_id long, text string")
    assert neighbour_fingerprints(df, ranges=4).count() == 5


def test_merge_over_parts_is_exact(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5, 400))) for _ in range(30)]
    df = spark.createDataFrame([(i % 3 if i % 7 else None, t) for i, t in enumerate(texts)], "source int, text string").repartition(6)
    want = {}
    for i, t in enumerate(texts):
        want.setdefault(i % 3 if i % 7 else None, set()).update(shingles(t))
    got = {r.source: from_text(r.fingerprint).tolist() for r in sketches(df, "source").collect()}
    assert got == {k: sorted(xxhash.xxh64_intdigest(s.encode()) for s in v)[:K] for k, v in want.items()}


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(0)
    for share in (0.1, 0.5, 0.9):
        a = rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)
        b = np.concatenate([a[: int(share * 20_000)], rng.integers(0, 1 << 64, 10_000, dtype=np.uint64)])
        sa, sb = merge(a[:0], a), merge(b[:0], b)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(resemblance(sa, sb) - true) < 0.13
        assert abs(containment(sa, sb) - share) < 0.25
        assert abs(distinct_count(sa) / 20_000 - 1) < 0.3
    assert from_text(to_text(sa)).tolist() == sa.tolist()


def test_long_text_in_parts():
    text = " ".join(str(i * i % 9973) for i in range(150_000))
    assert sketch(text).tolist() == slow(text)
