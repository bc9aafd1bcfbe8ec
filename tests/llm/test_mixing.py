import numpy as np
import pytest

from tessera.llm import mixing
from tessera.llm.bpe import encode, encoder
from tessera.llm.mixing import LANGUAGES, OTHER, TEMPER, TOPICS, probabilities, rake, token_sketch

import public_tokenizers

BPE = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def mix(docs, **options):
    return mixing.mix(docs, *BPE, **options).select("doc.doc_id", "doc.source", "doc.lang", "doc.text", "tokens", "topic", "probability", "sampled")


def sampled(docs, **options):
    return mixing.sampled(docs, *BPE, **options)


def test_raking_meets_all_marginals():
    rng = np.random.default_rng(0)
    t = rng.integers(1, 1000, (5, 4, 3)).astype(float)
    goals = [rng.dirichlet(np.ones(n)) for n in t.shape]
    w = rake(t, goals)
    for k, g in enumerate(goals):
        assert np.allclose(w.sum(axis=tuple(a for a in range(3) if a != k)) / w.sum(), g, atol=1e-6)
    # Cells keep their odds ratios: the weights are tokens times one factor per category of each dimension.
    f = np.log(w / t)
    assert np.allclose(f[1:, 1:] - f[:1, 1:] - f[1:, :1] + f[:1, :1], 0, atol=1e-6)


def test_raking_with_empty_cells_and_categories():
    t = np.zeros((2, 2, 2))
    assert rake(t, [np.array([0.5, 0.5])] * 3).sum() == 0
    t[0, 0, 0], t[0, 1, 0] = 10, 30
    w = rake(t, [np.array([0.5, 0.5]), np.array([0.5, 0.5]), np.array([0.0, 1.0])])
    assert np.allclose(w[0, :, 0], [20, 20]) and w.sum() == 40


@pytest.mark.parametrize("share", [0.1, 0.5, 0.9, 1.0])
def test_probabilities_hold_the_budget(share):
    rng = np.random.default_rng(1)
    t, w = rng.integers(1, 1000, 50).astype(float), rng.random(50)
    p = probabilities(t, w, share * t.sum())
    assert (0 <= p).all() and (p <= 1).all() and abs((p * t).sum() / t.sum() - share) < 1e-6


def test_mixture_nears_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    langs = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
    rows = mix(docs, languages=langs, budget=0.3)
    total = rows.selectExpr("sum(tokens) t", "sum(if(sampled, tokens, 0)) s", "sum(tokens * probability) e").first()
    assert abs(total.e / total.t - 0.3) < 0.001 and abs(total.s / total.t - 0.3) < 0.02
    for r in rows.groupBy("lang").agg({"*": "count"}).collect():
        s = rows.where(f"lang = '{r.lang}'").selectExpr("sum(tokens * probability) s").first().s
        assert abs(s / total.e - langs[r.lang]) < 0.03
    a, b = (sorted(r.doc_id for r in sampled(d, languages=langs, budget=0.3).select("doc_id").collect()) for d in (docs, docs.repartition(7)))
    assert a == b


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", "s"), (None, "x" * 100_000, "xx", "s"), (3, "a b", "en", "t"), (3, "a b", "en", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as topic", "2 as n", "3 as _s", "4 as _probability", "5 as tokens", "6 as sampled", "7 as doc")
    out = mix(df)
    assert out.count() == 5 and out.where("probability is null or sampled is null").count() == 0
    assert sampled(df).columns == df.columns
    assert mix(df.limit(0)).count() == 0
    assert mix(df, sources={"s": 1.0}, budget=1.0).where("sampled and source = 's' and tokens > 0").count() == 1
    assert OTHER == "other"


def test_every_source_has_a_target_of_its_own(spark):
    rng = np.random.default_rng(4)
    langs, n = ["en", "de", "fr", "es"], 90
    rows = [(k, "x" * int(rng.integers(4, 2000)), langs[int(rng.integers(4))], f"s{k % n}" if k % 97 else None) for k in range(9 * n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mix(df, budget=0.3).collect()
    axes = [sorted({r.source or OTHER for r in got}), [f"t{k}" for k in range(TOPICS)], [*LANGUAGES, OTHER]]
    tokens = np.zeros([len(a) for a in axes])
    at = lambda r: (axes[0].index(r.source or OTHER), axes[1].index(r.topic), axes[2].index(r.lang))
    for r in got:
        tokens[at(r)] += r.tokens
    own, by_topic = tokens.sum(axis=(1, 2)) ** TEMPER, tokens.sum(axis=(0, 2)) ** TEMPER
    langs = np.array([LANGUAGES.get(x, max(0.0, 1 - sum(LANGUAGES.values()))) for x in axes[2]])
    targets = [own / own.sum(), by_topic / by_topic.sum(), langs]
    p = probabilities(tokens, rake(tokens, targets), 0.3 * tokens.sum())
    assert len(axes[0]) == n + 1 and max(abs(p[at(r)] - r.probability) for r in got) < 1e-6


def test_tokens_and_topics_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in mix(docs.repartition(5)).collect()}
    enc, projection = encoder(*BPE), np.random.default_rng(mixing.SEED).standard_normal((4096, mixing.SKETCH))
    ids = {r.doc_id: encode(r.text, enc) for r in docs.collect()}
    assert {i: r.tokens for i, r in got.items()} == {i: len(x) for i, x in ids.items()}
    order = sorted(ids)
    x = np.stack([token_sketch(ids[i], projection) for i in order])
    langs = [got[i].lang if got[i].lang in LANGUAGES else OTHER for i in order]
    for lang in set(langs):
        members = [k for k, l in enumerate(langs) if l == lang and len(ids[order[k]])]
        x[members] -= sum(x[k] for k in members) / len(members)
    x = np.array([row / np.linalg.norm(row) for row in x])
    # Lloyd's rounds from the signs of the first three numbers, by loops over documents.
    topic = [sum((row[b] > 0) << b for b in range(3)) % TOPICS for row in x]
    centres = np.zeros((TOPICS, mixing.SKETCH))
    for _ in range(9):
        fresh = centres.copy()
        for k in range(TOPICS):
            members = [row for row, t in zip(x, topic) if t == k]
            if members:
                fresh[k] = sum(members) / np.linalg.norm(sum(members))
        done = centres.any() and np.abs(fresh - centres).max() < 1e-4
        if done:
            break
        centres = fresh
        topic = [int(np.argmax(np.round([row @ c for c in centres], 9))) for row in x]
    assert [got[i].topic for i in order] == [f"t{k}" for k in topic]
    assert len({r.topic for r in got.values()}) > 3
