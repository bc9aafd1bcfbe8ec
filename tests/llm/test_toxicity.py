import numpy as np
import pytest

from tessera.llm.toxicity import Chain, best_threshold, fit_chain, fit_linear, keep_clean, out_of_fold, predict, score, sigmoid


@pytest.fixture(scope="module")
def big(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_held_out_accuracy(spark, big):
    docs, labels = big
    train = labels.where("doc_id % 3 <> 0")
    chain = fit_chain(docs, train)
    assert [link.name for link in chain.links] == ["low_quality", "toxic"]
    assert len(chain.links[1].weights) == len(chain.links[0].weights) + 1  # the earlier category's probability
    truth = {r.doc_id: (r.toxic, r.quality) for r in labels.collect()}
    got = {r.doc_id: (r.toxic, r.low_quality) for r in score(docs, chain).collect()}
    ids = [i for i in truth if i % 3 == 0 and i in got]
    assert len(ids) > 1000
    # Labels of garbled documents (quality 0) don't follow their words.
    ids = [i for i in ids if truth[i][1] == 1]
    tp = sum(truth[i][0] == 1 and got[i][0] for i in ids)
    assert tp / sum(truth[i][0] for i in ids) > 0.9
    assert sum(truth[i][0] == 0 and got[i][0] for i in ids) <= 0.005 * len(ids)
    ids = [i for i in truth if i % 3 == 0]
    assert np.mean([(truth[i][1] == 0) == got[i][1] for i in ids]) > 0.97


def test_fit_is_repeatable_and_bounded(spark, big):
    docs, labels = big
    a, b = (fit_chain(docs.repartition(n), labels, sample=300, terms=20) for n in (3, 5))
    assert a.terms.keys() == b.terms.keys() and len(a.terms) <= 40
    for x, y in zip(a.links, b.links):
        assert np.allclose(np.sort(x.weights), np.sort(y.weights), atol=1e-3)


def test_linear_model_and_folds():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 3)).astype(np.float32)
    y = (rng.random(3000) < sigmoid(2 * x[:, 0] - x[:, 1] + 0.5)).astype(float)
    assert np.allclose(fit_linear(x, y, 0.01), [2, -1, 0, 0.5], atol=0.25)
    p = out_of_fold(x, y, np.arange(3000) % 3)
    assert np.mean((p > 0.5) == y) > 0.75
    assert best_threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0])) == pytest.approx(0.55)
    assert best_threshold(np.array([0.9]), np.array([1.0])) == 0.5


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "you IDIOT"), (2, None), (3, ""), (None, "x"), (3, ""), (5, "w " * 300_000)], "doc_id long, text string").selectExpr("*", "1 as toxic", "2 as id", "3 as words")
    chain = fit_chain(docs, labels, least=1)
    rows = score(docs, chain).collect()
    assert len(rows) == 6 and all(0 <= r.p_toxic <= 1 and r.toxic is not None for r in rows)
    assert keep_clean(docs, chain).columns == docs.columns
    none = fit_chain(docs, labels.limit(0))
    assert none == Chain({}, none.links) and predict(none, "x")[1] == 0.5
    assert keep_clean(docs, none).count() == 6
    assert score(docs.limit(0), chain).count() == 0


def test_probabilities_equal_plain_loops(spark, big):
    import math
    import re

    docs, labels = big
    chain = fit_chain(docs, labels, sample=600, terms=40)
    for r in score(docs.limit(300), chain).collect()[:60]:
        text = docs.where(f"doc_id = {r.doc_id}").first().text if r.doc_id % 7 == 0 else None
        if text is None:
            continue
        plain = set(re.findall(r"[^\W_]+", text.lower()))
        have = set(plain)
        for w in plain:
            have |= ({w[:4] + "-"} if len(w) > 4 else set()) | ({w[:5] + "-"} if len(w) > 5 else set())
        n = max(1, len(text))
        measures = [
            math.log1p(len(text)) / 12, min(1.0, 3 * len(have) / n), sum(c.isupper() for c in text) / n, 1 - sum(c.isalnum() or c.isspace() for c in text) / n,
        ]
        earlier = []
        for link in chain.links:
            z = sum(link.weights[k] for w, k in chain.terms.items() if w in have)
            z += sum(w * m for w, m in zip(link.weights[len(chain.terms) :], [*measures, *earlier])) + link.weights[-1]
            earlier.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        assert [r.p_low_quality, r.p_toxic] == pytest.approx(earlier, abs=1e-9)


def test_a_null_label_is_no_example(spark):
    docs = spark.createDataFrame([(i, f"{'vile' if i % 2 else 'kind'} words number {i}") for i in range(60)], "doc_id long, text string")
    known = [(i, 1, i % 2) for i in range(40)]
    with_nulls = spark.createDataFrame(known + [(i, 1, None) for i in range(40, 60)], "doc_id long, quality int, toxic int")
    chain = fit_chain(docs, with_nulls, least=2)
    got = {r.doc_id: r.p_toxic for r in score(docs, chain).collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(60))
    # A row that repeats an id is one example, whatever its texts.
    twice = docs.unionByName(docs)
    again = fit_chain(twice, with_nulls, least=2)
    assert again.terms.keys() == chain.terms.keys()


def test_all_labelled_documents_held_out(spark, big):
    """Over all documents, garbled ones too, whose labels don't follow their words; README has the figures."""
    docs, labels = big
    chain = fit_chain(docs, labels.where("doc_id % 3 <> 0"))
    truth = {r.doc_id: r.toxic for r in labels.where("doc_id % 3 = 0").collect()}
    got = {r.doc_id: r.toxic for r in score(docs.join(labels.where("doc_id % 3 = 0").select("doc_id"), "doc_id", "left_semi"), chain).collect()}
    hits, real, said = sum(truth[i] == 1 and got[i] for i in got), sum(truth[i] for i in got), sum(got.values())
    print("all held-out documents: recall", hits / real, "precision", hits / max(1, said))
    assert hits / real > 0.6 and hits / said > 0.8
