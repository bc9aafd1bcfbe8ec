"""Classifier chains: categories are predicted in turn, each linear model fed the earlier probabilities.

In training, what a later model sees of an earlier category are out-of-fold predictions, so that it learns from
probabilities as uncertain as those it meets later. Features are which of a bounded list of words a text
has, and four measures of its form. The fit uses a bounded, hash-ordered sample of labelled documents;
scoring is one pass over all documents without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, written

#: Labelled documents that a fit uses at most, those of the smallest hashes of their ids.
SAMPLE = 8000
#: Words that each category contributes to the features at most.
TERMS = 192
FOLDS = 3
_WORD = re.compile(r"[^\W_]+")
#: (name, column of labels, value that means the category applies), in chain order.
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))


class Link(NamedTuple):
    name: str
    weights: np.ndarray  # of terms, form measures, earlier categories, constant
    threshold: float


class Chain(NamedTuple):
    terms: dict[str, int]
    links: tuple[Link, ...]


def words(text: str) -> set[str]:
    """Lower-cased words and, marked by a hyphen, their first four and five letters, which inflected forms share."""
    plain = set(_WORD.findall(text.lower()))
    return plain | {w[:4] + "-" for w in plain if len(w) > 4} | {w[:5] + "-" for w in plain if len(w) > 5}


def form(text: str, distinct: int) -> list[float]:
    """Length, repetition, capitals and symbols, each about 0 to 1."""
    n = max(1, len(text))
    upper = sum(map(str.isupper, text))
    plain = sum(map(str.isalnum, text)) + sum(map(str.isspace, text))
    return [math.log1p(len(text)) / 12, min(1.0, 3 * distinct / n), upper / n, 1 - plain / n]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.2, rounds: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last weight is the constant, which is hardly penalised."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w.astype(np.float32)).astype(np.float64)
        slope = x.T @ (p - y).astype(np.float32) + penalty * w
        curve = (x * (p * (1 - p)).astype(np.float32)[:, None]).T @ x
        step = np.linalg.solve(curve.astype(np.float64) + np.diag(penalty), slope)
        w -= step
        if np.abs(step).max() < 1e-3:
            break
    return w


def out_of_fold(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    p = np.zeros(len(y))
    for k in range(FOLDS):
        at = fold == k
        if at.any():
            w = fit_linear(x[~at], y[~at])
            p[at] = sigmoid(x[at] @ w[:-1] + w[-1])
    return p


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Cut with the best F1 on out-of-fold predictions, 0.4 at least, so that doubtful documents stay; 0.5 if a class is missing."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    p = p[order]
    f1[:-1][p[:-1] == p[1:]] = 0  # no cut falls between equal scores
    k = int(np.argmax(f1))
    return max(0.4, float((p[k] + p[k + 1]) / 2)) if k + 1 < len(p) else 0.5


def labelled_sample(docs: DataFrame, labels: DataFrame, categories, sample: int) -> DataFrame:
    """(id, y0, y1, ..., words, form) of at most `sample` labelled documents.

    Of repeated labels the largest value of each category holds. A category whose labels are all null is null, and the document no example
    for it. Of rows that repeat an id the text with the smallest hash is taken.
    """
    cats = [F.max(F.when(F.col(c) == v, 1).when(F.col(c).isNotNull(), 0)).alias(f"y{i}") for i, (_, c, v) in enumerate(categories)]
    ids = (
        labels.where("doc_id is not null").groupBy("doc_id").agg(*cats)
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    ids = written(ids, "labelled").select(F.col("doc_id").alias("id"), *[f"y{i}" for i in range(len(cats))])
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("text is not null")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            have = [(t, words(t)) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([list(w) for _, w in have], pa.list_(pa.string())), pa.array([form(t, len(w)) for t, w in have], pa.list_(pa.float64()))],
                names=[*b.schema.names[:-1], "words", "form"],
            )

    ys = [f"y{i}" for i in range(len(cats))]
    # The ids are at most `sample`, so the broadcast has a fixed bound.
    joined = texts.join(F.broadcast(ids), "id").select("id", *ys, "text")
    joined = joined.groupBy("id", *ys).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    schema = "id long, " + ", ".join(f"{y} int" for y in ys) + ", words array<string>, form array<double>"
    return written(joined.mapInArrow(apply, schema), "sampled")


def fit_chain(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample: int = SAMPLE, terms: int = TERMS, least: int = 4) -> Chain:
    """Fits the chain on a bounded sample. Without labelled rows every probability is 0.5 and nothing is flagged."""
    rows = labelled_sample(docs, labels, categories, sample)
    ys = [f"y{i}" for i in range(len(categories))]
    total, *sums = rows.agg(F.count(F.lit(1)), *[F.count(y) for y in ys], *[F.coalesce(F.sum(y), F.lit(0)) for y in ys]).first()
    known, pos = sums[: len(ys)], sums[len(ys) :]
    if not total:
        return Chain({}, tuple(Link(c[0], np.zeros(5 + i), 1.0) for i, c in enumerate(categories)))
    counts = rows.select(*ys, F.explode("words").alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("all"), *[F.coalesce(F.sum(y), F.lit(0)).alias(y) for y in ys], *[F.count(y).alias(f"n{i}") for i, y in enumerate(ys)]
    ).where(F.col("all") >= least)
    chosen: dict[str, int] = {}
    for i, y in enumerate(ys):
        # Likelihood ratio of word and category against independence.
        n, with_word = known[i], F.col(f"n{i}")
        cells = ((F.col(y), pos[i], with_word), (with_word - F.col(y), n - pos[i], with_word), (pos[i] - F.col(y), pos[i], n - with_word), (n - pos[i] - with_word + F.col(y), n - pos[i], n - with_word))
        score = sum((F.when(o > 0, o * F.log(o * n / (col * row))).otherwise(0.0) for o, col, row in cells), F.lit(0.0))
        for r in counts.select("word", score.alias("s")).orderBy(F.desc("s"), "word").limit(terms).collect():
            chosen.setdefault(r.word, len(chosen))
    kept = F.array_intersect("words", F.array(*map(F.lit, chosen)).cast("array<string>"))
    data = sorted(rows.select("id", *ys, kept.alias("words"), "form").collect(), key=lambda r: (r.id, sorted(r.words)))
    x = np.zeros((len(data), len(chosen) + 4), np.float32)
    for k, r in enumerate(data):
        x[k, [chosen[w] for w in r.words]] = 1
        x[k, len(chosen) :] = r.form
    fold = np.array([r.id % 2_147_483_629 % FOLDS for r in data])
    links, features = [], x
    for i, (name, *_) in enumerate(categories):
        y = np.array([np.nan if r[f"y{i}"] is None else r[f"y{i}"] for r in data], float)
        have = ~np.isnan(y)
        w = fit_linear(features[have], y[have])
        # Documents without a label of this category take no part in its fit, so the whole model's prediction is out of sample for them.
        p = sigmoid(features @ w[:-1] + w[-1])
        p[have] = out_of_fold(features[have], y[have], fold[have])
        links.append(Link(name, w, best_threshold(p[have], y[have])))
        features = np.hstack([features, p[:, None].astype(np.float32)])
    return Chain(chosen, tuple(links))


def predict(chain: Chain, text: str | None) -> list[float]:
    """Probability of each category of one whole text; null counts as empty."""
    have = words(text or "")
    measures, out, n = form(text or "", len(have)), [], len(chain.terms)
    at = [chain.terms[w] for w in have & chain.terms.keys()]
    for link in chain.links:
        w = link.weights
        z = w[at].sum() + float(np.dot(w[n : n + 4], measures)) + float(np.dot(w[n + 4 : -1], out)) + w[-1]
        out.append(float(sigmoid(np.array(z))))
    return out


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, then p_<category> and the boolean <category> for each, in chain order.

    Null ids and texts are kept, a null text counting as empty; repeated rows are scored alike. Other columns
    are ignored.
    """
    names = [link.name for link in chain.links]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.array([predict(chain, t) for t in b.column(1).to_pylist()]).reshape(b.num_rows, len(names))
            columns = [b.column(0)]
            for k, link in enumerate(chain.links):
                columns += [pa.array(p[:, k]), pa.array(p[:, k] >= link.threshold)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *[x for n in names for x in (f"p_{n}", n)]])

    schema = "id long, " + ", ".join(f"p_{n} double, {n} boolean" for n in names)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(apply, schema).withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, chain: Chain, category: str = "toxic", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text the chain does not put in the category; all columns as they were, whatever their names.

    Null and empty texts are judged as texts without words. Null ids and repeated rows are judged like any others. No rows give no rows.
    """
    k = [link.name for link in chain.links].index(category)
    fine = free_name(docs, f"keep_{category}")

    @F.pandas_udf("boolean")
    def keep(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([predict(chain, t)[k] < chain.links[k].threshold for t in s], dtype=bool)

    return docs.withColumn(fine, keep(F.col(text_col))).where(F.col(fine)).drop(fine)
