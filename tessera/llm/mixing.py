"""Mixing to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Documents are counted in tokens of a byte-level BPE and put to topics by what tokens they use. They are summed to cells of source,
language and topic. Languages have named categories and one for all others, topics a fixed number; every source is a
category, a row of a table with the tokens of its languages and topics. Raking brings the cells' token weights to all three
marginals: a round is a pass over that table, of which the sums by language and topic reach the driver, bounded
however large the corpus is. Each document is then kept with the probability of its cell, by a hash of its id and text, so
that a re-run keeps the same ones.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SLICE, encode, encoder
from .common import written

#: Sources without a name and languages that have no target of their own.
OTHER = "other"
#: Target shares by language; what is not named shares the rest.
LANGUAGES = {"en": 0.54, "de": 0.15, "fr": 0.15, "es": 0.15}
#: Topics, and the numbers that a document's token counts are projected to for them.
TOPICS, SKETCH = 8, 16
#: Sources and topics are brought to shares in proportion to this power of their tokens.
TEMPER = 0.8
#: Share of all tokens that the mixture holds.
BUDGET = 0.8
SEED = 17
#: Token ids share so many rows of the projection.
_ROWS = 4096


def token_sketch(ids: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Unit vector of the projected square roots of the token counts; all 0 for no tokens."""
    counts = np.sqrt(np.bincount(ids % _ROWS, minlength=_ROWS))
    v = counts @ projection
    n = np.linalg.norm(v)
    return v / n if n else v


def measured(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc, tokens, sketch) of every row, doc a struct of its columns as they are; a null text has no tokens."""
    projection, text = np.random.default_rng(SEED).standard_normal((_ROWS, SKETCH)), docs.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file, pattern)
        for b in (big.slice(at, SLICE) for big in batches for at in range(0, big.num_rows, SLICE)):
            ids = [encode(t, enc) for t in b.column(0).field(text).to_pylist()]
            sketches = np.stack([token_sketch(x, projection) for x in ids])
            flat = pa.ListArray.from_arrays(np.arange(0, sketches.size + 1, SKETCH, dtype=np.int32), sketches.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), flat], names=["doc", "tokens", "sketch"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return rows.mapInArrow(apply, rows.select("doc", F.lit(0).cast("long").alias("tokens"), F.array(F.lit(0.0)).alias("sketch")).schema)


def _sums_by(rows: DataFrame, n: int, number) -> np.ndarray:
    """Sums and counts of vectors by number: number(frame) -> (0 .. n - 1, vectors) of a batch; n x (SKETCH + 1) numbers reach the driver."""
    names = [f"v{i}" for i in range(SKETCH + 1)]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, SKETCH + 1))
        for pdf in batches:
            if len(pdf):
                k, x = number(pdf)
                for j in range(SKETCH):
                    total[:, j] += np.bincount(k, x[:, j], n)
                total[:, SKETCH] += np.bincount(k, minlength=n)
        yield pd.DataFrame(total, columns=names).assign(k=range(n))

    parts = rows.where("tokens > 0").select("sketch", "l").mapInPandas(apply, ", ".join(f"{x} double" for x in names) + ", k long")
    out = np.zeros((n, SKETCH + 1))
    for r in parts.groupBy("k").agg(*[F.sum(x).alias(x) for x in names]).collect():
        out[r.k] = [r[x] for x in names]
    return out


class Topics:
    """Spherical k-means over the sketches of all rows(sketch, l, tokens), taken apart from the mean of their language.

    Without that, topics would be the languages over again. The rounds begin with the means by the signs of the first numbers; a
    centre without rows stays where it is. Of equally near centres the first is taken.
    """

    def __init__(self, rows: DataFrame, languages: list[str], topics: int, rounds: int = 8):
        at = self.at = {x: k for k, x in enumerate(languages)}
        found = _sums_by(rows, len(languages), lambda pdf: (pdf["l"].map(at).to_numpy(), np.stack(pdf["sketch"].to_numpy())))
        means = self.means = found[:, :SKETCH] / np.maximum(1, found[:, SKETCH:])
        apart = lambda pdf: Topics.apart(pdf["sketch"], pdf["l"], at, means)
        bits = max(1, (topics - 1).bit_length())
        powers, centres = 1 << np.arange(bits), None
        for _ in range(rounds + 1):
            if centres is None:
                pick = lambda pdf: ((((x := apart(pdf))[:, :bits] > 0) @ powers) % topics, x)
            else:
                pick = lambda pdf, c=centres: (Topics.nearest(x := apart(pdf), c), x)
            found = _sums_by(rows, topics, pick)
            size = np.linalg.norm(found[:, :SKETCH], axis=1, keepdims=True)
            fresh = np.divide(found[:, :SKETCH], size, out=np.zeros((topics, SKETCH)), where=size > 0)
            fresh = fresh if centres is None else np.where(size > 0, fresh, centres)
            if centres is not None and np.abs(fresh - centres).max() < 1e-4:
                break
            centres = fresh
        self.centres = centres

    @staticmethod
    def apart(sketches: pd.Series, languages: pd.Series, at: dict[str, int], means: np.ndarray) -> np.ndarray:
        x = np.stack(sketches.to_numpy()) - means[languages.map(at).to_numpy()]
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x), where=n > 1e-12)

    @staticmethod
    def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.argmax(np.round(x @ centres.T, 9), axis=1)

    def of(self, sketch, language):
        """Column of topic names t0, t1, ..."""
        at, means, centres = self.at, self.means, self.centres

        @F.pandas_udf("string")
        def topic(s: pd.Series, l: pd.Series) -> pd.Series:
            return pd.Series([f"t{k}" for k in Topics.nearest(Topics.apart(s, l, at, means), centres)] if len(s) else [], dtype=object)

        return topic(sketch, language)


def rake(tokens: np.ndarray, targets: list[np.ndarray], rounds: int = 200, tolerance: float = 1e-10) -> np.ndarray:
    """Token weights with the given marginals, in the cells that have tokens; axis k has the shares targets[k].

    Shares of categories without any tokens are spread over the others in proportion. Where the empty cells let no
    weights fit all marginals, the last dimension fits exactly and the others as near as the rounds came.
    """
    w = tokens.astype(float)
    if not w.sum():
        return w
    axes = range(w.ndim)
    goals = []
    for k in axes:
        there = w.sum(axis=tuple(a for a in axes if a != k)) > 0
        t = np.where(there, targets[k], 0.0)
        t = np.where(there, 1.0, 0.0) if not t.sum() else t
        goals.append(t / t.sum() * w.sum())
    for _ in range(rounds):
        worst = 0.0
        for k in axes:
            have = w.sum(axis=tuple(a for a in axes if a != k))
            factor = np.divide(goals[k], have, out=np.ones_like(have), where=have > 0)
            worst = max(worst, float(np.abs(factor[have > 0] - 1).max(initial=0.0)))
            w = w * factor.reshape([-1 if a == k else 1 for a in axes])
        if worst < tolerance:
            break
    return w


def probabilities(tokens: np.ndarray, weights: np.ndarray, budget: float) -> np.ndarray:
    """Probability of each cell, in proportion to weight over tokens where that is under 1, so that about budget tokens are kept."""
    ratio = np.divide(weights, tokens, out=np.zeros_like(weights), where=tokens > 0)
    if budget >= tokens.sum():
        return np.where(ratio > 0, 1.0, 0.0)
    # The kept tokens grow with the scale; where cells are full, the scale of the others is larger.
    low, high = 0.0, 1.0
    while (tokens * np.minimum(1, ratio * high)).sum() < budget and high < 1e12:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if (tokens * np.minimum(1, ratio * mid)).sum() > budget else (mid, high)
    return np.minimum(1, ratio * high)


def _sums(table: DataFrame, n: int, part) -> np.ndarray:
    """Sum over the table of part(tokens, goal), a vector of n numbers for each batch of sources; n numbers reach the driver."""

    def of(b: pd.DataFrame) -> np.ndarray:
        return part(np.stack(b["tokens"].to_numpy()), b["goal"].to_numpy()) if len(b) else np.zeros(n)

    names = [f"v{k}" for k in range(n)]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([sum((of(b) for b in batches), np.zeros(n))], columns=names)

    sums = table.mapInPandas(apply, ", ".join(f"{x} double" for x in names)).agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in names])
    return np.array(sums.first())


def _ratios(tokens: np.ndarray, goal: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Weight over tokens of each cell with the logarithms of the factors by topic and language, sources brought to their goals."""
    z = np.where(tokens > 0, logs, -np.inf)
    top = z.max(axis=1, keepdims=True)
    e = np.exp(z - np.where(np.isfinite(top), top, 0.0))
    have = (tokens * e).sum(axis=1)
    return e * np.divide(goal, have, out=np.zeros_like(have), where=have > 0)[:, None]


def rake_sources(table: DataFrame, targets: list[np.ndarray], rounds: int = 200, tolerance: float = 1e-10):
    """rake() for a table(goal, tokens): the goals of all sources and the tokens of each by topic and language.

    Gives a function (tokens, goal) -> weight over tokens of the cells. Sources are the first dimension, languages the last. Rounds end
    when all marginals are met or, where they can't be, when rounds come no nearer.
    """
    shape = tuple(map(len, targets))
    n = shape[0] * shape[1]
    there = _sums(table, n, lambda t, g: t.sum(axis=0)).reshape(shape)
    goals = []
    for k in (0, 1):
        some = there.sum(axis=1 - k) > 0
        t = np.where(some, targets[k], 0.0)
        t = np.where(some, 1.0, 0.0) if not t.sum() else t
        goals.append(t / max(1e-300, t.sum()) * there.sum())
    logs, last, before = np.zeros(n), np.ones(n), np.inf
    for _ in range(rounds):
        with np.errstate(divide="ignore"):
            logs = logs + np.log(last)
        w = _sums(table, n, lambda t, g: (t * _ratios(t, g, logs)).sum(axis=0)).reshape(shape)
        # How far the sources were from their goals before they were brought there shows in the steps of the others.
        worst, change = 0.0, np.ones(shape)
        for k in (0, 1):
            have = w.sum(axis=1 - k)
            step = np.divide(goals[k], have, out=np.ones_like(have), where=have > 0)
            worst = max(worst, float(np.abs(step[have > 0] - 1).max(initial=0.0)))
            step = step.reshape([-1, 1] if k == 0 else [1, -1])
            w, change = w * step, change * step
        last = change.ravel()
        if worst < tolerance or abs(worst - before) < tolerance:
            break
        before = worst
    return lambda t, g: _ratios(t, g, logs) * last


def scale_of(table: DataFrame, ratios, budget: float) -> float:
    """The scale at which min(1, scale * weight over tokens) of all cells keeps budget tokens; see probabilities().

    Kept tokens are a concave function of the scale, linear between cells that fill: Newton's steps from below reach it.
    """
    scale = 0.0
    for _ in range(100):

        def part(t: np.ndarray, g: np.ndarray) -> np.ndarray:
            ratio = ratios(t, g)
            full = ratio * scale >= 1
            return np.array([t[full].sum(), (t * ratio)[~full].sum()])

        full, rest = _sums(table, 2, part)
        nxt = (budget - full) / rest if rest > 0 else scale
        if nxt <= scale * (1 + 1e-13):
            break
        scale = nxt
    return scale


def mix(
    docs: DataFrame, rank_file: str, pattern: str, languages: Mapping[str, float] = LANGUAGES, topics: int = TOPICS,
    sources: Mapping[str, float] | None = None, temper: float = TEMPER, budget: float = BUDGET, seed: int = SEED,
) -> DataFrame:
    """(doc, tokens, topic, probability, sampled) of every row of docs, doc a struct of its columns.

    tokens are those of the rank file; topics come from clusters of the documents' tokens, and each is brought to a share in proportion to its
    tokens ** temper. sources are target shares by name; without them every source is brought to a share in proportion to tokens ** temper.
    Null sources and null and unnamed languages belong to `other`, whose target is what the named ones leave of 1 (or,
    where every source has one, its tokens ** temper); a source that is really called `other` is one with them. A null text has no tokens,
    the topic of an empty one, and is kept. Sampling is by a hash of doc_id and text, so that rows which repeat both are kept or left together.
    Other columns may have any name. No rows give no rows.
    """
    of = lambda c, names: F.when(F.col(c).isin(names), F.col(c)).otherwise(F.lit(OTHER)) if names else F.lit(OTHER)
    source = F.coalesce("doc.source", F.lit(OTHER)) if sources is None else of("doc.source", list(sources))
    names = [f"t{k}" for k in range(topics)]
    axes = [names, [*dict.fromkeys([*languages, OTHER])]]
    rows = written(measured(docs, rank_file, pattern), "measured").withColumn("l", of("doc.lang", list(languages)))
    found = Topics(rows, axes[1], topics)
    rows = rows.select("doc", "tokens", found.of(F.col("sketch"), F.col("l")).alias("topic"), source.alias("s"), "l")
    cells = written(rows.groupBy("s", "l", "topic").agg(F.sum("tokens").alias("n")).where("n > 0"), "cells")
    have = {r.topic: float(r.n) ** temper for r in cells.groupBy("topic").agg(F.sum("n").alias("n")).collect()}
    # Languages come last: where topics and languages can't both be met, the named targets of the languages are.
    targets = [np.array([have.get(x, 0.0) for x in names]), np.array([languages.get(x, max(0.0, 1 - sum(languages.values()))) for x in axes[1]])]
    at = list(itertools.product(*axes))
    each = [F.coalesce(F.sum(F.when((F.col("topic") == x) & (F.col("l") == y), F.col("n"))), F.lit(0)).cast("double") for x, y in at]
    table = cells.groupBy("s").agg(F.sum("n").alias("t"), F.array(*each).alias("tokens"))
    if sources is None:
        share = F.pow(F.col("t").cast("double"), F.lit(float(temper)))
    else:
        shares = {OTHER: max(0.0, 1 - sum(sources.values()))} | dict(sources)
        share = F.create_map(*[F.lit(x) for kv in shares.items() for x in (kv[0], float(kv[1]))])[F.col("s")]
    table = written(table.withColumn("share", share), "sources")
    sums = table.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("t"), F.coalesce(F.sum("share"), F.lit(0.0)).alias("share")).first()
    total = float(sums.t)
    even = F.lit(total) / F.lit(float(max(1, table.count()))) if not sums.share else F.col("share") / F.lit(sums.share) * F.lit(total)
    table = written(table.select("s", "tokens", even.alias("goal")), "goals")
    ratios = rake_sources(table, targets)
    whole = budget >= 1
    scale = 0.0 if whole else scale_of(table, ratios, budget * total)

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                tokens = np.stack(b["tokens"].to_numpy())
                ratio = ratios(tokens, b["goal"].to_numpy())
                p = np.where(ratio > 0, 1.0, 0.0) if whole else np.minimum(1, ratio * scale)
                i, j = np.nonzero(tokens > 0)
                yield pd.DataFrame({"s": b["s"].to_numpy()[i], "topic": [at[k][0] for k in j], "l": [at[k][1] for k in j], "p": p[i, j]})

    cell = written(table.mapInPandas(known, "s string, topic string, l string, p double"), "probabilities")
    joined = rows.join(cell, ["s", "l", "topic"], "left")
    unit = F.shiftrightunsigned(F.xxhash64("doc.doc_id", "doc.text", F.lit(seed)), 11) / float(1 << 53)
    probability = F.coalesce("p", F.lit(1.0))  # cells without tokens hold empty documents only
    return joined.select("doc", "tokens", "topic", probability.alias("probability"), (unit < probability).alias("sampled"))


def sampled(docs: DataFrame, rank_file: str, pattern: str, **options) -> DataFrame:
    """The documents that mix() keeps, with the columns of docs."""
    return mix(docs, rank_file, pattern, **options).where("sampled").select("doc.*")
