"""Document fingerprints: mergeable bottom-k sketches of word-shingle hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts

K = 128
WIDTH = 5
#: Shingles hashed before the sketch so far is cut to k again; bounds memory for very long texts.
PART = 1 << 16
_LEAST = -(1 << 63)


def sketch(text: str | None, k: int = K, width: int = WIDTH) -> np.ndarray:
    """The k smallest distinct 64-bit hashes of the lower-cased text's word shingles, ascending.

    Words are separated by ASCII white space; a text of fewer words than width is one shingle;
    null and wordless texts have an empty sketch. Under k hashes the sketch holds the whole set.
    """
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[-n:].tolist()
    digest, out = xxhash.xxh64_intdigest, np.empty(0, np.uint64)
    for at in range(0, n, PART):
        h = np.array([digest(line[s:e]) for s, e in zip(starts[at : at + PART], ends[at : at + PART])], np.uint64)
        out = merge(out, h, k)
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of two parts."""
    return np.unique(np.concatenate([a, b]))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness, 0 to 1; exact while the union has at most k hashes. Two empty sets are alike."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact under k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return min(1.0, both / distinct_count(a, k))


def to_text(a: np.ndarray) -> str:
    """16 lowercase hex digits for each hash, ascending."""
    return a.astype(">u8").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def edited(text: str, following: str) -> str:
    """text with its last third (rounded down, in code points) replaced by as much of the beginning of `following`."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def sketches(docs: DataFrame, key_col: str, text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """(key, fingerprint): one sketch for each key, merged over all its rows (parts of long documents, or a whole source).

    Each task merges its own rows of a key before the shuffle, so that a key with very many rows
    brings the final merge at most one sketch from a task. Null keys are a key of their own.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have: dict = {}
        for pdf in batches:
            for key, text in zip(pdf["key"].astype(object), pdf["text"]):
                key = None if pd.isna(key) else key
                s = sketch(text, k, width)
                have[key] = merge(have[key], s, k) if key in have else s
            if len(have) > 20_000:
                yield _frame(have)
                have = {}
        if have:
            yield _frame(have)

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.empty(0, np.uint64)
        for x in pdf["fingerprint"]:
            s = merge(s, from_text(x), k)
        return pd.DataFrame({"key": pdf["key"].iloc[:1].to_numpy(), "fingerprint": [to_text(s)]})

    schema = f"key {docs.schema[key_col].dataType.simpleString()}, fingerprint string"
    parts = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text")).mapInPandas(partial, schema)
    return parts.groupBy("key").applyInPandas(final, schema).withColumnRenamed("key", key_col)


def _frame(have: dict) -> pd.DataFrame:
    return pd.DataFrame({"key": pd.Series(list(have), dtype=object), "fingerprint": [to_text(s) for s in have.values()]})


def neighbour_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH, ranges: int | None = None
) -> DataFrame:
    """Each document's fingerprint beside that of its edited text (see edited()) and its likeness to both neighbours.

    The next document is the one that follows in descending id; after the last comes the first.
    Rows are dealt once, to ranges of ids; a range's first rows also go, as guests, to the range
    before, so each task walks its range in order with one document held at a time.
    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and by the same sketches shingles
    (distinct ones, estimated), in_edited and in_next (share of them that the edited text and the next document have).
    Null text counts as empty. Null ids come last. Repeated ids follow in the order of their texts'
    hashes. A single row is its own next. Other columns are ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("key", F.coalesce("id", F.lit(_LEAST))).withColumn("hash", F.xxhash64("text"))
    n = ranges or shuffle_parts(spark)
    known = rows.where("id is not null")
    cuts = np.array(sorted(set(known.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [1.0], 10_000)).first()[0] or [])), np.int64)
    top = len(cuts)

    @F.pandas_udf("int")
    def rank(keys: pd.Series) -> pd.Series:
        return pd.Series(top - np.searchsorted(cuts, keys.to_numpy(np.int64), "left"), dtype="int32")

    # Range 0 has the largest ids. Rows without an id come after all, dealt to n ranges of their texts' hashes.
    step = (1 << 64) // n + 1
    alone = F.lit(top + 1) + F.expr(f"(cast(hash as decimal(20, 0)) + {1 << 63}bd) div {step}bd")
    rows = rows.withColumn("part", F.when(F.col("id").isNull(), alone.cast("int")).otherwise(rank("key")))
    # The first row of a range goes to the range before as a guest: 2 n rows at most, whatever the table's size.
    first = F.min(F.struct((-F.col("key").cast("decimal(20,0)")).alias("down"), "hash"))
    heads = [(r.part, r.first) for r in rows.groupBy("part").agg(first.alias("first")).orderBy("part").collect()]
    at = [(-int(f.down), f.hash, heads[i - 1][0]) for i, (_, f) in enumerate(heads)]
    # Only the range with the ids needs them: a repeated first id and text is sent as often as it occurs, and used once.
    guests = spark.createDataFrame(at, "key long, hash long, before int") if at else spark.createDataFrame([], "key long, hash long, before int")
    rows = rows.join(F.broadcast(guests), ["key", "hash"], "left")
    place = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")), F.struct(F.col("before").alias("part"), F.lit(True).alias("guest")))
    dealt = (
        rows.select("id", "key", "hash", "text", F.explode(place).alias("p"))
        .select(F.col("p.part").alias("part"), F.col("p.guest").alias("guest"), "id", "key", "hash", "text")
        .where("part is not null")
        .repartitionById(n, F.col("part"))
        .sortWithinPartitions("part", "guest", F.desc("key"), "hash")
    )
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shingles double, in_edited double, in_next double"
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 5]
    names = [x.split()[0] for x in schema.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            out = []
            for part, is_guest, id_, text in zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 3))):
                if is_guest and (before is None or before[0] != part):
                    continue
                own = sketch(text, k, width)
                if before is not None and before[0] == part:
                    _, bid, btext, bown = before
                    new = edited(btext, text)
                    snew = sketch(new, k, width)
                    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    near = [resemblance(bown, x, k) for x in (snew, own)]
                    out.append((bid, len(btext), sha, to_text(bown), to_text(snew), *near, distinct_count(bown, k), containment(bown, snew, k), containment(bown, own, k)))
                before = None if is_guest else (part, id_, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return dealt.select("part", "guest", "id", "text").mapInArrow(walk, schema).withColumnRenamed("id", id_col)
