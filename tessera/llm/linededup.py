"""Substring dedup by unit hashing: repeated passages of lines and sentences go, but for their earliest occurrence.

Units are lines of any length, also in scripts without spaces, and, within them, sentences. A short sentence is hashed together with what stands
before it, so that it counts as repeated only inside a repeated passage. Units are counted by a 64-bit hash first; only
those that occur twice or more travel on with their 128-bit digest. A repeated unit goes if it and the repeated units that adjoin it
are a passage of some words: a stock phrase that stands alone in many documents is no copied passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Words that a sentence needs to be hashed by itself. A line needs none: each that is not blank is a unit.
SENTENCE_WORDS = 8
#: Words of a passage of repeated units that goes; LETTERS characters count as a word at least, for scripts without spaces.
PASSAGE_WORDS, LETTERS = 25, 6
_PIECE = re.compile(r"\S[^\n]*?(?:[.!?]+(?=\s|\Z)|(?=\n|\Z))")


def units(text: str) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, normalised words) of each unit, offsets in code points. Normalised: lower case, single spaces.

    A leading L or S keeps lines and sentences apart, which would else repeat each other in place.
    """
    at = 0
    for line in text.split("\n"):
        w = line.lower().split()
        if w:
            yield at, at + len(line), b"L" + " ".join(w).encode("utf-8", "surrogatepass")
        at += len(line) + 1
    before: list[str] = []
    for m in _PIECE.finditer(text):
        w = m.group().lower().split()
        if len(w) < SENTENCE_WORDS:
            w = before[-(SENTENCE_WORDS - len(w)) :] + w
        before = w if len(w) <= 4 * SENTENCE_WORDS else w[-SENTENCE_WORDS:]
        if len(w) >= SENTENCE_WORDS:
            yield m.start(), m.end(), b"S" + " ".join(w).encode("utf-8", "surrogatepass")


def unit_rows(docs: DataFrame) -> DataFrame:
    """docs(id, key, text) -> (id, key, start, end, d1, d2), the digest as two numbers."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "key", "start", "end", "d1", "d2"]
        for b in batches:
            row, start, end, digest = [], [], [], []
            for k, text in enumerate(b.column(2).to_pylist()):
                for s, e, norm in units(text):
                    row.append(k)
                    start.append(s)
                    end.append(e)
                    digest.append(xxhash.xxh3_128_digest(norm))
            d = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(d[:, 0]), pa.array(d[:, 1])],
                names=names,
            )

    return docs.select("id", "key", "text").mapInArrow(apply, "id long, key long, start int, end int, d1 long, d2 long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """docs(id, key, text) -> (id, key, spans), spans array<struct<start,end,kept_id>> of units that occur earlier.

    Earlier is the smaller (id, key, start), null ids last. A digest that very many documents share is counted by
    partial sums and joined with skew splitting.
    """
    found = written(unit_rows(docs), "units")
    often = written(found.groupBy("d1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d1"), "often")
    again = written(found.join(often, "d1"), "again")
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "key", "start")
    first = written(
        again.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first"
    )
    later = again.join(first, ["d1", "d2"]).where(rank > F.col("first"))
    span = F.struct("start", "end", F.col("first.id").alias("kept_id"))
    return written(later.groupBy("id", "key").agg(F.sort_array(F.collect_set(span)).alias("spans")), "spans")


def passages(text: str, spans: list, least: int = PASSAGE_WORDS) -> list:
    """The spans (start, end, ...) that lie in a passage: spans with nothing but white space between them, together of at least so many words."""
    out, run, end = [], [], -1

    def close() -> None:
        if run:
            inside = text[min(x["start"] for x in run) : end]
            if max(len(inside.split()), sum(not c.isspace() for c in inside) // LETTERS) >= least:
                out.extend(run)

    for x in sorted(spans, key=lambda x: (x["start"], x["end"])):
        if run and x["start"] > end and text[end : x["start"]].strip():
            close()
            run, end = [], -1
        run.append(x)
        end = max(end, x["end"])
    close()
    return out


def cut(text: str, spans: list) -> tuple[str, list[tuple[int, int]]]:
    """text without the spans, and the offsets in the original of what is kept."""
    kept, at = [], 0
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        if s > at:
            kept.append((at, s))
        at = max(at, e)
    if at < len(text):
        kept.append((at, len(text)))
    return "".join(text[s:e] for s, e in kept), kept


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = PASSAGE_WORDS) -> DataFrame:
    """One row per row of docs: id, text without its repeated units in passages of `least` words, removed, kept, n_removed_chars.

    removed holds (start, end, kept_id) of each such unit and kept the (start, end) of what stays, both as offsets in
    the original text. The earliest occurrence by id and offset is kept. Null and empty texts have no units and stay as they
    are. Null ids come last; rows that repeat an id and its text count as one document and come out alike. Other columns
    are ignored. No rows give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    spans = repeated_spans(rows.where("text <> ''")).withColumnRenamed("id", "sid").withColumnRenamed("key", "skey")
    joined = rows.join(spans, (F.col("key") == F.col("skey")) & F.col("id").eqNullSafe(F.col("sid")), "left").select("id", "text", "spans")
    kept_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, removed, kepts, gone = [], [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                removed.append(passages(text or "", spans or [], least))
                new, kept = cut(text or "", removed[-1])
                texts.append(new if text is not None else None)
                kepts.append([{"start": s, "end": e} for s, e in kept])
                gone.append(len(text or "") - len(new))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts, pa.string()), pa.array(removed, b.column(2).type), pa.array(kepts, kept_type), pa.array(gone, pa.int64())],
                names=["id", "text", "removed", "kept", "n_removed_chars"],
            )

    spans_type = "array<struct<start:int,end:int,kept_id:long>>"
    out = joined.withColumn("spans", F.coalesce("spans", F.array().cast(spans_type)))
    schema = f"id long, text string, removed {spans_type}, kept array<struct<start:int,end:int>>, n_removed_chars long"
    return out.mapInArrow(apply, schema).withColumnRenamed("id", id_col)
