"""Byte-level BPE with the tiktoken library, a local rank file and safe pre-splitting of long texts."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Texts longer than this are cut at match boundaries into pieces of about this many characters.
PIECE_CHARS = 1 << 14
#: Rows decoded, encoded and sent back at a time.
SLICE = 256
#: What the regex engine's \s matches (the Unicode White_Space property), as a fixed value.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: A match never spans a non-space followed by a space: the place before that space is a safe boundary.
_BOUNDARY = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
_RUN = re.compile(f"[{SPACE}]+")


@functools.lru_cache(maxsize=4)
def encoder(rank_file: str, pattern: str):
    """The tiktoken encoder of a rank file, built once in each worker process. No special tokens."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("tessera", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, enc) -> np.ndarray:
    """Token ids of a whole text as little-endian unsigned 32-bit integers; null and empty give none.

    The pattern is that of byte-level BPE with an optional leading space per word. Long texts are
    encoded piece by piece, cut before a space that follows a non-space. A run of more than
    PIECE_CHARS spaces, on which the regex engine would run out of stack, is one match by
    the pattern but for its last character if a non-space follows, and is encoded as such.
    """
    if not text:
        return np.empty(0, "<u4")
    if len(text) <= PIECE_CHARS:
        return np.array(enc.encode_ordinary(text), "<u4")
    out, at = [], 0
    while at < len(text):
        run = _RUN.match(text, at)
        if run and run.end() - at > PIECE_CHARS:
            end = run.end() - (run.end() < len(text))
            out.append(np.array(enc._encode_single_piece(text[at:end]), "<u4"))
        else:
            cut = _BOUNDARY.search(text, at + PIECE_CHARS)
            end = cut.start() if cut else len(text)
            # A long run of spaces begins at a boundary, so it can only lie inside this piece if a boundary does.
            for r in _RUN.finditer(text, at, end):
                if r.end() - r.start() > PIECE_CHARS:
                    end = r.start()
                    break
            out.append(np.array(enc.encode_ordinary(text[at:end]), "<u4"))
        at = end
    return np.concatenate(out)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens long, ids binary (little-endian unsigned 32-bit integers).

    Null text counts as empty: no tokens, empty ids. Ids may be null or repeated; each row is encoded
    by itself. Other columns are ignored. No shuffle: a task streams its batches.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file, pattern)
        for b in (big.slice(at, SLICE) for big in batches for at in range(0, big.num_rows, SLICE)):
            ids = [encode(t, enc) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                names=["id", "n_tokens", "ids"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(apply, "id long, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode_column(ids, rank_file: str, pattern: str):
    """Raw bytes of a column of binary ids; null gives null. Bytes, as one id may hold part of a character."""

    @pandas_udf("binary")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(rank_file, pattern)
        for s in parts:
            yield pd.Series([None if x is None else enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in s], dtype=object)

    return decode(ids)
