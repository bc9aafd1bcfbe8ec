"""Fill-in-middle: texts cut into units and rearranged batch by batch with pyarrow.compute.

A batch of texts becomes list arrays of units; flattened with their parent indices, units get ordinals, which tell the role of
each (prefix, middle, suffix). Filtering by role and rebuilding the lists gives the pieces, joined again to texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Marks of the three roles.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of text handled at a time (a longer text is handled alone) and most rows.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 1024
#: Kinds of bytes of UTF-8: ASCII letters, those inside a code point, and all others, which begin one.
_LETTER, _INSIDE = 1, 2
_KINDS = np.array([_LETTER if chr(b).isascii() and chr(b).isalpha() else _INSIDE if 0x80 <= b < 0xC0 else 0 for b in range(256)], np.uint8)


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, cut so that a slice has at most SLICE_ROWS rows and SLICE_BYTES bytes of the column, or one row."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            room = (ends[at - 1] if at else 0) + SLICE_BYTES
            end = min(max(at + 1, int(np.searchsorted(ends, room, side="right"))), at + SLICE_ROWS)
            yield b.slice(at, end - at)
            at = end


def _lists(counts, values: pa.Array) -> pa.Array:
    """List array with counts[k] of the values, in order, in row k."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def split_units(texts: pa.Array) -> pa.Array:
    """texts (large binary, no nulls) -> a list of units for each, over the bytes of the texts themselves."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kind = _KINDS[data]
    begins = kind != _INSIDE
    begins[1:] &= (kind[1:] != _LETTER) | (kind[:-1] != _LETTER)
    begins[ends[:-1][ends[:-1] < ends[1:]]] = True  # letters of two texts are no run
    at = np.flatnonzero(begins)
    offsets = np.append(at, len(data)).astype(np.int64)
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return _lists(np.diff(np.searchsorted(at, ends)), flat)


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """texts (large binary, no nulls) -> units of all texts, the row and the ordinal of each, and the number of units by row."""
    split = split_units(texts)
    flat, parent, n = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy(), pc.list_value_length(split).to_numpy().astype(np.int64)
    return flat, parent, np.arange(len(flat)) - (np.cumsum(n) - n)[parent], n


def rearranged(texts: pa.Array, draws: list[np.ndarray], cuts: tuple[int, int]) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars, output of each text; see fill_in_middle()."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    flat, parent, ordinal, n = units(texts)
    h1, h2, h3, h4 = draws
    ends = h1 % (n + 1), h2 % (n + 1)
    low, high = np.minimum(*ends), np.maximum(*ends)
    roles = (ordinal < low[parent], (ordinal >= low[parent]) & (ordinal < high[parent]), ordinal >= high[parent])
    prefix, middle, suffix = (
        pc.binary_join(_lists(np.bincount(parent[role], minlength=len(texts)), flat.filter(pa.array(role))), pa.scalar(b"", pa.large_binary())) for role in roles
    )
    marked = pc.or_(pc.or_(pc.match_substring(texts, PREFIX.decode()), pc.match_substring(texts, SUFFIX.decode())), pc.match_substring(texts, MIDDLE.decode()))
    plain = pc.or_(pc.or_(pc.equal(pc.binary_length(texts), 0), marked), pa.array(h3 % 100 >= cuts[0]))
    spm = pa.array(h4 % 100 < cuts[1])
    of = lambda x: pa.scalar(x, pa.large_binary())
    psm_text = pc.binary_join_element_wise(of(PREFIX), prefix, of(SUFFIX), suffix, of(MIDDLE), middle, of(b""))
    spm_text = pc.binary_join_element_wise(of(SUFFIX), suffix, of(PREFIX), prefix, of(MIDDLE), middle, of(b""))
    chars = lambda piece: pc.if_else(plain, None, pc.cast(pc.utf8_length(piece.cast(pa.large_string())), pa.int64()))
    return {
        "n": pa.array(n, pa.int64()), "form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")), "prefix_chars": chars(prefix), "middle_chars": chars(middle),
        "output": pc.if_else(plain, texts, pc.if_else(spm, spm_text, psm_text)).cast(pa.large_string()).cast(pa.string()),
    }


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", keep_plain: int = 90, spm_below: int = 20) -> DataFrame:
    """One row per row of docs: id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output.

    A unit is a run of ASCII letters or one other code point. Four numbers drawn from the sha256 of `seed:id` cut the units twice and choose
    the form: plain for an empty text, one that holds a mark, and where the third is at least keep_plain of 100; else spm where the fourth is
    below spm_below of 100. Null text counts as empty; a null id is drawn as the empty string. Rows that repeat an id and text give the same
    output, each its own row. Cuts may meet each other or an end: then pieces are empty. Lengths count code points. Other columns are ignored.
    No shuffle; a task holds one slice of texts at a time. No rows give no rows.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"_h{k}") for k in range(4)]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *draws)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            out = rearranged(b.column(1), [b.column(2 + k).to_numpy() for k in range(4)], (keep_plain, spm_below))
            yield pa.RecordBatch.from_arrays([b.column(0), *out.values()], names=["id", *out])

    schema = "id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(apply, schema).withColumnRenamed("id", id_col)


def restored_batch(output: pa.Array, form: pa.Array) -> pa.Array:
    """Texts of outputs and their forms; null gives null."""
    output = output.cast(pa.large_binary())

    def cut(texts: pa.Array, mark: bytes) -> tuple[pa.Array, pa.Array]:
        # At the first mark, which every text here has: a text with a mark of its own is always plain.
        halves = pc.list_flatten(pc.split_pattern(texts, mark, max_splits=1))
        return halves.take(pa.array(np.arange(0, len(halves), 2))), halves.take(pa.array(np.arange(1, len(halves), 2)))

    def rebuilt(rows: pa.Array, first: bytes, second: bytes) -> pa.Array:
        a, rest = cut(cut(rows, first)[1], second)
        b, middle = cut(rest, MIDDLE)
        prefix, suffix = (a, b) if first == PREFIX else (b, a)
        return pc.binary_join_element_wise(prefix, middle, suffix, pa.scalar(b"", pa.large_binary()))

    kinds = [pc.fill_null(pc.and_(pc.equal(form, kind), pc.is_valid(output)), False) for kind in ("psm", "spm")]
    rest = pc.invert(pc.or_(*kinds))
    parts = [rebuilt(output.filter(kinds[0]), PREFIX, SUFFIX), rebuilt(output.filter(kinds[1]), SUFFIX, PREFIX), output.filter(rest)]
    order = np.concatenate([np.flatnonzero(k.to_numpy(zero_copy_only=False)) for k in (*kinds, rest)])
    return pa.concat_arrays(parts).take(pa.array(np.argsort(order))).cast(pa.large_string()).cast(pa.string())


def restored_column(output, form):
    """Column of the exact texts rebuilt from the columns output and form of fill_in_middle(); a null of either gives null."""

    @arrow_udf("string")
    def restore(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for o, f in parts:
            rows = pa.RecordBatch.from_arrays([pc.if_else(pc.is_valid(f), o, None), f], names=["output", "form"])
            done = [restored_batch(b.column(0), b.column(1)) for b in slices(iter([rows]), 0)]
            yield pa.concat_arrays(done) if done else pa.array([], pa.string())

    return restore(output, form)
