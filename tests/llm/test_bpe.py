import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex

from tessera.llm.bpe import PIECE_CHARS, decode_column, encode, encode_documents, encoder
from tessera.llm.queries import op8_byte_bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


def slow(text, enc):
    return [t for m in regex.findall(P.PATTERN, text) for t in enc._encode_single_piece(m)]


@pytest.mark.parametrize("seed", range(6))
def test_pieces_equal_match_by_match(seed):
    enc, rng = encoder(RANKS, P.PATTERN), random.Random(seed)
    parts = ["don't", " we'll", "'s", " ", "  ", "\n", "\n\n", "\t", "\x0b", "\xa0", " ", "　", "\x1c", "\x85", "12", "é", "日本", "!?", "'", "_", "👍🏽", "abc", "..."]
    text = "".join(rng.choice(parts) for _ in range(3 * PIECE_CHARS))
    assert encode(text, enc).tolist() == enc.encode_ordinary(text)
    assert encode(text[:5000], enc).tolist() == slow(text[:5000], enc)


@pytest.mark.parametrize("text", ["", None, " ", "a", "\ud800".encode("utf-8", "replace").decode(), "x" * 200_000, "the" * 100_000, "1" * 100_000, "!" * 50_000])
def test_odd_texts(text):
    enc = encoder(RANKS, P.PATTERN)
    assert encode(text, enc).tolist() == enc.encode_ordinary(text or "")


def test_runs_of_spaces_beyond_the_regex_stack():
    enc, n = encoder(RANKS, P.PATTERN), 1_200_000
    for text in (" " * n, " " * n + "x", "a" + "\n" * n + "b", "word " * 5000 + " " * n + "  end \n" + "z" * 20_000 + " " * n):
        want = slow(text, enc)
        got = encode(text, enc)
        assert got.tolist() == want
        assert enc.decode_bytes(got.tolist()) == text.encode()


def test_query_equals_library(spark, sf):
    enc = encoder(RANKS, P.PATTERN)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op8_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_nulls_repeats_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "é", 6), (1, "a b", 7), (1, "a b", 7)], "doc_id long, text string, ids int")
    rows = encode_documents(df, RANKS, P.PATTERN)
    got = rows.withColumn("back", decode_column("ids", RANKS, P.PATTERN)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, bytes(r.back)) for r in got) == [(0, 1, "é".encode()), (1, 0, b""), (1, 2, b"a b"), (1, 2, b"a b")]
    assert encode_documents(df.limit(0), RANKS, P.PATTERN).count() == 0
