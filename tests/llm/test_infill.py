import hashlib
import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import infill
from tessera.llm.infill import fill_in_middle, restored_column
from tessera.llm.queries import OP11_SQL, op11_fill_in_middle


def brute(doc_id, text):
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:low]), "".join(u[low:high]), "".join(u[high:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def got(df):
    rows = fill_in_middle(df).withColumn("back", restored_column("output", "form")).collect()
    return sorted(((r.doc_id is not None, r.doc_id or 0), (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.back) for r in rows)


def test_query_equals_brute_force_and_sql(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in op11_fill_in_middle(spark, sf).collect()}
    assert rows.keys() == texts.keys() and {r.form for r in rows.values()} == {"plain", "psm", "spm"}
    for k, t in texts.items():
        want, r = brute(k, t), rows[k]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) == (*want[:4], hashlib.sha256(want[4].encode()).hexdigest())
        assert r.restored_sha256 == hashlib.sha256(t.encode()).hexdigest()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    assert {r[0]: r for r in con.sql(OP11_SQL).fetchall()} == {k: tuple(r) for k, r in rows.items()}


@pytest.mark.parametrize("slice_bytes,slice_rows", [(1, 9), (40, 3), (1000, 4)])
def test_slices_keep_all_rows_in_order(monkeypatch, slice_bytes, slice_rows):
    monkeypatch.setattr(infill, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(infill, "SLICE_ROWS", slice_rows)
    texts = [None, "", "a" * 39, "b", "c" * 500, None, "d", "e" * 40, "f"] * 7
    cut = list(infill.slices(iter([pa.RecordBatch.from_arrays([pa.array(texts[:30], pa.string())], names=["t"]), pa.RecordBatch.from_arrays([pa.array(texts[30:], pa.string())], names=["t"])]), 0))
    assert [t for b in cut for t in b.column(0).to_pylist()] == texts
    assert all(b.num_rows == 1 or b.num_rows <= slice_rows and sum(len(t or "") for t in b.column(0).to_pylist()) <= slice_bytes for b in cut)


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_texts(spark, seed):
    rng = random.Random(seed)
    texts = ["", None, "<P>", "x <M> y", "<", "<S", "é", "\x00\n\r", "👍🏽 日本", "a", "  ", "<<<SSS>>", "l'été\x85 12"]
    texts += ["".join(rng.choices(["abc", " ", "<", "P", ">", "ß", "\n", "9", "🙂"], k=rng.randint(0, 40))) for _ in range(120)]
    rows = [(rng.choice([None, k, 7]), t, "clash", 3) for k, t in enumerate(texts)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    want = sorted((((r[0] is not None, r[0] or 0)), brute(r[0], r[1]), r[1] or "") for r in rows)
    key = lambda r: (r[0], r[2], str(r[1]))
    assert sorted(got(df), key=key) == sorted(want, key=key)
    assert got(df.limit(0)) == []


def test_a_very_long_text(spark):
    df = spark.range(3).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 1, "a").otherwise(F.repeat(F.lit("Wörd 12, <x>"), 300_000)).alias("text"))
    texts = {r.doc_id: r.text for r in df.collect()}
    for (_, k), found, back in got(df):
        assert found == brute(k, texts[k]) and back == texts[k]


def test_nulls_are_not_restored():
    assert infill.restored_batch(pa.array(["a", None], pa.string()), pa.array(["plain", "psm"])).to_pylist() == ["a", None]
