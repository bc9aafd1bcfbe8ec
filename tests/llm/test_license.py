import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm.license import PHRASES, TEMPLATES, Template, blocks, matches, scan_licenses, template_sets, words_of
from tessera.llm.queries import ORACLES, op13_license_scans

SETS = template_sets()


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, sets=SETS):
    """All windows against all templates, with no filter."""
    words = plain_words(text)
    places, base = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        for k in range(len(words)):
            if words[k : k + len(p)] == p:
                places.append(k)
                base.add(label)
    labels, score = set(base), 0.0
    for step in {s.step for s in sets}:
        for k in range(0, max(1, len(words)), step):
            window = set(words[k : k + 2 * step])
            held = [s for s in sets if s.step == step and len(window & s.tokens) >= s.least and s.names <= window]
            for s in held:
                if not any(s.names and s.names < o.names for o in held):
                    labels.add(s.label)
                    score = max(score, len(window & s.tokens) / len(s.tokens))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def got(df, **options):
    return [tuple(r) for r in scan_licenses(df, **options).collect()]


def test_query_equals_brute_force_and_sql(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r[0]: tuple(r) for r in op13_license_scans(spark, sf).collect()}
    assert rows == {k: (k, *brute(t)) for k, t in texts.items()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    assert {r[0]: r for r in con.sql(ORACLES["op13_license_scans"]).fetchall()} == rows


@pytest.mark.parametrize("text,labels", [
    ("Released under the MIT License.", "mit"), ("Licensed under the Apache License, Version 2.0.", "apache"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("licensed under CC-BY 4.0", "cc-by"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("licensed under the GNU Lesser General Public License", "gpl,lgpl"),
    ("Released under the Foo License.", ""), ("Licensed under the Foo License, Version 2.0.", ""), ("dual: MIT license. Licensed under the Apache License, Version 2.0", "apache,mit"),
    ("The general public likes a license by the mit.", ""), ("You have no license to be released under the sun.", ""),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted,", "isc"),
])
def test_labels_of_notices(spark, text, labels):
    assert brute(text)[5] == labels
    filler = " ".join(f"wort{k}" for k in range(37))
    assert brute(f"{filler} {text} {filler}")[5] == labels


def test_notices_with_changes_and_line_breaks(spark):
    rng, rows = random.Random(3), []
    for k in range(240):
        t = TEMPLATES[k % len(TEMPLATES)]
        w = t.text.split()
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["other"], [w[at], "new"]])
        noise = lambda: [rng.choice(["the", "of", "é", "license", "under", "zu", "2", "0"]) for _ in range(rng.randint(0, 60))]
        rows.append((k, rng.choice([" ", "\n", ", "]).join(noise() + w + noise()).title()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted(got(df))
    assert found == [(k, *brute(t)) for k, t in rows]
    assert len({r[6] for r in found}) > 8


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_join_is_exact_at_any_threshold(spark, threshold):
    rng = random.Random(4)
    letters = "abcdefghijklmnop"
    templates = [Template(f"t{k}", " ".join(rng.choices(letters, k=rng.randint(1, 12)))) for k in range(12)]
    sets = template_sets(templates, threshold)
    rows = [(k, " ".join(rng.choices(letters + "xyz", weights=range(1, 20), k=rng.randint(0, 60)))) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(got(df, templates=templates, threshold=threshold)) == [(k, *brute(t, sets)) for k, t in rows]
    found = blocks(df, sets).select("row", F.explode("blocks").alias("k")).select("row", "k.*")
    assert matches(found, sets).count() == matches(found, sets).dropDuplicates(["row", "step", "block", "label", "containment"]).count()


def test_odd_rows(spark):
    rows = [(None, None), (None, ""), (1, "MIT License mit license"), (1, "MIT License mit license"), (2, " \n"), (3, "Ä mit License Ünïcode"), (4, "mit license " * 40_000), (None, "GENERAL PUBLIC LICENSE")]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, row int, labels string")
    key = lambda r: str(r)
    assert sorted(got(df), key=key) == sorted([(k, *brute(t)) for k, t in rows], key=key)
    assert got(df.limit(0)) == []
    assert words_of("ÀB c\x00d1_2") == ["À".encode() + b"b", b"c", b"d1", b"2"]
