import random

from tessera.llm.linededup import cut, dedup_lines, passages, units


def slow_units(text):
    """Units by walking the characters: every line that is not blank, and every sentence with the words before it that make it eight."""
    out, at = [], 0
    for line in text.split("\n"):
        if line.split():
            out.append((at, at + len(line), b"L" + " ".join(line.lower().split()).encode()))
        # Sentences end after . ! ? before white space or the end of the line.
        k = 0
        while k < len(line):
            while k < len(line) and line[k].isspace():
                k += 1
            if k == len(line):
                break
            e = k + 1
            while e < len(line) and not (line[e - 1] in ".!?" and e - 1 > k and line[e].isspace()):
                e += 1
            out.append((at + k, at + e, line[k:e].lower().split()))
            k = e
        at += len(line) + 1
    before, done = [], []
    for s, e, x in out:
        if isinstance(x, list):
            w = x if len(x) >= 8 else before[len(before) - min(len(before), 8 - len(x)) :] + x
            before = w if len(w) <= 32 else w[-8:]
            if len(w) >= 8:
                done.append((s, e, b"S" + " ".join(w).encode()))
        else:
            done.append((s, e, x))
    return done


def test_units_equal_slow_ones(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["", "a", "One. two three! four\nfive six seven eight nine ten? eleven", "...\n. .\n a.b c.  d", "x. " * 40, "\n\n", "é\u00a0ü. z " * 9]
    for t in texts:
        assert sorted(units(t)) == sorted(slow_units(t)), t[:200]


def slow_passages(text, spans, least):
    """Spans in runs of marked characters, white space between two marked ones marked too, of enough words."""
    mark = [False] * len(text)
    for x in spans:
        mark[x["start"] : x["end"]] = [True] * (x["end"] - x["start"])
    k = 0
    while k < len(text):
        if not mark[k] and text[k].isspace():
            e = k
            while e < len(text) and not mark[e] and text[e].isspace():
                e += 1
            if k and e < len(text) and mark[k - 1] and mark[e]:
                mark[k:e] = [True] * (e - k)
            k = e
        else:
            k += 1
    start, end = {}, {}
    for k in range(len(text)):
        start[k] = start[k - 1] if k and mark[k] and mark[k - 1] else k
    for k in reversed(range(len(text))):
        end[k] = end[k + 1] if k + 1 < len(text) and mark[k] and mark[k + 1] else k + 1
    sizes = {}
    for x in spans:
        a, b = start[x["start"]], end[x["end"] - 1]
        if (a, b) not in sizes:
            sizes[a, b] = max(len(text[a:b].split()), len("".join(text[a:b].split())) // 6)
        x["size"] = sizes[a, b]
    return [x for x in spans if x["size"] >= least]


def brute(rows, least=25):
    """(id, text) -> {id: (text, removed)} by a dictionary of normalised units in order of id."""
    first, out = {}, {}
    for i, text in sorted(rows):
        spans = []
        for s, e, norm in sorted(units(text or ""), key=lambda u: u[0]):
            if norm in first and first[norm] != (i, s):
                spans.append({"start": s, "end": e, "kept_id": first[norm][0]})
            else:
                first[norm] = (i, s)
        spans = slow_passages(text or "", spans, least)
        out[i] = (cut(text or "", spans)[0] if text is not None else None, sorted({(x["start"], x["end"], x["kept_id"]) for x in spans}))
    return out


def result(df):
    return {r.doc_id: (r.text, [tuple(x) for x in r.removed]) for r in df.collect()}


def test_units_have_true_offsets():
    text = "One two three four five six seven eight. Short one! And\nlong line of five words here\n\nno end at all in this last line of it"
    got = list(units(text))
    assert all(norm[1:].decode().endswith(" ".join(text[s:e].lower().split())) for s, e, norm in got)
    assert text[got[1][0] : got[1][1]] == "long line of five words here"
    assert any(n == b"Sthree four five six seven eight. short one!" for _, _, n in got)


def test_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for least in (1, 25):
        want = brute(rows, least)
        assert result(dedup_lines(docs, least=least)) == want
        assert any(spans for _, spans in want.values())


def repeated_words(texts, n):
    """Ids of the texts that hold a series of n words which another text holds too."""
    seen, out = {}, set()
    for i, t in texts.items():
        w = t.lower().split()
        for k in range(len(w) - n + 1):
            j = seen.setdefault(hash(tuple(w[k : k + n])), i)
            if j != i:
                out |= {i, j}
    return out


def test_documents_without_a_repeated_passage_are_left_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    # What a document repeats of itself goes by right, too.
    removed = {i: sum(e - s for s, e, k in r if k != i) for i, (_, r) in result(dedup_lines(docs)).items()}
    copied = repeated_words(texts, 50)
    shared = repeated_words(texts, 20)
    clean = [i for i in texts if i not in shared]
    assert sum(not removed[i] for i in clean) > 0.97 * len(clean) > 4000
    # Of the documents with a passage of 50 words that another has, all but the first holders lose it.
    assert sum(removed[i] > 0 for i in copied) > 0.5 * len(copied)


def test_planted_passages_go_and_clean_text_stays(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(4, 15))) + "."
    passage = " ".join(sentence() for _ in range(8))
    own = [[sentence() for _ in range(6)] for _ in range(9)]
    rows = [(i, "\n".join(own[i][:3]) + ("\n" if i % 2 else " ") + (passage if i in (2, 5, 7) else "") + " " + " ".join(own[i][3:])) for i in range(9)]
    got = result(dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    for i, text in rows:
        if i in (5, 7):
            assert len(got[i][0]) < len(text) - 0.8 * len(passage) and all(k == 2 for *_, k in got[i][1])
            assert all(s in got[i][0] for s in own[i][:3])
        else:
            assert got[i][0] == text


def test_odd_rows(spark):
    line = "this very line has more than five words in it and goes on with so many more of them that it is a passage all by itself"
    rows = [(3, line), (1, line.upper() + "\n" + line), (None, line), (4, None), (5, ""), (3, line), (6, "\n\n . !\n"), (7, "a " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as key", "3 as spans")
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.text, r.n_removed_chars) for r in dedup_lines(df).collect())
    assert [(i[1], t, n) for i, t, n in got] == [
        (1, line.upper() + "\n", len(line)), (3, "", len(line)), (3, "", len(line)), (4, None, 0), (5, "", 0), (6, "\n\n . !\n", 0), (7, "a " * 200_000, 0), (0, "", len(line)),
    ]
    assert dedup_lines(df.limit(0)).count() == 0


def test_stock_phrases_stay_and_unspaced_passages_go(spark):
    rights, han, url = "All rights reserved.", "この文章には空白がまったくありません。" * 9, "https://a.example/" + "q" * 190
    rows = [(i, f"own words {i} stand before it\n{rights}\nhere {i}\n{han}\n{rights}\nfar {i}\n{url}\nend of {i}") for i in range(3)]
    got = result(dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[0][0] == rows[0][1]
    for i in (1, 2):
        # The phrase goes where it adjoins a copied passage.
        assert got[i][0] == f"own words {i} stand before it\n{rights}\nhere {i}\n\n\nfar {i}\n\nend of {i}" and {k for *_, k in got[i][1]} == {0}


def test_passages_are_counted_across_units():
    text = "one two three.  four five six\nseven x eight nine"
    spans = [{"start": 0, "end": 14}, {"start": 16, "end": 29}, {"start": 30, "end": 35}, {"start": 38, "end": 48}]
    assert passages(text, spans, 7) == spans[:3] and passages(text, spans, 8) == [] and passages(text, spans, 2) == [s for s in spans]
    assert passages("", [], 1) == []
