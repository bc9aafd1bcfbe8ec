"""License scan: an exact set-similarity join of text blocks with license templates.

Blocks are windows of words, half of one window in the next, so that whatever a template says in as many words lies whole in one of them. A block matches
a template when it holds at least the threshold of the template's words. Tokens are ordered by their frequency in all blocks, the rarest
first, and a pair can only reach its overlap if prefixes share a token (prefix filter), the block has enough tokens (length filter) and
enough of both follow the first shared one (positional filter). What passes is verified by the overlap itself: the join is exact.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Share of a template's words that a block must hold.
THRESHOLD = 0.85


class Template(NamedTuple):
    """text: words of a notice; names: those of its words that a block must hold whatever else it holds."""

    label: str
    text: str
    names: str = ""


#: Notices of common licenses, in their own words.
TEMPLATES = (
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "licensed under the mit license", "mit license"),
    Template("mit", "distributed under the terms of the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    Template("apache", "licensed under the apache license version 2 0", "apache"),
    Template("apache", "released under the apache license", "apache license"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache"),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public"),
    Template("gpl", "released under the gnu general public license", "gnu general public"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public"),
    Template("agpl", "licensed under the gnu affero general public license", "gnu affero general public"),
    Template("mpl", "licensed under the mozilla public license version 2 0", "mozilla public"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public"),
    Template("bsd", "licensed under the bsd license", "bsd license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission"),
    Template("epl", "licensed under the eclipse public license", "eclipse public"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    Template("cc0", "licensed under cc0 1 0 universal", "cc0"),
    Template("cc0", "dedicated to the public domain under cc0", "cc0"),
    Template("cc-by", "licensed under cc by 4 0", "cc by"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nc-nd", "licensed under cc by nc nd 4 0", "cc by nc nd"),
    Template("cc-by-nc-sa", "licensed under cc by nc sa 4 0", "cc by nc sa"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8: runs of digits, letters and whatever is not ASCII; only A-Z are lower-cased. Null has none."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def phrase_starts(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Every place where the phrase's words stand consecutively, overlaps included."""
    out, at = [], 0
    try:
        while True:
            at = words.index(phrase[0], at)
            if words[at : at + len(phrase)] == phrase:
                out.append(at)
            at += 1
    except ValueError:
        return out


class Sets(NamedTuple):
    """A template as a set: size and least overlap, and the half window that its block classes move by."""

    tid: int
    label: str
    tokens: frozenset[str]
    names: frozenset[str]
    least: int
    step: int


def template_sets(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[Sets]:
    """Windows of a template move by the least power of two, 16 or more, that its words fit in, and are two such steps long."""
    out = []
    for k, t in enumerate(templates):
        words = t.text.split()
        tokens = frozenset(words)
        step = max(16, 1 << (len(words) - 1).bit_length())
        out.append(Sets(k, t.label, tokens, frozenset(t.names.split()), math.ceil(threshold * len(tokens) - 1e-9), step))
    return out


def blocks(docs: DataFrame, sets: list[Sets], phrases=PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: row (unique), id, n_words, n_base, first_word, last_word, base_labels, and the blocks long enough for a template.

    A block is (step, block, tokens): the words from block * step on, two steps long, of which only those that a template of that
    step has are kept, sorted and each once; others add to no overlap.
    """
    phrases = [(p.encode().split(), label) for p, label in phrases]
    classes = []
    for step in sorted({s.step for s in sets}):
        own = [s for s in sets if s.step == step]
        classes.append((step, {t.encode(): t for s in own for t in s.tokens}, min(s.least for s in own)))

    def of(text: str | None) -> tuple:
        words = words_of(text)
        places, labels = [], set()
        for phrase, label in phrases:
            if starts := phrase_starts(words, phrase):
                places += starts
                labels.add(label)
        found = []
        for step, vocabulary, least in classes:
            windows: dict[int, set[str]] = {}
            for at, t in enumerate(map(vocabulary.get, words)):
                if t is not None:
                    k = at // step
                    windows.setdefault(k, set()).add(t)
                    if k:
                        windows.setdefault(k - 1, set()).add(t)
            found += [{"step": step, "block": k, "tokens": sorted(w)} for k, w in sorted(windows.items()) if len(w) >= least]
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), found

    block = pa.list_(pa.struct([("step", pa.int32()), ("block", pa.int64()), ("tokens", pa.list_(pa.string()))]))
    names, types = ("n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"), (*[pa.int64()] * 4, pa.string(), block)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*map(of, b.column(2).to_pylist()))) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(cols, types)]], names=["row", "id", *names])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "row long, id long, n_words long, n_base long, first_word long, last_word long, base_labels string, blocks array<struct<step:int,block:bigint,tokens:array<string>>>"
    # Row numbers hold once they are written, as a task's rows are put down together and once.
    return written(rows.mapInArrow(apply, schema), "blocks")


def _ordered(tokens: Column, ranks: Column) -> Column:
    """Ranks of the tokens, ascending: the rarest first."""
    return F.array_sort(F.transform(tokens, lambda t: ranks[t]))


def matches(found: DataFrame, sets: list[Sets]) -> DataFrame:
    """blocks(row, step, block, tokens) -> (row, step, block, label, containment) of every pair that reaches the template's overlap and holds its names."""
    spark = found.sparkSession
    counted = {r.token: r.n for r in found.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    rank = {t: k for k, t in enumerate(sorted({t for s in sets for t in s.tokens}, key=lambda t: (counted.get(t, 0), t)))}
    ranks = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    prefixes, wholes = [], []
    for s in sets:
        own = sorted(rank[t] for t in s.tokens)
        wholes.append((s.tid, s.label, own, sorted(rank[t] for t in s.names)))
        prefixes += [(s.step, t, s.tid, i, len(own), s.least) for i, t in enumerate(own[: len(own) - s.least + 1])]
    # Both sides of templates are as small as the list of templates.
    index = spark.createDataFrame(prefixes, "step int, rank int, tid int, i int, size int, least int")
    wholes = spark.createDataFrame(wholes, "tid int, label string, own array<int>, names array<int>")
    least = {s.step: min(x.least for x in sets if x.step == s.step) for s in sets}
    shortest = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])[F.col("step")]
    ranked = found.select("row", "step", "block", _ordered(F.col("tokens"), ranks).alias("b"))
    prefix = ranked.select("*", F.posexplode(F.slice("b", 1, F.size("b") - shortest + 1)).alias("j", "rank"))
    pairs = prefix.join(F.broadcast(index), ["step", "rank"]).where(
        (F.size("b") >= F.col("least")) & (F.col("j") <= F.size("b") - F.col("least"))
        & (1 + F.least(F.col("size") - F.col("i") - 1, F.size("b") - F.col("j") - 1) >= F.col("least"))
    )
    pairs = pairs.dropDuplicates(["row", "step", "block", "tid"]).join(F.broadcast(wholes), "tid")
    overlap = F.size(F.array_intersect("b", "own"))
    held = F.size(F.array_intersect("b", "names")) == F.size("names")
    return pairs.where((overlap >= F.col("least")) & held).select("row", "step", "block", "label", "names", (overlap / F.col("size")).alias("containment"))


def named(pairs: DataFrame) -> DataFrame:
    """matches() -> (row, label, containment) without those whose names are a part of the names of another match in the block.

    So a block that holds `cc by nc` is not called `cc by`. A block has no more matches than there are templates.
    """
    held = pairs.groupBy("row", "step", "block").agg(F.collect_set(F.struct("label", "names", "containment")).alias("held"))
    inside = lambda x, y: (F.size(x["names"]) < F.size(y["names"])) & (F.size(F.array_except(x["names"], y["names"])) == 0) & (F.size(x["names"]) > 0)
    own = F.filter("held", lambda x: ~F.exists("held", lambda y: inside(x, y)))
    return held.select("row", F.explode(own).alias("m")).select("row", "m.label", "m.containment")


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of the phrases, first_word and last_word are the smallest and largest start (null where there is none).
    labels adds those of the templates that a block matches, but for names inside longer names; score is the greatest containment of
    these, 0 for none. Labels are distinct, sorted and joined by commas; none is an empty string. Null and empty texts have
    no words. Ids may be null or repeated: each row is judged by itself. Texts are read whole, once. Other columns are ignored. No rows give no rows.
    """
    sets = template_sets(templates, threshold)
    rows = blocks(docs, sets, phrases, id_col, text_col)
    found = rows.select("row", F.explode("blocks").alias("k")).select("row", "k.*")
    labels = named(matches(found, sets)).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("score"))
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    return rows.drop("blocks").join(labels, "row", "left").select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
