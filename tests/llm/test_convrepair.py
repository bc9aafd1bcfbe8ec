import hashlib
import itertools
import random
import re
import zlib

import pytest

from tessera.llm.convrepair import SuffixAutomaton, audits, repair_conversations
from tessera.llm.queries import op12_conversation_repair

SPACE = " \t\n\x0b\x0c\r"


def brute_edits(rows):
    """(cost, audit, repaired) of rows (role, text, fault) by trying all edits from the end; a separate, plain version."""
    legal = re.compile(r"(s?(ua)+)?")
    prefix_ok = re.compile(r"(s?(ua)*u?)?")
    # The cheapest way to every last initial so far; whether a beginning can be continued depends on nothing else.
    fold = lambda s: s[-1:]
    states = [(0, "", (), "")]

    def grow(found):
        out = list(found)
        for _ in range(2):
            out += [(c + 3, a + "I", (*r, (x, "")), s + x[0]) for c, a, r, s in out for x in ("user", "assistant") if prefix_ok.fullmatch(s + x[0])]
        least = {}
        for c, a, r, s in out:
            k = fold(s)
            if k not in least or (c, a) < least[k][:2]:
                least[k] = (c, a, r, s)
        return list(least.values())

    states = grow(states)
    for role, text, fault in rows:
        nxt = []
        for c, a, r, s in states:
            nxt.append((c + 4, a + "D", r, s))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                for x, cost, letter in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    if prefix_ok.fullmatch(s + x[:1]) and x[:1]:
                        nxt.append((c + cost + more, a + letter, (*r, (x, text)), s + x[0]))
        states = grow(nxt)
    ends = [x for x in states if legal.fullmatch(x[3])]
    return min(ends)


def brute(table):
    """Every conversation of (conv_id, turn, role, text) rows by the contract's words."""
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        space = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        turns = [r[0] for r in rows if r[0] is not None]
        counts, seen, judged = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, role, text in rows:
            bare = text.rstrip(SPACE)
            fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            judged.append((role, text, fault))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(judged))
        cost, audit, rep, _ = brute_edits(judged)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(), illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rep).encode()).hexdigest(),
        )
    return out


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


@pytest.mark.parametrize("length", range(5))
def test_automaton_equals_brute_force_on_all_short_signatures(length):
    alphabet = "xsuaoSUAO"
    many = sorted("".join(s).encode() for s in itertools.product(alphabet, repeat=length)) if length < 4 else sorted(
        "".join(random.Random(k).choices(alphabet, k=7)).encode() for k in range(300)
    )
    nodes = SuffixAutomaton()
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
    for reverse in many:
        nodes.read(reverse)
        rows = [(roles[c.lower()], "t", "blank" if c == "x" else "truncated" if c.isupper() else None) for c in reversed(reverse.decode())]
        assert nodes.answer() == brute_edits(rows)[:2]


def test_nodes_are_made_once():
    made = []

    class Counted(SuffixAutomaton):
        def _push(self, sign):
            made.append(sign)
            super()._push(sign)

    nodes = Counted()
    for reverse in sorted([b"au", b"auau", b"auas", b"auau", b"aua"]):
        nodes.read(reverse)
    assert len(made) == 1 + len({r[:k] for r in (b"au", b"auau", b"auas", b"aua") for k in range(1, 5) if k <= len(r)})


def test_query_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert got(op12_conversation_repair(spark, sf)) == brute([tuple(r) for r in rows])


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [
        (rng.choice([None, 1, 2, 3, 4, 5, 6, 7, -9]), rng.choice([None, 0, 1, 2, 3, 4, 9, 9]), rng.choice(["user", "assistant", "system", "tool", "admin", "User", "", None]),
         rng.choice(["Yes.", "no", "", None, " \n", "\xa0", "a.\n ", "é!\x0b", "…", "x" * 50_000, "Why?"]))
        for _ in range(160)
    ] + [(50, None, "user", "a."), (50, None, "user", "a."), (51, 4, "assistant", "b.")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(5)
    assert got(repair_conversations(df)) == brute(rows)
    assert repair_conversations(df.limit(0)).count() == 0


def test_a_conversation_with_most_rows_and_a_signature_of_most_conversations(spark):
    rows = [(7, k, "user" if k % 2 == 0 else "assistant", f"text {k}.") for k in range(3000)]
    rows += [(100 + c, t, r, f"{r} {c} {t}.") for c in range(400) for t, r in ((2, "user"), (5, "assistant"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    assert got(repair_conversations(df)) == brute(rows)


def test_without_damage(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    found = got(repair_conversations(df, damage=False))
    assert found[1][:7] == (0, 0, 0, 0, 0, 0, "KK")
    assert found[2][:7] == (0, 0, 0, 0, 0, 3, "IK")
    assert found[1][7] == hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest()


def test_ranges_split_a_common_signature(spark):
    df = spark.createDataFrame([(c, 0, 0, 0, 0, 0, b"au") for c in range(1000)], "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, reverse binary")
    from pyspark.sql import functions as F

    parts = audits(df.repartition(4)).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1 and sum(r["count"] for r in parts) == 1000
