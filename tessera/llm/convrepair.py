"""Conversation repair: cheapest edits that give every conversation a legal order of roles, by an automaton of shared suffixes.

A row is reduced to a sign of its role and faults, a conversation to its signature. Two conversations that end alike need the
same edits there, so signatures are read from the end: sorted by their reverse, they form the automaton of all suffixes, whose nodes come
up one after another. Each node has, for every state of the grammar `(s?(ua)+)?`, the cost to go and the first of the best
edits, found once; the rest of the edits is the answer of the node or state that follows. Texts never travel with signatures: they are
streamed once, in order, past the edits of their conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_parts, written

#: Costs of edits and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. The row that each takes, beside s at the start, and the state after it.
STEPS = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
ACCEPTED = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
_SPACE = r"\x20\x09-\x0D"
_NEVER = 1 << 60


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """rows -> conv_id, turn, role, text, gone: each row once with its planted damage, a repeated one twice, a dropped one marked as gone.

    crc32 of `conv_id:turn` modulo 20 tells the damage: 0 drops the row, 1 empties the text, 2 removes its `.!?`, 3 repeats the row,
    4 sets the role user. Nulls are one space, but for the ids that are returned.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", part(conv_col), part(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part(text_col), "[.!?]", "")).otherwise(part(text_col))
    out = rows.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(part(role_col)).alias("role"),
        text.alias("text"), (kind == 0).alias("gone"), kind.alias("_kind"),
    )
    return out.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind", "_copy")


def _initial(role: Column) -> Column:
    """s, u or a by the first character of the role; o for any other."""
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone -> conv_id, turn, role, digest, gone, initial, fault (blank, duplicate, truncated or null).

    A duplicate is a row whose role and text an earlier row of the conversation has, by the order turn, role, digest of the text.
    """
    keyed = rows.select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "gone", _initial(F.col("role")).alias("initial"),
        (~F.col("text").rlike(f"[^{_SPACE}]")).alias("blank"), F.col("text").rlike(rf"[^.!?{_SPACE}][{_SPACE}]*\z").alias("truncated"),
    )
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest", "gone").orderBy("turn")) > 1
    fault = F.when(F.col("blank"), "blank").when(seen, "duplicate").when(F.col("truncated"), "truncated")
    return keyed.withColumn("fault", F.when(~F.col("gone"), fault)).drop("blank", "truncated")


def _by_conversation(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of a conversation in one partition and in order; they are streamed, never gathered."""
    return rows.repartition(shuffle_parts(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", *order)


class _Tally:
    """What is kept of a conversation while its rows pass: counts, and one sign a row."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.signs, self.counts = conv_id, bytearray(), {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.low = self.high = self.last = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, fault: str | None) -> None:
        if turn is not None:
            if turn != self.high:
                self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.last = initial
        if fault:
            self.counts[fault] += 1
        self.signs += (b"x" if fault in ("blank", "duplicate") else initial.upper().encode() if fault else initial.encode())

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, *self.counts.values(), bytes(reversed(self.signs))


_COUNTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long"


def signatures(rows: DataFrame) -> DataFrame:
    """faults() -> one row per conversation: counts and `reverse`, its signs from the last row to the first.

    A sign is x where a row must be deleted, else the initial of its role, as a capital if the row is truncated.
    """
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "reverse"]

    def batch(done: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*done))
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:6]], pa.array(cols[6], pa.binary())], names=names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            done = []
            for conv, turn, gone, initial, fault in zip(*(b.column(k).to_pylist() for k in range(5))):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Tally(conv)
                if not gone:
                    now.add(turn, initial, fault)
            if done:
                yield batch(done)
        if now is not None:
            yield batch([now.row()])

    slim = rows.select("conv_id", "turn", "gone", "initial", "fault", "role", "digest")
    ordered = _by_conversation(slim, F.asc_nulls_first("turn"), "role", "digest").select("conv_id", "turn", "gone", "initial", "fault")
    return ordered.mapInArrow(apply, f"{_COUNTS}, reverse binary")


class SuffixAutomaton:
    """Nodes of the suffixes of signatures given in the order of their reverses; those of the latest are held, one a sign.

    `costs[k][state]` and `edits[k][state]` belong to the suffix of k signs: the cost to go, and (letter, signs taken, next state) of the
    first of the best edits. The letters of edits to choose from differ, so the least one among the cheapest begins the ASCII-least audit.
    """

    def __init__(self):
        self.costs, self.edits, self.reverse = [], [], b""
        self._push(None)

    def _push(self, sign: int | None) -> None:
        options: list[list[tuple[int, str, int, int]]] = [[] for _ in STEPS]
        costs = [0 if sign is None and q in ACCEPTED else _NEVER for q in range(len(STEPS))]
        if sign is not None:
            rest, c = self.costs[-1], chr(sign)
            stay = TRUNCATED if c.isupper() else 0
            for q, (role, to) in enumerate(STEPS):
                options[q].append((rest[q] + DELETE, "D", 1, q))
                if c != "x":
                    options[q].append((rest[to] + REROLE + stay, "R", 1, to))
                    if c.lower() == role:
                        options[q].append((rest[to] + stay, "K", 1, to))
                    elif c.lower() == "s" and q == 0:
                        options[q].append((rest[1] + stay, "K", 1, 1))
                costs[q] = min(options[q])[0]
        # Insertions stay at the node: at most two follow each other usefully.
        for _ in STEPS:
            costs = [min(cost, costs[to] + INSERT) for cost, (_, to) in zip(costs, STEPS)]
        best = []
        for q, (_, to) in enumerate(STEPS):
            found = [o for o in (*options[q], (costs[to] + INSERT, "I", 0, to)) if o[0] == costs[q]]
            best.append(min(found)[1:] if found else None)  # None: accepted, nothing to do
        self.costs.append(costs)
        self.edits.append(best)

    def read(self, reverse: bytes) -> None:
        """Makes the nodes of a signature that the one before does not share."""
        shared = _common(self.reverse, reverse)
        del self.costs[shared + 1 :], self.edits[shared + 1 :]
        for sign in reverse[shared:]:
            self._push(sign)
        self.reverse = reverse

    def answer(self) -> tuple[int, str]:
        """Cost and audit of the signature read last."""
        at, state, out = len(self.reverse), 0, []
        while edit := self.edits[at][state]:
            letter, taken, state = edit
            out.append(letter)
            at -= taken
        return self.costs[-1][0], "".join(out)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(np.argmax(differ))


def audits(signed: DataFrame) -> DataFrame:
    """signatures() with cost and audit. Conversations are dealt out by ranges of (reverse, conv_id), so a signature that very many have is split."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, found = SuffixAutomaton(), None
        for b in batches:
            out = []
            for reverse in b.column(6).to_pylist():
                if found is None or reverse != nodes.reverse:
                    nodes.read(reverse)
                    found = nodes.answer()
                out.append(found)
            cost, audit = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(cost, pa.int64()), pa.array(audit, pa.string())], names=[*b.schema.names[:6], "cost", "audit"])

    parts = shuffle_parts(signed.sparkSession)
    ordered = signed.repartitionByRange(parts, "reverse", "conv_id").sortWithinPartitions("reverse", "conv_id")
    return ordered.mapInArrow(apply, f"{_COUNTS}, cost long, audit string")


class _Repair:
    """One conversation while its rows pass: its edits are applied as they come, and the digest is carried on."""

    def __init__(self, head: dict):
        self.head, self.audit, self.at, self.state, self.sha, self.first = head, head["audit"], 0, 0, hashlib.sha256(), True

    def put(self, role: str, text: str) -> None:
        self.sha.update(("" if self.first else "\n").encode() + role.encode() + b":" + text.encode())
        self.first = False

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            role, self.state = STEPS[self.state]
            self.put(ROLES[role], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            role, self.state = ROLES[STEPS[self.state][0]], STEPS[self.state][1]
        elif edit == "K":
            self.state = 1 if role[:1] == "s" else STEPS[self.state][1]
        if edit != "D":
            self.put(role, text)

    def done(self) -> dict:
        self.inserts()
        return self.head | {"repaired_sha256": self.sha.hexdigest()}


def repaired(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """damaged() rows and audits() -> the audits with repaired_sha256, of the repaired rows `role:text` joined by newlines."""
    heads = judged.select("conv_id", F.struct(*judged.columns).alias("head"), F.lit(0).alias("kind"))
    body = rows.where("not gone").select("conv_id", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"), F.lit(1).alias("kind"))
    both = _by_conversation(heads.unionByName(body, allowMissingColumns=True), "kind", F.asc_nulls_first("turn"), "role", "digest").select("head", "role", "text")
    schema = f"{_COUNTS}, cost long, audit string, repaired_sha256 string"
    types = pa.schema([*[(c, pa.int64()) for c in judged.columns[:-1]], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            done = []
            for head, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if head is None:
                    now.row(role, text)
                    continue
                if now is not None:
                    done.append(now.done())
                now = _Repair(head)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=types)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.done()], schema=types)

    return both.mapInArrow(apply, schema)


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = True) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn (nulls first), then role and digest of the text; damage=False takes them as they are. The edits K(eep) 0, R(erole)
    to user or assistant 3, D(elete) 4 and I(nsert) an empty row 3 bring the initials of the roles to `(s?(ua)+)?`; blank and duplicate rows
    must go, truncated ones that stay cost 3 more. audit is the cheapest series of edits, the ASCII-least of several. A null conv_id is a
    conversation of its own; other nulls count as one space, so a null or empty role is none of s, u, a. Repeated rows are duplicates. A
    conversation of which no row is left has zeros, an empty audit and the digest of nothing. Other columns are ignored. No rows give no rows.

    A task holds a sign and an edit for each row of the conversation that passes, as the audit itself does, and one text.
    """
    if damage:
        hurt = damaged(rows, conv_col, turn_col, role_col, text_col)
    else:
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
        hurt = rows.select(
            F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"), F.lit(False).alias("gone")
        )
    signed = written(signatures(faults(hurt)), "signatures")
    return repaired(hurt, written(audits(signed), "audits"))
