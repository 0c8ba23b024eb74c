"""Repair of the structure of conversations by cheapest edits.

A row is one sign: its role's initial and its first fault. The signs of a conversation
are its signature. Different signatures, read from their ends, form an automaton in
which equal suffixes are one node; a node holds, for each state of the grammar
``(s?(ua)+)?``, the least cost of all that follows and the first edits of the best
audit, so the audit of a signature is a walk along its nodes. Signatures are ordered
by their reversed text and dealt out in ranges; a task keeps the nodes of the current
signature on a stack and computes those that the one before it does not share. A node
is computed once in its range; only the nodes on the border between two ranges are
computed in both.

A row counts with its first fault: blank (no sign but white space), duplicate (role and
text came before in the conversation), truncated (last sign no full stop, question or
exclamation mark). Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (blank and
duplicate rows must go), Insert an empty user or assistant turn 2; a truncated row that
stays costs 1. Of equally cheap audits the least in ASCII order is taken.

Edge cases: rows go by turn (null first), then role, then digest; null roles and texts
are one space, so a null text is blank; an empty role has no initial and fits nowhere;
repeated rows are duplicates; rows of a null conversation are one conversation; other
columns are ignored; an empty table gives an empty result. Only signs of a conversation
are gathered, a byte a row; its texts pass through the task that hashes them, in order,
row by row, and are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatialseg.llm.prefix_trie import ROWS_AT_ONCE, batch, schema
from spatialseg.runtime import cut, salt_of, shuffle_width

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
#: A row that must go; other rows are their role's initial (o: any other), in capitals if truncated.
GONE = "x"
#: Grammar states: start, behind s, behind u, behind a. Role initial -> next state; the role that an edit may set; states in which a conversation may end.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
SET = ("u", "u", "a", "u")
ENDS = (True, False, False, True)
ROLE = {"u": "user", "a": "assistant"}
NEVER = 1 << 40
#: Copies of an audit, so that a frequent signature meets its conversations in several tasks.
COPIES = 8

# a node: for each state (cost, letters of the edits up to and with the next row's, state behind it)
Best = tuple[int, str, int]


def with_inserts(plain: list[Best]) -> tuple[Best, ...]:
    """The best of each state, where turns may be inserted first. Two inserts in a row at most: a third leads back to a state."""

    def least(a: Best, b: Best) -> Best:
        return min(a, b, key=lambda x: (x[0], x[1]))

    def after(best: Best) -> Best:
        return (best[0] + 2, "I" + best[1], best[2])

    two, three = least(plain[2], after(plain[3])), least(plain[3], after(plain[2]))
    return least(plain[0], after(two)), least(plain[1], after(two)), two, three


END = with_inserts([(0, "", 0) if ends else (NEVER, "", q) for q, ends in enumerate(ENDS)])


def node(sign: str, then: tuple[Best, ...]) -> tuple[Best, ...]:
    """The node of ``sign`` before a node."""
    plain = []
    for q in range(4):
        edits = [(3 + then[q][0], "D", q)]
        if sign != GONE:
            stays = 0 if sign.islower() else 1
            if (to := NEXT[q].get(sign.lower())) is not None:
                edits.append((stays + then[to][0], "K", to))
            to = NEXT[q][SET[q]]
            edits.append((2 + stays + then[to][0], "R", to))
        plain.append(min(edits))
    return with_inserts(plain)


def audit(nodes: list[tuple[Best, ...]]) -> tuple[int, str]:
    """Least cost and best audit of the signature whose nodes are on the stack, the first row's on top."""
    state, letters = 0, []
    for n in reversed(nodes):
        _, edits, state = n[state]
        letters.append(edits)
    return nodes[-1][0][0], "".join(letters)


SIGNED = schema(conv_id=pa.int64(), signature=pa.string(), gaps=pa.int64(), blank=pa.int64(), duplicate=pa.int64(), truncated=pa.int64(), illegal=pa.int64())
AUDITED = schema(signature=pa.string(), cost=pa.int64(), audit=pa.string())
REPAIRED = schema(conv_id=pa.int64(), gaps=pa.int64(), blank=pa.int64(), duplicate=pa.int64(), truncated=pa.int64(), illegal=pa.int64(), cost=pa.int64(), audit=pa.string(), repaired_sha256=pa.string())
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"
FITTING = {"su", "ua", "au"}


def prepared(rows: DataFrame, copies: str | None) -> DataFrame:
    """Rows with nulls filled and a digest; a row of no copies stays as a mark that its conversation exists."""
    n = F.col(copies) if copies else F.lit(1)
    filled = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), n.alias("_n"))
    filled = filled.withColumns({"here": F.col("_n") > 0, "digest": F.unhex(F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))})
    return filled.select("*", F.explode(F.sequence(F.lit(1), F.greatest("_n", F.lit(1)))).alias("_copy")).drop("_n")


def signed(rows: DataFrame) -> DataFrame:
    """(conv_id, signature and counts) of prepared rows. Only initials, marks of faults and turns are shuffled by conversation."""
    text = F.expr("rtrim('" + "".join(f"\\u{ord(c):04x}" for c in BLANK) + "', text)")
    seen = Window.partitionBy("conv_id", "here", "digest").orderBy(F.col("turn").asc_nulls_first(), "_copy")
    light = rows.select("conv_id", "turn", "role", "here", "digest", "_copy", F.when(text == "", "b").when(~F.right(text, F.lit(1)).isin(".", "!", "?"), "t").otherwise("").alias("_fault"))
    light = light.withColumn("_again", F.row_number().over(seen) > 1).select("conv_id", "here", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), F.when(F.col("_fault") == "b", "b").when(F.col("_again"), "d").otherwise(F.col("_fault")).alias("fault"), F.when(F.col("_again"), 1).otherwise(0).alias("_late"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: dict | None = None

        def done(c: dict) -> tuple:
            gaps = c["last"] - c["first"] + 1 - c["turns"] if c["turns"] else 0
            return (c["conv_id"], c["signs"].decode(), gaps, c["b"], c["d"], c["t"], c["illegal"])

        for b in batches:
            out = []
            for conv, here, turn, initial, fault in zip(*(b.column(n).to_pylist() for n in ("conv_id", "here", "turn", "initial", "fault")), strict=True):
                if current is None or conv != current["conv_id"]:
                    if current is not None:
                        out.append(done(current))
                    current = {"conv_id": conv, "signs": bytearray(), "first": None, "last": None, "turns": 0, "b": 0, "d": 0, "t": 0, "illegal": 0, "before": None}
                if not here:
                    continue
                c = current
                if turn is not None and turn != c["last"]:
                    c["first"], c["last"], c["turns"] = turn if c["first"] is None else c["first"], turn, c["turns"] + 1
                if fault:
                    c[fault] += 1
                c["illegal"] += c["before"] is not None and c["before"] + initial not in FITTING
                c["before"] = initial
                sign = initial if initial in ("s", "u", "a") else "o"
                c["signs"] += (GONE if fault in ("b", "d") else sign.upper() if fault else sign).encode()
            yield batch(out, SIGNED)
        if current is not None:
            yield batch([done(current)], SIGNED)

    order = ["conv_id", "here", F.col("turn").asc_nulls_first(), "role", "digest", "_late"]
    return light.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "here", "turn", "initial", "fault").mapInArrow(run, f"conv_id long, signature string, {COUNTS}")


def audits(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each different signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, nodes = "", [END]
        for b in batches:
            out = []
            for back in b.column("back").to_pylist():
                shared = len(common(before, back))
                del nodes[shared + 1 :]
                for sign in back[shared:]:
                    nodes.append(node(sign, nodes[-1]))
                before = back
                out.append((back[::-1], *audit(nodes)))
            yield batch(out, AUDITED)

    width = shuffle_width(signatures.sparkSession)
    back = signatures.select("signature").distinct().select(F.reverse("signature").alias("back"))
    return back.repartitionByRange(width, "back").sortWithinPartitions("back").mapInArrow(run, "signature string, cost long, audit string")


def common(a: str, b: str) -> str:
    """The shared beginning of two strings."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return a[:low]


#: What an audit does with one row: turns inserted before it, and its own edit.
STEP = re.compile("(I*)([DKR])|(I+)$")


def repaired(audited: DataFrame, rows: DataFrame) -> DataFrame:
    """The audited conversations with the digest of their repaired text: each audit is followed by its rows, in order, in one stream."""
    heads = audited.select("conv_id", F.lit(False).alias("is_row"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(None).cast("binary").alias("digest"), F.struct("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit").alias("found"))
    own = rows.where("here").select("conv_id", F.lit(True).alias("is_row"), "turn", "role", "text", "digest", F.lit(None).cast(heads.schema["found"].dataType).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
        conv, found, steps, state, hashed, lines = None, None, None, 0, None, 0

        def write(role: str, text: str) -> None:
            nonlocal lines
            hashed.update((("\n" if lines else "") + f"{role}:{text}").encode())
            lines += 1

        def insert(n: int) -> None:
            nonlocal state
            for _ in range(n):
                write(ROLE[SET[state]], "")
                state = NEXT[state][SET[state]]

        def done() -> tuple:
            for m in steps:
                insert(len(m[3] or ""))
            return (conv, *(found[f] for f in fields), hashed.hexdigest())

        for b in batches:
            out = []
            for at in range(0, b.num_rows, 256):  # texts become Python strings a few rows at a time
                for c, is_row, role, text, f in zip(*(x.to_pylist() for x in b.slice(at, 256).select(["conv_id", "is_row", "role", "text", "found"]).columns), strict=True):
                    if not is_row:
                        if found is not None:
                            out.append(done())
                        conv, found, steps, state, hashed, lines = c, f, STEP.finditer(f["audit"]), 0, hashlib.sha256(), 0
                        continue
                    m = next(steps)
                    insert(len(m[1]))
                    if m[2] == "K":
                        write(role, text)
                        state = NEXT[state][role[:1]]
                    elif m[2] == "R":
                        write(ROLE[SET[state]], text)
                        state = NEXT[state][SET[state]]
            yield batch(out, REPAIRED)
        if found is not None:
            yield batch([done()], REPAIRED)

    order = ["conv_id", "is_row", F.col("turn").asc_nulls_first(), "role", "digest"]
    stream = heads.unionByName(own).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "is_row", "role", "text", "found")
    return stream.mapInArrow(run, f"conv_id long, {COUNTS}, cost long, audit string, repaired_sha256 string")


def repair(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of (conv_id, turn, role, text) rows.

    ``copies`` names a column of how often a row is there; a conversation whose rows
    are all there 0 times is in the result, empty.
    """
    ready = prepared(rows, copies)
    marks = cut(signed(ready), "signed")
    found = cut(audits(marks), "audits")
    salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    audited = marks.withColumn("_salt", salt_of(F.col("conv_id"), width=COPIES)).join(salted, ["signature", "_salt"]).drop("_salt")
    return repaired(audited, ready)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the planted faults of the contract, and ``copies``."""
    filled = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    filled = filled.withColumn("_k", F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20)
    k: Column = F.col("_k")
    return filled.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))
