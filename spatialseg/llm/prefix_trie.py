"""Conversations as a trie of shared prefixes, built as a burst trie.

A conversation is a binary string of cells, one a turn: 16 bytes of the digest of role
and text, and 8 of the text's words. Equal conversations become one sequence first,
with their number, smallest id and the digest of their ids. Sequences wait in
containers under trie heads. A container of more than ``CONTAINER`` sequences bursts by
its next turns: several levels at once, four times as many in each round, so that a
prefix that many conversations share for thousands of turns takes few rounds. What is
left are small containers; each is sorted and swept into nodes with a stack, and what
the nodes sum up is carried from the containers to the heads above them.

Edge cases: turns go by ``turn`` (null first), then by digest; a null role or text is
empty; rows of a null conversation are left out; a conversation without turns ends at
the root; repeated rows are turns of their own; other columns are ignored; an empty
table gives no nodes, not even a root. A conversation's cells are one value, 24 bytes a
turn; its texts are never gathered. Long texts are read where they lie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatialseg.llm.jaccard import small
from spatialseg.llm.mixing import WORD
from spatialseg.runtime import cut, shuffle_width

CELL, ID = 24, 16
#: Most sequences that a container holds before it bursts.
CONTAINER = 128
#: Most parts that the ids of equal conversations are joined in.
PARTS = 256
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NO_END = hashlib.sha256(b"").hexdigest()
ROOT = hashlib.sha256(b"").digest()[:ID]
ROWS_AT_ONCE = 4096


def cell(role: Column, text: Column) -> Column:
    """The hexadecimal cell of a turn."""
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.substring(digest, 1, 2 * ID), F.lpad(F.hex(F.regexp_count(text, F.lit(WORD)).cast("long")), 16, "0"))


def sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, seq) of rows (conv_id, turn, role, text)."""
    cells = rows.where("conv_id is not null").select("conv_id", "turn", cell(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("_cell"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "_cell")))
    return cells.groupBy("conv_id").agg(turns.alias("_turns")).select("conv_id", F.unhex(F.concat_ws("", F.transform("_turns", lambda t: t["_cell"]))).alias("seq"))


def distinct_sequences(seqs: DataFrame) -> DataFrame:
    """(seq, n, low, ends): the different sequences with their conversations' number, smallest id and digest of ids. The ids are joined in parts, so that no task meets a hot sequence row by row."""
    n = min(PARTS, shuffle_width(seqs.sparkSession))
    bounds = seqs.agg(F.percentile_approx("conv_id", F.array(*[F.lit((i + 1) / (n + 1)) for i in range(n)]), 10_000)).first()[0] or []
    part = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b <= F.col("conv_id"))) if bounds else F.lit(0)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = seqs.withColumn("part", part).groupBy("seq", "part").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"), ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, count, low, hashed = None, 0, 0, None
        for b in batches:
            out = []
            for s, n_, l_, i in zip(*(b.column(c).to_pylist() for c in ("seq", "n", "low", "ids")), strict=True):
                if s != seq:
                    if seq is not None:
                        out.append((seq, count, low, hashed.hexdigest()))
                    seq, count, low, hashed = s, 0, l_, hashlib.sha256()
                else:
                    hashed.update(b",")
                count += n_
                hashed.update(i.encode())
            yield batch(out, DISTINCT)
        if seq is not None:
            yield batch([(seq, count, low, hashed.hexdigest())], DISTINCT)

    return parts.repartition("seq").sortWithinPartitions("seq", "part").mapInArrow(run, "seq binary, n long, low long, ends string")


def schema(**kinds: pa.DataType) -> pa.Schema:
    return pa.schema(list(kinds.items()))


DISTINCT = schema(seq=pa.binary(), n=pa.int64(), low=pa.int64(), ends=pa.string())
PREFIX = schema(low=pa.int64(), pid=pa.binary(), parent=pa.binary(), depth=pa.int64(), n=pa.int64(), words=pa.int64(), ends=pa.string())
SWEPT = schema(**{c: pa.int64() for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")}, ends_sha256=pa.string(), path=pa.binary())


def batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(kind), kind, strict=True)], schema=kind)


def words_of(c: bytes) -> int:
    return int.from_bytes(c[ID:], "big")


def prefixes(waiting: DataFrame, start: int, step: int) -> DataFrame:
    """A row for each of the next ``step`` prefixes of each sequence, beyond the first ``start`` turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for seq, n, low, ends in zip(*(b.column(c).to_pylist() for c in ("seq", "n", "low", "ends")), strict=True):
                h = hashlib.sha256(seq[: CELL * start])
                pid, last = h.digest()[:ID], len(seq) // CELL
                for d in range(start + 1, min(start + step, last) + 1):
                    c = seq[CELL * (d - 1) : CELL * d]
                    h.update(c)
                    parent, pid = pid, h.copy().digest()[:ID]
                    out.append((low, pid, parent, d, n, words_of(c), ends if d == last else None))
                if len(out) >= ROWS_AT_ONCE:
                    yield batch(out, PREFIX)
                    out = []
            yield batch(out, PREFIX)

    return waiting.select("seq", "n", "low", "ends").mapInArrow(run, "low long, pid binary, parent binary, depth long, n long, words long, ends string")


def burst(sequences_: DataFrame, container: int) -> tuple[DataFrame, DataFrame]:
    """Sequences with the depth ``at`` of the head of their container, and the prefixes that were counted on the way: those of more than ``container`` sequences (``seqs``) are heads. Sequences that end at a head are in no container."""
    waiting, start, step, settled, counted = sequences_.where(F.length("seq") > 0), 0, 2, [], []
    turns = (F.length("seq") / CELL).cast("long")
    while True:
        each = cut(prefixes(waiting, start, step), "prefixes")
        found = each.groupBy("pid").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.count(F.lit(1)).alias("seqs"), F.sum("n").alias("n"), F.min("low").alias("low"), F.first("words").alias("words"), F.max("ends").alias("ends"))
        counted.append(cut(found, "counted"))
        heads = small(counted[-1].where(F.col("seqs") > container).select("pid"))
        below = each.join(heads, "pid", "left_semi").groupBy("low").agg(F.count(F.lit(1)).alias("_heads"))
        moved = cut(waiting.join(below, "low", "left").withColumn("_heads", F.coalesce("_heads", F.lit(0))).withColumn("_left", turns - start - F.col("_heads")), "moved")
        settled.append(moved.where((F.col("_left") > 0) & (F.col("_heads") < step)).withColumn("at", F.col("_heads") + start + 1))
        waiting = moved.where((F.col("_left") > 0) & (F.col("_heads") == step)).drop("_heads", "_left")
        if waiting.isEmpty():
            return reduce(DataFrame.unionByName, (s.drop("_heads", "_left") for s in settled)), reduce(DataFrame.unionByName, counted)
        start, step = start + step, step * 4


class Node:
    __slots__ = ("children", "depth", "ends", "leaves", "low", "n", "saved", "waiting", "words")

    def __init__(self, depth: int, words: int):
        self.depth, self.words, self.ends, self.low = depth, words, NO_END, None
        self.n = self.children = self.leaves = self.saved = 0
        self.waiting: list[tuple] = []  # finished children, which still lack their parent's name

    def close(self) -> tuple:
        self.leaves = self.leaves if self.children else 1
        self.saved += (self.n - 1) * self.words
        return (self.low, self.depth, None, self.n, self.children, self.leaves, self.saved, self.ends)

    def count(self, n: int, low: int) -> None:
        self.n += n
        self.low = low if self.low is None else min(self.low, low)


def shared_turns(a: bytes, b: bytes, at: int) -> int:
    """How many first turns two sequences share, of which ``at`` are known to be equal: by bisection, so that comparing runs at the speed of memory."""
    low, high = at, min(len(a), len(b)) // CELL
    while low < high:
        mid = (low + high + 1) // 2
        if a[CELL * low : CELL * mid] == b[CELL * low : CELL * mid]:
            low = mid
        else:
            high = mid - 1
    return low


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the containers of sorted sequences. ``path``: ids of the heads above a container's first node."""
    stack: list[Node] = []
    out: list[tuple] = []
    before, before_at = b"", -1

    def close_to(depth: int) -> None:
        """Finish all nodes deeper than ``depth``."""
        while stack and stack[-1].depth > depth:
            node = stack.pop()
            row = node.close()
            out.extend((*r[:2], node.low, *r[3:], None) for r in node.waiting)
            if stack:
                up = stack[-1]
                up.count(node.n, node.low)
                up.children, up.leaves, up.saved = up.children + 1, up.leaves + node.leaves, up.saved + node.saved
                up.waiting.append(row)
            else:
                h, path = hashlib.sha256(), [ROOT]
                for d in range(1, node.depth):
                    h.update(before[CELL * (d - 1) : CELL * d])
                    path.append(h.copy().digest()[:ID])
                out.append((*row, b"".join(path) if node.depth else None))

    for b in batches:
        for seq, n, low, ends, at in zip(*(b.column(c).to_pylist() for c in ("seq", "n", "low", "ends", "at")), strict=True):
            last = len(seq) // CELL
            if at != before_at or seq[: CELL * at] != before[: CELL * at]:
                close_to(-1)
                stack.append(Node(at, words_of(seq[CELL * (at - 1) : CELL * at]) if at else 0))
                shared = at
            else:
                shared = shared_turns(before, seq, at)
                close_to(shared)
            stack.extend(Node(d, words_of(seq[CELL * (d - 1) : CELL * d])) for d in range(shared + 1, last + 1))
            stack[-1].count(n, low)
            stack[-1].ends = ends
            before, before_at = seq, at
            if len(out) >= ROWS_AT_ONCE:
                yield batch(out, SWEPT)
                out.clear()
    close_to(-1)
    yield batch(out, SWEPT)


def head_nodes(heads: DataFrame, counted: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes of the heads, from the first nodes of the containers below them.

    A container adds its sums to all heads on its path. What the heads save themselves
    is added to those above by one container each, the one of smallest name below: along
    its path that is a running sum from the deepest head up.
    """
    places = F.explode(F.sequence(F.lit(0), (F.length("path") / ID).cast("int") - 1))
    above = tops.select(F.col("conv_id").alias("top"), "saved_tokens", "n_leaves", "path", places.alias("depth")).select("top", "saved_tokens", "n_leaves", "depth", F.expr(f"substring(path, depth * {ID} + 1, {ID})").alias("pid"))
    sums = above.groupBy("pid").agg(F.min("top").alias("top"), F.sum("saved_tokens").alias("_saved"), F.sum("n_leaves").alias("n_leaves"))
    summed = cut(heads.join(sums, "pid").withColumn("_own", (F.col("n") - 1) * F.col("words")), "heads")
    up = Window.partitionBy("top").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    lifted = above.select("top", "pid", "depth").join(summed.select("top", "pid", "_own"), ["top", "pid"], "left").select("pid", F.sum(F.coalesce("_own", F.lit(0))).over(up).alias("_lifted"))
    lifted = lifted.groupBy("pid").agg(F.sum("_lifted").alias("_lifted"))
    children = counted.groupBy(F.col("parent").alias("pid")).agg(F.count(F.lit(1)).alias("n_children"))
    names = summed.select(F.col("pid").alias("parent"), F.col("low").alias("parent_conv_id"))
    full = summed.join(lifted, "pid").join(children, "pid").join(small(names), "parent", "left")
    return full.select(F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", (F.col("_saved") + F.col("_lifted")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_END)).alias("ends_sha256"))


def prefix_trie(seqs: DataFrame, container: int = CONTAINER) -> DataFrame:
    """The nodes of the trie of (conv_id, seq): each with its smallest conversation, depth, parent's smallest conversation, members, children, leaves below, words that sharing saves below, and the digest of the ids that end there."""
    spark = seqs.sparkSession
    each = cut(distinct_sequences(seqs), "distinct")
    names = [c.split()[0] for c in NODE.split(", ")]
    total = each.agg(F.count(F.lit(1)).alias("seqs"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max(F.when(F.length("seq") == 0, F.col("ends"))).alias("ends")).first()
    whole = total["seqs"] <= container
    placed, counted = (each.withColumn("at", F.lit(0).cast("long")), None) if whole else burst(each, container)
    placed = placed.select("seq", "n", "low", "ends", "at")
    swept = placed.repartition(F.substring("seq", F.lit(1), (F.col("at") * CELL).cast("int"))).sortWithinPartitions("seq").mapInArrow(sweep, f"{NODE}, path binary")
    nodes = cut(swept, "swept")
    if whole:
        return nodes.select(*names)
    root = spark.createDataFrame([(ROOT, None, 0, total["n"], total["low"], 0, total["ends"])], "pid binary, parent binary, depth long, n long, low long, words long, ends string")
    heads = counted.where(F.col("seqs") > container).select(*root.columns).unionByName(root)
    tops = nodes.where("path is not null")
    parents = small(heads.select(F.col("pid").alias("_parent"), F.col("low").alias("_name")))
    named = tops.withColumn("_parent", F.expr(f"substring(path, length(path) - {ID - 1}, {ID})")).join(parents, "_parent").withColumn("parent_conv_id", F.col("_name"))
    return nodes.where("path is null").select(*names).unionByName(named.select(*names)).unionByName(head_nodes(heads, counted, tops).select(*names))
