"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spatialseg import runtime

#: Edges that a task contracts at once, at least a batch.
CONTRACTED_AT_ONCE = 100_000


def _large_star(edges: DataFrame, by: list[str]) -> DataFrame:
    """Every neighbour larger than a node is tied to the smallest of the node and its neighbours; a row an edge at most."""
    both = edges.select(*by, "v").union(edges.select(*[F.col("v" if c == "u" else c).alias(c) for c in by], F.col("u").alias("v")))
    low = both.groupBy(*by).agg(F.min("v").alias("m"))
    tied = both.join(low, by).where(F.col("v") > F.col("u"))
    return tied.select(F.col("v").alias("u"), *by[1:], F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, by: list[str]) -> DataFrame:
    """A node and its smaller neighbours, of edges whose ``v`` is the smaller end, are tied to the smallest of them."""
    low = edges.groupBy(*by).agg(F.min("v").alias("m"))
    tied = edges.join(low, by).where("v <> m").select(F.col("v").alias("u"), *by[1:], F.col("m").alias("v"))
    return tied.union(low.withColumnRenamed("m", "v")).distinct()


def _lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of ``n`` numbers, the least that it is tied to by the pairs."""
    low = np.arange(n)
    while True:
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            return low
        np.minimum.at(low, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (low != (jump := low[low])).any():
            low = jump


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: list[pa.RecordBatch] = []
    for b in batches:
        kept.append(b)
        if sum(x.num_rows for x in kept) >= CONTRACTED_AT_ONCE:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
            kept = []
    if any(b.num_rows for b in kept):
        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()


def _finished(edges: DataFrame, by: list[str]) -> bool:
    """Whether every edge leads from a node of no other edge straight to a root."""
    one, none = F.lit(1).alias("up"), F.lit(0).alias("up")
    ends = edges.select(*by, one, F.lit(False).alias("root")).union(edges.select(F.col("v").alias("u"), *by[1:], none, F.lit(True)))
    return ends.groupBy(*by).agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or up = 1 and root").isEmpty()


def _contracted(edges: DataFrame, by: list[str]) -> DataFrame:
    """The same components by stars inside runs of rows in order of their nodes: long chains of near numbers become short before the rounds. Nothing is held but a run of about ``CONTRACTED_AT_ONCE`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches):
            group = np.zeros(b.num_rows, np.int64)
            for c in by[1:]:
                codes = b.column(c).dictionary_encode(null_encoding="encode")
                group = np.unique(group * len(codes.dictionary) + codes.indices.to_numpy(), return_inverse=True)[1]
            ids, of = np.concatenate([b.column("u").to_numpy(), b.column("v").to_numpy()]), np.tile(group, 2)
            o = np.lexsort((ids, of))
            first = np.append(True, (ids[o][1:] != ids[o][:-1]) | (of[o][1:] != of[o][:-1]))
            number = np.empty(len(ids), np.int64)
            number[o] = np.cumsum(first) - 1
            at = o[first]  # of each node, a place
            low = _lowest(len(at), number[: b.num_rows], number[b.num_rows :])
            tied = np.flatnonzero(low != np.arange(len(low)))
            rows = pa.array(at[tied] % b.num_rows)
            yield pa.record_batch([pa.array(ids[at[tied]]), *[b.column(c).take(rows) for c in by[1:]], pa.array(ids[at[low[tied]]])], names=[*by, "v"])

    order = [*by[1:], "u"]
    return edges.select(*by, "v").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, edges.select(*by, "v").schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", cut: Callable[[DataFrame, str], DataFrame] | None = None, keys: list[str] | None = None) -> DataFrame:
    """([keys,] node, component) of every node of ``edges`` that has an edge to another; a component is named by its smallest node.

    Self loops and repeated edges make no difference, null ends are ignored; with
    ``keys``, which must not be null, each of their values is a graph of its own. Edges
    between numbers are contracted inside runs of rows first, and if that leaves stars no
    round is needed. The number of rounds grows with the logarithm of a component's
    width; each round is written, so that lost executors
    cost no more than one, and removed when the next one is. ``cut`` writes the result
    (else into a table of its own).
    """
    keys = keys or []
    by = ["u", *keys]
    scratch = runtime.Scratch(edges.sparkSession, "components")
    ends = edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("u"), *keys, F.least(src, dst).alias("v"))
    e = scratch.cut(ends.distinct(), "edges")
    if e.schema["u"].dataType == T.LongType():
        before, e = e, scratch.cut(_contracted(e, by), "contracted")
        scratch.drop(before)
    last, done = None, e.schema["u"].dataType == T.LongType() and _finished(e, by)
    while not done:
        before, e = e, scratch.cut(_small_star(_large_star(e, by), by), "stars")
        scratch.drop(before)
        # finished when every edge leads straight to a root and a round changes nothing
        now = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*by, "v").cast("decimal(38,0)")), F.lit(0))).first()
        done = last == tuple(now)
        last = tuple(now)
    roots = e.select(*keys, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = (cut or runtime.cut)(e.select(*keys, F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components")
    scratch.close()
    return found
