"""Approximate nearest neighbours by collision counting.

Every projection has a window on either side, beyond ``WINDOW`` standard deviations. A
query and a vector collide where both lie in the same window, and clash where they lie in
opposite ones; a block counts collisions less clashes of many queries at once, as a product
of short numbers. Vectors of enough collisions are verified with their inner product. How
many are enough follows from the radius: a wider one asks for fewer, in place of wider
windows (virtual rehashing). The search of a block ends when it has enough verified vectors
within the radius.

Vectors are set on a sphere by one more coordinate, so the largest inner product
is the nearest point. Queries come in sets of bounded size, each set against every
vector. A task keeps the best ``k`` of each query over its blocks, so later blocks
stop widening at the radius of the worst of them; the tasks' answers are merged.
Copies of a vector inside a block share one entry, of which the
smallest ids are kept, as many as any answer can hold.

Edge cases: null, zero and non-finite vectors and null ids take no part; vectors
are compared with those of their own length only; a query is never its own
neighbour, but its copies are; a row that repeats both id and vector counts once,
and of an id with several vectors the smallest vector is the query, all are
candidates; fewer candidates than ``k`` are all returned; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spatialseg.operators.boxtree import spans
from spatialseg.runtime import cut

PROJECTIONS, WINDOW, SLACK = 192, 0.6, 1.7  # windows begin at so many standard deviations of a projection, on either side
RADII = np.append(np.arange(0.96, -0.3, -0.05), -1.0)  # the cosines at which a search may end; at the last one all is verified
BLOCK, BLOCK_BYTES, TOGETHER, QUERY_BYTES = 32_768, 128 << 20, 128, 32 << 20


def windows(proj: np.ndarray) -> np.ndarray:
    """1 or -1 where a projection lies in the window of its side, else 0, in short numbers: a product counts collisions less clashes."""
    return (proj > WINDOW).astype(np.float32) - (proj < -WINDOW)


def needed(proj: np.ndarray) -> np.ndarray:
    """(queries, RADII): the collisions less clashes of a vector at this cosine, less ``SLACK`` standard deviations.

    Its projections are the query's times the cosine, and normal noise; a logistic curve stands for the normal one.
    """
    need = np.full((len(proj), len(RADII)), -PROJECTIONS, np.float32)
    size = np.abs(proj)
    inside = size > WINDOW
    for i, c in enumerate(RADII[:-1]):
        steep = np.float32(1.702 / np.sqrt(1 - c * c))
        same, other = (inside / (1 + np.exp(np.minimum(steep * (np.float32(WINDOW) - np.float32(x) * size), 80))) for x in (c, -c))
        mean = same - other
        need[:, i] = mean.sum(axis=1) - SLACK * np.sqrt((same + other - mean * mean).sum(axis=1))
    return need


class Block:
    """Windows of up to some thousand vectors of one length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, seed: int = 11):
        order = np.argsort(ids, kind="stable")
        distinct, first = np.unique(x[order], axis=0, return_inverse=True)
        first = first.reshape(-1)
        by = np.argsort(first, kind="stable")
        again = np.zeros(len(by), bool)
        again[1:] = (first[by][1:] == first[by][:-1]) & (ids[order][by][1:] == ids[order][by][:-1])
        by = by[~again]  # a repeated row counts once
        starts = np.searchsorted(first[by], np.arange(len(distinct)))
        place = np.arange(len(by)) - starts[first[by]]
        few = place <= k  # the k smallest ids of a vector, and one for the query itself
        self.copy_of, self.ids = first[by][few], ids[order][by][few]
        self.copies = np.searchsorted(self.copy_of, np.arange(len(distinct) + 1))
        self.x = distinct
        norms = np.linalg.norm(distinct, axis=1)
        self.top = norms.max()
        self.size = np.diff(self.copies)
        n, d = distinct.shape
        rng = np.random.default_rng(seed)
        turns = [np.linalg.qr(rng.normal(size=(d + 1, min(d + 1, PROJECTIONS))))[0] for _ in range(-(-PROJECTIONS // (d + 1)))]
        self.axes = (np.concatenate(turns, axis=1)[:, :PROJECTIONS] * np.sqrt(d + 1)).astype(np.float32)
        self.short = (distinct / self.top).astype(np.float32)
        height = np.sqrt(np.maximum(0, 1 - (norms / self.top) ** 2)).astype(np.float32)
        self.inside = windows(self.short @ self.axes[:-1] + height[:, None] * self.axes[-1])
        self.verified = 0  # over all searches

    def search(self, qs: np.ndarray, own: np.ndarray, k: int, bars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and inner products of the nearest found; those below its bar are of no interest."""
        radius = 0
        for at in range(0, len(qs), TOGETHER):
            q = qs[at : at + TOGETHER]
            lengths = np.linalg.norm(q, axis=1)
            unit = (q / lengths[:, None]).astype(np.float32)
            proj = unit @ self.axes[:-1]
            count, need = windows(proj) @ self.inside.T, needed(proj)
            for i in range(len(q)):
                bar = bars[at + i]
                found, radius = self.verified_within(unit[i], count[i], need[i], k, bar / (lengths[i] * self.top), max(0, radius - 2))
                s = (self.x[found] * q[i]).sum(axis=1)  # the same bits wherever a vector lies
                found, s = found[s >= bar], s[s >= bar]
                copy, rows = spans(self.copies[found], self.size[found])
                ids, s = self.ids[rows], s[copy]
                other = ids != own[at + i]
                ids, s = ids[other], s[other]
                best = np.lexsort((ids, -s))[:k]
                yield ids[best], s[best]

    def verified_within(self, unit: np.ndarray, count: np.ndarray, need: np.ndarray, k: int, bar: float, radius: int) -> tuple[np.ndarray, int]:
        """The vectors that may be among the ``k + 1`` nearest, and the place in ``RADII`` where the search ended, which begins at ``radius``."""
        found, score = np.zeros(0, np.int64), np.zeros(0, np.float32)
        while True:
            new = np.flatnonzero(count >= need[radius])
            count[new] = -PROJECTIONS - 1
            self.verified += len(new)
            found, score = np.concatenate([found, new]), np.concatenate([score, self.short[new] @ unit])
            if len(found) > k + 1:  # those that the rounding of short numbers might put among the nearest stay
                least = np.partition(score, -(k + 1))[-(k + 1)] - np.float32((len(unit) + 2) * 2.0**-22)
                found, score = found[score >= least], score[score >= least]
            order = np.argsort(-score)
            rows = np.cumsum(self.size[found[order]])
            reached = max(bar, score[order[np.searchsorted(rows, k, "right")]] if len(rows) and rows[-1] > k else -np.inf)
            enough = min(int(np.searchsorted(-RADII, -reached)), len(RADII) - 1)
            if enough <= radius:
                return found, radius
            radius = min(enough, radius + 2)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vid, v) of the vectors that take part, in double precision."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("vid"), v.alias("v"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class Best:
    """The best ``k`` so far for each of a set of queries, over the blocks of a task."""

    def __init__(self, qids: np.ndarray, qs: np.ndarray, k: int):
        self.qids, self.qs, self.k = qids, qs, k
        self.score, self.id = np.full((len(qids), k), -np.inf), np.zeros((len(qids), k), np.int64)

    def add(self, block: Block) -> None:
        for i, (ids, s) in enumerate(block.search(self.qs, self.qids, self.k, self.score[:, -1])):
            if len(ids):
                held = ~np.isneginf(self.score[i])
                ids, s = np.append(self.id[i, held], ids), np.append(self.score[i, held], s)
                order = np.lexsort((ids, -s))
                ids, s = ids[order], s[order]
                new = np.append(True, (ids[1:] != ids[:-1]) | (s[1:] != s[:-1]))
                n = min(self.k, new.sum())
                self.id[i, :n], self.score[i, :n] = ids[new][:n], s[new][:n]

    def rows(self) -> pa.RecordBatch:
        held = ~np.isneginf(self.score)
        columns = [np.repeat(self.qids, held.sum(axis=1)), self.id[held], self.score[held]]
        return pa.record_batch([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def best_of_tasks(vectors: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each partition of ``vectors`` for each of a bounded set of queries, given by length."""
    sent = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: Best(*of, k) for d, of in sent.value.items()}
        waiting: dict[int, list] = {}
        for b in batches:
            lengths = b.column("v").value_lengths().to_numpy()
            for d in {*np.unique(lengths).tolist()} & best.keys():
                part = b.filter(pa.array(lengths == d))
                rows = waiting.setdefault(d, [0, [], []])
                rows[0] += part.num_rows
                rows[1].append(part.column("vid").to_numpy())
                rows[2].append(matrix(part.column("v"), d))
                if rows[0] >= min(BLOCK, BLOCK_BYTES // (8 * d)):
                    del waiting[d]
                    best[d].add(Block(np.concatenate(rows[1]), np.concatenate(rows[2]), k))
        for d, rows in waiting.items():
            best[d].add(Block(np.concatenate(rows[1]), np.concatenate(rows[2]), k))
        yield from (b.rows() for b in best.values())

    return vectors.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that meets ``is_query`` (a condition on ``vid``), its ``k`` nearest of all other rows.

    The table is read once for each ``query_bytes`` of queries and their answers.
    """
    spark = df.sparkSession
    vectors = usable(df, id_col, vec_col)
    queries = vectors.where(is_query).groupBy("vid").agg(F.min("v").alias("v"))
    n = queries.agg(F.sum(F.size("v") * 8 + k * 16)).first()[0] or 0
    blocks = -(-n // query_bytes)
    done = []
    for i in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("vid"), F.lit(blocks)) == i).toArrow()
        by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        v = part.column("v").combine_chunks()
        lengths = v.value_lengths().to_numpy()
        for d in np.unique(lengths):
            mask = pa.array(lengths == d)
            by_length[int(d)] = (part.column("vid").combine_chunks().filter(mask).to_numpy(), matrix(v.filter(mask), int(d)))
        found = best_of_tasks(vectors, by_length, k)
        done.append(cut(found, "neighbours") if blocks > 1 else found)
    merged = reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], "query_id long, vec_id long, score double")
    # rows that repeat in other tasks have equal ranks; Spark drops ranks beyond k before the shuffle
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = merged.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k)
    return best.dropDuplicates(["query_id", "rank"]).select("query_id", "rank", "vec_id", "score")
