"""How many points of a segment lie near one segment of another set, the most of any.

Pairs of points are looked at inside tasks and never rows: both sets are dealt into
groups of whole segments, of about ``GROUP`` points each, and a task that holds two
groups keeps one number for a segment. Groups of the other set are taken in rounds, one of
a cloud at first and then as many as before, and a segment that has reached its
share asks no more. So what is shuffled is the points, once for each group that they
still meet, and not the pairs; looking at pairs stays quadratic where no share is
reached. A segment of more than ``GROUP`` points is dealt over the groups of the first
set, and its counts are added up; one of the other set is searched by ``knn``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spatialseg.functions.geometry import AXES, SEGMENT
from spatialseg.operators.boxtree import PAIRS, TOGETHER, Block
from spatialseg.operators.knn import blocks, knn, known
from spatialseg.operators.project import null_safe
from spatialseg.runtime import cut, shuffle_width

#: Points of a group of segments.
GROUP = 100_000


def numbered(points: DataFrame) -> DataFrame:
    """(cloud_id, seg_id, _s, _n): the segments with a number and their rows."""
    return cut(points.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", F.monotonically_increasing_id()), "segments")


def with_numbers(points: DataFrame, segments: DataFrame) -> DataFrame:
    names = segments.select(*[F.col(c).alias(f"_k_{c}") for c in SEGMENT], "_s", "_n")
    return points.join(names, null_safe(points, names, SEGMENT))


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes in order, and where they start in the sorted ones; with the number of codes at the end."""
    codes = np.sort(codes)
    start = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
    return codes[start], np.append(start, len(codes))


def met_segments(chunks: Iterator[tuple[np.ndarray, np.ndarray]], seg: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(segment, other, points): from (point, other) pairs in order of points, with repeats, how many different points of a segment meet another. All rows of a segment come together; ``seg`` is each point's segment, in order, ``width`` the number of others."""
    pairs, code, count = (np.zeros(0, np.int64) for _ in range(3))

    def counted(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, start = distinct(seg[pairs // width] * width + pairs % width)
        both = np.concatenate([code, found])
        by = np.argsort(both, kind="stable")
        names, at = distinct(both)
        return names, np.add.reduceat(np.concatenate([count, np.diff(start)])[by], at[:-1]) if len(names) else np.zeros(0, np.int64)

    for point, other in chunks:
        if len(point):
            pairs = distinct(np.concatenate([pairs, point * width + other]))[0]
            whole = np.searchsorted(pairs, point[-1] * width)
            code, count = counted(pairs[:whole])
            pairs = pairs[whole:]
            if done := np.searchsorted(code, seg[point[-1]] * width):
                yield code[:done] // width, code[:done] % width, count[:done]
                code, count = code[done:], count[done:]
    code, count = counted(pairs)
    yield code // width, code % width, count


def block_counts(asks: pa.Table, gives: pa.Table, dist: float) -> pa.RecordBatch:
    """(_s, _b, _k) of a block: of a whole segment the most points that one of the others is near to, of a split one the points for each of them."""
    s, p, split = (asks.column(c).to_numpy() for c in ("_s", "_p", "_split"))
    new_s = np.append(True, s[1:] != s[:-1])
    new_p = new_s | np.append(True, p[1:] != p[:-1])
    point, segment = np.cumsum(new_p) - 1, np.cumsum(new_s) - 1
    names, parted, seg = s[new_s], split[new_s], segment[new_p]
    others, other = np.unique(gives.column("_s").to_numpy(), return_inverse=True)
    block = Block(np.column_stack([gives.column(c).to_numpy() for c in AXES]))
    x = np.column_stack([asks.column(c).to_numpy() for c in AXES])
    step = max(1, min(TOGETHER, PAIRS // block.tree.first))

    def near() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(x), step):
            some = x[at : at + step]
            far = np.full(len(some), dist)
            for q, t, _ in block.met(some, *block.tree.within(some, far), far, None):
                yield point[q + at], other[t]

    most = np.zeros(len(names), np.int64)
    rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for one, met, n in met_segments(near(), seg, len(others)):
        at = distinct(one)[1][:-1]
        if len(at):
            most[one[at]] = np.maximum.reduceat(n, at)
        if (parts := parted[one]).any():
            rows.append((names[one[parts]], others[met[parts]], n[parts]))
    whole = np.flatnonzero((most > 0) & ~parted)
    out = [np.concatenate(c) for c in zip((names[whole], np.full(len(whole), -1), most[whole]), *rows, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["_s", "_b", "_k"])


def searched_groups(rows: DataFrame, dist: float, tasks: int) -> DataFrame:
    """(_j, _s, _b, _k) of all blocks (cloud_id, _i, _j) of ``rows``: targets (_tag 0) and the points that ask (_tag 1). The rows look few for the work on them, so the number of tasks is given."""
    by = ["cloud_id", "_i", "_j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def answer() -> Iterator[pa.RecordBatch]:
            block = pa.Table.from_batches(held)
            n = int(np.searchsorted(block.column("_tag").to_numpy(), 1))
            if 0 < n < block.num_rows:
                found = block_counts(block.slice(n), block.slice(0, n), dist)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(found.num_rows, block.column("_j")[0].as_py()), pa.int32()), *found.columns], names=["_j", *found.schema.names])

        for new, part in blocks(batches, by):
            if new and held:
                yield from answer()
                held = []
            held.append(part)
        if held:
            yield from answer()

    return rows.repartition(tasks, *by).sortWithinPartitions(*by, "_tag", "_s", "_p").mapInArrow(run, "_j int, _s long, _b long, _k long")


def most_met(a: DataFrame, b: DataFrame, dist: float, enough: float) -> DataFrame:
    """(cloud_id, seg_id, _n, _k) of the segments of ``a``: their rows, and the most different points that one segment of ``b`` has within ``dist``. Where _k / _n has come to ``enough``, there may be more than _k.

    A null segment of ``a`` meets nothing, one of ``b`` is a segment like others. Points
    without an id or a cloud, or at no finite place, meet nothing.
    """
    asking, given = numbered(a), numbered(b)
    p = with_numbers(known(a, [*SEGMENT, "point_id"]), asking).select("cloud_id", "_s", "point_id", *AXES).withColumn("_r", F.monotonically_increasing_id())
    # rows of one id are one point
    p = cut(p.withColumn("_p", F.min("_r").over(Window.partitionBy("_s", "point_id"))).select("cloud_id", "_s", "_p", *AXES), "asking")
    in_groups = lambda n: F.ceil(F.sum(n) / GROUP).cast("int")
    groups = given.where(F.col("_n") <= GROUP).groupBy("cloud_id").agg(in_groups("_n").alias("_groups"))
    t = with_numbers(known(b, ["cloud_id"]), given).select("cloud_id", "_s", "_n", *AXES)
    dealt = t.where(F.col("_n") <= GROUP).join(groups, "cloud_id").withColumn("_j", F.pmod(F.xxhash64("_s"), F.col("_groups")).cast("int"))
    dealt = cut(dealt.select("cloud_id", "_s", *AXES, "_j"), "given")
    last = groups.agg(F.max("_groups")).first()[0] or 0
    todo = asking.where(F.col("seg_id").isNotNull() & (F.lit(0.0) < enough)).select("cloud_id", "_s", "_n")
    found = []

    def left(met: DataFrame) -> DataFrame:
        found.append(met)
        return cut(todo.join(met, "_s", "left").where(F.coalesce(F.col("_k") / F.col("_n"), F.lit(0.0)) < enough).drop("_k"), "undecided")

    lo, hi = 0, 1
    while lo < last:
        clouds = todo.groupBy("cloud_id").agg(in_groups("_n").alias("_parts")).join(groups, "cloud_id").where(F.col("_groups") > lo)
        n = clouds.agg(F.sum(F.col("_parts") * (F.least(F.col("_groups"), F.lit(hi)) - lo))).first()[0]
        if not n:
            break
        own = todo.join(clouds, "cloud_id").select("_s", "_parts", "_groups", (F.col("_n") > GROUP).alias("_split"))
        part = F.pmod(F.when(F.col("_split"), F.xxhash64("_s", "_p")).otherwise(F.xxhash64("_s")), F.col("_parts")).cast("int")
        asks = p.join(own, "_s").withColumns({"_i": part, "_j": F.explode(F.sequence(F.lit(lo), F.least(F.col("_groups"), F.lit(hi)) - 1)), "_tag": F.lit(1)}).drop("_parts", "_groups")
        gives = dealt.where(F.col("_j").between(lo, hi - 1)).join(clouds, "cloud_id").withColumns({"_i": F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)), "_tag": F.lit(0), "_p": F.lit(0).cast("long"), "_split": F.lit(False)})
        met = searched_groups(gives.select(asks.columns).unionByName(asks), dist, min(2 * n, shuffle_width(a.sparkSession)))
        todo = left(cut(met.groupBy("_s", "_j", "_b").agg(F.sum("_k").alias("_k")).groupBy("_s").agg(F.max("_k").alias("_k")), "met"))
        lo, hi = hi, 2 * hi
    large = given.where((F.col("_n") > GROUP) & F.col("cloud_id").isNotNull()).select("cloud_id", F.col("_s").alias("_b"))
    if not large.isEmpty() and not todo.isEmpty():
        asks = p.join(todo.select("_s"), "_s").join(large, "cloud_id").withColumn("point_id", F.struct("_s", "_p"))
        near = knn(asks, t.where(F.col("_n") > GROUP).withColumnsRenamed({"_s": "_b"}).withColumn("point_id", F.lit(0)), 1, keys=["cloud_id", "_b"], within=dist)
        counts = near.select("_b", "src._s", "src._p").distinct().groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_k"))
        found.append(cut(counts.groupBy("_s").agg(F.max("_k").alias("_k")), "met"))
    out = asking.withColumn("_k", F.lit(0).cast("long"))
    if found:
        best = found[0]
        for more in found[1:]:
            best = best.unionByName(more)
        out = asking.join(best.groupBy("_s").agg(F.max("_k").alias("_k")), "_s", "left").withColumn("_k", F.coalesce("_k", F.lit(0)))
    return out.select(*SEGMENT, "_n", "_k")
