"""Ordered polylines: geometry, joining, comparison. ``ord`` is the place of a point in its segment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spatialseg.components import connected_components
from spatialseg.functions.geometry import AXES, SEGMENT, along, angle_between, cross, distance, norm, step
from spatialseg.operators.cloud import downsample_medoid
from spatialseg.operators.graph import cut_graph, kept_edges
from spatialseg.operators.knn import Where, band_pairs, knn
from spatialseg.operators.matching import most_met
from spatialseg.operators.project import dense_ids, null_safe
from spatialseg.operators.raster import interpolate_polyline
from spatialseg.runtime import cut

LEAF = 128  # points of a leaf of the tree that orders points


def tree_of(x: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Order of ``x`` by leaves of a k-d tree of 2^depth leaves, each split at the median of its widest axis, and where each leaf starts."""
    order, parts = np.arange(len(x)), [(0, len(x))]
    for _ in range(max(0, (len(x) // LEAF).bit_length())):
        halves = []
        for a, b in parts:
            v = x[order[a:b]]
            axis, mid = int(np.argmax(np.ptp(v, axis=0))), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(v[:, axis], mid)]
            halves += [(a, a + mid), (a + mid, b)]
        parts = halves
    return order, [a for a, _ in parts]


def nearest_walk(x: np.ndarray) -> list[int]:
    """Indices of ``x`` from the point farthest from the mean, always to the nearest point left, ties to the smaller index.

    The points lie in the leaves of a k-d tree. A leaf keeps those that are left in
    front; a search looks at the leaf it stands in, and then at those parts of the
    tree whose boxes are no farther than the best point found and not yet empty.
    """
    at = int(np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1).round(9)))
    order, starts = tree_of(x)
    first_leaf = len(starts)
    sizes = np.diff([*starts, len(x)])
    cx, cy, cz = (np.ascontiguousarray(x[order, i]) for i in range(3))
    name = order.copy()
    leaf_at = np.empty(len(x), np.int64)
    leaf_at[order] = np.repeat(np.arange(first_leaf), sizes)
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    leaf_at, place, left = leaf_at.tolist(), place.tolist(), sizes.tolist()
    # boxes and numbers of leaves with points, as a heap: node k has the parts 2k and 2k + 1
    low, high = np.empty((2 * first_leaf, 3)), np.empty((2 * first_leaf, 3))
    low[first_leaf:], high[first_leaf:] = np.minimum.reduceat(x[order], starts), np.maximum.reduceat(x[order], starts)
    for k in range(first_leaf - 1, 0, -1):
        low[k], high[k] = np.minimum(low[2 * k], low[2 * k + 1]), np.maximum(high[2 * k], high[2 * k + 1])
    boxes = [tuple(b) for b in np.hstack([low, high]).tolist()]
    full = [0] * first_leaf + [1] * first_leaf
    for k in range(first_leaf - 1, 0, -1):
        full[k] = full[2 * k] + full[2 * k + 1]
    coordinates, way = x.tolist(), [at]
    for _ in range(len(x) - 1):
        # the point leaves its leaf: the leaf's last one takes its place
        leaf = leaf_at[at]
        left[leaf] -= 1
        p, q = place[at], starts[leaf] + left[leaf]
        if p != q:
            moved = int(name[q])
            cx[p], cy[p], cz[p], name[p], place[moved] = cx[q], cy[q], cz[q], moved, p
        k = leaf + first_leaf
        if not left[leaf]:
            up = k
            while up:
                full[up] -= 1
                up >>= 1
        px, py, pz = coordinates[at]
        best, at = np.inf, -1
        look = [k] if left[leaf] else []
        while True:
            while look:
                n = look.pop()
                if not full[n]:
                    continue
                if n != k:
                    a, b, c, d, e, f = boxes[n]
                    away = 0.0
                    if px < a:
                        away += (a - px) * (a - px)
                    elif px > d:
                        away += (px - d) * (px - d)
                    if py < b:
                        away += (b - py) * (b - py)
                    elif py > e:
                        away += (py - e) * (py - e)
                    if pz < c:
                        away += (c - pz) * (c - pz)
                    elif pz > f:
                        away += (pz - f) * (pz - f)
                    if away > best * (1 + 1e-12):
                        continue
                if n < first_leaf:
                    # the half on this side first
                    near = 2 * n
                    box = boxes[near]
                    if not (box[0] <= px <= box[3] and box[1] <= py <= box[4] and box[2] <= pz <= box[5]):
                        near += 1
                    look += [near ^ 1, near]
                    continue
                s = starts[n - first_leaf]
                t = s + left[n - first_leaf]
                dx, dy, dz = cx[s:t] - px, cy[s:t] - py, cz[s:t] - pz
                dist = dx * dx + dy * dy + dz * dz
                i = int(dist.argmin())
                d = float(dist[i])
                if d <= best:
                    found = int(name[s + i])
                    if np.count_nonzero(dist == d) > 1:
                        found = int(name[s:t][dist == d].min())
                    at = found if d < best or at < 0 else min(at, found)
                    best = d
            if k == 1:
                break
            look.append(k ^ 1)
            k >>= 1
            n = k
        way.append(at)
    return way


def nearest_walks(x: np.ndarray) -> np.ndarray:
    """``nearest_walk`` of many segments of equally many points (segment, point, axis) at once, every point left looked at: for short ones."""
    m, n = x.shape[:2]
    rows, left, way = np.arange(m), np.ones((m, n), bool), np.empty((m, n), np.int64)
    # the mean of a segment as of it alone: sums over another axis add in another order
    mean = np.array([v.mean(axis=0) for v in x])
    at = ((x - mean[:, None]) ** 2).sum(axis=2).round(9).argmax(axis=1)
    for k in range(n):
        way[:, k] = at
        left[rows, at] = False
        d = x - x[rows, at][:, None]
        d = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]
        at = np.where(left, d, np.inf).argmin(axis=1)
    return way


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by segment and point, with ``ord``. Whole segments of a batch are walked together by their number of points, long ones alone; the last segment of a batch waits for the next."""

    def ids_of(rows: pa.Table | pa.RecordBatch) -> pd.DataFrame:
        return rows.select(SEGMENT).to_pandas(integer_object_nulls=True)

    def numbered(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        ids = ids_of(table).groupby(SEGMENT, sort=False, dropna=False).ngroup().to_numpy()
        start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        size = np.diff(np.r_[start, len(ids)])
        x, out = np.column_stack([table.column(c).to_numpy() for c in AXES]).astype(float), np.zeros(len(ids), np.int64)
        for n in np.unique(size):
            of = start[size == n]
            if n <= 2:
                way = np.tile(np.arange(n), (len(of), 1))
            elif n <= LEAF:
                few = max(1, (1 << 18) // n)
                way = np.concatenate([nearest_walks(x[of[i : i + few, None] + np.arange(n)]) for i in range(0, len(of), few)])
            else:
                way = np.array([nearest_walk(x[a : a + n]) for a in of])
            out[of[:, None] + way] = np.arange(n)
        yield from table.append_column("ord", pa.array(out.astype(np.int32))).to_batches()

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        own = ids_of(b)
        before = [ids_of(held[-1].slice(held[-1].num_rows - 1))] if held else []
        code = pd.concat([*before, own]).groupby(SEGMENT, sort=False, dropna=False).ngroup().to_numpy()
        if code[0] != code[-1]:  # else the segment goes on
            n = int(np.argmax(code == code[-1])) - len(before)
            yield from numbered([*held, b.slice(0, n)])
            held, b = [], b.slice(n)
        held.append(b)
    if held:
        yield from numbered(held)


def order_points(points: DataFrame) -> DataFrame:
    """``points`` with ``ord`` along the line: from an end, always to the nearest point left; two points keep their order. Each step depends on all before it, so one segment is walked in one task, in time n log n and some 200 bytes a point; short segments are walked many at a time."""
    rows = points.drop("ord")
    return rows.repartition(*SEGMENT).sortWithinPartitions(*SEGMENT, "point_id").mapInArrow(walked, rows.withColumn("ord", F.lit(0)).schema)


def with_steps(points: DataFrame) -> DataFrame:
    w = along()
    return points.withColumn("_step", F.coalesce(norm([F.col(c) - F.lag(c).over(w) for c in AXES]), F.lit(0.0)))


def segment_length(points: DataFrame) -> DataFrame:
    return with_steps(points).groupBy(*SEGMENT).agg(F.sum("_step").alias("length"))


def endpoints(points: DataFrame) -> DataFrame:
    p = F.struct("point_id", *AXES)
    e = points.groupBy(*SEGMENT).agg(F.min_by(p, "ord").alias("a"), F.max_by(p, "ord").alias("b"))
    return e.select(*SEGMENT, *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("point_id", *AXES)])


def segment_tortuosity(points: DataFrame) -> DataFrame:
    """Length over distance of the ends; 1 for one point or equal ends."""
    p = F.struct(*AXES)
    s = with_steps(points).groupBy(*SEGMENT).agg(F.sum("_step").alias("length"), F.min_by(p, "ord").alias("a"), F.max_by(p, "ord").alias("b"))
    return s.select(*SEGMENT, F.coalesce(F.col("length") / F.nullif(distance("a.", "b."), F.lit(0.0)), F.lit(1.0)).alias("tortuosity"))


def curvature(points: DataFrame, per: str = "point") -> DataFrame:
    """|r' x r''| / |r'|^3 by central differences; 0 at the ends, as their second difference is not defined."""
    w = along()
    first = [(F.lead(c).over(w) - F.lag(c).over(w)) / 2 for c in AXES]
    second = [F.lead(c).over(w) - 2 * F.col(c) + F.lag(c).over(w) for c in AXES]
    p = points.select(*SEGMENT, "point_id", "ord", *[e.alias(f"_f{c}") for c, e in zip(AXES, first, strict=True)], *[e.alias(f"_s{c}") for c, e in zip(AXES, second, strict=True)])
    f, s = [F.col(f"_f{c}") for c in AXES], [F.col(f"_s{c}") for c in AXES]
    p = p.select(*SEGMENT, "point_id", "ord", F.coalesce(norm(cross(f, s)) / F.nullif(F.pow(norm(f), 3), F.lit(0.0)), F.lit(0.0)).alias("curvature"))
    return p if per == "point" else p.groupBy(*SEGMENT).agg(F.avg("curvature").alias("curvature"))


def bend_angles(points: DataFrame) -> DataFrame:
    """Interior angle at each inner point; null at the ends."""
    w = along()
    return points.withColumn("angle", angle_between(step(-1, w), step(1, w)))


def cut_sharp_bends(points: DataFrame, min_angle: float = 150.0) -> DataFrame:
    """Segments split after each bend sharper than ``min_angle``. A bend right after a cut has become an end, so of a run of sharp bends every second one cuts. New segments are numbered within the cloud."""
    w = along()
    p = bend_angles(points).withColumn("_sharp", F.coalesce((F.col("angle") < min_angle).cast("int"), F.lit(0)))
    p = p.withColumn("_calm", F.sum(1 - F.col("_sharp")).over(w))
    run = Window.partitionBy(*SEGMENT, "_calm", "_sharp").orderBy("ord")
    p = p.withColumn("_cut", F.when((F.col("_sharp") == 1) & (F.row_number().over(run) % 2 == 1), 1).otherwise(0))
    p = p.withColumn("_part", F.coalesce(F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    named = p.withColumn("seg_id", F.when(F.col("seg_id").isNotNull(), F.struct("seg_id", "_part")))
    return dense_ids(named.select("cloud_id", "seg_id", *[c for c in points.columns if c not in SEGMENT]), ["cloud_id"], "seg_id")


def resample(points: DataFrame, spacing: float) -> DataFrame:
    """Points at equal arc length; the start is kept."""
    w = along()
    p = with_steps(points).withColumn("_at", F.sum("_step").over(w))
    p = p.withColumns({"_next": F.lead("_at").over(w), **{f"_n{c}": F.lead(c).over(w) for c in AXES}})
    first, last = F.ceil(F.col("_at") / spacing), F.ceil(F.col("_next") / spacing) - 1
    single = F.col("_next").isNull() & (F.col("_at") == 0)
    ks = F.when(single, F.array(F.lit(0).cast("long"))).when(last >= first, F.sequence(first, last))
    p = p.where(ks.isNotNull()).withColumn("_k", F.explode(ks))
    part = F.coalesce((F.col("_k") * spacing - F.col("_at")) / F.nullif(F.col("_next") - F.col("_at"), F.lit(0.0)), F.lit(0.0))
    return p.select(*SEGMENT, F.col("_k").cast("int").alias("ord"), *[F.coalesce(F.col(c) + part * (F.col(f"_n{c}") - F.col(c)), F.col(c)).alias(c) for c in AXES])


def smooth(points: DataFrame, s: int = 2) -> DataFrame:
    """Mean over a window of ``s`` points to both sides, for segments of more than four points."""
    w = along()
    whole = Window.partitionBy(*SEGMENT)
    many = F.count(F.lit(1)).over(whole) > 4
    return points.withColumns({c: F.when(many, F.avg(c).over(w.rowsBetween(-s, s))).otherwise(F.col(c)) for c in AXES})


def renumber(points: DataFrame, start: int = 0) -> DataFrame:
    return dense_ids(points, ["cloud_id"], "seg_id", start)


def sort_by_length(points: DataFrame) -> DataFrame:
    """The shortest segment of a cloud becomes 0, ties by id. Segments are dealt out by range of length, so a cloud may have any number of them; points of no segment stay as they are."""
    order = dense_ids(segment_length(points).where("seg_id is not null").withColumn("_new", F.struct("length", "seg_id")), ["cloud_id"], "_new").select(*[F.col(c).alias(f"_k_{c}") for c in SEGMENT], "_new")
    return points.join(order, null_safe(points, order, SEGMENT), "left").withColumn("seg_id", F.col("_new")).select(points.columns)


def filter_short(points: DataFrame, min_length: float = 1000.0) -> DataFrame:
    return points.join(segment_length(points).where(F.col("length") >= min_length), SEGMENT, "left_semi")


def end_table(points: DataFrame) -> DataFrame:
    """Two rows a segment: an end and the unit vector that leads out of it."""
    near = F.struct(*AXES)
    lists = points.groupBy(*SEGMENT).agg(F.min_by(near, "ord").alias("a"), F.max_by(near, "ord").alias("b"), F.min("ord").alias("_lo"), F.max("ord").alias("_hi"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    w = along()
    inner = points.select(*SEGMENT, "ord", *[(F.col(c) - F.coalesce(F.lead(c).over(w), F.col(c))).alias(f"_o{c}") for c in AXES], *[(F.col(c) - F.coalesce(F.lag(c).over(w), F.col(c))).alias(f"_i{c}") for c in AXES])
    heads = lists.join(inner, SEGMENT).where("ord = _lo").select(*SEGMENT, F.lit(0).alias("end"), *[F.col(f"a.{c}").alias(c) for c in AXES], *[F.col(f"_o{c}").alias(f"v{c}") for c in AXES])
    tails = lists.join(inner, SEGMENT).where("ord = _hi").select(*SEGMENT, F.lit(1).alias("end"), *[F.col(f"b.{c}").alias(c) for c in AXES], *[F.col(f"_i{c}").alias(f"v{c}") for c in AXES])
    e = heads.unionByName(tails)
    length = F.nullif(norm([F.col(f"v{c}") for c in AXES]), F.lit(0.0))
    return e.withColumns({f"v{c}": F.col(f"v{c}") / length for c in AXES})


def facing(cylinder: float) -> Where:
    """Which pairs of ends, as arrays, are of two segments, lead towards each other and lie within the cylinder around the way out of the first."""

    def good(a: dict, i: np.ndarray, b: dict, j: np.ndarray) -> np.ndarray:
        gap = [b[f"t_{c}"][j] - a[c][i] for c in AXES]
        va, vb = [a[f"v{c}"][i] for c in AXES], [b[f"t_v{c}"][j] for c in AXES]
        product = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
        dist, axial = np.sqrt(product(gap, gap)), product(gap, va)
        radial = np.sqrt(np.maximum(dist * dist - axial * axial, 0.0))
        return (a["seg_id"][i] != b["t_seg_id"][j]) & (axial >= 0) & (radial <= cylinder) & (product(va, vb) < 0)

    return good


def end_links(points: DataFrame, max_dist: float, cylinder: float) -> DataFrame:
    """Pairs of ends of two segments that face each other: near, within the cylinder around the way out, and each other's best."""
    e = end_table(points).where("vx is not null and vy is not null and vz is not null and seg_id is not null").withColumn("point_id", F.struct("seg_id", "end"))
    # of ends at one place that lead the same way the first three stand for all: only two are of the segment that asks
    alike = Window.partitionBy("cloud_id", *AXES, "vx", "vy", "vz").orderBy("seg_id", "end")
    some = e.withColumn("_nth", F.row_number().over(alike)).where("_nth <= 3").drop("_nth")
    way = ["seg_id", "vx", "vy", "vz"]
    near = knn(e, some, 1, carry=way, own=way, within=max_dist, where=facing(cylinder))
    best = near.select("cloud_id", *[F.col(f"{c}.{f}").alias(f"{p}_{f}") for p, c in (("a", "src"), ("b", "dst")) for f in ("seg_id", "end")], "dist")
    back = best.select("cloud_id", F.col("b_seg_id").alias("a_seg_id"), F.col("b_end").alias("a_end"), F.col("a_seg_id").alias("b_seg_id"), F.col("a_end").alias("b_end"))
    return best.join(back, back.columns, "left_semi")


def chain_places(links: DataFrame, chains: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cloud_id, seg_id, _before, _turn): how many points of its chain lie before a segment, and whether the chain runs through it backwards.

    A state is a segment and the end at which it is entered; a link leads from it to
    the state of the next segment. Pointers double their reach from round to round and
    add up the points they pass, until all lead to the end of their chain. Of the two
    directions of a chain the one that ends at the larger segment is taken. A ring is
    opened before end 0 of its smallest segment.
    """
    ends = links.groupBy("cloud_id", F.col("a_seg_id").alias("seg_id")).agg(F.count(F.lit(1)).alias("_l")).join(chains, SEGMENT)
    rings = ends.groupBy("cloud_id", "_new").agg(F.min("_l").alias("_least")).where("_least = 2").select("cloud_id", F.col("_new").alias("_ring"))
    opened = rings.select("cloud_id", F.col("_ring").alias("seg_id"), F.lit(0).alias("end"), F.lit(True).alias("_cut"))
    side = lambda p: opened.select("cloud_id", *[F.col(c).alias(f"{p}_{c}") for c in ("seg_id", "end")])
    kept = links.join(side("a"), ["cloud_id", "a_seg_id", "a_end"], "left_anti").join(side("b"), ["cloud_id", "b_seg_id", "b_end"], "left_anti")
    members = chains.join(sizes, SEGMENT)
    states = members.withColumn("_in", F.explode(F.array(F.lit(0), F.lit(1))))
    out = kept.select("cloud_id", F.col("a_seg_id").alias("seg_id"), (1 - F.col("a_end")).alias("_in"), F.struct(F.col("b_seg_id").alias("s"), F.col("b_end").alias("e")).alias("_to"))
    key = ["cloud_id", "seg_id", "_in"]
    now = cut(states.join(out, key, "left").select(*key, "_to", F.col("_n").alias("_passed"), F.struct(F.col("seg_id").alias("s"), F.col("_in").alias("e")).alias("_last")), "chains")
    while not now.where("_to is not null").isEmpty():
        then = now.select("cloud_id", F.struct(F.col("seg_id").alias("s"), F.col("_in").alias("e")).alias("_to"), F.col("_to").alias("_next"), F.col("_passed").alias("_more"), F.col("_last").alias("_end"))
        now = cut(now.join(then, ["cloud_id", "_to"], "left").select(*key, F.col("_next").alias("_to"), (F.col("_passed") + F.coalesce("_more", F.lit(0))).alias("_passed"), F.coalesce("_end", "_last").alias("_last")), "chains")
    by_end = now.groupBy(*SEGMENT).agg(F.max_by(F.struct("_in", "_passed"), "_last").alias("_way"), F.sum("_passed").alias("_both")).join(sizes, SEGMENT)
    return by_end.select(*SEGMENT, (F.col("_both") - F.col("_n") - F.col("_way._passed")).alias("_before"), (F.col("_way._in") == 1).alias("_turn"), "_n")


def connect_ends(points: DataFrame, max_dist: float = 2500.0, cylinder: float = 250.0) -> DataFrame:
    """Segments joined at facing ends get one id, ids are renumbered. A joined line keeps the points of its segments in their order, each segment forwards or backwards; ``ord`` counts along the line."""
    links = cut(end_links(points, max_dist, cylinder), "links")
    node = lambda c: F.struct("cloud_id", F.col(c).alias("s"))
    chains = connected_components(links.select(node("a_seg_id").alias("src"), node("b_seg_id").alias("dst"))).select("node.cloud_id", F.col("node.s").alias("seg_id"), F.col("component.s").alias("_new"))
    sizes = points.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("_n"))
    places = chains.join(chain_places(links, chains, sizes), SEGMENT)
    nth = F.row_number().over(Window.partitionBy(*SEGMENT).orderBy("ord", "point_id")) - 1
    linked = points.join(places, SEGMENT).withColumn("_r", nth)
    ord_ = F.col("_before") + F.when(F.col("_turn"), F.col("_n") - 1 - F.col("_r")).otherwise(F.col("_r"))
    joined = linked.withColumns({"ord": ord_.cast(points.schema["ord"].dataType), "seg_id": F.col("_new")}).select(points.columns)
    same = points.join(chains, SEGMENT, "left_anti")
    return renumber(joined.unionByName(same))


def connect_near_segments(points: DataFrame, max_dist: float = 1000.0, cylinder: float = 250.0) -> DataFrame:
    return connect_ends(points, max_dist, cylinder)


def confidence(edges: DataFrame, nodes: DataFrame, threshold: float = 0.5, k: int = 2) -> DataFrame:
    """Mean probability of a segment's kept edges. ``nodes`` is what cut_graph returns."""
    return kept_confidence(kept_edges(edges, threshold, k), nodes)


def kept_confidence(kept: DataFrame, nodes: DataFrame) -> DataFrame:
    return kept.join(nodes.withColumnRenamed("node", "src"), ["cloud_id", "src"]).groupBy("cloud_id", "seg_id").agg(F.avg("prob").alias("confidence"))


def overlap_probability(a: DataFrame, b: DataFrame, dist: float, by_b: bool = False) -> DataFrame:
    """Share of each segment's points that have a point of ``b`` (of one segment of it, if ``by_b``) within ``dist``."""
    if by_b:
        met = band_pairs(a, b, dist, ["cloud_id"], ["seg_id", "point_id"], ["seg_id"]).withColumnRenamed("a_seg_id", "seg_id")
    else:  # the nearest point of ``b`` says it
        near = knn(a.withColumn("point_id", F.struct("seg_id", "point_id")), b, 1, within=dist)
        met = near.select("cloud_id", "src.seg_id", F.col("src.point_id").alias("a_point_id"))
    keys = ["cloud_id", "seg_id", *(["b_seg_id"] if by_b else [])]
    hits = met.select(*keys, "a_point_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    return a.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("_n")).join(hits.hint("merge"), SEGMENT, "left").select(*keys, F.coalesce(F.col("_k") / F.col("_n"), F.lit(0.0)).alias("overlap"))


def compare_segmentations(a: DataFrame, b: DataFrame, dist: float = 175.0, min_overlap: float = 0.25) -> DataFrame:
    """(cloud_id, seg_id, class): segments of both that match one of the other, and those that do not."""
    parts = []
    for name, one, other in (("a", a, b), ("b", b, a)):
        met = most_met(one, other, dist, min_overlap)
        parts.append(met.select(*SEGMENT, F.when(F.col("_k") / F.col("_n") >= min_overlap, f"{name}_matched").otherwise(f"{name}_noise").alias("class")))
    return parts[0].unionByName(parts[1])


def thin_order_smooth(points: DataFrame, cell: float = 5.0, s: int = 2) -> DataFrame:
    thin = downsample_medoid(points, cell)
    many = thin.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("_n")).where("_n > 3")
    return smooth(order_points(thin.join(many, SEGMENT, "left_semi")), s)


def segment_lines(edges: DataFrame, points: DataFrame, threshold: float = 0.5, k: int = 2, prune: int = 5, sort: bool = True, smooth_lines: bool = False, cell: float = 5.0) -> DataFrame:
    """The graph cut with coordinates: (cloud_id, seg_id, point_id, ord, x, y, z) of the points of each segment, in order along it, or by id where ``sort`` is off. Smoothed lines are thinned by ``cell`` first, those of up to three points go, and segments keep their ids."""
    cut_ = cut_graph(edges, threshold, k, prune)
    found = points.select("cloud_id", "point_id", *AXES).join(cut_.withColumnRenamed("node", "point_id"), ["cloud_id", "point_id"])
    found = found.withColumn("ord", F.lit(0)).select(*SEGMENT, "point_id", "ord", *AXES)
    if smooth_lines:
        return thin_order_smooth(found, cell).select(*SEGMENT, "point_id", "ord", *AXES)
    by_id = F.row_number().over(Window.partitionBy(*SEGMENT).orderBy("point_id")) - 1
    return order_points(found).select(found.columns) if sort else found.withColumn("ord", by_id)


def intensity_along(points: DataFrame, voxels: DataFrame) -> DataFrame:
    """Mean and sum of the image under a filament, and both per length."""
    cells = interpolate_polyline(points).select(*SEGMENT, "z", "y", "x").distinct()
    v = voxels.withColumnRenamed("image_id", "cloud_id") if "image_id" in voxels.columns else voxels
    # the walked cells look few to the planner, which would broadcast them
    on = cells.join(v.hint("merge"), ["cloud_id", "z", "y", "x"]).groupBy(*SEGMENT).agg(F.avg("value").alias("mean_intensity"), F.sum("value").alias("sum_intensity"))
    j = on.join(segment_length(points).hint("merge"), SEGMENT)
    per = lambda c: (F.col(c) / F.nullif(F.col("length"), F.lit(0.0))).alias(f"{c}_per_length")
    return j.select(*SEGMENT, "mean_intensity", "sum_intensity", per("mean_intensity"), per("sum_intensity"))


def filament_report(points: DataFrame, voxels: DataFrame | None = None, px: float | None = None) -> DataFrame:
    """A row for each segment: points, length, tortuosity, curvature and, with an image, intensities."""
    if px:
        points = points.withColumns({c: F.col(c) * px for c in AXES})
    out = points.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("n_points"))
    for part in (segment_length(points), segment_tortuosity(points), curvature(points, "segment")):
        out = out.join(part, SEGMENT)
    return out.join(intensity_along(points, voxels), SEGMENT, "left") if voxels is not None else out


def offset_union(sets: list[DataFrame]) -> DataFrame:
    """Several sets in one, ids of each after those of the ones before."""
    parts = [s.withColumn("_set", F.lit(i)) for i, s in enumerate(sets)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return dense_ids(both.withColumn("seg_id", F.when(F.col("seg_id").isNotNull(), F.struct("_set", "seg_id"))).drop("_set"), ["cloud_id"], "seg_id")
