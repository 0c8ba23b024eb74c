"""Graphs over points and the graph cut."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spatialseg.components import connected_components
from spatialseg.functions.geometry import AXES, along, squared
from spatialseg.operators.cloud import build_patches, downsample_medoid, scale_cloud
from spatialseg.operators.knn import knn
from spatialseg.operators.project import dense_ids

PAIR = ["cloud_id", "src", "dst"]


def chain_edges(points: DataFrame, close_below: float = 5.0) -> DataFrame:
    """Both directions between consecutive points, self loops, and the closing edge of near-closed lines."""
    w = along()
    step = points.select("cloud_id", F.col("point_id").alias("src"), F.lead("point_id").over(w).alias("dst")).where("dst is not null")
    loops = points.select("cloud_id", F.col("point_id").alias("src"), F.col("point_id").alias("dst"))
    p = F.struct("point_id", *AXES)
    ends = points.groupBy("cloud_id", "seg_id").agg(F.min_by(p, "ord").alias("a"), F.max_by(p, "ord").alias("b"), F.count(F.lit(1)).alias("n"))
    gap = F.sqrt(squared("a.", "b."))
    ring = ends.where((gap < close_below) & (F.col("n") > 2)).select("cloud_id", F.col("b.point_id").alias("src"), F.col("a.point_id").alias("dst"))
    one = step.unionByName(ring)
    return one.unionByName(one.select("cloud_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).unionByName(loops).distinct()


def knn_edges(points: DataFrame, k: int, same_label: bool = True) -> DataFrame:
    """k nearest, the point itself among them; with ``same_label`` those of another label are dropped."""
    near = knn(points, points, k, carry=["seg_id"])
    own = near.join(points.select("cloud_id", F.col("point_id").alias("src"), "seg_id"), ["cloud_id", "src"])
    return (own.where(F.col("seg_id") == F.col("t_seg_id")) if same_label else own).select(*PAIR, "dist")


def gaussian_bank(dist, sigmas: list[float], zero_below: float = 0.0):
    bank = F.transform(F.array(*map(F.lit, sigmas)), lambda s: F.exp(-dist * dist / (2 * s * s)))
    return F.transform(bank, lambda v: F.when(F.isnan(v) | (v <= zero_below), 0.0).otherwise(v))


def knn_edge_features(points: DataFrame, k: int, sigmas: list[float], zero_below: float = 0.0) -> DataFrame:
    return knn(points, points, k).select(*PAIR, "dist", gaussian_bank(F.col("dist"), sigmas, zero_below).alias("feat"))


def pairwise_features(patch_points: DataFrame, sigma: float) -> DataFrame:
    """Gaussian kernel of all pairs inside a patch; patches are bounded by their builder."""
    side = lambda p: patch_points.select("cloud_id", "patch_id", *[F.col(c).alias(f"{p}{c}") for c in ("point_id", *AXES)])
    pairs = side("a_").join(side("b_"), ["cloud_id", "patch_id"])
    value = F.when(F.col("a_point_id") == F.col("b_point_id"), 1.0).otherwise(F.exp(-squared("a_", "b_") / (2 * sigma * sigma)))
    return pairs.select("cloud_id", "patch_id", F.col("a_point_id").alias("src"), F.col("b_point_id").alias("dst"), value.alias("prob"))


def incoming_neighbours(edges: DataFrame, k: int) -> DataFrame:
    """Per node its k nearest incoming edges."""
    w = Window.partitionBy("cloud_id", "dst").orderBy("dist", "src")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbour_slots(edges: DataFrame, k: int) -> DataFrame:
    """(cloud_id, node, side, rank, src, dst, dist): of each node its k nearest outgoing edges and its k nearest incoming ones, ties to the smaller other end."""

    def of(side: str, node: str, other: str) -> DataFrame:
        w = Window.partitionBy("cloud_id", node).orderBy("dist", other)
        return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("cloud_id", F.col(node).alias("node"), F.lit(side).alias("side"), "rank", "src", "dst", "dist")

    return of("out", "src", "dst").unionByName(of("in", "dst", "src"))


def stitch_edges_mean(edges: DataFrame) -> DataFrame:
    return edges.groupBy(*PAIR).agg(F.avg("prob").alias("prob"))


def merge_edges_median(edges: DataFrame, threshold: float) -> DataFrame:
    """Edges under the threshold go patch by patch first, self edges go, then the median over patches."""
    own = Window.partitionBy(*PAIR)
    kept = edges.where((F.col("prob") >= threshold) & (F.col("src") != F.col("dst"))).select(*PAIR, "prob")
    ranked = kept.withColumns({"_r": F.row_number().over(own.orderBy("prob")), "_n": F.count(F.lit(1)).over(own)})
    # the one or two scores in the middle; a sort of the pair's few rows, no map of values for each pair
    return ranked.where((2 * F.col("_r") >= F.col("_n")) & (2 * F.col("_r") <= F.col("_n") + 2)).groupBy(*PAIR).agg(F.avg("prob").alias("prob"))


def mutual_edges(edges: DataFrame) -> DataFrame:
    back = edges.select("cloud_id", F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    return edges.join(back, PAIR, "left_semi")


def top_k_edges(edges: DataFrame, k: int) -> DataFrame:
    """The k strongest of each node, and of those the mutual ones."""
    w = Window.partitionBy("cloud_id", "src").orderBy(F.desc("prob"), "dst")
    return mutual_edges(edges.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r"))


def segment_components(edges: DataFrame) -> DataFrame:
    """(cloud_id, node, component) with the smallest node as name."""
    # a null cloud is a cloud of its own; joins need a key that is never null
    cloud = F.when(F.col("cloud_id").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("cloud_id").cast("string")))
    found = connected_components(edges.select(cloud.alias("_cloud"), "src", "dst"), keys=["_cloud"])
    own = F.when(F.col("_cloud") != "-", F.substring("_cloud", 2, 2**31 - 1)).cast(edges.schema["cloud_id"].dataType)
    return found.select(own.alias("cloud_id"), "node", "component")


def prune_segments(components: DataFrame, min_points: int) -> DataFrame:
    large = components.groupBy("cloud_id", "component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points)
    return components.join(large, ["cloud_id", "component"], "left_semi")


def number_segments(components: DataFrame) -> DataFrame:
    """Ids from 0 in order of the smallest node."""
    return dense_ids(components.withColumn("seg_id", F.col("component")), ["cloud_id"], "seg_id").select("cloud_id", "node", "seg_id")


def segment_transitive(edges: DataFrame, t: float) -> DataFrame:
    return segment_components(edges.where(F.col("prob") >= t))


def stitch_points(patch_points: DataFrame) -> DataFrame:
    """One row a point; of several patches the last wins."""
    cols = [c for c in patch_points.columns if c not in ("cloud_id", "point_id", "patch_id")]
    last = patch_points.groupBy("cloud_id", "point_id").agg(F.max_by(F.struct(*cols), "patch_id").alias("_s"))
    return last.select("cloud_id", "point_id", *[F.col(f"_s.{c}").alias(c) for c in cols])


def kept_edges(edges: DataFrame, threshold: float, k: int) -> DataFrame:
    return top_k_edges(mutual_edges(merge_edges_median(edges, threshold)), k)


def cut_graph(edges: DataFrame, threshold: float = 0.5, k: int = 2, prune: int = 5) -> DataFrame:
    """Scored edges of overlapping patches to numbered segments: (cloud_id, node, seg_id)."""
    return cut_kept(kept_edges(edges, threshold, k), prune)


def cut_kept(kept: DataFrame, prune: int = 5) -> DataFrame:
    return number_segments(prune_segments(segment_components(kept), prune))


def polyline_edges(points: DataFrame) -> DataFrame:
    return points.select("cloud_id", "seg_id", F.col("point_id").alias("src"), F.lead("point_id").over(along()).alias("dst")).where("dst is not null")


def knn_triangles(points: DataFrame, k: int = 6) -> DataFrame:
    """Triangles of each point and every two of its k - 1 neighbours in its segment, each once."""
    large = points.groupBy("cloud_id", "seg_id").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 3")
    p = points.join(large, ["cloud_id", "seg_id"], "left_semi")
    near = knn(p, p, k - 1, keys=["cloud_id", "seg_id"], exclude_self=True)
    around = near.groupBy("cloud_id", "seg_id", "src").agg(F.array_sort(F.collect_list("dst")).alias("d"))  # k - 1 ids
    pairs = F.flatten(F.transform("d", lambda a: F.transform(F.filter("d", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    tri = around.select("cloud_id", "seg_id", "src", F.explode(pairs).alias("e")).select("cloud_id", "seg_id", F.array_sort(F.array("src", "e.a", "e.b")).alias("t"))
    return tri.select("cloud_id", "seg_id", *[F.col("t")[i].alias(n) for i, n in enumerate("abc")]).distinct()


#: Points of a patch that a scorer takes at most.
PATCH_MOST = 100_000
#: Scorers that this Python worker has loaded.
_LOADED: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}


def loaded(key: str, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The scorer of a key, loaded once in the life of a Python worker."""
    if key not in _LOADED:
        _LOADED[key] = load()
    return _LOADED[key]


def whole_patches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pd.DataFrame]:
    """The rows of one patch after the other, from batches that are sorted by patch; a patch of more than ``most`` points is an error as soon as that is known."""
    kept: list[pd.DataFrame] = []
    name, rows = None, 0
    for b in batches:
        for key, part in b.to_pandas().groupby(["cloud_id", "patch_id"], sort=False, dropna=False):
            if kept and key != name:
                yield pd.concat(kept, ignore_index=True)
                kept, rows = [], 0
            name, rows = key, rows + len(part)
            kept.append(part)
            if rows > most:
                raise ValueError(f"patch {name[1]} of cloud {name[0]} has more than {most} points")
    if kept:
        yield pd.concat(kept, ignore_index=True)


def score_patches(patch_points: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame] | None = None, sigma: float = 1.0, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]] | None = None, most: int = PATCH_MOST) -> DataFrame:
    """Edge probabilities of each patch from a scorer (rows of one patch by point_id -> src, dst, prob), self edges 1; without one the Gaussian kernel.

    ``load`` makes the scorer where it runs, once for each Python worker and not for each
    patch: that is where a model is read. Tasks stream through sorted patches and hold
    one at a time.
    """
    if scorer is None and load is None:
        return pairwise_features(patch_points, sigma)
    cloud = patch_points.schema["cloud_id"].dataType.simpleString()
    key = uuid.uuid4().hex
    schema = f"cloud_id {cloud}, patch_id int, src long, dst long, prob double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for pdf in whole_patches(batches, most):
            score = scorer if load is None else loaded(key, load)
            out = score(pdf)[["src", "dst", "prob"]].astype({"src": "int64", "dst": "int64", "prob": "float64"})
            kind = kind or pa.Schema.from_pandas(pdf[["cloud_id"]], preserve_index=False).field(0).type
            n = len(out)
            yield pa.record_batch([pa.array([pdf["cloud_id"].iloc[0]] * n, kind), pa.array([int(pdf["patch_id"].iloc[0])] * n, pa.int32()), *(pa.array(out[c].to_numpy()) for c in ("src", "dst", "prob"))], names=["cloud_id", "patch_id", "src", "dst", "prob"])

    scored = patch_points.repartition("cloud_id", "patch_id").sortWithinPartitions("cloud_id", "patch_id", "point_id").mapInArrow(run, schema)
    return scored.withColumn("prob", F.when(F.col("src") == F.col("dst"), 1.0).otherwise(F.col("prob")))


#: How each kind of labelled set becomes a graph: neighbours of a point, 0 for the chains of filaments.
KINDS = {"filament": 0, "part": 6, "indoor": 6, "room": 8}


def load_labelled_dataset(points: DataFrame, kind: str, px: float = 1.0, cell: float | None = None, max_points: int = 500) -> dict[str, DataFrame]:
    """Tables ``points`` (scaled, down-sampled by ``cell``), ``patches`` and ``edges`` (true edges inside a patch) of a labelled set."""
    k = KINDS[kind]
    scaled = scale_cloud(points, px)
    if cell:
        scaled = downsample_medoid(scaled, cell).withColumn("ord", F.col("point_id"))
    patches = build_patches(scaled, max_points)
    edges = chain_edges(scaled) if k == 0 else knn_edges(scaled, k).select(*PAIR)
    end = lambda c: patches.select("cloud_id", "patch_id", F.col("point_id").alias(c))
    return {"points": scaled, "patches": patches, "edges": edges.join(end("src"), ["cloud_id", "src"]).join(end("dst"), ["cloud_id", "patch_id", "dst"]).select("cloud_id", "patch_id", "src", "dst")}
