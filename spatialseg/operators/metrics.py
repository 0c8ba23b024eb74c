"""Accuracy metrics on scored rows: (group_id, item_id, score, target)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatialseg.operators.graph import cut_graph
from spatialseg.operators.quantiles import group_quantiles
from spatialseg.operators.tiles import soft_skeleton

EPS = 1e-16


def P() -> Column:  # noqa: N802
    return F.col("score")


def T() -> Column:  # noqa: N802
    return F.col("target")


def counts(pred: Column, truth: Column) -> list[Column]:
    return [F.count_if(pred & truth).alias("tp"), F.count_if(pred & ~truth).alias("fp"), F.count_if(~pred & ~truth).alias("tn"), F.count_if(~pred & truth).alias("fn")]


def confusion(scored: DataFrame, t: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    return scored.groupBy(*(keys or ["group_id"])).agg(*counts(P() >= t, T() == 1))


def rates(df: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    p, r = tp / (tp + fp + EPS), tp / (tp + fn + EPS)
    return df.withColumns({"accuracy": (tp + tn) / (tp + fp + tn + fn + EPS), "precision": p, "recall": r, "f1": 2 * p * r / (p + r + EPS)})


def binarize(values: DataFrame) -> DataFrame:
    """Per group: > 0, or < 0 where nothing is positive and the maximum is 0; groups of 0 and 1 stay."""
    s = values.groupBy("group_id").agg(F.max("score").alias("_hi"), F.min("score").alias("_lo"))
    return values.join(s, "group_id").withColumn("score", F.when((F.col("_hi") == 0) & (F.col("_lo") < 0), (P() < 0).cast("int")).otherwise((P() > 0).cast("int"))).select(values.columns)


def prf(scored: DataFrame, t: float = 0.5) -> DataFrame:
    return rates(confusion(scored, t))


def sweep(scored: DataFrame, n: int) -> DataFrame:
    """Confusion at each threshold i/n, i from 0 to n-1, with strict >: one aggregation to at most n + 1 bins a group, then suffix sums over them."""
    bins = scored.withColumn("_bin", F.ceil(F.greatest(F.least(P(), F.lit(1.0)), F.lit(0.0)).cast("decimal(18,6)") * n).cast("int"))
    by = bins.groupBy("group_id", "_bin").agg(F.sum((T() == 1).cast("long")).alias("_p"), F.count(F.lit(1)).alias("_n"))
    groups = by.groupBy("group_id").agg(F.sum("_p").alias("_ps"), F.sum("_n").alias("_ns"))
    grid = groups.select("group_id", "_ps", "_ns", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    full = grid.join(by.withColumn("i", F.least(F.col("_bin"), F.lit(n)) - 1).where("i >= 0").select("group_id", "i", "_p", "_n"), ["group_id", "i"], "left")
    up = Window.partitionBy("group_id").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tp, k = F.coalesce(F.sum("_p").over(up), F.lit(0)), F.coalesce(F.sum("_n").over(up), F.lit(0))
    return full.select("group_id", "i", tp.alias("tp"), (k - tp).alias("fp"), (F.col("_ns") - F.col("_ps") - (k - tp)).alias("tn"), (F.col("_ps") - tp).alias("fn"))


def best_f1(scored: DataFrame) -> DataFrame:
    """Thresholds 0.00 to 0.99; among equal best ones the mean threshold, with the metrics of the row it falls on."""
    s = rates(sweep(scored, 100)).withColumn("f1", F.round("f1", 2))
    top = s.groupBy("group_id").agg(F.max("f1").alias("_best"))
    at = s.join(top, "group_id").where("f1 = _best").groupBy("group_id").agg(F.floor(F.avg("i") + 0.5).cast("int").alias("i"), F.avg("i").alias("_mean"))
    return at.join(s, ["group_id", "i"]).select("group_id", (F.col("_mean") / 100).alias("threshold"), *[F.round(c, 2).alias(c) for c in ("precision", "recall", "f1")])


def graph_f1(edges: DataFrame, t: float = 0.5) -> DataFrame:
    """Mean of the F1 of edges (self edges taken out) and of non-edges, per group; columns src, dst, score, target."""
    pred, real, off = P() >= t, T() == 1, F.col("src") != F.col("dst")
    c = edges.groupBy("group_id").agg(*[F.count_if(e).alias(n) for n, e in (("tp1", pred & real & off), ("fp1", pred & ~real & off), ("fn1", ~pred & real & off), ("tp0", ~pred & ~real), ("fp0", ~pred & real), ("fn0", pred & ~real))])
    f = lambda k: 2 * F.col(f"tp{k}") / (2 * F.col(f"tp{k}") + F.col(f"fp{k}") + F.col(f"fn{k}") + EPS)
    return c.select("group_id", ((f(1) + f(0)) / 2).alias("f1"))


def soft_prf(scored: DataFrame) -> DataFrame:
    """1 - mean soft F1 of both classes."""
    s = scored.groupBy("group_id").agg(F.sum(P() * T()).alias("tp"), F.sum(P() * (1 - T())).alias("fp"), F.sum((1 - P()) * T()).alias("fn"), F.sum((1 - P()) * (1 - T())).alias("tn"))
    one = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fn") + F.col("fp") + EPS)
    zero = 2 * F.col("tn") / (2 * F.col("tn") + F.col("fn") + F.col("fp") + EPS)
    return s.select("group_id", (1 - (one + zero) / 2).alias("loss"))


def ranked_sums(scored: DataFrame, parts: int = 64) -> DataFrame:
    """(group_id, score, tp, fp, positives, negatives): cumulative counts down the distinct scores.

    Equal scores are collapsed first; bins of about equally many scores, their edges
    from a sketch, split a group, so that a window holds a bin and another one the
    bins' totals. Sums do not depend on where the edges lie.
    """
    by = scored.groupBy("group_id", "score").agg(F.sum((T() == 1).cast("long")).alias("_p"), F.sum((T() != 1).cast("long")).alias("_q"))
    ends = by.groupBy("group_id").agg(F.percentile_approx("score", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 1000).alias("_cuts"), F.sum("_p").alias("positives"), F.sum("_q").alias("negatives"))
    b = by.join(ends, "group_id").withColumn("_bin", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= P())), F.lit(0))).drop("_cuts")
    totals = b.groupBy("group_id", "_bin").agg(F.sum("_p").alias("_tp"), F.sum("_q").alias("_tq"))
    above = Window.partitionBy("group_id").orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("group_id", "_bin", F.coalesce(F.sum("_tp").over(above), F.lit(0)).alias("_op"), F.coalesce(F.sum("_tq").over(above), F.lit(0)).alias("_oq"))
    inside = Window.partitionBy("group_id", "_bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return b.join(totals, ["group_id", "_bin"]).select("group_id", "score", (F.sum("_p").over(inside) + F.col("_op")).alias("tp"), (F.sum("_q").over(inside) + F.col("_oq")).alias("fp"), "_p", "_q", "positives", "negatives")


def average_precision(scored: DataFrame) -> DataFrame:
    r = ranked_sums(scored)
    return r.groupBy("group_id").agg(F.coalesce(F.sum(F.col("_p") / F.nullif(F.col("positives"), F.lit(0)) * F.col("tp") / (F.col("tp") + F.col("fp"))), F.lit(0.0)).alias("ap"))


def mask_diagonal(edges: DataFrame, mode: str = "drop") -> DataFrame:
    if mode == "drop":
        return edges.where("src <> dst")
    same = F.col("src") == F.col("dst")
    return edges.withColumns({"score": F.when(same, 1.0).otherwise(P()), "target": F.when(same, 1).otherwise(T())})


def roc_auc(scored: DataFrame, diagonal: bool = False) -> DataFrame:
    """Trapezoid area under the ROC curve; null where a class is missing."""
    r = ranked_sums(mask_diagonal(scored, "force") if diagonal else scored)
    area = F.sum(F.col("_q") * (F.col("tp") - F.col("_p") / 2)) / F.nullif(F.max("positives") * F.max("negatives"), F.lit(0))
    return r.groupBy("group_id").agg(area.alias("auc"))


def iou(scored: DataFrame, t: float = 0.5) -> DataFrame:
    return confusion(scored, t).select("group_id", (F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn") + EPS)).alias("iou"))


def pair_counts(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Common points of predicted and true instances, by equal coordinates."""
    keys = ["cloud_id", "x", "y", "z"]
    a = pred.select(*keys, F.col("seg_id").alias("p_seg")).distinct()
    b = truth.select(*keys, F.col("seg_id").alias("t_seg")).distinct()
    return a.join(b.hint("merge"), keys).groupBy("cloud_id", "p_seg", "t_seg").agg(F.count(F.lit(1)).alias("inter"))


def instance_sizes(points: DataFrame, name: str) -> DataFrame:
    return points.select("cloud_id", F.col("seg_id").alias(f"{name}_seg"), "x", "y", "z").distinct().groupBy("cloud_id", f"{name}_seg").agg(F.count(F.lit(1)).alias(f"{name}_n"))


def instance_precision(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean over true instances of the best share found in one predicted instance."""
    best = pair_counts(pred, truth).groupBy("cloud_id", "t_seg").agg(F.max("inter").alias("_m"))
    return instance_sizes(truth, "t").join(best, ["cloud_id", "t_seg"], "left").groupBy("cloud_id").agg(F.avg(F.coalesce(F.col("_m") / F.col("t_n"), F.lit(0.0))).alias("precision"))


def mean_coverage(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean, and mean by size, of each true instance's best IoU."""
    # tables of instances and of points grow with the input; what they are made of may look small enough to broadcast
    sizes = {n: instance_sizes(df, n).hint("merge") for n, df in (("p", pred), ("t", truth))}
    j = pair_counts(pred, truth).join(sizes["p"], ["cloud_id", "p_seg"]).join(sizes["t"], ["cloud_id", "t_seg"])
    best = j.groupBy("cloud_id", "t_seg").agg(F.max(F.col("inter") / (F.col("p_n") + F.col("t_n") - F.col("inter"))).alias("_b"))
    c = sizes["t"].join(best, ["cloud_id", "t_seg"], "left").withColumn("_b", F.coalesce("_b", F.lit(0.0)))
    return c.groupBy("cloud_id").agg(F.avg("_b").alias("mcov"), (F.sum(F.col("_b") * F.col("t_n")) / F.sum("t_n")).alias("mwcov"))


def pr_curve(scored: DataFrame, n: int = 1000) -> DataFrame:
    """Precision and recall at n even thresholds; where nothing lies above, the last defined precision."""
    s = sweep(scored, n)
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))
    up = Window.partitionBy("group_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return s.select("group_id", "i", F.last(p, ignorenulls=True).over(up).alias("precision"), (F.col("tp") / (F.col("tp") + F.col("fn") + EPS)).alias("recall"))


def precision_at_recall(curve: DataFrame, level: float = 0.9) -> DataFrame:
    """Linear between the nearest recalls below and above; a recall that is hit gives its precision."""
    lo = F.max(F.when(F.col("recall") <= level, F.struct("recall", "precision")))
    hi = F.min(F.when(F.col("recall") >= level, F.struct("recall", "precision")))
    j = curve.groupBy("group_id").agg(lo.alias("lo"), hi.alias("hi"))
    gap = F.nullif(F.col("hi.recall") - F.col("lo.recall"), F.lit(0.0))
    mid = F.col("lo.precision") + (F.col("hi.precision") - F.col("lo.precision")) * (level - F.col("lo.recall")) / gap
    return j.select("group_id", F.coalesce(mid, F.col("hi.precision"), F.col("lo.precision")).alias("precision_at_recall"))


def batch_benchmark(scored: DataFrame, reduce: str = "none") -> DataFrame:
    curve = pr_curve(scored)
    by = prf(scored).select("group_id", "precision", "recall", "f1").join(curve.groupBy("group_id").agg(F.avg("precision").alias("mean_precision")), "group_id").join(precision_at_recall(curve), "group_id")
    cols = [c for c in by.columns if c != "group_id"]
    if reduce == "none":
        return by
    return by.agg(*[(F.avg(c) if reduce == "mean" else F.percentile(c, F.lit(0.5))).alias(c) for c in cols])


def image_benchmark(scored: DataFrame) -> DataFrame:
    by = prf(scored).join(iou(scored), "group_id").join(average_precision(scored), "group_id").join(roc_auc(scored), "group_id")
    return by.agg(*[F.avg(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "iou", "ap", "auc")])


def graph_benchmark(scored: DataFrame, pred: DataFrame, truth: DataFrame, t: float = 0.5) -> DataFrame:
    """Means over patches of IoU and AUC, and over clouds of the coverage of cut segments."""
    patches = iou(scored, t).join(roc_auc(scored), "group_id").agg(F.avg("iou").alias("iou"), F.avg("auc").alias("auc"))
    return patches.crossJoin(mean_coverage(pred, truth).agg(F.avg("mcov").alias("mcov"), F.avg("mwcov").alias("mwcov")))  # a row each


def coverage_by_threshold(edges: DataFrame, truth: DataFrame, thresholds: tuple[float, ...] = (0.25, 0.5, 0.9), k: int = 2, prune: int = 5) -> DataFrame:
    """(cloud_id, threshold, mcov, mwcov) of graph cuts at all thresholds in one job: each is a cloud of its own. A cut that leaves nothing counts as 0. ``truth`` has point_id, coordinates and seg_id."""
    named = lambda df: df.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).withColumn("_cloud", F.col("cloud_id")).withColumn("cloud_id", F.concat_ws("@", F.col("threshold").cast("string"), "cloud_id"))
    of = named(edges)
    cut = cut_graph(of.where(F.col("prob") >= F.col("threshold")).select(edges.columns), 0.0, k, prune)
    true = named(truth)
    # neither side may be broadcast: the truth is repeated for each threshold, which the planner does not see
    pred = cut.join(true.select("cloud_id", F.col("point_id").alias("node"), "x", "y", "z").hint("merge"), ["cloud_id", "node"])
    return mean_coverage(pred, true).join(true.select("cloud_id", "_cloud", "threshold").distinct().hint("merge"), "cloud_id").select(F.col("_cloud").alias("cloud_id"), "threshold", "mcov", "mwcov")


def region_metrics(scored: DataFrame, region: Column, t: float = 0.5) -> DataFrame:
    c = rates(confusion(scored.where(region), t))
    tp, fp, fn = (F.col(x) for x in ("tp", "fp", "fn"))
    return c.select("group_id", "precision", "recall", "f1", (tp / (tp + fp + fn + EPS)).alias("iou"), (2 * tp / (2 * tp + fp + fn + EPS)).alias("dice"), "tp", "fp", "fn")


def quantile_bins(values: DataFrame, n: int = 5, top_pct: float = 1.0) -> DataFrame:
    """Rows of positive value with their bin (equal counts, the last closed), and again as bin ``top`` where they reach the upper tail."""
    pos = values.where("value > 0")
    edges = group_quantiles(pos, ["group_id"], "value", [*[i / n for i in range(1, n)], 1 - top_pct / 100], "_q")
    j = pos.join(edges.select("group_id", F.slice("_q", 1, n - 1).alias("_e"), F.element_at("_q", n).alias("_t")), "group_id")
    bins = j.withColumn("bin", F.size(F.filter("_e", lambda e: e <= F.col("value"))).cast("string"))
    top = j.where(F.col("value") >= F.col("_t")).withColumn("bin", F.lit("top"))
    return bins.unionByName(top).select(*values.columns, "bin")


def metrics_by_bin(scored: DataFrame, bins: DataFrame, t: float = 0.5) -> DataFrame:
    """Rates over all rows, over rows with a bin, and by bin."""
    return rates(confusion(region_rows(scored, bins), t, ["group_id", "bin"]))


def region_rows(scored: DataFrame, bins: DataFrame) -> DataFrame:
    """Scored rows once for each region they lie in (column ``bin``): global, binned, their bin, and top."""
    named = scored.join(bins.select("group_id", "item_id", "bin"), ["group_id", "item_id"])
    return scored.withColumn("bin", F.lit("global")).unionByName(named.where("bin <> 'top'").withColumn("bin", F.lit("binned"))).unionByName(named)


def overlaps(df: DataFrame) -> DataFrame:
    """``rates`` with IoU and Dice."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return rates(df).withColumns({"iou": tp / (tp + fp + fn + EPS), "dice": 2 * tp / (2 * tp + fp + fn + EPS)})


def region_rollup(scored: DataFrame, bins: DataFrame, t: float = 0.5) -> DataFrame:
    """Counts and rates by region and data set, by region over all data sets (level 1), and over everything (level 3), from one aggregation. Rows of several regions count in each, so level 3 is of the global region alone."""
    rows = region_rows(scored, bins)
    by = rows.rollup("bin", "group_id").agg(F.grouping_id().cast("int").alias("level"), *counts(P() >= t, T() == 1))
    whole = rows.where("bin = 'global'").agg(*counts(P() >= t, T() == 1)).select(F.lit(None).cast("string").alias("bin"), F.lit(None).cast(scored.schema["group_id"].dataType).alias("group_id"), F.lit(3).alias("level"), "tp", "fp", "tn", "fn")
    return overlaps(by.where("level < 3").unionByName(whole))


def region_pivot(scored: DataFrame, bins: DataFrame, t: float = 0.5, metric: str = "f1", datasets: list[str] | None = None) -> DataFrame:
    """A row a region, a column a data set with its ``metric``, and ``mean``, their mean. Without ``datasets`` their names are read first."""
    by = overlaps(confusion(region_rows(scored, bins), t, ["group_id", "bin"]))
    wide = by.groupBy("bin").pivot("group_id", datasets).agg(F.first(metric))
    means = by.where(F.col("group_id").isin(datasets)) if datasets else by
    return wide.join(means.groupBy("bin").agg(F.avg(metric).alias("mean")), "bin")


def compare_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Which of two runs' metric maps has the strictly greater mean."""
    mean = lambda c: F.aggregate(F.map_values(c), F.lit(0.0), lambda s, v: s + v) / F.size(F.map_values(c))
    j = old.select("model", "dataset", mean("metrics").alias("old_mean")).join(new.select("model", "dataset", mean("metrics").alias("new_mean")), ["model", "dataset"])
    return j.withColumn("better", F.col("new_mean") > F.col("old_mean"))


def latest_best(model_scores: DataFrame) -> DataFrame:
    return model_scores.groupBy("model", "dataset").agg(F.max("ts").alias("ts"), F.max_by("metrics", "ts").alias("metrics"))


def append_score(run: DataFrame, path: str) -> None:
    run.write.mode("append").parquet(path)


def early_stop(history: DataFrame, patience: int = 10, key: str = "run", min_delta: float = 0.0, column: str = "loss", higher: bool = False) -> DataFrame:
    """Epochs without improvement and whether ``patience`` is reached.

    A loss improves where it falls below the best one by more than ``min_delta``, a
    score (``higher``) where it is above the best one less ``min_delta``; either then is
    the best one, and the count starts anew. A value at exactly that distance neither
    improves nor counts, nor does a null. Without ``min_delta`` the best value is a running
    extreme; with it, it depends on each choice before, so the numbers of a run's epochs
    are folded in order as one bounded array.
    """
    if min_delta == 0:
        w = Window.partitionBy(key).orderBy("epoch")
        v = -F.col(column) if higher else F.col(column)
        h = history.withColumn("_v", v).withColumn("_best", F.min("_v").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        first = F.col("_best").isNull() & F.col("_v").isNotNull()
        h = h.withColumns({"_up": F.coalesce((first | (F.col("_v") < F.col("_best"))).cast("int"), F.lit(0)), "_worse": F.coalesce((F.col("_v") > F.col("_best")).cast("int"), F.lit(0))})
        since = Window.partitionBy(key, "_run").orderBy("epoch")
        h = h.withColumn("_run", F.sum("_up").over(w)).withColumn("counter", F.sum("_worse").over(since).cast("long"))
        return h.select(key, "epoch", column, "counter", (F.col("counter") >= patience).alias("stop"))
    known = F.sort_array(F.collect_list(F.struct("epoch", F.col(column).cast("double").alias("_v"))))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).cast("long").alias("counter"), F.array().cast("array<long>").alias("out"))

    def then(s: Column, x: Column) -> Column:
        ahead = (x["_v"] - s["best"]) if higher else (s["best"] - x["_v"])
        edge = F.lit(-min_delta if higher else min_delta)
        better = s["best"].isNull() & x["_v"].isNotNull() | F.coalesce(ahead > edge, F.lit(False))
        worse = F.coalesce(ahead < edge, F.lit(False))
        counter = F.when(better, F.lit(0).cast("long")).when(worse, s["counter"] + 1).otherwise(s["counter"])
        return F.struct(F.when(better, x["_v"]).otherwise(s["best"]).alias("best"), counter.alias("counter"), F.concat(s["out"], F.array(counter)).alias("out"))

    runs = history.groupBy(key).agg(known.alias("_h")).select(key, F.explode(F.arrays_zip(F.col("_h"), F.aggregate("_h", start, then)["out"].alias("counter"))).alias("_x"))
    return runs.select(key, F.col("_x._h.epoch").alias("epoch"), F.col("_x._h._v").alias(column), F.col("_x.counter").alias("counter"), (F.col("_x.counter") >= patience).alias("stop"))


def log(p: Column) -> Column:
    """ln, not below -100."""
    return F.when(p > 0, F.greatest(F.ln(p), F.lit(-100.0))).otherwise(-100.0)


def CE() -> Column:
    """Cross-entropy of a row."""
    return -(T() * log(P()) + (1 - T()) * log(1 - P()))


def bce(scored: DataFrame) -> DataFrame:
    by = scored.groupBy("group_id")
    return by.agg(F.avg(CE()).alias("bce"), (F.coalesce(F.avg(F.when(T() == 1, CE())), F.lit(0.0)) + F.coalesce(F.avg(F.when(T() == 0, CE())), F.lit(0.0))).alias("bce_by_class"))


def dice_of(p: Column, eps: float = 1e-16) -> Column:
    return 1 - (2 * F.sum(p * T()) + eps) / (F.sum(p * p) + F.sum(T() * T()) + eps)


def dice(scored: DataFrame, alpha: float = 0.1) -> DataFrame:
    return scored.groupBy("group_id").agg(dice_of(P()).alias("dice"), dice_of(P() * F.pow(1 - P(), F.lit(alpha))).alias("adaptive_dice"))


def losses(scored: DataFrame, gamma: float = 0.25, weights: tuple[float, float] = (1.0, 0.1)) -> DataFrame:
    """bce + dice, class-weighted bce, focal loss."""
    pt = F.when(T() == 1, P()).otherwise(1 - P())
    return scored.groupBy("group_id").agg((F.avg(CE()) + dice_of(P())).alias("bce_dice"), F.avg(CE() * F.when(T() == 1, weights[0]).otherwise(weights[1])).alias("wbce"), F.avg(F.pow(1 - pt, F.lit(gamma)) * CE()).alias("focal"))


def cross_entropy(logits: DataFrame) -> DataFrame:
    """Mean softmax cross-entropy of rows (group_id, logits array, target class from 0), by the largest logit so that none overflows; rows without a target take no part."""
    top = F.array_max("logits")
    spread = F.ln(F.aggregate("logits", F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top)))
    known = logits.where(T().isNotNull())
    return known.groupBy("group_id").agg(F.avg(top + spread - F.element_at("logits", (T() + 1).cast("int"))).alias("cross_entropy"))


def bce_mse(voxels: DataFrame) -> DataFrame:
    """bce plus a tenth of the squared difference to the slices before and after; columns score, target."""
    w = Window.partitionBy("image_id", "y", "x").orderBy("z")
    v = voxels.withColumns({"_up": F.lead("score").over(w), "_down": F.lag("score").over(w)})
    mse = F.coalesce(F.avg(F.pow(P() - F.col("_up"), 2)), F.lit(0.0)) + F.coalesce(F.avg(F.pow(P() - F.col("_down"), 2)), F.lit(0.0))
    return v.groupBy("image_id").agg((F.avg(CE()) + 0.1 * mse).alias("bce_mse"))


def centreline_dice(pred: DataFrame, truth: DataFrame, images: DataFrame, iters: int = 2) -> DataFrame:
    """1 - harmonic mean of how much of each one's soft skeleton lies in the other."""
    cell = ["image_id", "z", "y", "x"]

    def share(skeleton: DataFrame, mask: DataFrame, name: str) -> DataFrame:
        j = skeleton.join(mask.withColumnRenamed("value", "_m"), cell, "left")
        return j.groupBy("image_id").agg(((F.sum(F.col("value") * F.coalesce("_m", F.lit(0.0))) + 1) / (F.sum("value") + 1)).alias(name))

    j = share(soft_skeleton(pred, images, iters), truth, "_p").join(share(soft_skeleton(truth, images, iters), pred, "_s"), "image_id")
    return j.select("image_id", (1 - 2 * F.col("_p") * F.col("_s") / (F.col("_p") + F.col("_s"))).alias("cldice"))
