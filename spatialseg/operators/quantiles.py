"""Exact quantiles of large groups, without a group's values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatialseg.runtime import cut

#: Most rows of group sizes that are broadcast; more of them are joined by a shuffle.
GROUPS = 100_000
#: Parts that a bracket which is still too large is cut into.
PARTS = 64


def group_quantiles(df: DataFrame, keys: list[str], value: str, at: list[float], name: str, accuracy: int = 10_000) -> DataFrame:
    """(keys, ``name``): the quantiles ``at`` of each group's values, linear between neighbours; nulls take no part, groups without values give no row.

    The input is read twice. A sketch of bounded size brackets each quantile; then
    values below a bracket are counted and those inside it kept, equal ones as one row.
    A bracket that still holds more than ``accuracy`` different values is cut into parts
    whose counts say which of them holds the quantile, until none does; so no more than
    ``accuracy`` rows of a group are ever ranked. A group of up to ``accuracy`` values
    is its own bracket. A bracket that misses its rank raises.
    """
    v, eps = F.col("_v"), 3 / accuracy
    own = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    ends = F.percentile_approx("_v", F.array(*[F.lit(min(1.0, max(0.0, p + d))) for p in at for d in (-eps, eps)]), accuracy)
    sizes = cut(own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), ends.alias("_e")), "sizes")
    groups, most = sizes.agg(F.count(F.lit(1)), F.max("_n")).first()

    def bracket(i: int, p: float) -> Column:
        lo, hi = F.col("_e")[2 * i], F.col("_e")[2 * i + 1]
        slack = 1e-12  # a value may be computed anew, from sums added in another order
        whole = F.col("_n") <= accuracy
        low = F.when(whole | F.lit(p <= eps), float("-inf")).otherwise(lo - F.abs(lo) * slack)
        high = F.when(whole | F.lit(p >= 1 - eps), float("inf")).otherwise(hi + F.abs(hi) * slack)
        return F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"), low.alias("lo"), high.alias("hi"))

    ranges = sizes.select(*keys, "_n", F.array(*[bracket(i, p) for i, p in enumerate(at)]).alias("_b"))
    near = own.join(F.broadcast(ranges) if groups <= GROUPS else ranges, keys).select(*keys, "_v", "_n", F.explode("_b").alias("_b")).where((v <= F.col("_b.hi")) | (F.isnan("_v") & (F.col("_b.hi") == float("inf"))))
    # what lies below a bracket becomes one row, so that ranks go on from its count
    steps = near.groupBy(*keys, F.col("_b.i").alias("_i"), F.col("_b.p").alias("_p"), "_n", F.when(v >= F.col("_b.lo"), v).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    if most and most * 3 * eps > accuracy:  # else no bracket can be that large
        steps = narrowed(cut(steps, "steps"), keys, accuracy)
    upto = Window.partitionBy(*keys, "_i").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = steps.withColumns({"_end": F.sum("_c").over(upto), "_at": F.col("_p") * (F.col("_n") - 1)})
    holds = lambda k: F.max(F.when((k >= F.col("_end") - F.col("_c")) & (k < F.col("_end")), v))
    found = ranked.groupBy(*keys, "_i", "_at").agg(holds(F.floor("_at")).alias("_l"), holds(F.ceil("_at")).alias("_h"))
    between = F.when(F.col("_l") == F.col("_h"), F.col("_l")).otherwise((F.ceil("_at") - F.col("_at")) * F.col("_l") + (F.col("_at") - F.floor("_at")) * F.col("_h"))
    one = F.coalesce(between, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))
    return found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", one.alias("q")))), lambda s: s["q"]).alias(name))


def narrowed(steps: DataFrame, keys: list[str], accuracy: int) -> DataFrame:
    """``steps`` with brackets of at most ``accuracy`` rows. A round reads what the brackets of the one before hold, and leaves about one part in ``PARTS`` of the large ones."""
    by = [*keys, "_i"]
    while True:
        inside = steps.where("_v is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), F.percentile_approx("_v", F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)]), 1000).alias("_cuts"))
        large = cut(inside.where(F.col("_rows") > accuracy).select(*by, "_cuts"), "large")
        if large.isEmpty():
            return steps
        split = steps.join(F.broadcast(large) if large.count() <= GROUPS else large, by)
        # part 0 is what lies below, which every bracket may have
        split = split.withColumn("_part", F.when(F.col("_v").isNull(), 0).otherwise(1 + F.size(F.filter("_cuts", lambda c: c <= F.col("_v"))))).drop("_cuts")
        before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        sums = split.groupBy(*by, "_p", "_n", "_part").agg(F.sum("_c").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0)))
        place = F.col("_p") * (F.col("_n") - 1)
        wanted = (F.col("_before") <= F.ceil(place)) & (F.col("_before") + F.col("_s") > F.floor(place)) & (F.col("_part") > 0)
        parts = cut(sums.where(wanted).select(*by, "_part", "_before"), "parts")
        kept = split.join(F.broadcast(parts) if parts.count() <= GROUPS else parts, [*by, "_part"], "left_semi").select(*steps.columns)
        below = parts.groupBy(*by).agg(F.min("_before").alias("_c")).join(steps.select(*by, "_p", "_n").distinct(), by).select(*by, "_p", "_n", F.lit(None).cast("double").alias("_v"), "_c").where("_c > 0")
        steps = cut(steps.join(large, by, "left_anti").unionByName(kept).unionByName(below.select(*steps.columns)), "steps")
