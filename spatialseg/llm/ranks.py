"""Ranks within groups of any size: groups are salted, so no task holds one whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, keys: list[str], bucket: Column, order: list[str], rank: str = "_rank") -> DataFrame:
    """``df`` with a rank from 0 within ``keys``, by ``bucket`` and then ``order``.

    ``bucket`` splits a group into parts; each part is ranked alone and starts
    where the parts before it end. ``keys`` must not be null.
    """
    parts = df.withColumn("_part", bucket)
    sizes = parts.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    ranked = parts.withColumn("_inside", inside).join(starts, [*keys, "_part"])
    return ranked.withColumn(rank, F.col("_start") + F.col("_inside")).drop("_part", "_start", "_inside")
