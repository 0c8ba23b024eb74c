"""Normalisation and statistics of images. Aggregates of an image are joined back, so no task holds one whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatialseg.operators.project import per_image
from spatialseg.operators.quantiles import group_quantiles


def V() -> Column:  # noqa: N802
    return F.col("value")


def norm_dtype(voxels: DataFrame, images: DataFrame) -> DataFrame:
    """Divided by the range of the source type; signed types are shifted first."""
    t = F.col("dtype")
    scaled = F.when(t == "uint8", V() / 255).when(t == "int8", (V() + 128) / 255).when(t == "uint16", V() / 65535).when(t == "int16", (V() + 32768) / 65535).otherwise(V())
    return voxels.join(images.select("image_id", "dtype"), "image_id").withColumn("value", scaled).select(voxels.columns)


def norm_minmax(voxels: DataFrame) -> DataFrame:
    """(v - min) / (max - min); where the maximum is not positive, |min| is added to the values first."""
    lift = F.when(F.col("_hi") <= 0, F.abs("_lo")).otherwise(0.0)
    return per_image(voxels, _lo=F.min("value"), _hi=F.max("value")).withColumn("value", (V() + lift - F.col("_lo")) / F.nullif(F.col("_hi") + lift - F.col("_lo"), F.lit(0.0))).select(voxels.columns)


def norm_meanstd(voxels: DataFrame) -> DataFrame:
    return per_image(voxels, _m=F.avg("value"), _s=F.stddev_pop("value")).withColumn("value", (V() - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).select(voxels.columns)


#: The ranges of integer types. Of other types values are brought to -1 to 1.
RANGES = {"uint8": (0, 255), "int8": (-128, 127), "uint16": (0, 65535), "int16": (-32768, 32767)}


def norm_percentile(voxels: DataFrame, lo: float = 1, hi: float = 99, exact: bool = True, images: DataFrame | None = None) -> DataFrame:
    """Clipped to percentiles and stretched to the range of the type, which starts at 0 if the lower bound is not negative; integers are cut off at the point.

    The type is what ``images`` has as dtype; without it values are floats, and go to
    [0, 1] or [-1, 1]. Of uint8 an upper bound from 250 on becomes 256 and a lower one
    up to 5 becomes 0. Where both bounds are equal, values are clipped to the range.
    """
    at = [lo / 100, hi / 100]
    both = per_image(voxels, _p=F.percentile_approx("value", F.array(*map(F.lit, at)), 100_000)) if not exact else voxels.join(group_quantiles(voxels, ["image_id"], "value", at, "_p"), "image_id", "left")
    kind = F.lit("float")
    if images is not None:
        both, kind = both.join(images.select("image_id", F.col("dtype").alias("_dtype")), "image_id", "left"), F.coalesce("_dtype", F.lit("float"))
    low, high = F.col("_p")[0], F.col("_p")[1]
    byte = kind == "uint8"
    j = both.withColumns({"_lo": F.when(byte & (low <= 5), 0.0).otherwise(low), "_hi": F.when(byte & (high >= 250), 256.0).otherwise(high)})
    least, most = F.lit(-1.0), F.lit(1.0)
    for name, (a, b) in RANGES.items():
        least, most = F.when(kind == name, float(a)).otherwise(least), F.when(kind == name, float(b)).otherwise(most)
    least = F.when(F.col("_lo") >= 0, F.greatest(least, F.lit(0.0))).otherwise(least)
    unit = (F.greatest(F.least(V(), F.col("_hi")), F.col("_lo")) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    out = F.coalesce(unit * (most - least) + least, F.when(F.col("_lo") == F.col("_hi"), F.greatest(F.least(V(), most), least)))
    whole = F.when(out >= 0, F.floor(out)).otherwise(F.ceil(out)).cast("double")
    return j.withColumn("value", F.when(kind.isin(*RANGES), whole).otherwise(out)).select(voxels.columns)


def normalize_image(voxels: DataFrame) -> DataFrame:
    """Mean and deviation, then percentiles 1 and 99; values that still lie in [0, 255] beyond 1 are brought to [-1, 1]."""
    done = per_image(norm_percentile(norm_meanstd(voxels)), _lo=F.min("value"), _hi=F.max("value"))
    out = (F.col("_lo") >= 0) & (F.col("_hi") > 1) & (F.col("_hi") <= 255)
    return done.withColumn("value", F.when(out, V() / 255 * 2 - 1).otherwise(V())).select(voxels.columns)


def adaptive_threshold(voxels: DataFrame) -> DataFrame:
    """1 where a value reaches mean over deviation of its z-slice."""
    stats = voxels.groupBy("image_id", "z").agg((F.avg("value") / F.nullif(F.stddev_pop("value"), F.lit(0.0))).alias("_t"))
    return voxels.join(stats, ["image_id", "z"]).withColumn("value", F.coalesce((V() >= F.col("_t")).cast("int"), F.lit(0))).select(voxels.columns)


def rank_channels_by_snr(voxels: DataFrame, channel: str = "z") -> DataFrame:
    snr = voxels.groupBy("image_id", channel).agg((F.avg("value") / F.nullif(F.stddev_pop("value"), F.lit(0.0))).alias("snr"))
    return snr.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("snr"), channel)))


def image_stats(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("image_id").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count_if(V() > 0).alias("foreground"))


def z_projection(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("image_id", "y", "x").agg(F.sum("value").alias("value"))


def busiest_slice(voxels: DataFrame, images: DataFrame, t: float = 0) -> DataFrame:
    """The slice with most foreground: the first of equals, the middle one where there is none."""
    by_slice = voxels.groupBy("image_id", "z").agg(F.count_if(V() > t).alias("_n"))
    best = by_slice.groupBy("image_id").agg(F.max_by("z", F.struct("_n", -F.col("z"))).alias("_z"), F.max("_n").alias("n"))
    return best.join(images.select("image_id", "nz"), "image_id").select("image_id", F.when(F.col("n") > 0, F.col("_z")).otherwise(F.floor(F.col("nz") / 2)).cast("int").alias("z"), "n")
