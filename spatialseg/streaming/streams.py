"""New files and new runs as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spatialseg.operators.filament import filament_report
from spatialseg.runtime import delete_path

POINTS = "cloud_id string, point_id long, seg_id long, ord int, x double, y double, z double"


def watch_points(spark: SparkSession, folder: str, out: str, checkpoint: str, per_trigger: int = 100) -> StreamingQuery:
    """A report for each new Parquet file of points, once each; a run that stops goes on from its checkpoint. A batch that is repeated after a failure replaces its own folder."""

    def report(batch: DataFrame, number: int) -> None:
        filament_report(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return stream.writeStream.foreachBatch(report).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


RUNS = "model string, dataset string, ts long, score double"
REGISTRY = "model string, dataset string, best double, at long, latest long"


def versions(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the versions of a registry that were written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [f.getPath() for f in fs.listStatus(path)]
    done = [p.getName() for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.removeprefix("version=")) for n in done if n.startswith("version="))


def registry(spark: SparkSession, table: str) -> DataFrame:
    """The newest version: best score of each model and dataset, the time of it, and the time of the latest run."""
    found = versions(spark, table)
    return spark.read.schema(REGISTRY).parquet(f"{table}/version={found[-1]}") if found else spark.createDataFrame([], REGISTRY)


def watch_metrics(spark: SparkSession, folder: str, table: str, checkpoint: str, keep: int = 2) -> StreamingQuery:
    """New runs go into a registry of Parquet versions, one for each batch.

    A batch joins the newest version before its own number and writes its own, so a
    batch that is repeated after a failure gives the same table. Readers take the newest
    version that is complete; versions before the last ``keep`` are removed. Among equal
    scores the later run counts.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        found = [v for v in versions(session, table) if v < number]
        runs = batch.select("model", "dataset", F.col("score").alias("best"), F.col("ts").alias("at"), F.col("ts").alias("latest"))
        both = session.read.schema(REGISTRY).parquet(f"{table}/version={found[-1]}").unionByName(runs) if found else runs
        merged = both.groupBy("model", "dataset").agg(F.max("best").alias("best"), F.max_by("at", F.struct("best", "at")).alias("at"), F.max("latest").alias("latest"))
        merged.write.mode("overwrite").parquet(f"{table}/version={number}")
        for old in found[: max(0, len(found) + 1 - keep)]:
            delete_path(session, f"{table}/version={old}")

    runs = spark.readStream.schema(RUNS).parquet(folder)
    return runs.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
