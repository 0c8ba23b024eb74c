"""Where intermediate tables go, and how lineage is cut.

Long plans are cut by writing a Parquet table into the folder that the cluster
names in ``spark.checkpoint.dir``: every executor sees that folder, so a lost
executor costs a re-read and nothing more.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of local sessions that have none configured, by application.
_LOCAL: dict[str, str] = {}


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. Where none is configured, a local session takes a temporary one; on a cluster, whose executors would not see it, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        # the setting of a running session cannot be changed, so the folder is kept here
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spatialseg-")
        base = _LOCAL[app]
    return f"{base.rstrip('/')}/spatialseg/{name}-{uuid.uuid4().hex}"


#: The session setting that frees a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` and return the written table; the shuffle files of the write are freed when it ends, not when the driver next collects garbage."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once and go on from the written table, which stays until ``release`` or the end of the program: a result may be read from it."""
    path = work_path(df.sparkSession, name)
    if not _WRITTEN:
        atexit.register(release)
    _WRITTEN.append((df.sparkSession, path))
    return write_table(df, path)


def delete_path(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Remove all tables that ``cut`` has written; call it when the results that read from them are saved."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        with contextlib.suppress(Py4JError, OSError):  # at the end of a program, Spark may be gone
            delete_path(spark, path)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, the width that hot groups are salted to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salt_of(*keys, width: int):
    """A reproducible salt in [0, width) from key columns."""
    return F.pmod(F.xxhash64(*keys), F.lit(width)).cast("int")


class Scratch:
    """A folder of intermediate tables of one operator, removed when its result is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, work_path(spark, name), 0

    def cut(self, df: DataFrame, name: str = "step") -> DataFrame:
        self.n += 1
        return write_table(df, f"{self.base}/{self.n}-{name}")

    def drop(self, df: DataFrame) -> None:
        """Remove a table of this folder that nothing reads any more."""
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if f"/{self.base.rsplit('/', 1)[1]}/" in folder:
                delete_path(self.spark, folder)

    def close(self) -> None:
        delete_path(self.spark, self.base)
