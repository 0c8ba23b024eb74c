"""Readers and writers of files of coordinates, graphs and meshes; volumes are in ``volumes``.

Paths are read by Spark's own sources, or through ``binaryFile`` rows, so any
store that Spark reads will do. A parser gets one file at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spatialseg.functions.geometry import AXES
from spatialseg.operators.cloud import labels_from_color
from spatialseg.runtime import shuffle_width
from spatialseg.sources.volumes import scan_volume_headers, scan_volume_slabs  # noqa: F401

IMAGE_SUFFIXES = (".mrc", ".rec", ".map", ".tif", ".tiff", ".am")
#: What ends the header of a binary spatial graph, and the bytes of its field types.
DATA_FOLLOWS = b"# Data section follows\n"
FIELD_TYPES = {"float": "<f4", "int": "<i4", "double": "<f8", "short": "<i2", "byte": "u1"}


def read_points_csv(spark: SparkSession, path: str) -> DataFrame:
    """[ID, X, Y(, Z)] rows of CSV files, a header dropped where the first cell is no number; ``ord`` is the place in the file."""
    raw = spark.read.option("header", False).schema("a string, b string, c string, d string").csv(path).select("*", F.col("_metadata.file_path").alias("cloud_id"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    rows = raw.withColumns({"seg_id": F.expr("try_cast(a as double)").cast("long"), "x": F.expr("try_cast(b as double)"), "y": F.expr("try_cast(c as double)"), "z": F.coalesce(F.expr("try_cast(d as double)"), F.lit(0.0))}).where("seg_id is not null")
    # places: rows of a block are in order, blocks follow each other
    inside = F.row_number().over(Window.partitionBy("cloud_id", "_block").orderBy("_row"))
    size = rows.groupBy("cloud_id", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("cloud_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_in", inside).join(size.withColumn("_before", before), ["cloud_id", "_block"])
    return placed.select("cloud_id", (F.col("_before") + F.col("_in") - 1).alias("point_id"), "seg_id", (F.col("_before") + F.col("_in") - 1).cast("int").alias("ord"), *AXES)


def write_instances_csv(points: DataFrame, path: str) -> None:
    """IDs, X [A], Y [A], Z [A], a folder for each cloud."""
    cols = [F.col("seg_id").alias("IDs"), *[F.col(c).alias(f"{c.upper()} [A]") for c in AXES]]
    points.select("cloud_id", *cols).write.partitionBy("cloud_id").option("header", True).csv(path)


def read_scene_txt(spark: SparkSession, path: str) -> DataFrame:
    """Scenes of one text file for each instance, ``X Y Z R G B`` a line; other lines are skipped, colours divided by 255."""
    raw = spark.read.text(path, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("f"))
    part = F.split(F.trim("value"), r"\s+")
    num = [F.try_element_at(part, F.lit(i + 1)).try_cast("double") for i in range(6)]
    rows = raw.select(F.regexp_extract("f", r"([^/]+)/[^/]+$", 1).alias("cloud_id"), "f", *[n.alias(c) for n, c in zip(num, "xyzrgb", strict=True)]).where("b is not null")
    files = rows.select("cloud_id", "f").distinct().withColumn("seg_id", (F.dense_rank().over(Window.partitionBy("cloud_id").orderBy("f")) - 1).cast("long"))
    return rows.join(files, ["cloud_id", "f"]).select("cloud_id", "seg_id", *AXES, *[(F.col(c) / 255).alias(c) for c in "rgb"])


def read_ply_points(spark: SparkSession, path: str, palette: DataFrame | None = None) -> DataFrame:
    """Vertices of ASCII PLY files (x y z r g b); the class comes from a palette (r, g, b, seg_id) or from the distinct colours in order."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("cloud_id"))
    rows = raw.where(F.col("value").rlike(r"^\s*[-+0-9.eE]+\s+[-+0-9.eE]+\s+[-+0-9.eE]+\s+\d+\s+\d+\s+\d+\s*$"))
    part = F.split(F.trim("value"), r"\s+")
    p = rows.select("cloud_id", *[part[i].cast("double").alias(c) for i, c in enumerate(AXES)], *[part[3 + i].cast("int").alias(c) for i, c in enumerate("rgb")])
    if palette is None:
        return labels_from_color(p)
    return p.join(palette, ["r", "g", "b"], "left")


def spatial_graph_rows(text: str) -> Iterator[tuple]:
    """(section, row, values) of an ASCII spatial graph: numeric rows by the @-mark of the header that names them."""
    names = {m[3]: (m[1], m[2]) for m in re.finditer(r"^(VERTEX|EDGE|POINT)\s*\{[^}]*?(\w+)\s*\}\s*(@\d+)", text, re.M)}
    at, row = None, 0
    for line in text.splitlines():
        line = line.strip()
        if line in names:
            at, row = names[line], 0
        elif line.startswith("@") or not line:
            at = None if line else at
        elif at:
            try:
                values = [float(v) for v in line.split()]
            except ValueError:
                at = None
                continue
            yield at[0], at[1], row, values
            row += 1


def binary_graph_rows(content: bytes) -> Iterator[tuple]:
    """The rows of ``spatial_graph_rows`` of a little-endian binary spatial graph; each block is as long as the header says, since its bytes may look like a mark."""
    head, follows, body = content.partition(DATA_FOLLOWS)
    if not follows:
        raise ValueError("a binary spatial graph without a data section")
    text = head.decode("iso-8859-1")
    rows = {m[1]: int(m[2]) for m in re.finditer(r"^\s*define\s+(\w+)\s+(\d+)", text, re.M)}
    fields = {m[5]: m for m in re.finditer(r"^\s*(VERTEX|EDGE|POINT)\s*\{\s*(\w+?)(?:\[(\d+)\])?\s+(\w+)\s*\}\s*@(\d+)", text, re.M)}
    at = 0
    while mark := re.compile(rb"\s*@(\d+)[^\n]*\n").match(body, at):
        section, kind, width, name, _ = fields[mark[1].decode()].groups()
        shape = rows.get(section, 0), int(width or 1)
        values = np.frombuffer(body, FIELD_TYPES[kind], shape[0] * shape[1], mark.end())
        at = mark.end() + values.nbytes
        for row, v in enumerate(values.reshape(shape).astype(float).tolist()):
            yield section, name, row, v


def ingest_spatial_graphs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """sg_vertex, sg_edge, sg_point and sg_label of ASCII or little-endian binary spatial-graph files; a point's edge follows from the edges' point counts. A binary file that is cut short is an error."""

    def parse(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                raw = bytes(content)
                binary = b"BINARY-LITTLE-ENDIAN" in raw.partition(b"\n")[0]
                rows = [(p, *r) for r in (binary_graph_rows(raw) if binary else spatial_graph_rows(raw.decode("utf-8", "replace")))]
                yield pd.DataFrame(rows, columns=["cloud_id", "section", "name", "row", "v"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "cloud_id string, section string, name string, row int, v array<double>")
    pick = lambda section, name: rows.where((F.col("section") == section) & F.col("name").rlike(name))
    v = F.col("v")
    vertex = pick("VERTEX", "(?i)coord").select("cloud_id", F.col("row").alias("v_id"), *[v[i].alias(c) for i, c in enumerate(AXES)])
    ends = pick("EDGE", "(?i)connectivity").select("cloud_id", F.col("row").alias("edge_id"), v[0].cast("int").alias("v0"), v[1].cast("int").alias("v1"))
    count = pick("EDGE", "(?i)^numedgepoints$").select("cloud_id", F.col("row").alias("edge_id"), v[0].cast("int").alias("n_points"))
    edge = ends.join(count, ["cloud_id", "edge_id"])
    first = F.coalesce(F.sum("n_points").over(Window.partitionBy("cloud_id").orderBy("edge_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = edge.withColumn("_first", first).where("n_points > 0").select("cloud_id", "edge_id", F.posexplode(F.sequence(F.col("_first"), F.col("_first") + F.col("n_points") - 1)).alias("ord", "row"))
    point = pick("POINT", "(?i)coord").join(place, ["cloud_id", "row"]).select("cloud_id", "edge_id", "ord", *[v[i].alias(c) for i, c in enumerate(AXES)])
    label = rows.where("section = 'EDGE'").where(~F.col("name").rlike("(?i)connectivity|^numedgepoints$")).select("cloud_id", F.col("row").alias("edge_id"), F.col("name").alias("label"), v[0].alias("value"))
    return {"sg_vertex": vertex, "sg_edge": edge, "sg_point": point, "sg_label": label}


def ingest_surfaces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(mesh_vertex, mesh_tri) of ASCII surface files: vertices, then patches of triangles named by their inner region; vertices are numbered from 0 in each material."""

    def parse(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                rows, mode, left, material = [], None, 0, "surface"
                for line in bytes(content).decode("utf-8", "replace").splitlines():
                    line = line.strip()
                    if m := re.match(r"(Vertices|Triangles)\s+(\d+)", line):
                        mode, left = m[1], int(m[2])
                    elif m := re.match(r"InnerRegion\s+(\S+)", line):
                        material = m[1]
                    elif left and mode:
                        rows.append((p, mode, material, len(rows), [float(x) for x in line.split()[:3]]))
                        left -= 1
                first = min((r[3] for r in rows if r[1] == "Vertices"), default=0)
                yield pd.DataFrame([(a, b, c, n - first, v) for a, b, c, n, v in rows], columns=["mesh_id", "kind", "material", "row", "v"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "mesh_id string, kind string, material string, row int, v array<double>")
    vertex = rows.where("kind = 'Vertices'").select("mesh_id", (F.col("row") + 1).alias("old"), *[F.col("v")[i].alias(c) for i, c in enumerate(AXES)])
    tri = rows.where("kind = 'Triangles'").select("mesh_id", "material", F.col("row").alias("tri"), F.posexplode(F.transform("v", lambda x: x.cast("int"))).alias("corner", "old"))
    ids = tri.select("mesh_id", "material", "old").distinct().withColumn("v_id", F.row_number().over(Window.partitionBy("mesh_id", "material").orderBy("old")) - 1)
    named = tri.join(ids, ["mesh_id", "material", "old"]).groupBy("mesh_id", "material", "tri").agg(*[F.max(F.when(F.col("corner") == i, F.col("v_id"))).alias(c) for i, c in enumerate("abc")])
    return ids.join(vertex, ["mesh_id", "old"]).select("mesh_id", "material", "v_id", *AXES), named.select("mesh_id", "material", "a", "b", "c")


def catalog_files(spark: SparkSession, path: str, allow: tuple[str, ...] = IMAGE_SUFFIXES, deny: tuple[str, ...] = ("_mask", "_semantic", "_instances")) -> DataFrame:
    """Files by suffix, without those whose stem ends in a denied mark; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    f = files.select("path", "length", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("suffix"))
    bad = "|".join(re.escape(d) for d in deny)
    return f.where(F.col("suffix").isin(*allow) & ~F.col("stem").rlike(f"({bad})$" if deny else "^$"))


def convert_points(spark: SparkSession, src: str, dst: str, to: str = "csv") -> None:
    """Coordinates of a folder, CSV or spatial graphs, as CSV or Parquet."""
    if src.rstrip("/").endswith(".am"):
        p = ingest_spatial_graphs(spark, src)["sg_point"].withColumnRenamed("edge_id", "seg_id").withColumn("cloud_id", F.regexp_extract("cloud_id", r"([^/]+)$", 1))
    else:
        p = read_points_csv(spark, src).withColumn("cloud_id", F.regexp_extract("cloud_id", r"([^/]+)$", 1))
    if to == "csv":
        write_instances_csv(p, dst)
    else:
        p.write.parquet(dst)


def materialize(df: DataFrame, path: str, key: str = "cloud_id") -> DataFrame:
    """Keep prepared rows for later passes, one folder a key."""
    df.write.partitionBy(key).parquet(path)
    return df.sparkSession.read.schema(T.StructType([*[f for f in df.schema if f.name != key], df.schema[key]])).parquet(path)


def materialize_buckets(df: DataFrame, name: str, path: str, keys: tuple[str, ...] = ("cloud_id", "patch_id"), buckets: int | None = None) -> DataFrame:
    """Keep prepared rows as table ``name``, dealt into buckets by ``keys`` and sorted by them, one file a bucket however many clouds there are. Joins and groupings on the keys need no exchange in later passes."""
    n = buckets or shuffle_width(df.sparkSession)
    df.repartition(n, *keys).write.mode("overwrite").option("path", path).bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def attach_buckets(spark: SparkSession, name: str, path: str, keys: tuple[str, ...] = ("cloud_id", "patch_id"), buckets: int = 8) -> DataFrame:
    """The table of ``materialize_buckets`` in another session; keys and number of buckets must be those it was written with."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
