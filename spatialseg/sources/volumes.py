"""Volumes as a Spark data source: headers are read alone, and a task reads only the bytes of its own slabs.

``spark.read.format("volumes")`` plans runs of z-slices from the headers of MRC files
and binary lattices, with filters on image and z applied before anything else is read.
ASCII lattices have no places to jump to: their bodies are cut into blocks, the numbers
of each block are counted, and the sums of these counts say which voxel a block starts
with (``ascii_voxels``). ``scan_volume_slabs`` puts both together.

Files are opened by ``pyarrow.fs``, so paths may be local or in any store it knows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, fields
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

#: Voxel types by header mode (mode 0 is unsigned where no value is negative), and their bytes.
MODES = {0: "uint8", 1: "int16", 2: "float32", 6: "uint16", 12: "float16"}
BYTES = {"uint8": "u1", "int8": "i1", "int16": "<i2", "float32": "<f4", "uint16": "<u2", "float16": "<f2"}
#: Types of a lattice's values, and lengths of its units in angstrom.
LATTICE = {"byte": "uint8", "sbyte": "int8", "float": "float32"}
UNITS = {"m": 1e10, "nm": 10.0}
HEADER, LATTICE_HEAD = 1024, 20_000
MARK = b"\n@1\n"
PARTITION_BYTES, BLOCK_BYTES = 32 << 20, 4 << 20
SUFFIXES = (".mrc", ".rec", ".map", ".am")
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Header:
    """What a header says. ``axes``: the order of the file's axes, which look swapped where one is over twice as long as another. ``shift`` is added to values: signed bytes of lattices become unsigned."""

    nz: int
    ny: int
    nx: int
    dtype: str
    pixel_size: float
    data_start: int
    axes: str = "zyx"
    encoding: str = "binary"
    shift: int = 0
    off_x: float = 0.0
    off_y: float = 0.0
    off_z: float = 0.0
    size_x: float = 0.0
    size_y: float = 0.0
    size_z: float = 0.0


VOLUME = "image_id string, length long, nz int, ny int, nx int, dtype string, pixel_size double, data_start long, axes string, encoding string, shift int, off_x double, off_y double, off_z double, size_x double, size_y double, size_z double, odd_axes boolean"
VOXEL = "image_id string, z int, y int, x int, value double"
VOXEL_ARROW = pa.schema([("image_id", pa.string()), ("z", pa.int32()), ("y", pa.int32()), ("x", pa.int32()), ("value", pa.float64())])


def opened(path: str) -> pa.NativeFile:
    store, inside = located(path)
    return store.open_input_file(inside)


def located(path: str) -> tuple[stores.FileSystem, str]:
    """The store of a path in Spark's spelling, and the path inside it."""
    if path.startswith("file:") or "://" not in path:
        return stores.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return stores.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def listed(path: str) -> list[str]:
    """Volumes under a folder, of a pattern in a path's last part, or one file; named as Spark names them."""
    store, inside = located(path)
    scheme = "file:" if isinstance(store, stores.LocalFileSystem) else path.split("://")[0] + "://"
    folder, _, last = inside.rpartition("/")
    if any(c in last for c in "*?["):
        found = [f for f in store.get_file_info(stores.FileSelector(folder)) if fnmatch(f.base_name, last)]
    elif (info := store.get_file_info(inside)).type == stores.FileType.Directory:
        found = store.get_file_info(stores.FileSelector(inside, recursive=True))
    else:
        found = [info]
    return sorted(scheme + f.path for f in found if f.type == stores.FileType.File and f.path.lower().endswith(SUFFIXES))


def mrc_header(head: bytes) -> Header:
    if len(head) < HEADER:
        raise ValueError(f"a header of {len(head)} bytes")
    nx, ny, nz, mode = struct.unpack_from("<4i", head, 0)
    xlen, least = struct.unpack_from("<f", head, 40)[0], struct.unpack_from("<f", head, 76)[0]
    extended = struct.unpack_from("<i", head, 92)[0]
    if mode not in MODES or min(nx, ny, nz) < 1 or extended < 0:
        raise ValueError(f"voxel mode {mode} or shape {nz, ny, nx} is not supported")
    axes = "yzx" if nz > 2 * ny else "xyz" if nz > 2 * nx else "zyx"
    return Header(nz, ny, nx, "int8" if mode == 0 and least < 0 else MODES[mode], round(xlen / nx, 3), HEADER + extended, axes)


def lattice_header(head: bytes, length: int) -> Header:
    text = head.decode("iso-8859-1")
    shape = re.search(r"^define Lattice (\d+) (\d+) (\d+)", text, re.M)
    kind = re.search(r"Lattice \{ (\w+) Data \}", text)
    if not shape or not kind or kind[1] not in LATTICE:
        raise ValueError("no lattice of bytes, signed bytes or floats")
    nx, ny, nz = map(int, shape.groups())
    box = re.search(r"^\s*BoundingBox" + r"\s+([-+.\deE]+)" * 6, text, re.M)
    x0, x1, y0, y1, z0, z1 = map(float, box.groups()) if box else (0.0,) * 6
    unit = re.search(r'^\s*Coordinates\s+"(\w+)"', text, re.M)
    pixel = round((x1 - x0) / (nx - 1) * UNITS.get(unit[1] if unit else "", 1.0), 3) if nx > 1 else 0.0
    dtype = LATTICE[kind[1]]
    ascii_ = "ASCII" in text.partition("\n")[0]
    mark = head.find(MARK)
    # the data of a binary file end it, should its mark lie beyond what was read
    start = mark + len(MARK) if mark >= 0 else -1 if ascii_ else length - nx * ny * nz * np.dtype(BYTES[dtype]).itemsize
    return Header(nz, ny, nx, dtype, pixel, start, "zyx", "ascii" if ascii_ else "binary", 128 if dtype == "int8" else 0, x0, y0, z0, x1, y1, z1)


def read_header(f: pa.NativeFile, path: str) -> Header:
    """At most ``LATTICE_HEAD`` bytes are read."""
    if path.lower().endswith(".am"):
        f.seek(0)
        return lattice_header(f.read(LATTICE_HEAD), f.size())
    f.seek(0)
    return mrc_header(f.read(HEADER))


def scan_volume_headers(spark: SparkSession, path: str) -> DataFrame:
    """Shape, type, pixel size, offset and place of the data of volumes, and whether the axes look swapped (``odd_axes``: nz > 2 ny). Spark lists the files; a task opens each and reads its head alone. A file that is no volume is an error; spatial graphs, which share a suffix with lattices, are skipped."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in VOLUME.split(", ")]
        for b in batches:
            rows = []
            for p in b.column("path").to_pylist():
                with opened(p) as f:
                    if p.lower().endswith(".am") and not is_lattice(f):
                        continue
                    h = asdict(read_header(f, p))
                    rows.append({"image_id": p, "length": f.size(), "odd_axes": h["axes"] == "yzx"} | h)
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW_VOLUME).select(names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").where(F.lower("path").rlike("(" + "|".join(re.escape(s) for s in SUFFIXES) + ")$"))
    return files.mapInArrow(parse, VOLUME)


ARROW_VOLUME = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]]) for c in VOLUME.split(", ")])


def is_lattice(f: pa.NativeFile) -> bool:
    f.seek(0)
    return b"define Lattice" in f.read(LATTICE_HEAD)


@dataclass
class Slabs(InputPartition):
    """Consecutive slices of one file."""

    path: str
    header: Header
    first: int
    end: int

    def __init__(self, path: str, header: Header, first: int, end: int):
        self.path, self.header, self.first, self.end = path, header, first, end


#: Filters on z that choose slices, and those on the image that choose files.
ON_Z: dict[type, Callable[[int, object], bool]] = {EqualTo: lambda z, v: z == v, In: lambda z, v: z in v, GreaterThan: lambda z, v: z > v, GreaterThanOrEqual: lambda z, v: z >= v, LessThan: lambda z, v: z < v, LessThanOrEqual: lambda z, v: z <= v}
ON_IMAGE: dict[type, Callable[[str, object], bool]] = {EqualTo: lambda p, v: p == v, In: lambda p, v: p in v, StringStartsWith: lambda p, v: p.startswith(v), StringEndsWith: lambda p, v: p.endswith(v)}


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.rows = int(options.get("rows_per_slab", "8"))
        self.most = int(options.get("partition_bytes", str(PARTITION_BYTES)))
        self.others = options.get("ascii", "error")
        self.z: list[Filter] = []
        self.image: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Files and slices are chosen by filters; Spark still applies them, which costs little and holds where axes are swapped."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("z",) and type(f) in ON_Z:
                self.z.append(f)
            elif column == ("image_id",) and type(f) in ON_IMAGE:
                self.image.append(f)
            yield f

    def planned(self, path: str) -> list[Slabs]:
        with opened(path) as f:
            if path.lower().endswith(".am") and not is_lattice(f):
                return []
            h, length = read_header(f, path), f.size()
        if h.encoding == "ascii":
            if self.others == "skip":
                return []
            raise ValueError(f"{path} is an ASCII lattice: read it by scan_volume_slabs")
        slice_bytes = h.ny * h.nx * np.dtype(BYTES[h.dtype]).itemsize
        there = min(h.nz, max(0, length - h.data_start) // slice_bytes)
        wanted = [z for z in range(there) if h.axes != "zyx" or all(ON_Z[type(f)](z, operand(f)) for f in self.z)]
        most = max(1, self.most // slice_bytes)
        runs: list[Slabs] = []
        for z in wanted:
            if runs and runs[-1].end == z and z - runs[-1].first < most:
                runs[-1].end = z + 1
            else:
                runs.append(Slabs(path, h, z, z + 1))
        return runs

    def partitions(self) -> list[Slabs]:
        files = [p for p in listed(self.path) if all(ON_IMAGE[type(f)](p, operand(f)) for f in self.image)]
        with ThreadPoolExecutor(32) as pool:
            return [s for found in pool.map(self.planned, files) for s in found]

    def read(self, partition: Slabs | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # where there is nothing to read, Spark still asks once
            return
        h = partition.header
        kind = np.dtype(BYTES[h.dtype])
        with opened(partition.path) as f:
            for z in range(partition.first, partition.end, self.rows):
                n = min(self.rows, partition.end - z)
                f.seek(h.data_start + z * h.ny * h.nx * kind.itemsize)
                values = np.frombuffer(f.read(n * h.ny * h.nx * kind.itemsize), kind)
                yield voxel_batch(partition.path, h, z * h.ny * h.nx, values.astype(np.float64) + h.shift)


def operand(f: Filter) -> object:
    return getattr(f, "value", None)


def voxel_batch(path: str, h: Header, first: int, values: np.ndarray) -> pa.RecordBatch:
    """Voxels from a file's ``first`` on, in the axes that they should have."""
    n = np.arange(first, first + len(values))
    place = {"z": n // (h.ny * h.nx), "y": n // h.nx % h.ny, "x": n % h.nx}
    at = {c: pa.array(place[named].astype(np.int32)) for c, named in zip("zyx", h.axes, strict=True)}
    name = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(values), np.int32)), [path]).cast(pa.string())
    return pa.record_batch([name, at["z"], at["y"], at["x"], pa.array(values)], schema=VOXEL_ARROW)


class VolumeSource(DataSource):
    """Options: path; rows_per_slab, slices held in memory at once; partition_bytes, bytes of a task; ascii, ``skip`` leaves out lattices of text."""

    @classmethod
    def name(cls) -> str:
        return "volumes"

    def schema(self) -> str:
        return VOXEL

    def reader(self, schema) -> VolumeReader:
        return VolumeReader(dict(self.options))


def block_bounds(h: Header, length: int, block: int, size: int) -> tuple[int, int]:
    start = h.data_start + block * size
    return start, min(start + size, length)


def starts_of(raw: np.ndarray, before_white: bool) -> np.ndarray:
    """Where numbers start in bytes."""
    white = WHITE[raw]
    return np.flatnonzero(~white & np.concatenate([[before_white], white[:-1]]))


def read_block(f: pa.NativeFile, start: int, end: int, first: bool) -> tuple[bytes, bool]:
    """The bytes of a block, and whether white space or the start of the data lies before it."""
    f.seek(start if first else start - 1)
    raw = f.read(end - f.tell())
    return (raw, True) if first else (raw[1:], bool(WHITE[raw[0]]) if raw else True)


def data_mark(f: pa.NativeFile, step: int = 1 << 20) -> int:
    """Where the data of an ASCII lattice start, found by passing over the file."""
    at, kept = 0, b""
    f.seek(0)
    while chunk := f.read(step):
        if (i := (kept + chunk).find(MARK)) >= 0:
            return at - len(kept) + i + len(MARK)
        at, kept = at + len(chunk), (kept + chunk)[-(len(MARK) - 1) :]
    raise ValueError("an ASCII lattice without a data section")


def header_of(row: dict) -> Header:
    return Header(**{f.name: row[f.name] for f in fields(Header)})


def ascii_voxels(headers: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Voxels of ASCII lattices. Blocks of bytes count the numbers that start in them; the sum of those before a block names its first voxel. Of a truncated file, the whole slices that exist."""
    keep = [c.split()[0] for c in VOLUME.split(", ")]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                if r["data_start"] < 0:
                    with opened(r["image_id"]) as f:
                        r["data_start"] = data_mark(f)
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW_VOLUME)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = []
            for r in b.to_pylist():
                with opened(r["image_id"]) as f:
                    raw, white = read_block(f, *block_bounds(header_of(r), r["length"], r["block"], block_bytes), r["block"] == 0)
                n.append(len(starts_of(np.frombuffer(raw, np.uint8), white)))
            yield b.append_column("n", pa.array(n, pa.int64()))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                h = header_of(r)
                with opened(r["image_id"]) as f:
                    start, end = block_bounds(h, r["length"], r["block"], block_bytes)
                    raw, white = read_block(f, start, end, r["block"] == 0)
                    at = starts_of(np.frombuffer(raw, np.uint8), white)
                    if not len(at):
                        continue
                    while end < r["length"] and not WHITE[raw[-1]]:  # the last number may go on
                        f.seek(end)
                        more = f.read(min(64, r["length"] - end))
                        rest = re.match(rb"\S*", more)[0]
                        raw, end = raw + rest, end + len(rest)
                        if len(rest) < len(more):
                            break
                whole = h.ny * h.nx * min(h.nz, r["total"] // (h.ny * h.nx))
                tokens = raw[at[0] :].split()[: max(0, whole - r["first"])]
                if tokens:
                    yield voxel_batch(r["image_id"], h, r["first"], np.array(tokens, np.float64) + h.shift)

    blocks = headers.where("encoding = 'ascii'").mapInArrow(marked, VOLUME)
    blocks = blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((F.col("length") - F.col("data_start")) / block_bytes), F.lit(1)).cast("int") - 1)))
    width = max(1, int(headers.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = blocks.repartition(width, "image_id", "block")
    counts = dealt.mapInArrow(counted, f"{VOLUME}, block int, n long")
    before = Window.partitionBy("image_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumns({"first": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(Window.partitionBy("image_id"))})
    return placed.select(*keep, "block", "first", "total").repartition(width, "image_id", "block").mapInArrow(parsed, VOXEL)


def scan_volume_slabs(spark: SparkSession, path: str, rows_per_slab: int = 8) -> DataFrame:
    """(image_id, z, y, x, value) of volumes. Tasks read runs of slices of at most ``PARTITION_BYTES``, one slab at a time; filters on image_id and z are pushed to the files. Of a truncated file the whole slices that exist; swapped axes are put right; signed bytes of lattices are shifted by 128."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VolumeSource)
    binary = spark.read.format("volumes").option("rows_per_slab", rows_per_slab).option("ascii", "skip").load(path)
    if not any(p.lower().endswith(".am") for p in listed(path)):
        return binary
    texts = scan_volume_headers(spark, path).where("encoding = 'ascii'")
    return binary if texts.isEmpty() else binary.unionByName(ascii_voxels(texts))
