"""Volumes are planned from headers and read by byte range."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual

from spatialseg.sources import volumes

SHAPE = (7, 5, 4)


def mrc(path, values, mode, extended=0, least=0.0, pixel=2.5, cut=None):
    nz, ny, nx = values.shape
    head = struct.pack("<4i", nx, ny, nz, mode) + bytes(24) + struct.pack("<f", nx * pixel) + bytes(32) + struct.pack("<f", least) + bytes(12) + struct.pack("<i", extended)
    raw = head + bytes(volumes.HEADER - len(head) + extended) + values.tobytes()
    path.write_bytes(raw[:cut] if cut else raw)


def lattice(path, values, kind, text=False, unit="nm", pad=0, tail=b""):
    nz, ny, nx = values.shape
    head = f"# AmiraMesh {'3D ASCII 2.0' if text else 'BINARY-LITTLE-ENDIAN 2.1'}\n\ndefine Lattice {nx} {ny} {nz}\n\nParameters {{\n    Units {{\n        Coordinates \"{unit}\"\n    }}\n    BoundingBox 10 {10 + 2.32 * (nx - 1)} 20 30 464 465.5,\n    CoordType \"uniform\"\n}}\n\nLattice {{ {kind} Data }} @1\n{'#' * pad}\n# Data section follows\n@1\n"
    path.write_bytes(head.encode() + (b" \n".join(b"%s" % str(v).encode() for v in values.ravel()) if text else values.tobytes()) + tail)


def voxels(df):
    return {(r["z"], r["y"], r["x"]): r["value"] for r in df.collect()}


def as_voxels(values):
    return {at: float(v) for at, v in np.ndenumerate(values)}


@pytest.mark.parametrize(("mode", "kind", "least"), [(0, "u1", 0.0), (0, "i1", -5.0), (1, "<i2", 0.0), (2, "<f4", 0.0), (6, "<u2", 0.0), (12, "<f2", 0.0)])
def test_modes(spark, tmp_path, mode, kind, least):
    values = np.arange(140).reshape(SHAPE).astype(kind) - np.dtype(kind).type(5 if least else 0)
    mrc(tmp_path / "v.mrc", values, mode, extended=96, least=least)
    path = f"file://{tmp_path}/v.mrc"
    h = volumes.scan_volume_headers(spark, path).first()
    assert (h["nz"], h["ny"], h["nx"], h["pixel_size"], h["data_start"], h["odd_axes"]) == (*SHAPE, 2.5, 1120, False)
    assert np.dtype(h["dtype"]) == np.dtype(kind)
    assert voxels(volumes.scan_volume_slabs(spark, path, 2)) == as_voxels(values)


def test_swapped_axes(spark, tmp_path):
    values = np.arange(9 * 4 * 5).reshape(9, 4, 5).astype("u1")
    mrc(tmp_path / "y.mrc", values, 0)
    assert volumes.scan_volume_headers(spark, f"file://{tmp_path}/y.mrc").first()["odd_axes"]
    assert voxels(volumes.scan_volume_slabs(spark, f"file://{tmp_path}/y.mrc")) == as_voxels(values.transpose(1, 0, 2))
    wide = values.transpose(0, 2, 1).copy()
    mrc(tmp_path / "x.mrc", wide, 0)
    assert voxels(volumes.scan_volume_slabs(spark, f"file://{tmp_path}/x.mrc").where("z < 2")) == {k: v for k, v in as_voxels(wide.transpose(2, 1, 0)).items() if k[0] < 2}


class Counting:
    """A file that adds up the bytes read from it."""

    def __init__(self, file, counts, path):
        self.file, self.counts, self.path = file, counts, path

    def read(self, n):
        raw = self.file.read(n)
        self.counts[self.path] = self.counts.get(self.path, 0) + len(raw)
        return raw

    def __getattr__(self, name):
        return getattr(self.file, name)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def test_only_own_bytes_are_read(tmp_path, monkeypatch):
    values = np.arange(64 * 100 * 100).reshape(64, 100, 100).astype("<f4")
    mrc(tmp_path / "a.mrc", values, 2)
    mrc(tmp_path / "b.mrc", values, 2)
    lattice(tmp_path / "c.am", values, "float")
    (tmp_path / "notes.txt").write_text("no volume")
    counts, plain = {}, volumes.opened
    monkeypatch.setattr(volumes, "opened", lambda p: Counting(plain(p), counts, p.rsplit("/", 1)[1]))
    reader = volumes.VolumeReader({"path": f"file://{tmp_path}", "partition_bytes": "400000", "rows_per_slab": "4"})
    parts = reader.partitions()
    assert len(parts) == 3 * 7 and all(p.end - p.first <= 10 for p in parts)  # ten slices of 40 kB a task
    assert counts == {"a.mrc": volumes.HEADER, "b.mrc": volumes.HEADER, "c.am": 2 * volumes.LATTICE_HEAD}
    counts.clear()
    batches = list(reader.read(parts[3]))
    assert counts == {parts[3].path.rsplit("/", 1)[1]: 10 * 40_000} and [b.num_rows for b in batches] == [40_000, 40_000, 20_000]
    counts.clear()
    chosen = volumes.VolumeReader({"path": f"file://{tmp_path}"})
    filters = [EqualTo(("image_id",), f"file:{tmp_path}/b.mrc"), GreaterThanOrEqual(("z",), 62)]
    assert list(chosen.pushFilters(filters)) == filters
    [only] = chosen.partitions()
    assert (only.first, only.end) == (62, 64) and sum(b.num_rows for b in chosen.read(only)) == 20_000
    assert counts == {"b.mrc": volumes.HEADER + 80_000}


def test_filters_reach_the_files(spark, tmp_path):
    values = np.arange(140).reshape(SHAPE).astype("u1")
    for name in "ab":
        mrc(tmp_path / f"{name}.mrc", values, 0)
    v = volumes.scan_volume_slabs(spark, f"file://{tmp_path}").where(F.col("image_id").endswith("a.mrc") & F.col("z").isin(2, 5))
    assert v.count() == 40 and voxels(v) == {k: x for k, x in as_voxels(values).items() if k[0] in (2, 5)}
    (tmp_path / "b.mrc").write_bytes(b"not a header")  # a file that no filter lets through is not opened
    assert v.count() == 40
    with pytest.raises(Exception, match="a header of 12 bytes"):
        volumes.scan_volume_slabs(spark, f"file://{tmp_path}").count()


@pytest.mark.parametrize("text", [False, True])
@pytest.mark.parametrize(("kind", "stored"), [("byte", "u1"), ("sbyte", "i1"), ("float", "<f4")])
def test_lattices(spark, tmp_path, kind, stored, text):
    values = (np.arange(140).reshape(SHAPE) - (70 if kind == "sbyte" else 0)).astype(stored)
    lattice(tmp_path / "v.am", values, kind, text, tail=b"\n")
    (tmp_path / "graph.am").write_text("# AmiraMesh 3D ASCII 2.0\ndefine VERTEX 2\n")
    path = f"file://{tmp_path}"
    h = volumes.scan_volume_headers(spark, path).collect()
    assert len(h) == 1 and (h[0]["nz"], h[0]["ny"], h[0]["nx"], h[0]["pixel_size"], h[0]["encoding"]) == (*SHAPE, 23.2, "ascii" if text else "binary")
    assert (h[0]["off_x"], h[0]["off_y"], h[0]["off_z"], h[0]["size_y"], h[0]["size_z"]) == (10, 20, 464, 30, 465.5)
    assert voxels(volumes.scan_volume_slabs(spark, path)) == as_voxels(values.astype(float) + (128 if kind == "sbyte" else 0))


def test_ascii_blocks_meet_inside_numbers(spark, tmp_path):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 10**9, SHAPE).astype("<f4").astype(float) / 7
    lattice(tmp_path / "v.am", values, "float", True, unit="m", pad=30_000)  # the data start beyond the head
    headers = volumes.scan_volume_headers(spark, f"file://{tmp_path}/v.am")
    assert headers.first()["data_start"] == -1
    for size in (1, 3, 17, 1000, 1 << 20):
        assert voxels(volumes.ascii_voxels(headers, size)) == as_voxels(values)
    raw = (tmp_path / "v.am").read_bytes()
    (tmp_path / "v.am").write_bytes(raw[: int(len(raw) - 0.3 * (len(raw) - 30_000))])
    got = voxels(volumes.ascii_voxels(volumes.scan_volume_headers(spark, f"file://{tmp_path}/v.am"), 50))
    assert 0 < len(got) < 140 and len(got) % 20 == 0 and got == {k: v for k, v in as_voxels(values).items() if k in got}


def test_truncated_files_give_whole_slices(spark, tmp_path):
    values = np.arange(140).reshape(SHAPE).astype("u1")
    mrc(tmp_path / "v.mrc", values, 0, cut=volumes.HEADER + 59)
    assert voxels(volumes.scan_volume_slabs(spark, f"file://{tmp_path}/v.mrc", 3)) == {k: v for k, v in as_voxels(values).items() if k[0] < 2}
    mrc(tmp_path / "v.mrc", values, 0, cut=volumes.HEADER)
    assert volumes.scan_volume_slabs(spark, f"file://{tmp_path}/v.mrc").count() == 0


def test_patterns_and_large_numbers_of_tasks(spark, tmp_path):
    values = np.arange(64 * 64 * 64).reshape(64, 64, 64).astype("<u2")
    for name in ("a.rec", "b.rec", "c.mrc"):
        mrc(tmp_path / name, values, 6)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(volumes.VolumeSource)
    v = spark.read.format("volumes").option("partition_bytes", 64 * 64 * 2 * 16).load(f"file://{tmp_path}/*.rec")
    assert v.rdd.getNumPartitions() == 8
    assert v.groupBy("image_id").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n")).select("s", "n").distinct().collect() == [(float(values.sum()), values.size)]
