"""Files of points and pictures: round trips through every point format, side files, and files that a job writes."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from ocellus.sources import images, las, sinks
from ocellus.sources.formats import pcd_bytes, read_metacloud_text
from ocellus.sources.ranges import read_point_ranges
from ocellus.sources.readers import read_header, read_metacloud_attributes, read_points, read_variable_records
from pyspark.sql import functions as F


@pytest.mark.parametrize("fmt", range(11))
def test_las_formats_with_extra_bytes(fmt):
    rng = np.random.default_rng(fmt)
    n = 40
    said = {c: np.round(rng.normal(0, 50, n), 2) for c in "xyz"}
    said["x"][3] = np.nan
    for f, kind in las.LAS_FORMATS[fmt]:
        if f not in las._PACKED:
            said[f] = rng.integers(0, 100, n).astype(kind)
    bits = las._OLD_BITS if fmt <= 5 else las._NEW_BITS
    said |= {b: rng.integers(0, 1 << w, n) for b, (_, _, w) in bits.items()}
    said |= {"height": rng.normal(size=n), "class2": rng.integers(-9, 9, n).astype("i2"), "flag": rng.random(n) < 0.5, "raw": np.array([bytes([k, 255 - k, 7]) for k in range(n)], dtype=object)}
    raw = las.las_bytes(said, offset=(100.0, 0.0, -5.0), point_format=fmt)
    h, got = las.las_records(raw)
    assert h["format"] == fmt and h["points"] == n
    for c, v in said.items():
        if c == "raw":
            assert [x.tobytes() for x in got[c]] == list(v)
        elif c in "xyz":
            assert np.allclose(got[c], v, atol=1e-6, equal_nan=True)
        else:
            assert np.array_equal(got[c].astype(float), np.asarray(v).astype(float)), c
    head = las.public_header(raw)
    assert head["numberOfPointRecords"] == n and sum(head["numberOfPointsByReturn"]) == n - int((said["returnNumber"] == 0).sum())
    assert head["legacyNumberOfPointRecords"] == (n if fmt <= 5 else 0)


def test_las_format_choice_and_casts():
    assert las.suitable_format({"x", "scananglerank"}) == 0
    assert [las.suitable_format({"scananglerank", *a}) for a in (["gpstime"], ["red"], ["red", "gpstime"], ["gpstime", "wavedescriptor"], ["red", "gpstime", "wavedescriptor"])] == [1, 2, 3, 4, 5]
    assert [las.suitable_format(set(a)) for a in ([], ["red"], ["red", "nir"], ["wavedescriptor"], ["red", "nir", "wavedescriptor"])] == [6, 7, 8, 9, 10]
    assert las.cast(np.array([-5.0, 1.9, 1e9, np.nan]), "<u2").tolist() == [0, 1, 65535, 0]
    assert las.cast(np.array([300, -1]), "u1").tolist() == [255, 0]


def test_extended_records_and_undescribed_bytes():
    raw = bytearray(las.las_bytes({"x": np.array([1.0]), "y": np.array([2.0]), "z": np.array([3.0]), "a": np.array([7], dtype="u1")}))
    name, kind = las.extra_fields(bytes(raw))[0]
    assert (name, kind) == ("a", "u1")
    # An extended record with another name for the same byte counts for more; without any, the byte is raw.
    data = bytearray(192)
    data[2], data[4:6] = 2, b"b2"
    at = len(raw)
    raw += struct.pack("<H16sHQ32s", 0, b"LASF_Spec", 4, 192, b"more") + data
    struct.pack_into("<QI", raw, 235, at, 1)
    assert las.las_records(bytes(raw))[1]["b2"].tolist() == [7]
    assert [v["extended"] for v in las.variable_records(bytes(raw))] == [False, True]
    struct.pack_into("<QI", raw, 235, 0, 0)
    struct.pack_into("<I", raw, 100, 0)
    assert las.las_records(bytes(raw))[1]["extraBytes"][0].tobytes() == b"\x07"


def test_a_job_writes_files_that_are_read_back(spark, tmp_path):
    points = spark.range(100).select(*[(F.col("id") * k / 4).alias(c) for k, c in enumerate("xyz", start=1)], F.col("id").cast("int").alias("intensity"), (F.col("id") * 0.5).alias("score")).repartition(3)
    for kind in ("las", "pcd"):
        at = str(tmp_path / kind)
        sinks.write_points(points, at, kind)
        back = read_points(spark, f"{at}/*.{kind}", kind)
        got = sorted((r.x, r.y, r.z, r.intensity, r.score) for r in back.collect())
        assert np.allclose(got, sorted(tuple(r) for r in points.collect())) and back.select("file").distinct().count() == 3
        assert not list((tmp_path / kind).glob("_held*"))
    head = {r.name: r.numbers for r in read_header(spark, str(tmp_path / "las" / "part-000000.las")).collect()}
    assert head["versionMinor"] == [4.0] and len(head["numberOfPointsByReturn"]) == 15
    (v,) = read_variable_records(spark, str(tmp_path / "las" / "part-000000.las")).collect()
    assert (v.user, v.record, len(v.data)) == ("LASF_Spec", 4, 192)


def test_two_files_of_one_name_are_refused(spark, tmp_path):
    files = spark.createDataFrame([("a", b"1"), ("a", b"2")], "name string, content binary").repartition(2)
    with pytest.raises(Exception, match="two files"):
        sinks.write_files(files, str(tmp_path / "x"))


def test_metacloud_side_files_go_in_step(spark, tmp_path):
    (tmp_path / "a.las").write_bytes(las.las_bytes({c: np.array([1.0, 2.0, 3.0]) for c in "xyz"}))
    (tmp_path / "b c.pcd").write_bytes(pcd_bytes({c: np.array([4.0, 5.0]) for c in "xyz"}))
    (tmp_path / "side.bin").write_bytes(np.array([(k, k / 2) for k in range(4)], dtype=[("k", "<u2"), ("v", "<f4")]).tobytes())
    (tmp_path / "m.metacloud").write_text('POINTS_FILES # two\na.las "b c.pcd"\nEXTRA_ATTRIBUTES\nside.bin uint16 k float32 "v"\nINDEX_FILES\ni.bin grid cells\nMETACLOUD_ATTRIBUTES\nyear 2020\nscale 1.5e0\ntitle "12"\n')
    rows = read_points(spark, str(tmp_path / "m.metacloud")).orderBy("member", "row").collect()
    assert [(r.x, r.k, r.v) for r in rows] == [(1.0, 0, 0.0), (2.0, 1, 0.5), (3.0, 2, 1.0), (4.0, 3, 1.5), (5.0, None, None)]
    said = {(r.section, r.name): (r.value, r.kind) for r in read_metacloud_attributes(spark, str(tmp_path / "m.metacloud")).collect()}
    assert said[("attribute", "year")] == ("2020", "int") and said[("attribute", "title")] == ("12", "str") and said[("attribute", "scale")] == ("1.5", "float")
    assert said[("index", "cells")][1] == "grid"
    for bad in ("a", "POINTS_FILES\nx\nEXTRA_ATTRIBUTES\nf string n", "INDEX_FILES\na b"):
        with pytest.raises(ValueError):
            read_metacloud_text(bad)


def test_packed_colours(spark, tmp_path):
    packed = np.array([0x00FF8001, 0x7F010203], dtype="<u4")
    (tmp_path / "c.pcd").write_bytes(pcd_bytes({"x": np.zeros(2), "rgba": packed.view("<f4")}))
    got = [(r.r, r.g, r.b, r.a) for r in read_points(spark, str(tmp_path / "c.pcd")).orderBy("row").collect()]
    assert got == [(255, 128, 1, 0), (1, 2, 3, 127)]


@pytest.mark.parametrize("channels", [1, 3])
def test_pictures(spark, tmp_path, channels):
    cells = spark.range(6 * 5 * channels).select(F.lit(4).alias("img"), (F.col("id") % 6).cast("int").alias("i"), (F.floor(F.col("id") / 6) % 5).cast("int").alias("j"), F.floor(F.col("id") / 30).cast("int").alias("c"), ((F.col("id") * 37) % 256).cast("double").alias("value"))
    sinks.write_files(images.encode_images(cells), str(tmp_path / "p"))
    got = {(r.i, r.j, r.c): r.value for r in images.read_images(spark, str(tmp_path / "p")).collect()}
    assert got == {(r.i, r.j, r.c): r.value for r in cells.collect()}
    assert images.levels(np.array([True, False])).tolist() == [255, 0] and images.levels(np.array([-3.0, 700.4]), 8).tolist() == [0, 255]


@pytest.mark.parametrize("kind", ["las", "pcd", "sdc"])
def test_ranges_of_a_file_are_the_whole(spark, tmp_path, kind):
    points = spark.range(1000).select(*[(F.col("id") * k / 4).alias(c) for k, c in enumerate("xyz", start=1)], F.col("id").cast("int").alias("amplitude"), F.col("id").cast("short").alias("mark"))
    sinks.write_points(points.repartition(2), str(tmp_path / "p"), kind)
    at = f"{tmp_path}/p/*.{kind}"
    whole, parts = read_points(spark, at, kind), read_point_ranges(spark, at, kind, range_bytes=3000)
    assert parts.rdd.getNumPartitions() > 6 and parts.columns == whole.columns and parts.dtypes == whole.dtypes
    key = lambda df: sorted((r.file.rsplit("/", 1)[1], *r[1:]) for r in df.collect())
    assert key(parts) == key(whole)


def test_ranges_with_extended_records(spark, tmp_path):
    raw = bytearray(las.las_bytes({"x": np.arange(5.0), "y": np.arange(5.0), "z": np.arange(5.0), "a": np.arange(5, dtype="u1")}))
    data = bytearray(192)
    data[2], data[4:6] = 2, b"b2"
    struct.pack_into("<QI", raw, 235, len(raw), 1)
    raw += struct.pack("<H16sHQ32s", 0, b"LASF_Spec", 4, 192, b"more") + data
    (tmp_path / "e.las").write_bytes(raw)
    assert sorted(r.b2 for r in read_point_ranges(spark, str(tmp_path / "e.las"), range_bytes=100).collect()) == [0, 1, 2, 3, 4]
