"""Large files of fixed-length point records, read by byte ranges: binary PCD, LAS and SDC.

`ocellus_points` is a Spark data source: a file is cut into ranges of whole records, and each range is a task that reads its
own bytes only, so a file of any size is spread over the cluster and none is held whole. Paths are those that Arrow's file
systems open; other stores go through read_points(), which reads a file whole.
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ocellus.sources import formats as f
from ocellus.sources import las
from ocellus.sources.readers import _kind, _values
from ocellus.sources.sinks import _store

#: Bytes of records that a task reads, and records of a batch.
RANGE_BYTES = 64 << 20
BATCH_RECORDS = 50_000
#: Bytes that hold any header but for long variable records, which are read when they are asked for.
HEAD_BYTES = 1 << 16


@dataclass
class Layout:
    """Where a file's records are and how they become columns."""

    kind: str
    dtype: np.dtype
    data_at: int
    records: int
    header: dict
    names: list[str]

    def columns(self, rows: np.ndarray) -> dict[str, np.ndarray]:
        if self.kind == "las":
            return las.las_columns(self.header, self.names, rows)
        plain = {c: rows[c] for c in rows.dtype.names}
        return f.with_colours(plain) if self.kind == "pcd" else plain


@dataclass
class Range(InputPartition):
    path: str
    layout: Layout
    start: int
    count: int


def files_at(path: str) -> list[str]:
    """The files of a path or pattern, in order."""
    from pyarrow import fs

    store, at = _store(path)
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    if "*" not in at and "?" not in at:
        if store.get_file_info(at).type == fs.FileType.File:
            return [path]
        pattern = posixpath.join(at, "*")
    else:
        pattern = at
    found = store.get_file_info(fs.FileSelector(posixpath.dirname(pattern)))
    return sorted(scheme + x.path for x in found if x.type == fs.FileType.File and fnmatch.fnmatch(posixpath.basename(x.path), posixpath.basename(pattern)) and not x.base_name.startswith(("_", ".")))


def layout_of(path: str, kind: str) -> Layout:
    """Read from the head of a file."""
    store, at = _store(path)
    with store.open_input_file(at) as file:
        size, raw = file.size(), file.read_at(min(HEAD_BYTES, file.size()), 0)
        if kind == "las":
            # Variable records may be long, and extended ones stand behind the points.
            h = las.las_header(raw)
            if h["data_at"] > len(raw):
                raw = file.read_at(min(h["data_at"], size), 0)
            head = las.public_header(raw)
            extras = las.extra_fields(_Sparse(file, size) if head["numberOfExtendedVariableLengthRecords"] else raw)
            dtype, names = las.record_type(h, extras)
            return Layout(kind, dtype, h["data_at"], h["points"], h, names)
        if kind == "pcd":
            h = f.pcd_header(raw)
            if h.data != "binary":
                raise ValueError("only binary PCD files have records of one length")
            return Layout(kind, h.dtype, h.size, h.points, {}, h.fields)
        head, _ = f.sdc_records(raw[: int.from_bytes(raw[:4], "little")])
        dtype = f.sdc_dtype(head["major"], head["minor"])
        return Layout(kind, dtype, head["header_size"], (size - head["header_size"]) // dtype.itemsize, head, list(dtype.names))


class _Sparse:
    """Bytes of a file that are read where they are looked at."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at):
        if isinstance(at, slice):
            start, stop, _ = at.indices(self.size)
            return self.file.read_at(max(stop - start, 0), start)
        return self.file.read_at(1, at)[0]


def _schema(layout: Layout) -> str:
    sample = layout.columns(np.zeros(1, dtype=layout.dtype))
    return ", ".join(["file string", "row long", *[f"`{c}` {_kind(a)}" for c, a in sample.items()]])


class PointsReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.own, self.options = schema, options

    def partitions(self) -> list[Range]:
        step = int(self.options.get("range_bytes", RANGE_BYTES))
        out = []
        for path in files_at(self.options["path"]):
            layout = layout_of(path, self.options["kind"])
            count = max(1, step // layout.dtype.itemsize)
            out += [Range(path, layout, k, min(count, layout.records - k)) for k in range(0, layout.records, count)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if part is None:
            return
        schema = to_arrow_schema(self.own)
        store, at = _store(part.path)
        size = part.layout.dtype.itemsize
        with store.open_input_file(at) as file:
            for k in range(part.start, part.start + part.count, BATCH_RECORDS):
                n = min(BATCH_RECORDS, part.start + part.count - k)
                rows = np.frombuffer(file.read_at(n * size, part.layout.data_at + k * size), dtype=part.layout.dtype)
                got = {c: _values(a) for c, a in part.layout.columns(rows).items()}
                got |= {"file": [part.path] * n, "row": np.arange(k, k + n)}
                yield pa.RecordBatch.from_arrays([pa.array(got[field.name], field.type) for field in schema], schema=schema)


class PointsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ocellus_points"

    def schema(self) -> str:
        files = files_at(self.options["path"])
        if not files:
            raise ValueError(f"no file at {self.options['path']}")
        return _schema(layout_of(files[0], self.options["kind"]))

    def reader(self, schema: StructType) -> PointsReader:
        return PointsReader(schema, dict(self.options))


def read_point_ranges(spark: SparkSession, path: str, kind: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """What read_points() gives, of files with records of one length (las, sdc, binary pcd) that may be of any size."""
    spark.dataSource.register(PointsSource)
    return spark.read.format("ocellus_points").option("kind", kind or path.rsplit(".", 1)[-1].lower()).option("range_bytes", range_bytes).load(path)
