"""Point clouds and arrays as DataFrames, and back.

Bytes come by Spark's binary reader, so any store that Spark reads will do, and
are decoded on the executors, a file to a row; the schema comes of one file's
header. Writers encode a partition to a file's bytes; sinks.py puts them at a path.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.operators.attributes import union
from ocellus.sources import formats as f
from ocellus.sources.las import public_header, variable_records

_SPARK = {"f4": "float", "f8": "double", "i1": "byte", "i2": "short", "i4": "int", "i8": "long", "u1": "short", "u2": "int", "u4": "long", "u8": "decimal(20,0)"}
_WIDER = {"u1": "i2", "u2": "i4", "u4": "i8"}


def _columns(kind: str, raw: bytes) -> dict[str, np.ndarray]:
    if kind == "pcd":
        h, rows = f.pcd_records(raw)
        return f.with_colours({c: rows[c] for c in h.fields})
    if kind == "las":
        return f.las_records(raw)[1]
    if kind == "sdc":
        rows = f.sdc_records(raw)[1]
        return {c: rows[c] for c in rows.dtype.names}
    raise ValueError(f"no reader for {kind}")


def _kind(a: np.ndarray) -> str:
    if a.dtype.kind == "V":
        return "binary"
    one = _SPARK[a.dtype.str[1:]]
    return one if a.ndim == 1 else f"array<{one}>"


def _values(a: np.ndarray) -> np.ndarray | list:
    """A column as pandas takes it."""
    if a.dtype.kind == "V":
        return [v.tobytes() for v in a]
    if a.ndim > 1:
        return list(a)
    return a.astype(_WIDER.get(a.dtype.str[1:], a.dtype.str[1:]))


def read_points(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Points of a file, or of the files of a pattern, that have one schema; and file, row. Chosen by suffix: pcd, las, sdc, metacloud."""
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if kind == "metacloud":
        return read_metacloud(spark, path)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    first = files.orderBy("path").select("content").first()
    if first is None:
        raise ValueError(f"no file at {path}")
    sample = _columns(kind, bytes(first[0]))
    names = list(sample)
    schema = ", ".join(["file string", "row long", *[f"`{c}` {_kind(a)}" for c, a in sample.items()]])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path_, content in zip(pdf["path"], pdf["content"], strict=True):
                got = _columns(kind, bytes(content))
                data = {c: _values(got[c]) for c in names}
                n = len(next(iter(data.values()))) if data else 0
                for at in range(0, max(n, 1), 100_000):
                    yield pd.DataFrame({"file": path_, "row": np.arange(at, min(n, at + 100_000)), **{c: v[at : at + 100_000] for c, v in data.items()}})

    return files.mapInPandas(decode, schema)


def _metacloud(spark: SparkSession, path: str) -> f.Metacloud:
    """The description, with relative paths taken from its own folder."""
    text = spark.read.format("text").option("wholetext", "true").load(path).first()[0]
    base = posixpath.dirname(path)
    own = lambda p: p if "://" in p or p.startswith("/") else posixpath.join(base, p)
    said = f.read_metacloud_text(text)
    return f.Metacloud([own(m) for m in said.members], [(own(p), a) for p, a in said.sides], [(own(p), t, n) for p, t, n in said.indices], said.attributes)


def read_metacloud(spark: SparkSession, path: str) -> DataFrame:
    """All members' points; an attribute that a member lacks is null there.

    A side file has a record for each point, counted over all members in their order; a point beyond its end has nulls.
    """
    said = _metacloud(spark, path)
    points = union([read_points(spark, m).withColumn("member", F.lit(k)) for k, m in enumerate(said.members)])
    if not said.sides:
        return points
    # A row for each file of a member: where its points begin among all.
    sizes = sorted(tuple(r) for r in points.groupBy("member", "file").agg(F.count("*").alias("n")).collect())
    begin, starts = 0, []
    for member, file, n in sizes:
        starts.append((member, file, begin))
        begin += n
    at = spark.createDataFrame(starts, "member int, file string, _at long")
    out = points.join(F.broadcast(at), ["member", "file"]).withColumn("_at", F.col("_at") + F.col("row"))
    for side, attributes in said.sides:
        out = out.join(_read_side(spark, side, attributes), "_at", "left")
    return out.drop("_at")


def _read_side(spark: SparkSession, path: str, attributes: list[tuple[str, str]]) -> DataFrame:
    schema = ", ".join(["_at long", *[f"`{name}` {_SPARK[np.dtype(f.SIDE_KINDS[kind]).str[1:]]}" for kind, name in attributes]])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows = f.side_records(bytes(content), attributes)
                for at in range(0, len(rows), 100_000):
                    part = rows[at : at + 100_000]
                    yield pd.DataFrame({"_at": np.arange(at, at + len(part)), **{c: _values(part[c]) for c in part.dtype.names}})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, schema)


def read_metacloud_attributes(spark: SparkSession, path: str) -> DataFrame:
    """name and value of a metacloud's own attributes, and of its index files (name, and path under their type)."""
    said = _metacloud(spark, path)
    rows = [("attribute", n, str(v), type(v).__name__) for n, v in said.attributes.items()] + [("index", n, p, t) for p, t, n in said.indices]
    return spark.createDataFrame(rows, "section string, name string, value string, kind string")


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """A row for each value of the public header of each LAS file: its name, its text, and its number or numbers if it is one."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path_, content in zip(pdf["path"], pdf["content"], strict=True):
                for name, v in public_header(bytes(content)).items():
                    numbers = None if isinstance(v, str) else [float(x) for x in (v if isinstance(v, list) else [v])]
                    rows.append((path_, name, str(v).rstrip("\0"), numbers))
            yield pd.DataFrame(rows, columns=["file", "name", "value", "numbers"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "file string, name string, value string, numbers array<double>")


def read_variable_records(spark: SparkSession, path: str) -> DataFrame:
    """The variable length records of LAS files, extended ones too."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, v["user"], v["record"], v["description"], v["extended"], bytes(v["data"])) for p, c in zip(pdf["path"], pdf["content"], strict=True) for v in variable_records(bytes(c))]
            yield pd.DataFrame(rows, columns=["file", "user", "record", "description", "extended", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "file string, user string, record int, description string, extended boolean, data binary")


def read_arrays(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """file, i, j, c, value of flow files (kind flo) or dense arrays of two or three axes (kind raw)."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path_, content in zip(pdf["path"], pdf["content"], strict=True):
                a = f.flow_array(bytes(content)) if kind == "flo" else f.dense_array(bytes(content))
                a = a[:, :, None] if a.ndim == 2 else a
                i, j, c = np.indices(a.shape, dtype=np.int32)
                yield pd.DataFrame({"file": path_, "i": i.ravel(), "j": j.ravel(), "c": c.ravel(), "value": a.astype(float).ravel()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "file string, i int, j int, c int, value double")


def encode_points(df: DataFrame, kind: str, binary: bool = True, **options) -> DataFrame:
    """part, content: the bytes of a file for each partition's points. options are those of las_bytes or sdc_bytes."""
    from pyspark import TaskContext

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [p for p in batches if len(p)]
        if not parts:
            return
        pdf = pd.concat(parts)
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        raw = f.pcd_bytes(columns, binary) if kind == "pcd" else f.las_bytes(columns, **options) if kind == "las" else f.sdc_bytes(columns, **options)
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "content": [raw]})

    return df.mapInPandas(encode, "part int, content binary")


def decode_points(files: DataFrame, kind: str, schema: str) -> DataFrame:
    """The points of files' bytes (content), of a known schema."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                got = _columns(kind, bytes(content))
                yield pd.DataFrame({c: _values(got[c]) for c in names})

    return files.mapInPandas(decode, schema)
