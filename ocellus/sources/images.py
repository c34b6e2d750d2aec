"""Pictures as cells and back: Spark's own image source reads, and a PNG encoder writes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """file, i, j, c, value (0 to 255) of the pictures that the JVM decodes (PNG, JPEG, BMP, GIF); c counts red, green, blue, alpha."""
    shots = spark.read.format("image").load(path).select("image.*").where("height > 0")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                a = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.nChannels)
                if r.nChannels >= 3:  # as it comes, blue is first
                    a = a[:, :, [2, 1, 0, *range(3, r.nChannels)]]
                i, j, c = np.indices(a.shape, dtype=np.int32)
                yield pd.DataFrame({"file": r.origin, "i": i.ravel(), "j": j.ravel(), "c": c.ravel(), "value": a.astype(float).ravel()})

    return shots.mapInPandas(decode, "file string, i int, j int, c int, value double")


def levels(value: np.ndarray, bits: int = 8) -> np.ndarray:
    """Values as levels of a picture: booleans are black and white, others are rounded and cut off at the ends."""
    top = (1 << bits) - 1
    if value.dtype.kind == "b":
        return value.astype(f">u{bits // 8}") * top
    return np.clip(np.round(np.nan_to_num(value.astype(float))), 0, top).astype(f">u{bits // 8}")


def png_bytes(array: np.ndarray, bits: int = 8) -> bytes:
    """A PNG of an array (rows, columns) or (rows, columns, 1 to 4)."""
    a = levels(array, bits)
    a = a[:, :, None] if a.ndim == 2 else a
    h, w, c = a.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[c]
    lines = np.zeros((h, 1 + w * c * bits // 8), dtype=np.uint8)
    lines[:, 1:] = np.frombuffer(np.ascontiguousarray(a).tobytes(), dtype=np.uint8).reshape(h, -1)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def encode_images(cells: DataFrame, bits: int = 8) -> DataFrame:
    """name, content: a PNG for each img of cells (img, i, j, value, and c where there are channels). An image is one task's."""
    columns = ["img", "i", "j", "value"] + ["c"] * ("c" in cells.columns)

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf["c"].to_numpy() if "c" in pdf else np.zeros(len(pdf), dtype=int)
        a = np.zeros((int(pdf["i"].max()) + 1, int(pdf["j"].max()) + 1, int(c.max()) + 1), dtype=bool if pdf["value"].dtype == bool else float)
        a[pdf["i"], pdf["j"], c] = pdf["value"]
        return pd.DataFrame({"name": [f"{pdf['img'].iloc[0]}.png"], "content": [png_bytes(a, bits)]})

    return cells.select(*columns).groupBy("img").applyInPandas(encode, "name string, content binary")


def disparity_picture(disparities: DataFrame) -> DataFrame:
    """img, i, j, value: disparities stretched over the levels of their image."""
    ends = disparities.groupBy("img").agg(F.min("disparity").alias("_lo"), F.max("disparity").alias("_hi"))
    share = F.try_divide(F.col("disparity") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return disparities.join(ends, "img").select("img", "i", "j", (255 * F.coalesce(share, F.lit(0.0))).alias("value"))
