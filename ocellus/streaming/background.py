"""Frames as micro-batches against a static background: a stream-static join without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def mask_stream(frames: DataFrame, background: DataFrame, tolerance: int) -> DataFrame:
    """img, i, j, foreground for a stream of frames (img, i, j, disparity) and a static background (i, j, disparity)."""
    b = background.select("i", "j", F.col("disparity").alias("_b"))
    return frames.join(b, ["i", "j"]).select("img", "i", "j", (F.abs(F.col("disparity") - F.col("_b")) >= tolerance).alias("foreground"))


def write_masks(masks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends masks as Parquet, each frame once whatever fails in between."""
    return masks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
