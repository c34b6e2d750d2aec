"""Shared folders, materialised tables and column helpers of the corpus operators."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.operators.iteration import Step

#: Bytes of an Arrow batch while a table is written: texts are long, and each task of an executor holds a batch on either side.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def release(spark: SparkSession) -> None:
    """Let the files of shuffles that nothing refers to any more go now, not at the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Table(Step):
    """A written table, made with Arrow batches of bounded bytes."""

    def __init__(self, df: DataFrame):
        conf = df.sparkSession.conf
        before = conf.get(_BATCH)
        conf.set(_BATCH, str(BATCH_BYTES))
        try:
            super().__init__(df)
        finally:
            conf.set(_BATCH, before)
        release(self.spark)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it where df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; of a null id as of an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def sampled(table: Table, h: str, rows: int) -> DataFrame:
    """About as many rows of table as given, and hardly ever more, or all if there are no more: those of low hash h, which is near to unique.

    The bound comes from a count, so what is collected does not grow with the table.
    """
    n = table.read().count()
    if n <= rows:
        return table.read()
    share = max(rows - 4 * rows**0.5, rows / 2) / n
    return table.read().where(F.col(h) < int((2 * share - 1) * 2**63))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
