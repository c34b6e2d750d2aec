"""Steps of iterative operators, written to the shared folder so that lineage ends there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


class NotSettled(RuntimeError):
    """An iteration ended at its limit without meeting its tolerance."""


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. In local mode, one is made where that is unset; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="ocellus-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path below the shared folder, for files of any kind; it goes with the driver."""
    path = f"{shared_dir(spark)}/ocellus/{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written step."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the session has ended, and the folder may have gone with it
            return


class Step:
    """A written table: lineage ends here, and a lost executor costs nothing. What is not dropped before goes with the driver."""

    def __init__(self, df: DataFrame):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = scratch(self.spark)
        df.write.option("compression", "zstd").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)
        _made.remove((self.spark, self.path))
