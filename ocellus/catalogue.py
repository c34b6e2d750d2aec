"""All queries of the image, point-cloud and graph operators, with their SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from ocellus.plans.registry import Query

MODULES = ("raster_queries", "stereo_queries", "spatial_queries", "kernel_queries", "more_queries", "detection_queries", "matching_queries", "fitting_queries", "volume_queries", "program_queries")


def _all():
    return [importlib.import_module(f"ocellus.plans.{m}").R for m in MODULES]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["disparity_histogram"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {k: q for r in _all() for k, q in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for r in _all() for k, q in r.sql.items()}
