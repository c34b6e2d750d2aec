"""Robust kernels and covariance functions as column expressions, and index tables."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def huber(x: Column, k: float) -> Column:
    return F.when(F.abs(x) <= k, x * x / 2).otherwise(k * (F.abs(x) - k / 2))


def huber_derivative(x: Column, k: float) -> Column:
    return F.least(F.greatest(x, F.lit(-k)), F.lit(k))


def pseudo_huber(x: Column, k: float) -> Column:
    return k * k * (F.sqrt(1 + (x / k) * (x / k)) - 1)


def pseudo_huber_derivative(x: Column, k: float) -> Column:
    return x / F.sqrt(1 + (x / k) * (x / k))


def sqrt_huber(x: Column, k: float) -> Column:
    return F.signum(x) * F.sqrt(huber(x, k))


def matern(d: Column, rho: float, nu: float) -> Column:
    """Matern correlation; closed forms for nu 1/2, 3/2, 5/2, the Gaussian limit beyond 150, a series of integrals otherwise."""
    if nu > 150:
        return F.exp(-d * d / (2 * rho * rho))
    x = math.sqrt(2 * nu) * d / rho
    if nu == 0.5:
        return F.exp(-x)
    if nu == 1.5:
        return (1 + x) * F.exp(-x)
    if nu == 2.5:
        return (1 + x + x * x / 3) * F.exp(-x)

    @F.pandas_udf("double")
    def general(values: pd.Series) -> pd.Series:
        return pd.Series(matern_values(values.to_numpy(dtype=float), nu))

    return general(x)


def matern_derivative(d: Column, rho: float, nu: float) -> Column:
    """Derivative of matern() by the distance; nu 1/2 (one-sided at 0), 3/2, 5/2, or beyond 150."""
    if nu > 150:
        return -d / (rho * rho) * F.exp(-d * d / (2 * rho * rho))
    x = math.sqrt(2 * nu) * d / rho
    if nu == 0.5:
        return -F.exp(-x) / rho
    if nu == 1.5:
        return -3 * d / (rho * rho) * F.exp(-x)
    if nu == 2.5:
        return -5 * d / (3 * rho * rho) * (1 + x) * F.exp(-x)
    raise ValueError(f"no closed derivative for nu {nu}")


def covariance(d: Column, variance: float, rho: float, nu: float, nugget: float = 0.0) -> Column:
    """A variance times the correlation; the nugget is added at no distance."""
    return variance * matern(d, rho, nu) + F.when(d == 0, nugget).otherwise(0.0)


def matern_values(x: np.ndarray, nu: float) -> np.ndarray:
    """2^(1-nu) / Gamma(nu) x^nu K_nu(x), K by its integral over cosh."""
    t = np.linspace(0, 12, 4001)
    safe = np.maximum(x, 1e-12)[:, None]
    bessel = np.trapezoid(np.exp(-safe * np.cosh(t)) * np.cosh(nu * t), t, axis=1)
    return np.where(x <= 1e-12, 1.0, 2 ** (1 - nu) / math.gamma(nu) * np.maximum(x, 1e-12) ** nu * bessel)


def choose_indices(spark: SparkSession, n: int, k: int) -> DataFrame:
    """k, a, b, ...: all choices in order. The table's size is the number of choices."""
    names = [chr(97 + i) for i in range(k)]
    rows = [(i, *c) for i, c in enumerate(combinations(range(n), k))]
    return spark.createDataFrame(rows, ", ".join(["k long", *[f"{c} long" for c in names]]))
