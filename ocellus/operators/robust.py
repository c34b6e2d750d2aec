"""Consensus and least-median fits of any model.

Rows are drawn for all trials in one pass: each row has an exponential key for
each trial, by its number and the trial's, and the rows of the least keys are
the trial's. A partition keeps those alone, so what is shuffled depends on
partitions and trials and not on rows. Models are fitted to the drawn rows;
their measure is a column function, and one aggregation without a shuffle of
rows counts for all trials together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of draws are taken modulo this prime.
PRIME = 2_147_483_647
#: Bits of a double that a pass of the median's search looks at.
DIGIT = 11
#: Fits drawn rows, an array for each column; None where they fix no model.
Fit = Callable[..., Sequence[float] | None]
#: The error of a row under a model.
Measure = Callable[[Sequence[float]], Column]


@dataclass
class Found:
    """The best trial, its model, and what it was chosen by: its inliers' number, or its median error."""

    trial: int
    model: list[float]
    score: float


def draw_numbers(ids: np.ndarray, trials: int, seed: int) -> np.ndarray:
    """A number from 0 to PRIME - 1 for each row and trial."""
    start = (ids.astype(np.int64)[:, None] % PRIME * 7919 + np.arange(trials, dtype=np.int64) * 104_729 + seed) % PRIME
    square = start * start % PRIME
    return (square * 48_271 + start) % PRIME


def _least(n: int, trials: int, seed: int, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            weight = pdf["w"].to_numpy(dtype=float)[:, None]
            u = (draw_numbers(pdf["id"].to_numpy(), trials, seed) + 1) / (PRIME + 1)
            with np.errstate(divide="ignore"):
                key = np.where(weight > 0, -np.log(u) / weight, np.inf)
            take = np.argpartition(key, min(n, len(pdf)) - 1, axis=0)[:n] if len(pdf) > n else np.tile(np.arange(len(pdf))[:, None], (1, trials))
            own = pdf.iloc[take.T.ravel()].drop(columns="w").assign(trial=np.repeat(np.arange(trials, dtype=np.int32), len(take)), key=np.take_along_axis(key, take, axis=0).T.ravel())
            held = own if held is None else pd.concat([held, own])
            held = held.sort_values(["trial", "key", "id"]).groupby("trial").head(n)
        if held is not None:
            yield held[np.isfinite(held["key"])][["trial", "key", "id", *columns]]

    return run


def draws(rows: DataFrame, id_column: str, columns: list[str], n: int, trials: int, seed: int = 1, weight: Column | None = None) -> DataFrame:
    """trial, key, id and the columns (doubles) of n rows for each trial, of all equally likely or by their weights."""
    asked = rows.select(F.col(id_column).cast("long").alias("id"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"), *[F.col(c).cast("double") for c in columns])
    kinds = ", ".join(f"`{c}` double" for c in columns)
    near = asked.mapInPandas(_least(n, trials, seed, columns), f"trial int, key double, id long, {kinds}")
    best = near.groupBy("trial").agg(F.slice(F.array_sort(F.collect_list(F.struct("key", "id", *columns))), 1, n).alias("_r"))
    return best.select("trial", F.explode("_r").alias("_r")).select("trial", "_r.*")


def models(drawn: DataFrame, columns: list[str], n: int, fit: Fit) -> dict[int, list[float]]:
    """A model for each trial whose n rows fix one: as many rows as trials times n reach the driver."""
    out = {}
    for trial, own in drawn.toPandas().groupby("trial"):
        own = own.sort_values(["key", "id"])
        model = fit(*[own[c].to_numpy() for c in columns]) if len(own) == n else None
        if model is not None and np.isfinite(model).all():
            out[int(trial)] = [float(x) for x in model]
    return out


def consensus(rows: DataFrame, id_column: str, columns: list[str], n: int, fit: Fit, measure: Measure, threshold: float, trials: int = 50, seed: int = 1, weight: Column | None = None) -> Found | None:
    """The model that most rows are nearer to than threshold; of equal ones the first trial's. None where no trial has one."""
    fitted = models(draws(rows, id_column, columns, n, trials, seed, weight), columns, n, fit)
    if not fitted:
        return None
    counts = rows.agg(*[F.count_if(measure(m) < threshold).alias(f"t{t}") for t, m in fitted.items()]).first()
    best = max(fitted, key=lambda t: (counts[f"t{t}"], -t))
    return Found(best, fitted[best], float(counts[f"t{best}"]))


def _digits(shift: int, prefix: dict[int, int]):
    """For each trial how many errors with its prefix have each next digit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(prefix), 1 << DIGIT), dtype=np.int64)
        for pdf in batches:
            if not len(pdf):
                continue
            # The bits of numbers that are not negative stand in their order.
            bits = (np.stack(pdf["e"].to_numpy()).astype(np.float64) + 0.0).view(np.uint64)
            for k, (_, known) in enumerate(prefix.items()):
                own = bits[:, k]
                digit = (own[(own >> np.uint64(min(shift + DIGIT, 63))) == known] >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)
                total[k] += np.bincount(digit.astype(np.int64), minlength=1 << DIGIT)
        k, digit = np.nonzero(total)
        yield pd.DataFrame({"k": k.astype(np.int32), "digit": digit.astype(np.int32), "n": total[k, digit]})

    return run


def median_errors(rows: DataFrame, fitted: dict[int, list[float]], measure: Measure) -> dict[int, float]:
    """The exact upper median of each trial's errors (which are not negative), digit by digit from counts; null errors count as infinite."""
    errors = rows.select(F.array(*[F.coalesce(measure(m).cast("double"), F.lit(float("inf"))) for m in fitted.values()]).alias("e"))
    n = rows.count()
    if not n:
        return {}
    rank = dict.fromkeys(fitted, n // 2)
    prefix = dict.fromkeys(fitted, 0)
    # 66 bits in six digits: the highest two are none.
    for shift in range(5 * DIGIT, -1, -DIGIT):
        made = errors.mapInPandas(_digits(shift, {t: np.uint64(p) for t, p in prefix.items()}), "k int, digit int, n long").groupBy("k", "digit").agg(F.sum("n").alias("n")).toPandas()
        for k, t in enumerate(fitted):
            own = made[made["k"] == k].sort_values("digit")
            upto = own["n"].cumsum().to_numpy()
            at = int(np.searchsorted(upto, rank[t], side="right"))
            rank[t] -= int(upto[at - 1]) if at else 0
            prefix[t] = (prefix[t] << DIGIT) | int(own["digit"].iloc[at])
    return {t: float(np.array([p], dtype=np.uint64).view(np.float64)[0]) for t, p in prefix.items()}


def least_median(rows: DataFrame, id_column: str, columns: list[str], n: int, fit: Fit, measure: Measure, trials: int = 50, seed: int = 1, weight: Column | None = None) -> Found | None:
    """The model whose median error is least; of equal ones the first trial's."""
    fitted = models(draws(rows, id_column, columns, n, trials, seed, weight), columns, n, fit)
    medians = median_errors(rows, fitted, measure) if fitted else {}
    if not medians:
        return None
    best = min(medians, key=lambda t: (medians[t], t))
    return Found(best, fitted[best], medians[best])


# --- models


def plane(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> list[float] | None:
    """Unit normal and offset of the plane through three points."""
    p = np.stack([x, y, z], axis=1)
    normal = np.cross(p[1] - p[0], p[2] - p[0])
    length = float(np.linalg.norm(normal))
    if length < 1e-9:
        return None
    normal = normal / length
    return [*normal, -float(normal @ p[0])]


def plane_distance(m: Sequence[float], x: str = "x", y: str = "y", z: str = "z") -> Column:
    return F.abs(float(m[0]) * F.col(x) + float(m[1]) * F.col(y) + float(m[2]) * F.col(z) + float(m[3]))


def homography(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[float] | None:
    """The nine entries, the last of them 1, that carry four points (x, y) to (u, v)."""
    a = []
    for p, q, s, t in zip(x, y, u, v, strict=True):
        a += [[p, q, 1, 0, 0, 0, -s * p, -s * q], [0, 0, 0, p, q, 1, -t * p, -t * q]]
    a = np.array(a)
    if len(a) != 8 or np.linalg.cond(a) > 1e10:
        return None
    return [*np.linalg.solve(a, np.stack([u, v], axis=1).ravel()), 1.0]


def transfer_distance(m: Sequence[float], x: str = "x", y: str = "y", u: str = "u", v: str = "v") -> Column:
    """How far a carried point lies from its partner; infinite where it is carried beyond the horizon."""
    a = [float(k) for k in m]
    over = a[6] * F.col(x) + a[7] * F.col(y) + a[8]
    px, py = (F.try_divide(a[3 * k] * F.col(x) + a[3 * k + 1] * F.col(y) + a[3 * k + 2], over) for k in (0, 1))
    gone = F.sqrt((px - F.col(u)) * (px - F.col(u)) + (py - F.col(v)) * (py - F.col(v)))
    return F.coalesce(gone, F.lit(float("inf")))
