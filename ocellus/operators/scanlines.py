"""Scan-line paths whose steps are priced by a policy.

A path matches a column, passes over a target (the disparity grows by one, in
the same column) or over a source (it falls by one, in the next). What a step
costs depends on its kind, on the kind of the step before it and on how many of
that kind there were in a row, so a state is a disparity, a kind and a run
length up to the policy's last one. A policy is a table of prices; it may be
weighted cell by cell, by a guide image for one.

Rows are independent: each task takes some rows of an image, side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.operators.sequential import VOLUME

MATCH, PAST_TARGET, PAST_SOURCE = range(3)
#: Rows of an image that a task takes together.
ROWS = 16


@dataclass
class Policy:
    """prices[kind][before][run]: of a step of a kind after run (0: at the start; the last: so many or more) steps of the kind before."""

    prices: np.ndarray

    @property
    def runs(self) -> int:
        return self.prices.shape[2] - 1

    def state(self, kind: int, run: int) -> int:
        return kind * (self.runs + 1) + run

    def ways(self, kind: int, run: int) -> list[tuple[int, float]]:
        """The states from which a step of this kind leads to this run of it, and its price there."""
        out = []
        for before in range(3):
            for past in range(self.runs + 1):
                now = min(past + 1, self.runs) if before == kind else 1
                if now == run and (past or before == MATCH):
                    out.append((self.state(before, past), float(self.prices[kind, before, past])))
        return out


def two_prices(first: float, further: float) -> Policy:
    """The first step of a run of passes costs first, each that follows further."""
    prices = np.zeros((3, 3, 2))
    for kind in (PAST_TARGET, PAST_SOURCE):
        prices[kind] = first
        prices[kind, kind] = further
    return Policy(prices)


def free_after(first: float, further: float, steps: int) -> Policy:
    """As two_prices, but a run of more than so many steps goes on at no price."""
    prices = np.zeros((3, 3, steps + 2))
    for kind in (PAST_TARGET, PAST_SOURCE):
        prices[kind] = first
        prices[kind, kind] = further
        prices[kind, kind, steps + 1 :] = 0
    return Policy(prices)


def growing(first: float, step: float, steps: int) -> Policy:
    """The price of a run's next step grows by step, up to so many times."""
    prices = np.zeros((3, 3, steps + 1))
    for kind in (PAST_TARGET, PAST_SOURCE):
        prices[kind] = first
        prices[kind, kind] = first + step * np.arange(steps + 1)
    return Policy(prices)


def edge_weight(guide: DataFrame, scale: float) -> DataFrame:
    """img, i, j, weight: scale / (scale + the guide's difference to the cell on the left), so that jumps are cheap at its edges."""
    along = Window.partitionBy("img", "i").orderBy("j")
    return guide.select("img", "i", "j", (scale / (scale + F.abs(F.col("value") - F.coalesce(F.lag("value").over(along), F.col("value"))))).alias("weight"))


def paths(cost: np.ndarray, policy: Policy, weight: np.ndarray | None = None) -> np.ndarray:
    """Disparities of lines (lines, columns, disparities) along the paths of least price from disparity 0 to 0; -1 where a source is passed over.

    weight (lines, columns) multiplies the prices of the passes at a column: over a source at its own, over a target at the
    one last matched or passed. Of equal ways that by the least kind and run before is taken.
    """
    lines, w, n = cost.shape
    size = 3 * (policy.runs + 1)
    factor = np.ones((lines, w)) if weight is None else weight
    ways = {kind: [(policy.state(kind, run), *map(np.array, zip(*found, strict=True))) for run in range(1, policy.runs + 1) if (found := policy.ways(kind, run))] for kind in range(3)}
    best = np.full((lines, n, size), np.inf)
    best[:, 0, policy.state(MATCH, 0)] = 0
    came = np.full((w + 1, lines, n, size), -1, dtype=np.int16)

    def pass_targets(j: int) -> None:
        by = factor[:, max(j - 1, 0), None]
        for d in range(1, n):
            for to, states, prices in ways[PAST_TARGET]:
                tried = best[:, d - 1, states] + prices * by
                at = tried.argmin(axis=1)
                best[:, d, to], came[j, :, d, to] = tried[np.arange(lines), at], states[at]

    pass_targets(0)
    for j in range(1, w + 1):
        before, best = best, np.full((lines, n, size), np.inf)
        for to, states, prices in ways[MATCH]:
            tried = before[:, :, states] + prices
            at = tried.argmin(axis=2)
            best[:, :, to] = np.take_along_axis(tried, at[:, :, None], axis=2)[:, :, 0] + cost[:, j - 1]
            came[j, :, :, to] = states[at]
        for to, states, prices in ways[PAST_SOURCE]:
            tried = before[:, 1:, states] + prices * factor[:, j - 1, None, None]
            at = tried.argmin(axis=2)
            best[:, :-1, to] = np.take_along_axis(tried, at[:, :, None], axis=2)[:, :, 0]
            came[j, :, :-1, to] = states[at]
        pass_targets(j)
    out = np.full((lines, w), -1, dtype=np.int32)
    for line in range(lines):
        j, d, state = w, 0, int(best[line, 0].argmin())
        while j or d:
            kind, before = state // (policy.runs + 1), int(came[j, line, d, state])
            if kind == MATCH:
                out[line, j - 1] = d
                j -= 1
            elif kind == PAST_SOURCE:
                j, d = j - 1, d + 1
            else:
                d -= 1
            state = before
    return out


def priced_paths(volume: DataFrame, policy: Policy, weight: DataFrame | None = None) -> DataFrame:
    """img, i, j, d of paths() along each row of a volume whose cells all have as many costs; weight: img, i, j, weight."""
    rows = volume.select(*VOLUME)
    rows = rows.withColumn("weight", F.lit(1.0)) if weight is None else rows.join(weight, ["img", "i", "j"], "left").fillna(1.0, ["weight"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "j"])
        lines = pdf["i"].nunique()
        c = np.stack(pdf["costs"].to_numpy()).astype(float)
        d = paths(c.reshape(lines, -1, c.shape[1]), policy, pdf["weight"].to_numpy().reshape(lines, -1))
        return pd.DataFrame({"img": pdf["img"], "i": pdf["i"], "j": pdf["j"], "d": d.reshape(-1)})

    return rows.groupBy("img", _band().alias("band")).applyInPandas(run, "img int, i int, j int, d int")


def _band() -> Column:
    return F.floor(F.col("i") / ROWS)
