"""Shares of one or two steps that bring a vector nearest to another, in the sense of squares, of absolute values, or of their median.

gap is what is left to go, a step what a share of 1 adds; all are array columns
of one length. Shares of the median sense are tried, not solved for: those that
leave nothing of single entries, or of given parts of the entries by squares.
Equal costs (to nine decimals) go to the first one tried.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ocellus.functions.vectors import dot, medad, total

#: A share of one step; the shares of two, as a struct of p and q.
Share = Callable[[Column, Column], Column]
Shares = Callable[[Column, Column, Column], Column]


def by_squares(gap: Column, step: Column) -> Column:
    return F.try_divide(dot(gap, step), dot(step, step))


def by_absolutes(gap: Column, step: Column) -> Column:
    """The weighted median of the entries' own shares, which is where the sum of absolute values is least."""
    own = F.zip_with(gap, step, lambda g, u: F.struct((g / F.when(u != 0, u)).alias("r"), F.abs(u).alias("w")))
    own = F.array_sort(F.filter(own, lambda x: x["r"].isNotNull()))
    half = total(F.transform(own, lambda x: x["w"])) / 2
    none = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("r"))

    def passed(acc: Column, x: Column) -> Column:
        now = acc["sum"] + x["w"]
        return F.struct(now.alias("sum"), F.when(acc["r"].isNotNull(), acc["r"]).when(now >= half, x["r"]).alias("r"))

    return F.aggregate(own, none, passed, lambda acc: acc["r"])


def _left(gap: Column, step: Column, share: Column) -> Column:
    return F.zip_with(gap, step, lambda g, u: g - share * u)


def by_median(gap: Column, step: Column, parts: Sequence[Sequence[int]] | None = None) -> Column:
    """parts: lists of entries that are solved together; without, every entry by itself."""
    if parts is None:
        tried = F.zip_with(gap, step, lambda g, u: g / F.when(u != 0, u))
    else:
        at = lambda x, part: F.array(*[F.get(x, F.lit(k)) for k in part])
        tried = F.array(*[by_squares(at(gap, p), at(step, p)) for p in parts])
    zero = F.transform(gap, lambda g: F.lit(0.0))
    priced = F.transform(tried, lambda r, k: F.when(r.isNotNull(), F.struct(F.round(medad(_left(gap, step, r), zero), 9).alias("cost"), k.alias("k"), r.alias("r"))))
    return F.array_min(F.array_compact(priced))["r"]


def two_by_squares(gap: Column, one: Column, two: Column) -> Column:
    det = dot(one, one) * dot(two, two) - dot(one, two) * dot(one, two)
    p = F.try_divide(dot(gap, one) * dot(two, two) - dot(gap, two) * dot(one, two), det)
    q = F.try_divide(dot(gap, two) * dot(one, one) - dot(gap, one) * dot(one, two), det)
    return F.when(p.isNotNull(), F.struct(p.alias("p"), q.alias("q")))


def _with(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is computed once however often f refers to it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _sad_of(rest: list[np.ndarray]) -> np.ndarray:
    out = 0.0
    for e in rest:
        out = out + np.abs(e)
    return out


def _medad_of(rest: list[np.ndarray]) -> np.ndarray:
    return np.partition(np.abs(rest), len(rest) // 2, axis=0)[len(rest) // 2]


def two_solved(gap: np.ndarray, one: np.ndarray, two: np.ndarray, cost: Callable[[list[np.ndarray]], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """p and q, one for each row of gap, one and two: of shares that leave nothing of two entries, those that cost least; nan where there are none."""
    g, u, w = gap.T, one.T, two.T
    p, q, least = np.full(len(gap), np.nan), np.full(len(gap), np.nan), np.full(len(gap), np.inf)
    with np.errstate(all="ignore"):
        for a in range(len(g)):
            for b in range(a + 1, len(g)):
                det = u[a] * w[b] - w[a] * u[b]
                det[det == 0] = np.nan
                s, t = (g[a] * w[b] - w[a] * g[b]) / det, (u[a] * g[b] - g[a] * u[b]) / det
                c = np.round(cost([g[k] - s * u[k] - t * w[k] for k in range(len(g))]), 9)
                better = (c < least) | np.isnan(p) & ~np.isnan(det)
                p[better], q[better], least[better] = s[better], t[better], c[better]
    return p, q


def _two_of_entries(cost: Callable[[list[np.ndarray]], np.ndarray]) -> Shares:
    """Shares of two steps by two_solved, over batches of rows: as nested column functions, 36 pairs of nine entries are interpreted one number at a time."""

    @F.pandas_udf("p double, q double")
    def solved(gap: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
        known = gap.notna() & one.notna() & two.notna()
        out = np.full((len(gap), 2), np.nan)
        if known.any():
            out[known] = np.column_stack(two_solved(*[np.stack(x[known].to_list()).astype(float) for x in (gap, one, two)], cost))
        return pd.DataFrame(out, columns=["p", "q"])

    def shares(gap: Column, one: Column, two: Column) -> Column:
        s = solved(gap, one, two)
        return F.when(s["p"].isNotNull() & ~F.isnan(s["p"]), F.struct(s["p"].alias("p"), s["q"].alias("q")))

    return shares


def _two_by_parts(gap: Column, one: Column, two: Column, n: int, cost: Callable[[Column, Column], Column], parts: Sequence[Sequence[int]]) -> Column:
    """Of shares that leave least of a part's squares, those that cost least."""
    zero = F.array(*[F.lit(0.0)] * n)

    def priced(entries: Column, x: Column, k: Column) -> Column:
        rest = F.transform(entries, lambda e: e["g"] - x["p"] * e["u"] - x["q"] * e["w"])
        return F.when(x["p"].isNotNull(), F.struct(F.round(cost(rest, zero), 9).alias("cost"), k.alias("k"), x["p"].alias("p"), x["q"].alias("q")))

    def best(entries: Column) -> Column:
        at = lambda x, part: F.array(*[F.get(x, F.lit(k)) for k in part])
        tried = F.array(*[two_by_squares(at(gap, p), at(one, p), at(two, p)) for p in parts])
        return F.array_min(F.array_compact(F.transform(tried, lambda x, k: priced(entries, x, k))))

    entries = F.zip_with(F.zip_with(gap, one, lambda g, u: F.struct(g.alias("g"), u.alias("u"))), two, lambda x, w: F.struct(x["g"].alias("g"), x["u"].alias("u"), w.alias("w")))
    return _with(_with(entries, best), lambda x: F.when(x.isNotNull(), F.struct(x["p"].alias("p"), x["q"].alias("q"))))


def two_by_absolutes(n: int) -> Shares:
    """For vectors of n entries: a sum of absolute values of two unknowns is least where two entries are left nothing."""
    return _two_of_entries(_sad_of)


def two_by_median(n: int, parts: Sequence[Sequence[int]] | None = None) -> Shares:
    return _two_of_entries(_medad_of) if parts is None else lambda gap, one, two: _two_by_parts(gap, one, two, n, medad, parts)
