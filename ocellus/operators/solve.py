"""Least squares, robust fits and assignments.

What grows with the data is aggregated on the cluster (sums, normal
equations); what is solved on the driver has the size of the unknowns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.operators.iteration import NotSettled, Step
from ocellus.operators.robust import DIGIT

#: Steps of an iteration that has no number of its own.
LIMIT = 1000


def line_fit(rows: DataFrame) -> DataFrame:
    """g, slope, intercept of y over x."""
    return rows.groupBy("g").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))


def normal_equations(rows: DataFrame, a: list[Column], b: Column, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A'A and A'b, by one aggregation."""
    n, w = len(a), F.lit(1.0) if weight is None else weight
    sums = [F.sum(w * a[i] * a[j]).alias(f"m{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(w * a[i] * b).alias(f"v{i}") for i in range(n)]
    got = rows.agg(*sums).first()
    m = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            m[i, j] = m[j, i] = got[f"m{i}_{j}"] or 0.0
    return m, np.array([got[f"v{i}"] or 0.0 for i in range(n)])


def least_squares(rows: DataFrame, a: list[Column], b: Column) -> np.ndarray:
    return np.linalg.lstsq(*normal_equations(rows, a, b), rcond=None)[0]


def affine_least_squares(rows: DataFrame, a: list[Column], b: Column) -> np.ndarray:
    """Weights that sum to 1: the last is what the others leave."""
    free = least_squares(rows, [c - a[-1] for c in a[:-1]], b - a[-1])
    return np.append(free, 1 - free.sum())


def gauss_newton(rows: DataFrame, residual: Callable[[list[float]], Column], jacobian: Callable[[list[float]], list[Column]], start: list[float], weight: Callable[[Column], Column] | None = None, steps: int | None = None, tol: float = 1e-9) -> list[float]:
    """Minimises the sum of squared residuals (or a kernel's, by its weights); one aggregation a step. With steps, as many at most; without, until they are small, and an error if LIMIT of them are not."""
    x = np.array(start, dtype=float)
    for _ in range(steps or LIMIT):
        r = residual(x.tolist())
        m, v = normal_equations(rows, jacobian(x.tolist()), r, None if weight is None else weight(r))
        d = np.linalg.lstsq(m, v, rcond=None)[0]
        x = x - d
        if np.linalg.norm(d) < tol:
            return x.tolist()
    if steps is not None:
        return x.tolist()
    raise NotSettled(f"Gauss-Newton still moves after {LIMIT} steps")


def l_bfgs(rows: DataFrame, value: Callable[[list[float]], Column], gradient: Callable[[list[float]], list[Column]], start: list[float], steps: int = 400, memory: int = 6, tol: float = 1e-8) -> list[float]:
    """Minimises a summed function by its summed gradient, with backtracking. An error if neither the gradient nor the gain becomes small."""

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        got = rows.agg(F.sum(value(x.tolist())), *[F.sum(c) for c in gradient(x.tolist())]).first()
        return float(got[0]), np.array([float(v) for v in got[1:]])

    x = np.array(start, dtype=float)
    f, g = at(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.linalg.norm(g) < tol:
            return x.tolist()
        q, alphas = g.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (y @ s)
            alphas.append(a)
            q -= a * y
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - (y @ q) / (y @ s))
        step, t = -q, 1.0 if past else min(1.0, 1 / np.linalg.norm(g))
        while t > 1e-12:
            f_new, g_new = at(x + t * step)
            if f_new <= f + 1e-4 * t * (g @ step):
                break
            t /= 2
        s, y = t * step, g_new - g
        if s @ y > 1e-14:
            past = [*past, (s, y)][-memory:]
        if abs(f - f_new) < tol * max(1.0, abs(f)):
            return (x + s).tolist()
        x, f, g = x + s, f_new, g_new
    raise NotSettled(f"L-BFGS still gains after {steps} steps")


def pca(rows: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Variances in descending order and their axes, each with its largest entry positive."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    got = rows.agg(*[F.covar_samp(a, b) for a, b in pairs]).first()
    m = np.zeros((len(columns), len(columns)))
    for (a, b), v in zip(pairs, got, strict=True):
        i, j = columns.index(a), columns.index(b)
        m[i, j] = m[j, i] = v or 0.0
    value, vector = np.linalg.eigh(m)
    value, vector = value[::-1], vector[:, ::-1].T
    return value, vector * np.sign(vector[np.arange(len(value)), np.abs(vector).argmax(axis=1)])[:, None]


def ransac_lines(rows: DataFrame, trials: int, threshold: float, seed: int = 7) -> DataFrame:
    """g, slope, intercept, inliers: the best of lines through two rows, for each group.

    The pairs come of the rows' own hashes, or of draws by row number where there is a column `k`: for each trial, a group's rows of lowest and highest hash, or, with
    priorities (a column `priority`, above 0), the row of least exponential draw with that rate in either half of the group
    (by another hash), so that a row is drawn as often as its priority says. A row is joined to its group's lines once, and counts for all of them in one
    aggregation.
    """
    lines = Step(_drawn_lines(rows, trials, seed))
    held = rows.select("g", "x", "y").join(lines.read(), "g")
    inlier = [F.abs(F.col("y") - F.get("lines", F.lit(k))["slope"] * F.col("x") - F.get("lines", F.lit(k))["intercept"]) < threshold for k in range(trials)]
    # Sums of plain numbers by group: an array among them would have every row sorted.
    score = held.groupBy("g").agg(*[F.count_if(c).alias(f"_n{k}") for k, c in enumerate(inlier)])
    score = score.select("g", F.array(*[f"_n{k}" for k in range(trials)]).alias("n")).join(lines.read(), "g")
    listed = F.zip_with("lines", "n", lambda x, n: F.struct(n.alias("inliers"), (-x["trial"]).alias("t"), x["slope"].alias("slope"), x["intercept"].alias("intercept")))
    best = F.array_max(F.filter(listed, lambda x: x["inliers"].isNotNull() & x["slope"].isNotNull()))
    return score.select("g", best.alias("b")).select("g", "b.slope", "b.intercept", "b.inliers")


def _draw(key: Column, trial: Column, seed: int) -> Column:
    """A number below 2^32 for each row number and trial, by whole-number arithmetic that any engine repeats."""
    once = (F.pmod(key.cast("bigint"), F.lit(2147483647)) + trial * 7919 + seed * 104729) * F.lit(2654435761) % F.lit(4294967296)
    return once.bitwiseXOR(F.shiftright(once, 16)) * F.lit(40503) % F.lit(4294967296)


def _drawn_lines(rows: DataFrame, trials: int, seed: int) -> DataFrame:
    """g, lines: an array of trial, slope, intercept through two rows each; groups without any are left out.

    Numbered rows of a group of no more than HELD are drawn by one task. Otherwise the least and greatest numbers of all
    trials are found by one aggregation of plain numbers, and rows are read again for those that have them. No row is
    repeated for the trials, sorted or sent for each.
    """
    if "k" in rows.columns and "priority" not in rows.columns:
        held = rows.select("g", *[F.col(c).cast("double").alias(c) for c in "xy"], F.col("k").cast("bigint").alias("k"))
        large = Step(_large(held))
        kind = dict(held.dtypes)["g"]
        if large.read().isEmpty():
            return held.groupBy("g").applyInPandas(_drawn(trials, seed), f"g {kind}, {_LINES}")
        small = held.join(large.read(), "g", "left_anti").groupBy("g").applyInPandas(_drawn(trials, seed), f"g {kind}, {_LINES}")
        return small.unionByName(_lines_by_numbers(held.join(large.read(), "g", "left_semi"), trials, seed))
    return _lines_by_numbers(rows, trials, seed)


_LINES = "lines array<struct<trial: int, slope: double, intercept: double>>"


def _large(rows: DataFrame) -> DataFrame:
    """The groups of more rows than HELD."""
    return rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > HELD).select("g")


def _drawn(trials: int, seed: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"], na_position="first")
        x, y, lines = pdf["x"].to_numpy(dtype=float), pdf["y"].to_numpy(dtype=float), []
        k = pdf["k"].to_numpy(dtype=float, na_value=-1) if pdf["k"].isna().any() else pdf["k"].to_numpy(dtype=np.int64)
        none, k = pdf["k"].isna().to_numpy(), k.astype(np.int64)
        for t in range(trials):
            once = (k % 2147483647 + t * 7919 + seed * 104729) * 2654435761 % 4294967296
            h = np.where(none, -1, (once ^ (once >> 16)) * 40503 % 4294967296)
            # Of equal numbers the first and the last in order of x and y.
            p, q = int(h.argmin()), len(h) - 1 - int(h[::-1].argmax())
            if x[p] != x[q] and np.isfinite([x[p], x[q], y[p], y[q]]).all():
                slope = (y[q] - y[p]) / (x[q] - x[p])
                lines.append({"trial": t, "slope": slope, "intercept": y[p] - slope * x[p]})
        return pd.DataFrame({"g": [key[0]], "lines": [lines]}) if lines else pd.DataFrame({"g": pd.Series(dtype="int64"), "lines": pd.Series(dtype=object)})

    return run


def _lines_by_numbers(rows: DataFrame, trials: int, seed: int) -> DataFrame:
    numbered, prioritised = "k" in rows.columns, "priority" in rows.columns
    firsts, seconds, numbers = [], [], []
    for t in range(trials):
        trial = F.lit(t)
        h = F.coalesce(_draw(F.col("k"), trial, seed), F.lit(-1).cast("bigint")) if numbered else F.xxhash64("x", "y", trial, F.lit(seed))
        p = q = h
        if prioritised:
            # 53 bits of the hash as a uniform number make an exponential draw.
            uniform = (h + 1) / F.lit(float(1 << 32)) if numbered else (F.shiftrightunsigned(h, 11) + 1) / F.lit(float(1 << 53))
            h = -F.ln(uniform) / F.col("priority")
            half = F.pmod(F.xxhash64(trial, "y", "x", F.lit(seed)), F.lit(2))
            p, q = F.when(half == 0, h), F.when(half == 1, h)
        numbers.append((p, q))
        firsts.append(F.min(p).alias(f"_p{t}"))
        seconds.append((F.min(q) if prioritised else F.max(q)).alias(f"_q{t}"))
    ends = rows.groupBy("g").agg(*firsts, *seconds)
    held = rows.join(ends.select("g", F.array(*[F.struct(F.col(f"_p{t}").alias("p"), F.col(f"_q{t}").alias("q")) for t in range(trials)]).alias("_ends")), "g")
    held = held.select("g", "x", "y", "_ends", F.array(*[F.struct(p.alias("p"), q.alias("q")) for p, q in numbers]).alias("_h"))
    same = lambda h, e, c: F.coalesce(h[c] == e[c], F.lit(False))
    # The numbers are made once for a row's test: as many tests of a column each would be too long a method to be compiled.
    held = held.where(F.exists(F.zip_with("_h", "_ends", lambda h, e: same(h, e, "p") | same(h, e, "q")), lambda x: x))
    drawn = F.posexplode(F.zip_with("_h", "_ends", lambda h, e: F.struct(same(h, e, "p").alias("a"), same(h, e, "q").alias("b"))))
    chosen = held.select("g", "x", "y", drawn.alias("trial", "_d")).where("_d.a OR _d.b").select("g", "x", "y", "trial", "_d.a", "_d.b").distinct()
    own = F.struct("x", "y")
    two = chosen.groupBy("g", "trial").agg(F.min(F.when(F.col("a"), own)).alias("p"), (F.min if prioritised else F.max)(F.when(F.col("b"), own)).alias("q"))
    slope = F.try_divide(F.col("q.y") - F.col("p.y"), F.col("q.x") - F.col("p.x"))
    lines = two.select("g", "trial", slope.alias("slope"), (F.col("p.y") - slope * F.col("p.x")).alias("intercept")).where("slope IS NOT NULL")
    return lines.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("trial", "slope", "intercept"))).alias("lines"))


#: Fixed value: rows of a group that one task holds; medians of larger groups come of counts.
HELD = 1 << 20


def lmeds_lines(rows: DataFrame, trials: int, seed: int = 7) -> DataFrame:
    """g, slope, intercept, median: the line through two rows of least median squared residual (the lower median of an even number)."""
    lines = Step(_drawn_lines(rows, trials, seed))
    rows = rows.select("g", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("g IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    large = Step(_large(rows))
    kind = dict(rows.dtypes)["g"]
    if large.read().isEmpty():
        return _medians_by_group(rows, lines.read(), kind)
    some = large.read()
    small = _medians_by_group(rows.join(some, "g", "left_anti"), lines.read().join(some, "g", "left_anti"), kind)
    return small.unionByName(_medians_by_counts(rows.join(some, "g", "left_semi"), lines.read().join(some, "g").join(rows.groupBy("g").agg(F.count("*").alias("n")), "g")))


def _medians_by_group(rows: DataFrame, lines: DataFrame, kind: str) -> DataFrame:
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"g": pd.Series(dtype="int64"), "slope": [], "intercept": [], "median": []})
        x, y, best = left["x"].to_numpy(), left["y"].to_numpy(), None
        for line in right["lines"].iloc[0]:
            e = y - line["slope"] * x - line["intercept"]
            median = np.partition(e * e, (len(e) - 1) // 2)[(len(e) - 1) // 2]
            if best is None or median < best[2]:
                best = line["slope"], line["intercept"], median
        return pd.DataFrame([(key[0], *best)], columns=["g", "slope", "intercept", "median"])

    return rows.groupBy("g").cogroup(lines.groupBy("g")).applyInPandas(run, f"g {kind}, slope double, intercept double, median double")


def _medians_by_counts(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """As _medians_by_group, of the few groups above HELD (with n): errors are counted digit by digit, so no task holds a group."""
    fits = {r["g"]: (r["n"], [(line["slope"], line["intercept"]) for line in r["lines"]]) for r in lines.collect()}
    state = {(g, t): (0, (n - 1) // 2) for g, (n, own) in fits.items() for t in range(len(own))}
    kind = dict(rows.dtypes)["g"]
    for shift in range(5 * DIGIT, -1, -DIGIT):
        prefix = {k: np.uint64(p) for k, (p, _) in state.items()}

        def run(batches, prefix=prefix, shift=shift):
            total: dict[tuple, np.ndarray] = {}
            for pdf in batches:
                for g, own in pdf.groupby("g"):
                    x, y = own["x"].to_numpy(), own["y"].to_numpy()
                    for t, (slope, intercept) in enumerate(fits[g][1] if g in fits else ()):
                        e = y - slope * x - intercept
                        # The bits of numbers that are not negative stand in their order.
                        bits = (e * e + 0.0).view(np.uint64)
                        digit = (bits[(bits >> np.uint64(min(shift + DIGIT, 63))) == prefix[g, t]] >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)
                        n = np.bincount(digit.astype(np.int64), minlength=1 << DIGIT)
                        total[g, t] = total[g, t] + n if (g, t) in total else n
            out = [(g, t, int(d), int(n[d])) for (g, t), n in total.items() for d in np.flatnonzero(n)]
            yield pd.DataFrame(out, columns=["g", "t", "digit", "n"])

        counts = rows.mapInPandas(run, f"g {kind}, t int, digit int, n long").groupBy("g", "t", "digit").agg(F.sum("n").alias("n"))
        upto = counts.withColumn("_u", F.sum("n").over(Window.partitionBy("g", "t").orderBy("digit")))
        asked = rows.sparkSession.createDataFrame([(g, t, int(r)) for (g, t), (_, r) in state.items()], f"g {kind}, t int, rank long")
        hit = upto.join(asked, ["g", "t"]).where((F.col("_u") > F.col("rank")) & (F.col("_u") - F.col("n") <= F.col("rank")))
        for r in hit.select("g", "t", "digit", (F.col("rank") - F.col("_u") + F.col("n")).alias("rank")).collect():
            state[r["g"], r["t"]] = (state[r["g"], r["t"]][0] << DIGIT) | r["digit"], r["rank"]
    found = []
    for g, (_, own) in fits.items():
        medians = [float(np.array([state[g, t][0]], dtype=np.uint64).view(np.float64)[0]) for t in range(len(own))]
        t = min(range(len(own)), key=lambda k: (medians[k], k))
        found.append((g, *map(float, own[t]), medians[t]))
    return rows.sparkSession.createDataFrame(found, f"g {kind}, slope double, intercept double, median double")


def l1_fit(a: np.ndarray, b: np.ndarray, steps: int = LIMIT) -> np.ndarray:
    """Least absolute residuals: from least squares, moves along one unknown at a time, or one active row's null space, to weighted medians. An error if the last of the steps still moves."""
    x = np.linalg.lstsq(a, b, rcond=None)[0]
    best = np.abs(a @ x - b).sum()
    for _ in range(steps):
        r = b - a @ x
        active = np.argsort(np.abs(r))[: a.shape[1] - 1]
        directions = list(np.eye(a.shape[1]))
        if len(active):
            _, _, vt = np.linalg.svd(a[active])
            directions.append(vt[-1])
        moved = False
        for d in directions:
            slope = a @ d
            ok = np.abs(slope) > 1e-12
            if not ok.any():
                continue
            breaks, weight = (b - a @ x)[ok] / slope[ok], np.abs(slope[ok])
            order = np.argsort(breaks)
            t = breaks[order][np.searchsorted(2 * np.cumsum(weight[order]), weight.sum(), side="right").clip(0, len(order) - 1)]
            value = np.abs(a @ (x + t * d) - b).sum()
            if value < best - 1e-12:
                x, best, moved = x + t * d, value, True
        if not moved:
            return x
    raise NotSettled(f"least absolute residuals still fall after {steps} rounds")


def l1_lines(rows: DataFrame) -> DataFrame:
    """g, slope, intercept of least absolute residuals. A group is fitted by one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = l1_fit(np.stack([pdf["x"], np.ones(len(pdf))], axis=1), pdf["y"].to_numpy())
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "slope": [x[0]], "intercept": [x[1]]})

    return rows.groupBy("g").applyInPandas(run, "g long, slope double, intercept double")


def affine_of(fit: Callable[[np.ndarray, np.ndarray], np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weights that sum to 1 by a fit of free ones: the last is what the others leave."""
    free = fit(a[:, :-1] - a[:, -1:], b - a[:, -1])
    return np.append(free, 1 - free.sum())


def affine_l1(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weights that sum to 1 with least absolute residuals."""
    return affine_of(l1_fit, a, b)


def median_fit(a: np.ndarray, b: np.ndarray, trials: int = 500, seed: int = 7) -> np.ndarray:
    """Unknowns of least median squared residual among those that solve as many rows as there are unknowns, drawn by a seed."""
    rng, n = np.random.default_rng(seed), a.shape[1]
    best = np.inf, np.linalg.lstsq(a, b, rcond=None)[0]
    for _ in range(trials):
        rows = rng.choice(len(a), n, replace=False)
        if abs(np.linalg.det(a[rows])) < 1e-12:
            continue
        x = np.linalg.solve(a[rows], b[rows])
        median = float(np.sort((a @ x - b) ** 2)[len(b) // 2])
        if median < best[0]:
            best = median, x
    return best[1]


def affine_median(a: np.ndarray, b: np.ndarray, trials: int = 500, seed: int = 7) -> np.ndarray:
    """Weights that sum to 1 of least median squared residual."""
    return affine_of(lambda p, q: median_fit(p, q, trials, seed), a, b)


def spherical_affine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weights that sum to 1 whose mix of columns points in a direction nearest to b's: the affine span's point along b's projection on the columns' span."""
    m, base = a[:, :-1] - a[:, -1:], a[:, -1]
    along = a @ np.linalg.lstsq(a, b, rcond=None)[0]
    normal = base - m @ np.linalg.lstsq(m, base, rcond=None)[0]
    reach = float(normal @ along)
    scale = float(normal @ normal) / reach if abs(reach) > 1e-15 else 1.0
    free = np.linalg.lstsq(m, scale * along - base, rcond=None)[0]
    return np.append(free, 1 - free.sum())


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, in the order of columns; by potentials, one row at a time."""
    if cost.shape[0] > cost.shape[1]:
        return sorted(((j, i) for i, j in hungarian(cost.T)), key=lambda p: p[1])
    n, m = cost.shape
    row_of = np.full(m + 1, -1)
    u, v = np.zeros(n), np.zeros(m + 1)
    for i in range(n):
        row_of[m], col = i, m
        least, came, used = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, dtype=bool)
        while row_of[col] >= 0:
            used[col] = True
            r = row_of[col]
            free = ~used[:m]
            reduced = cost[r] - u[r] - v[:m]
            closer = free & (reduced < least)
            least[closer], came[closer] = reduced[closer], col
            nxt = int(np.where(free, least, np.inf).argmin())
            step = least[nxt]
            at = np.flatnonzero(used)
            u[row_of[at]] += step
            v[at] -= step
            least[free] -= step
            col = nxt
        while col != m:
            row_of[col], col = row_of[came[col]], came[col]
        row_of[m] = -1
    return [(int(row_of[j]), j) for j in range(m) if row_of[j] >= 0]


def assignment(costs: DataFrame) -> DataFrame:
    """g, a, b, cost of the cheapest assignment of each group (g, a, b, cost); missing pairs are not to be had unless nothing else is left."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index="a", columns="b", values="cost", aggfunc="min")
        m = table.to_numpy()
        big = np.nanmax(np.abs(m)) * m.size + 1
        pairs = hungarian(np.where(np.isnan(m), big, m))
        rows = [(pdf["g"].iloc[0], table.index[i], table.columns[j], m[i, j]) for i, j in pairs if not np.isnan(m[i, j])]
        return pd.DataFrame(rows, columns=["g", "a", "b", "cost"])

    return costs.groupBy("g").applyInPandas(run, "g long, a long, b long, cost double")


def with_non_matches(costs: DataFrame, price: float) -> DataFrame:
    """costs and, for each a, a partner -1 - a of its own at a price, so that it may stay unmatched."""
    own = costs.select("g", "a").distinct().select("g", "a", (-1 - F.col("a")).alias("b"), F.lit(float(price)).alias("cost"))
    return costs.select("g", "a", "b", "cost").unionByName(own)
