"""Alignment of two sets of rays: by a linear relaxation, by Gauss-Newton, and robustly; also of rays that one turn carries into both frames.

Every pass over the rays is one aggregation: each partition adds up the outer
products of its rows' coefficients, and one small matrix reaches the driver.
Iterations go on until the pose settles; one that does not is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocellus.functions import geometry as g
from ocellus.functions import vectors
from ocellus.operators.iteration import NotSettled
from ocellus.operators.pose import rotation, skew
from ocellus.operators.solve import normal_equations

LIMIT, TOLERANCE = 200, 1e-10


def gram(rows: DataFrame, vector: Column, n: int, weight: Column | None = None) -> np.ndarray:
    """The sum of the outer products of a column of n numbers with itself: a matrix for each partition, then their sum."""
    upper = np.triu_indices(n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, n))
        for pdf in batches:
            if len(pdf):
                a = np.stack(pdf["a"].to_numpy()).astype(float)
                total += a.T @ (a * pdf["w"].to_numpy(dtype=float)[:, None])
        yield pd.DataFrame({"k": np.arange(len(upper[0]), dtype=np.int32), "v": total[upper]})

    made = rows.select(vector.alias("a"), (F.lit(1.0) if weight is None else weight).alias("w")).mapInPandas(run, "k int, v double")
    out = np.zeros((n, n))
    for k, v in made.groupBy("k").agg(F.sum("v")).collect():
        out[upper[0][k], upper[1][k]] = out[upper[1][k], upper[0][k]] = v
    return out


def _ray(names: str) -> tuple[Column, Column]:
    """Origin and direction of a ray by the first letters of its columns."""
    return tuple(F.array(*[F.col(f"{n}{c}") for c in "xyz"]) for n in names)


def meeting_coefficients() -> Column:
    """Of a pair of rays (ox..dz in the first frame, px..ez in the second): 9 numbers for the rotation, 9 for the product of the shift's cross matrix and it.

    A line of direction d and moment m, moved by R and t, meets one of direction e and moment n where e.(R m + [t] R d) + n.(R d) = 0.
    """
    (o, d), (p, e) = _ray("od"), _ray("pe")

    def entries(x: Column) -> Column:
        m, n = g.cross(x["o"], x["d"]), g.cross(x["p"], x["e"])
        turn = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.zip_with(m, x["d"], lambda a, b: F.get(x["e"], i) * a + F.get(n, i) * b)))
        move = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.transform(x["d"], lambda b: F.get(x["e"], i) * b)))
        return F.concat(turn, move)

    return g.let(F.struct(o.alias("o"), d.alias("d"), p.alias("p"), e.alias("e")), entries)


def nearest_rotation(m: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(m)
    return u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt


def relaxed_of_gram(m: np.ndarray) -> np.ndarray:
    """The 18 numbers that leave least, from the coefficients' products: of all matrices of a rotation's size in the first place the best, with the best in the other's."""
    a, b, c = m[:9, :9], m[:9, 9:], m[9:, 9:]
    inverse = np.linalg.pinv(c, rcond=1e-12)
    found = np.linalg.eigh(a - b @ inverse @ b.T)[1][:, 0] * np.sqrt(3)
    if np.linalg.det(found.reshape(3, 3)) < 0:
        found = -found
    return np.concatenate([found, -inverse @ b.T @ found])


def pose_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R, t of the rotation nearest to the relaxation's."""
    found, moved = x[:9].reshape(3, 3), x[9:].reshape(3, 3)
    r = nearest_rotation(found)
    cross = moved / np.linalg.svd(found)[1].mean() @ r.T
    return r, np.array([cross[2, 1] - cross[1, 2], cross[0, 2] - cross[2, 0], cross[1, 0] - cross[0, 1]]) / 2


def align_relaxed(rays: DataFrame, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """R, t by the linear relaxation; 17 pairs or more in general places."""
    return pose_of(relaxed_of_gram(gram(rays, meeting_coefficients(), 18, weight)))


def _constant(x: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in np.ravel(x)])


def miss(r: np.ndarray, t: np.ndarray) -> Column:
    """By how much a pair's rays fail to meet, times the sine of the angle between them."""
    x = np.concatenate([np.ravel(r), np.ravel(skew(t) @ r)])
    return vectors.dot(meeting_coefficients(), _constant(x))


def _settle(step: Callable[[tuple], tuple], start: tuple, limit: int, tolerance: float) -> tuple:
    now = start
    for _ in range(limit):
        new = step(now)
        if max(float(np.abs(a - b).max()) for a, b in zip(now, new, strict=True)) <= tolerance:
            return new
        now = new
    raise NotSettled(f"the pose still moves by more than {tolerance} after {limit} rounds")


def align(rays: DataFrame, start: tuple[np.ndarray, np.ndarray] | None = None, bound: float | None = None, limit: int = LIMIT, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """R, t for which the pairs' squared misses are least, from the relaxation's pose or another; beyond a bound misses weigh as Huber's kernel says."""

    def step(now: tuple) -> tuple:
        r, t = now
        (o, d), (p, e) = _ray("od"), _ray("pe")
        m, shift = _constant(r), _constant(t)
        rows = rays.select(g.apply(m, o).alias("a"), g.apply(m, d).alias("b"), p.alias("p"), e.alias("e")).withColumn("gap", g.add(g.add(F.col("a"), shift), g.scale(F.col("p"), -1.0)))
        axes = [_constant(np.eye(3)[k]) for k in range(3)]
        left = g.dot(F.col("e"), g.cross(F.col("gap"), F.col("b")))
        turn = [g.dot(F.col("e"), g.add(g.cross(g.cross(x, F.col("a")), F.col("b")), g.cross(F.col("gap"), g.cross(x, F.col("b"))))) for x in axes]
        move = [g.dot(F.col("e"), g.cross(x, F.col("b"))) for x in axes]
        weight = None if bound is None else _huber(F.col("_left"), bound)
        rows = rows.select(left.alias("_left"), *[c.alias(f"_c{k}") for k, c in enumerate(turn + move)])
        a, b = normal_equations(rows, [F.col(f"_c{k}") for k in range(6)], F.col("_left"), weight)
        change = np.linalg.lstsq(a, b, rcond=1e-12)[0]
        return rotation(-change[:3]) @ r, t - change[3:]

    return _settle(step, align_relaxed(rays) if start is None else start, limit, tolerance)


def _huber(left: Column, bound: float) -> Column:
    return F.when(F.abs(left) <= bound, 1.0).otherwise(bound / F.abs(left))


def align_robust(rays: DataFrame, bound: float, limit: int = LIMIT, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """R, t by relaxations whose pairs weigh as Huber's kernel says of what the one before leaves of them, until the relaxation settles; then by Gauss-Newton with the same kernel."""
    coefficients = meeting_coefficients()

    def step(now: tuple) -> tuple:
        return (relaxed_of_gram(gram(rays, coefficients, 18, _huber(vectors.dot(coefficients, _constant(now[0])), bound))),)

    start = (relaxed_of_gram(gram(rays, coefficients, 18)),)
    return align(rays, pose_of(_settle(step, start, limit, tolerance)[0]), bound, limit, tolerance)


# --- one turn for both frames: pairs v1, v2 (directions), r12 (nine numbers, from the first frame to the second), t (the shift between them)

_PAIRS = [(a, b) for a in range(9) for b in range(a, 9)]


def axis_coefficients() -> Column:
    """45 numbers of a pair: its miss t.((r12 X v1) x (X v2)) is their product with the products of X's entries, two by two."""
    one, two, r12, t = (F.col(c) for c in ("v1", "v2", "r12", "t"))

    def entries(x: Column) -> Column:
        # Of entry (i, j) of X: column i of r12 times v1[j] on one side, axis i times v2[j] on the other.
        sides = F.array(*[F.array(*[F.get(x["r"], F.lit(3 * k + i)) for k in range(3)]) for i in range(3)])
        axes = F.array(*[_constant(np.eye(3)[i]) for i in range(3)])
        both = F.transform(sides, lambda s: F.transform(axes, lambda a: g.dot(x["t"], g.cross(s, a))))
        return g.let(F.struct(both.alias("m"), x["one"].alias("one"), x["two"].alias("two")), lambda y: F.array(*[_pair_term(y, a, b) for a, b in _PAIRS]))

    return g.let(F.struct(one.alias("one"), two.alias("two"), r12.alias("r"), t.alias("t")), entries)


def _pair_term(x: Column, a: int, b: int) -> Column:
    term = lambda p, q: F.get(F.get(x["m"], F.lit(p // 3)), F.lit(q // 3)) * F.get(x["one"], F.lit(p % 3)) * F.get(x["two"], F.lit(q % 3))
    return term(a, b) if a == b else term(a, b) + term(b, a)


def _rotation_constraints() -> tuple[np.ndarray, np.ndarray]:
    """What products of a rotation's entries (45 of them, after the 9 entries) obey: unit rows and columns at right angles, each row the cross product of the others."""
    place = {p: 9 + k for k, p in enumerate(_PAIRS)}
    at = lambda a, b: place[min(a, b), max(a, b)]
    rows, sides = [], []

    def equation(terms: list[tuple[int, float]], side: float) -> None:
        row = np.zeros(54)
        for k, v in terms:
            row[k] += v
        rows.append(row)
        sides.append(side)

    for i in range(3):
        for j in range(i, 3):
            equation([(at(3 * i + k, 3 * j + k), 1.0) for k in range(3)], float(i == j))
            equation([(at(3 * k + i, 3 * k + j), 1.0) for k in range(3)], float(i == j))
    for i in range(3):
        n, p = (i + 1) % 3, (i + 2) % 3
        for j in range(3):
            nj, pj = (j + 1) % 3, (j + 2) % 3
            equation([(3 * i + j, -1.0), (at(3 * n + nj, 3 * p + pj), 1.0), (at(3 * n + pj, 3 * p + nj), -1.0)], 0.0)
    return np.array(rows), np.array(sides)


def axis_of_gram(m: np.ndarray) -> np.ndarray:
    """The 54 numbers that leave least of what 45 of them are multiplied with, along the equations of a rotation exactly."""
    c, side = _rotation_constraints()
    base = np.linalg.lstsq(c, side, rcond=None)[0]
    free = np.linalg.svd(c)[2][np.linalg.matrix_rank(c) :].T
    products = free[9:]
    return base + free @ np.linalg.lstsq(products.T @ m @ products, -products.T @ m @ base[9:], rcond=1e-12)[0]


def axis_relaxed(pairs: DataFrame, weight: Column | None = None) -> np.ndarray:
    """X by the relaxation: its entries and their products are unknowns of their own, bound by a rotation's equations; then the nearest rotation."""
    return nearest_rotation(axis_of_gram(gram(pairs, axis_coefficients(), 45, weight))[:9].reshape(3, 3))


def axis_miss(x: np.ndarray) -> Column:
    r = np.ravel(x)
    return vectors.dot(axis_coefficients(), _constant(np.array([r[a] * r[b] for a, b in _PAIRS])))


def align_axis(pairs: DataFrame, start: np.ndarray | None = None, bound: float | None = None, limit: int = LIMIT, tolerance: float = TOLERANCE) -> np.ndarray:
    """X for which the pairs' squared misses are least, from the relaxation's or another; with a bound as Huber's kernel says."""

    def step(now: tuple) -> tuple:
        x = now[0]
        m = _constant(x)
        rows = pairs.select(g.apply(m, F.col("v1")).alias("a"), g.apply(m, F.col("v2")).alias("b"), "r12", "t").withColumn("ra", g.apply(F.col("r12"), F.col("a")))
        left = g.dot(F.col("t"), g.cross(F.col("ra"), F.col("b")))
        columns = []
        for k in range(3):
            axis = _constant(np.eye(3)[k])
            columns.append(g.dot(F.col("t"), g.add(g.cross(g.apply(F.col("r12"), g.cross(axis, F.col("a"))), F.col("b")), g.cross(F.col("ra"), g.cross(axis, F.col("b"))))))
        weight = None if bound is None else _huber(F.col("_left"), bound)
        rows = rows.select(left.alias("_left"), *[c.alias(f"_c{k}") for k, c in enumerate(columns)])
        a, b = normal_equations(rows, [F.col(f"_c{k}") for k in range(3)], F.col("_left"), weight)
        return (rotation(-np.linalg.lstsq(a, b, rcond=1e-12)[0]) @ x,)

    return _settle(step, (axis_relaxed(pairs) if start is None else start,), limit, tolerance)[0]


def axis_robust(pairs: DataFrame, bound: float, limit: int = LIMIT, tolerance: float = 1e-6) -> np.ndarray:
    """X by relaxations weighted as Huber's kernel says of what the one before leaves, until they settle; then by Gauss-Newton with the same kernel."""
    coefficients = axis_coefficients()

    def step(now: tuple) -> tuple:
        return (axis_of_gram(gram(pairs, coefficients, 45, _huber(vectors.dot(coefficients, _constant(now[0][9:])), bound))),)

    start = (axis_of_gram(gram(pairs, coefficients, 45)),)
    return align_axis(pairs, nearest_rotation(_settle(step, start, limit, tolerance)[0][:9].reshape(3, 3)), bound, limit, tolerance)
