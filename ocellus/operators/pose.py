"""Two-view and pose estimation, alignment of rays and points: what is aggregated is on the cluster, what is solved has the unknowns' size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.operators.iteration import NotSettled
from ocellus.operators.solve import normal_equations


def skew(v: np.ndarray) -> np.ndarray:
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])


def rotation(r: np.ndarray) -> np.ndarray:
    a = float(np.linalg.norm(r))
    if a < 1e-12:
        return np.eye(3) + skew(r)
    k = skew(r / a)
    return np.eye(3) + np.sin(a) * k + (1 - np.cos(a)) * k @ k


def null_vector(rows: DataFrame, columns: list) -> np.ndarray:
    """The unit vector that makes the rows' products with it least, by one aggregation of their outer products."""
    m, _ = normal_equations(rows, columns, F.lit(0.0))
    return np.linalg.eigh(m)[1][:, 0]


def essential(ties: DataFrame) -> np.ndarray:
    """E of at least eight pairs of normalised points (x1, y1, x2, y2): (x2, y2, 1) E (x1, y1, 1) = 0, singular values 1, 1, 0."""
    x1, y1, x2, y2, one = F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(1.0)
    e = null_vector(ties, [a * b for a in (x2, y2, one) for b in (x1, y1, one)]).reshape(3, 3)
    u, _, vt = np.linalg.svd(e)
    return u @ np.diag([1.0, 1.0, 0.0]) @ vt


def homography(ties: DataFrame) -> np.ndarray:
    """H of at least four pairs: (x2, y2, 1) is along H (x1, y1, 1); the last entry 1."""
    x1, y1, x2, y2, o, i = F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(0.0), F.lit(1.0)
    a = [x1, y1, i, o, o, o, -x2 * x1, -x2 * y1, -x2]
    b = [o, o, o, x1, y1, i, -y2 * x1, -y2 * y1, -y2]
    m = normal_equations(ties, a, o)[0] + normal_equations(ties, b, o)[0]
    h = np.linalg.eigh(m)[1][:, 0].reshape(3, 3)
    return h / h[2, 2]


def poses_of(e: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The four poses that an essential matrix allows; translations of length 1."""
    u, _, vt = np.linalg.svd(e)
    u, vt = u * np.sign(np.linalg.det(u)), vt * np.sign(np.linalg.det(vt))
    w = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    return [(u @ x @ vt, s * u[:, 2]) for x in (w, w.T) for s in (1, -1)]


def select_pose(ties: DataFrame, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pose that puts most points before both cameras, counted by one aggregation for all four."""
    from ocellus.functions import geometry as g

    def front(r: np.ndarray, t: np.ndarray):
        m = F.array(*[F.lit(float(v)) for v in r.ravel()])
        v = F.array(*[F.lit(float(x)) for x in t])
        p = g.triangulate(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), m, v)
        return g.let(p, lambda q: (g.at(q, 2) > 0) & (g.at(g.add(g.apply(m, q), v), 2) > 0))

    options = poses_of(e)
    got = ties.agg(*[F.count_if(front(r, t)) for r, t in options]).first()
    return options[int(np.argmax(list(got)))]


def similarity(ties: DataFrame, scaled: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """s, R, t with (x2, y2, z2) near s R (x, y, z) + t, in closed form from means and covariances; one aggregation."""
    a, b = ["x", "y", "z"], ["x2", "y2", "z2"]
    got = ties.agg(*[F.avg(c) for c in a + b], *[F.covar_pop(p, q) for p in a for q in b], sum((F.var_pop(c) for c in a), F.lit(0.0))).first()
    ma, mb, cov, spread = np.array(got[:3]), np.array(got[3:6]), np.array(got[6:15]).reshape(3, 3), got[15]
    u, d, vt = np.linalg.svd(cov.T)
    flip = np.diag([1, 1, np.sign(np.linalg.det(u @ vt))])
    r = u @ flip @ vt
    s = float((d * np.diag(flip)).sum() / spread) if scaled else 1.0
    return s, r, mb - s * r @ ma


def affine_map(ties: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A, t with (x2, y2, z2) nearest to A (x, y, z) + t: one aggregation of outer products for all three rows."""
    columns = [F.col(c) for c in "xyz"] + [F.lit(1.0)]
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    got = ties.agg(*[F.sum(columns[i] * columns[j]) for i, j in pairs], *[F.sum(c * F.col(f"{b}2")) for b in "xyz" for c in columns]).first()
    m = np.zeros((4, 4))
    for (i, j), v in zip(pairs, got, strict=False):
        m[i, j] = m[j, i] = v or 0.0
    right = np.array([v or 0.0 for v in got[len(pairs) :]]).reshape(3, 4).T
    x = np.linalg.lstsq(m, right, rcond=None)[0]
    return x[:3].T, x[3]


def nearest_similarity(a: np.ndarray, scaled: bool = True) -> tuple[float, np.ndarray]:
    """The scale and rotation nearest to a matrix: what is left of an affine map when it may not shear."""
    u, d, vt = np.linalg.svd(a)
    flip = np.diag([1, 1, np.sign(np.linalg.det(u @ vt))])
    return float((d * np.diag(flip)).mean()) if scaled else 1.0, u @ flip @ vt


def quasi_similarity(ties: DataFrame, scaled: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """s, R, t from the affine map's nearest similarity (or, without scale, rigid map); t lays the means on each other."""
    a, _ = affine_map(ties)
    s, r = nearest_similarity(a, scaled)
    got = np.array(ties.agg(*[F.avg(c) for c in ("x", "y", "z", "x2", "y2", "z2")]).first())
    return s, r, got[3:] - s * r @ got[:3]


def translation(ties: DataFrame) -> np.ndarray:
    """t alone: the mean difference."""
    return np.array(ties.agg(*[F.avg(F.col(f"{c}2") - F.col(c)) for c in "xyz"]).first())


def scale_and_translation(ties: DataFrame) -> tuple[float, np.ndarray]:
    """s, t with (x2, y2, z2) nearest to s (x, y, z) + t."""
    got = ties.agg(*[F.avg(c) for c in ("x", "y", "z", "x2", "y2", "z2")], sum((F.covar_pop(c, f"{c}2") for c in "xyz"), F.lit(0.0)), sum((F.var_pop(c) for c in "xyz"), F.lit(0.0))).first()
    s = float(got[6] / got[7]) if got[7] else 1.0
    return s, np.array(got[3:6]) - s * np.array(got[:3])


def reproject(pixels: DataFrame, r: np.ndarray, t: np.ndarray) -> DataFrame:
    """pixels (u, v normalised, depth, and others) with u2, v2, depth2 in the other image; null behind its camera."""
    from ocellus.functions import geometry as g

    m, tt = F.array(*[F.lit(float(v)) for v in np.asarray(r).ravel()]), F.array(*[F.lit(float(v)) for v in t])
    rows = pixels.withColumn("_p", g.add(g.apply(m, F.array(F.col("u") * F.col("depth"), F.col("v") * F.col("depth"), F.col("depth"))), tt))
    z = F.get("_p", F.lit(2))
    ahead = z > 0
    return rows.withColumns({"u2": F.when(ahead, F.get("_p", F.lit(0)) / z), "v2": F.when(ahead, F.get("_p", F.lit(1)) / z), "depth2": F.when(ahead, z)}).drop("_p")


def reprojected_image(cells: DataFrame, depth: DataFrame, r: np.ndarray, t: np.ndarray, focal: float) -> DataFrame:
    """img, i, j, value: cells as the other camera sees them, the nearest of those that fall on one place; null where none does."""
    from ocellus.operators.raster import sizes

    rows = cells.join(depth.select("img", "i", "j", "depth"), ["img", "i", "j"]).join(sizes(cells), "img")
    seen = reproject(rows.withColumns({"u": (F.col("j") - (F.col("w") - 1) / 2) / focal, "v": (F.col("i") - (F.col("h") - 1) / 2) / focal}), r, t).where("depth2 IS NOT NULL")
    place = seen.select("img", F.round(F.col("v2") * focal + (F.col("h") - 1) / 2).cast("int").alias("i"), F.round(F.col("u2") * focal + (F.col("w") - 1) / 2).cast("int").alias("j"), "depth2", "value")
    near = place.groupBy("img", "i", "j").agg(F.min(F.struct("depth2", "value")).alias("m"))
    return cells.select("img", "i", "j").join(near.select("img", "i", "j", F.col("m.value").alias("value")), ["img", "i", "j"], "left")


def _minimise(residuals: Callable[[np.ndarray], np.ndarray], x: np.ndarray, steps: int = 500, tol: float = 1e-9) -> np.ndarray:
    """Damped Gauss-Newton with differences."""
    damp = 1e-3
    r = residuals(x)
    for _ in range(steps):
        j = np.stack([(residuals(x + h) - r) / 1e-6 for h in np.eye(len(x)) * 1e-6], axis=1)
        d = np.linalg.solve(j.T @ j + damp * np.eye(len(x)), -j.T @ r)
        new = residuals(x + d)
        if (new**2).sum() < (r**2).sum():
            x, r, damp = x + d, new, damp / 3
            if np.linalg.norm(d) < tol:
                break
        else:
            damp *= 4
            if damp > 1e9:
                break
    return x


def _camera(p: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R, t of a projection's twelve entries that has the middle of the points before it."""
    p = p.reshape(3, 4)
    p = p * np.sign((p[2] @ np.append(middle, 1)) or 1)
    u, d, vt = np.linalg.svd(p[:, :3])
    return u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt, p[:, 3] / d.mean()


def pnp_solve(world: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R, t of a camera that sees world points at normalised image points: a linear start, then reprojection errors."""
    rows = []
    for (x, y, z), (u, v) in zip(world, image, strict=True):
        rows += [[x, y, z, 1, 0, 0, 0, 0, -u * x, -u * y, -u * z, -u], [0, 0, 0, 0, x, y, z, 1, -v * x, -v * y, -v * z, -v]]
    # Only the last right vector is asked for; the left ones would be a square of the points.
    r0, t0 = _camera(np.linalg.svd(np.array(rows), full_matrices=False)[2][-1], world.mean(axis=0))

    def residuals(x: np.ndarray) -> np.ndarray:
        q = world @ (rotation(x[:3]) @ r0).T + x[3:]
        return (q[:, :2] / q[:, 2:] - image).ravel()

    x = _minimise(residuals, np.concatenate([np.zeros(3), t0]))
    return rotation(x[:3]) @ r0, x[3:]


def _placed(world: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R, t that lay world points on seen ones."""
    a, b = world - world.mean(axis=0), seen - seen.mean(axis=0)
    u, _, vt = np.linalg.svd(b.T @ a)
    r = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
    return r, seen.mean(axis=0) - r @ world.mean(axis=0)


def p3p(world: np.ndarray, image: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The poses, four at most, that see three world points at normalised image points: Grunert's quartic for the ratio of two distances."""
    rays = np.column_stack([image, np.ones(3)])
    rays /= np.linalg.norm(rays, axis=1, keepdims=True)
    a2, b2, c2 = (((world[i] - world[j]) ** 2).sum() for i, j in ((1, 2), (0, 2), (0, 1)))
    ca, cb, cg = rays[1] @ rays[2], rays[0] @ rays[2], rays[0] @ rays[1]
    if min(a2, b2, c2) < 1e-18:
        return []
    d, s = (a2 - c2) / b2, (a2 + c2) / b2
    quartic = [
        (d - 1) ** 2 - 4 * c2 / b2 * ca * ca,
        4 * (d * (1 - d) * cb - (1 - s) * ca * cg + 2 * c2 / b2 * ca * ca * cb),
        2 * (d * d - 1 + 2 * d * d * cb * cb + 2 * (b2 - c2) / b2 * ca * ca - 4 * s * ca * cb * cg + 2 * (b2 - a2) / b2 * cg * cg),
        4 * (-d * (1 + d) * cb + 2 * a2 / b2 * cg * cg * cb - (1 - s) * ca * cg),
        (1 + d) ** 2 - 4 * a2 / b2 * cg * cg,
    ]
    out = []
    for v in np.roots(quartic):
        if abs(v.imag) > 1e-6 or v.real <= 0:
            continue
        v = float(v.real)
        below = 2 * (cg - v * ca)
        if abs(below) < 1e-12:
            continue
        u = ((d - 1) * v * v - 2 * d * cb * v + 1 + d) / below
        near = 1 + v * v - 2 * v * cb
        if u <= 0 or near <= 0:
            continue
        first = np.sqrt(b2 / near)
        out.append(_placed(world, rays * (first * np.array([1.0, u, v]))[:, None]))
    return out


def _misses(pose: tuple[np.ndarray, np.ndarray], world: np.ndarray, image: np.ndarray) -> np.ndarray:
    q = world @ pose[0].T + pose[1]
    ahead = q[:, 2] > 1e-12
    off = np.linalg.norm(q[:, :2] / np.where(ahead, q[:, 2], 1)[:, None] - image, axis=1)
    return np.where(ahead, off, np.inf)


def p4p(world: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The pose of three of four points (or more) that misses the others least; each of the first four points is left out in turn."""
    best = None
    for k in range(4):
        chosen = [x for x in range(4) if x != k]
        for pose in p3p(world[chosen], image[chosen]):
            miss = float(_misses(pose, world, image).sum())
            if np.isfinite(miss) and (best is None or miss < best[0]):
                best = miss, pose
    return None if best is None else best[1]


def refine_pose(pose: tuple[np.ndarray, np.ndarray], world: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A pose of least squared reprojection errors, from one near it."""

    def residuals(x: np.ndarray) -> np.ndarray:
        q = world @ (rotation(x[:3]) @ pose[0]).T + x[3:]
        return (q[:, :2] / q[:, 2:] - image).ravel()

    x = _minimise(residuals, np.concatenate([np.zeros(3), pose[1]]))
    return rotation(x[:3]) @ pose[0], x[3:]


def _pose_of(world: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    if len(world) >= 6:
        return pnp_solve(world, image)
    if len(world) >= 4:
        start = p4p(world, image)
        return None if start is None else refine_pose(start, world, image)
    return None


#: Points of a view that one task holds, and of those how many are summed at once; larger views are solved from sums.
HELD, BLOCK = 1 << 14, 1 << 12
#: Steps of a large view's poses; no view took more than a few.
STEPS = 100
_SUMS = "g long, s array<double>"


def _summed(rows: DataFrame, of: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """g and the sum of what of() makes of its points, block by block: an array of one length for each partition and view is shuffled."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for g, own in pdf.groupby("g"):
                for k in range(0, len(own), BLOCK):
                    some = own.iloc[k : k + BLOCK]
                    s = of(int(g), some[["x", "y", "z"]].to_numpy(), some[["u", "v"]].to_numpy())
                    total[int(g)] = total[int(g)] + s if int(g) in total else s
        yield pd.DataFrame({"g": pd.Series(list(total), dtype="int64"), "s": [s.tolist() for s in total.values()]})

    sums = rows.mapInPandas(run, _SUMS).select("g", F.posexplode("s").alias("k", "v")).groupBy("g", "k").agg(F.sum("v").alias("v"))
    got = sums.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda e: e["v"]).alias("s"))
    return {r["g"]: np.array(r["s"]) for r in got.collect()}


def _products(g: int, world: np.ndarray, image: np.ndarray) -> np.ndarray:
    """The 144 sums of the linear start's equations, and those of the points."""
    one, zero, (u, v) = np.column_stack([world, np.ones(len(world))]), np.zeros((len(world), 4)), image.T[:, :, None]
    a = np.concatenate([np.hstack([one, zero, -u * one]), np.hstack([zero, one, -v * one])])
    return np.concatenate([(a.T @ a).ravel(), world.sum(axis=0)])


def _normal(r: np.ndarray, t: np.ndarray, world: np.ndarray, image: np.ndarray) -> np.ndarray:
    """36 sums of products of the derivatives by a turn and a move, 6 with the errors, and the squared errors."""
    turned = world @ r.T
    x, y, z = (turned + t).T
    e = np.concatenate([x / z - image[:, 0], y / z - image[:, 1]])
    zero, (a, b, c) = np.zeros(len(world)), turned.T
    j = np.concatenate([np.stack([-x / z * b / z, (c + x / z * a) / z, -b / z, 1 / z, zero, -x / z / z], axis=1), np.stack([-(c + y / z * b) / z, y / z * a / z, a / z, zero, 1 / z, -y / z / z], axis=1)])
    return np.concatenate([(j.T @ j).ravel(), j.T @ e, [e @ e]])


def _large(rows: DataFrame, counts: dict[int, int], tol: float = 1e-9) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Poses of views with many points (how many are in counts): damped Gauss-Newton for all of them together, one aggregation a step."""
    pose = {}
    for g, s in _summed(rows, _products).items():
        pose[g] = _camera(np.linalg.eigh(s[:144].reshape(12, 12))[1][:, 0], s[144:] / counts[g])
    at = {g: (s, 1e-3) for g, s in _summed(rows, lambda g, w, m: _normal(*pose[g], w, m) if g in pose else np.zeros(43)).items()}
    live = set(pose)
    for _ in range(STEPS):
        tried, step = {}, {}
        for g in live:
            s, damp = at[g]
            step[g] = np.linalg.solve(s[:36].reshape(6, 6) + damp * np.eye(6), -s[36:42])
            tried[g] = rotation(step[g][:3]) @ pose[g][0], pose[g][1] + step[g][3:]
        if not live:
            return pose
        made = _summed(rows.where(F.col("g").isin(sorted(live))), lambda g, w, m, tried=tried: _normal(*tried[g], w, m))
        for g in list(live):
            s, damp = at[g]
            if made[g][42] < s[42]:
                pose[g], at[g] = tried[g], (made[g], damp / 3)
                if np.linalg.norm(step[g]) < tol:
                    live.discard(g)
            else:
                at[g] = s, damp * 4
                # A step too short to count ends it too: what is left of the errors is rounding.
                if damp * 4 > 1e9 or np.linalg.norm(step[g]) < tol:
                    live.discard(g)
    raise NotSettled(f"poses still move after {STEPS} steps")


def pnp(views: DataFrame) -> DataFrame:
    """g and the pose (r: 9 by rows, t: 3) of each view's points (g, x, y, z, u, v); four at least, and four or five start from three of them; one without a pose gives no row.

    A view of no more than HELD points is solved by one task; larger ones are solved together from sums over their points.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # In a fixed order, so that the first four are the same whatever the plan.
        pdf = pdf.sort_values(["x", "y", "z", "u", "v"])
        found = _pose_of(pdf[["x", "y", "z"]].to_numpy(), pdf[["u", "v"]].to_numpy())
        if found is None:
            return pd.DataFrame({"g": pd.Series(dtype="int64"), "r": pd.Series(dtype=object), "t": pd.Series(dtype=object)})
        r, t = found
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "r": [r.ravel().tolist()], "t": [t.tolist()]})

    kinds = "g long, r array<double>, t array<double>"
    rows = views.select(F.col("g").cast("long").alias("g"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "u", "v")])
    counts = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > HELD).collect()}
    if not counts:
        return rows.groupBy("g").applyInPandas(run, kinds)
    some = F.col("g").isin(sorted(counts))
    found = _large(rows.where(some), counts)
    large = views.sparkSession.createDataFrame([(g, r.ravel().tolist(), t.tolist()) for g, (r, t) in found.items()], kinds)
    return rows.where(~some).groupBy("g").applyInPandas(run, kinds).unionByName(large)


def align_rays(rays: DataFrame, steps: int = 20, bound: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """R, t for which rays (ox..dz) of one frame meet those (px..ez) of the other: Gauss-Newton, one aggregation a step. With a bound, pairs that miss by more weigh as Huber's kernel says."""
    from ocellus.functions import geometry as g

    r, t = np.eye(3), np.zeros(3)
    o, d, p, e = (F.array(*[F.col(f"{n}{c}") for c in "xyz"]) for n in "odpe")
    for _ in range(steps):
        m = F.array(*[F.lit(float(v)) for v in r.ravel()])
        tt = F.array(*[F.lit(float(v)) for v in t])
        rows = rays.select(g.apply(m, o).alias("a"), g.apply(m, d).alias("b"), p.alias("p"), e.alias("e"))
        gap = g.add(g.add(F.col("a"), tt), g.scale(F.col("p"), -1.0))
        res = g.dot(F.col("e"), g.cross(gap, F.col("b")))
        turn = [g.dot(F.col("e"), g.add(g.cross(g.cross(x, F.col("a")), F.col("b")), g.cross(gap, g.cross(x, F.col("b"))))) for x in _AXES()]
        move = [g.dot(F.col("e"), g.cross(x, F.col("b"))) for x in _AXES()]
        weight = None if bound is None else F.when(F.abs(res) <= bound, 1.0).otherwise(bound / F.abs(res))
        a, b = normal_equations(rows, turn + move, res, weight)
        step = np.linalg.lstsq(a, b, rcond=1e-12)[0]
        r, t = rotation(-step[:3]) @ r, t - step[3:]
        if np.linalg.norm(step) < 1e-10:
            break
    return r, t


def _AXES():
    return [F.array(*[F.lit(float(k == c)) for c in range(3)]) for k in range(3)]


def rectify(r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations of both cameras that lay the baseline along x and share the mean view direction."""
    base = -r.T @ t
    if np.linalg.norm(base) < 1e-4:
        raise ValueError("the cameras stand in one place")
    x = base / np.linalg.norm(base)
    views = [v - (v @ x) * x for v in (np.array([0.0, 0, 1]), r.T[:, 2])]
    z = views[0] / np.linalg.norm(views[0]) + views[1] / np.linalg.norm(views[1])
    if np.linalg.norm(z) < 0.4:
        raise ValueError("the cameras look apart")
    z /= np.linalg.norm(z)
    first = np.stack([x, np.cross(z, x), z])
    return first, first @ r.T


def backward_map(cells: DataFrame, r: np.ndarray, focal: float) -> DataFrame:
    """img, i, j, si, sj: where each pixel of an image turned by r (from rectify()) lies in the one it is made of; null behind the camera."""
    from ocellus.operators.raster import sizes

    m = np.asarray(r).T
    rows = cells.select("img", "i", "j").join(sizes(cells), "img")
    x, y = (F.col("j") - (F.col("w") - 1) / 2) / focal, (F.col("i") - (F.col("h") - 1) / 2) / focal
    p = [F.lit(float(m[k, 0])) * x + F.lit(float(m[k, 1])) * y + F.lit(float(m[k, 2])) for k in range(3)]
    ahead = p[2] > 0
    return rows.select("img", "i", "j", F.when(ahead, p[1] / p[2] * focal + (F.col("h") - 1) / 2).alias("si"), F.when(ahead, p[0] / p[2] * focal + (F.col("w") - 1) / 2).alias("sj"))
