"""Operators whose recurrences have no fixed-depth plan: one image, or one row of one, to a task, in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.operators.iteration import NotSettled

VOLUME = ["img", "i", "j", "costs"]
#: Steps of 4, 8 and 16 path directions.
DIRECTIONS = {
    4: ((0, 1), (0, -1), (1, 0), (-1, 0)),
    8: ((0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (-1, -1), (1, -1), (-1, 1)),
    16: ((0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (-1, -1), (1, -1), (-1, 1), (1, 2), (-1, -2), (2, 1), (-2, -1), (1, -2), (-1, 2), (2, -1), (-2, 1)),
}


def cube(pdf: pd.DataFrame) -> np.ndarray:
    pdf = pdf.sort_values(["i", "j"])
    h, w = int(pdf["i"].max()) + 1, int(pdf["j"].max()) + 1
    return np.stack(pdf["costs"].to_numpy()).astype(float).reshape(h, w, -1)


def image(pdf: pd.DataFrame, value: str = "value") -> np.ndarray:
    pdf = pdf.sort_values(["i", "j"])
    return pdf[value].to_numpy(dtype=float).reshape(int(pdf["i"].max()) + 1, -1)


def _long(img: int, **arrays: np.ndarray) -> pd.DataFrame:
    h, w = next(iter(arrays.values())).shape
    i, j = np.mgrid[:h, :w]
    return pd.DataFrame({"img": np.int32(img), "i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), **{k: v.ravel() for k, v in arrays.items()}})


def path_costs(cost: np.ndarray, step: tuple[int, int], p1: float, p2: float) -> np.ndarray:
    """Costs along one direction: a cell's own, and the least of the cell before with the penalties of a jump."""
    h, w, n = cost.shape
    di, dj = step
    out = np.array(cost)
    rows = range(h) if di >= 0 else range(h - 1, -1, -1)
    cols = range(w) if dj >= 0 else range(w - 1, -1, -1)
    for i in rows:
        if di:
            if not 0 <= i - di < h:
                continue
            before = np.full((w, n), np.nan)
            lo, hi = max(dj, 0), w + min(dj, 0)
            before[lo:hi] = out[i - di, lo - dj : hi - dj]
            out[i] = _stepped(cost[i], before, p1, p2)
        else:
            for j in cols:
                if 0 <= j - dj < w:
                    out[i, j] = _stepped(cost[i, j][None], out[i, j - dj][None], p1, p2)[0]
    return out


def _stepped(cost: np.ndarray, before: np.ndarray, p1: float, p2: float) -> np.ndarray:
    least = before.min(axis=1, keepdims=True)
    near = np.full_like(before, np.inf)
    near[:, 1:] = before[:, :-1]
    near[:, :-1] = np.fmin(near[:, :-1], before[:, 1:])
    got = np.minimum(np.minimum(before, near + p1), least + p2) - least
    return np.where(np.isnan(least), cost, cost + got)


def sgm(volume: DataFrame, p1: float, p2: float, directions: int = 8) -> DataFrame:
    """img, i, j, d: the least of path costs summed over directions; of equal ones the last."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = cube(pdf)
        s = sum(path_costs(c, step, p1, p2) for step in DIRECTIONS[directions])
        d = s.shape[2] - 1 - s[:, :, ::-1].argmin(axis=2)
        return _long(pdf["img"].iloc[0], d=d.astype(np.int32))

    return volume.select(*VOLUME).groupBy("img").applyInPandas(run, "img int, i int, j int, d int")


def dp_scanline(volume: DataFrame, jump: float) -> DataFrame:
    """img, i, j, d along each row: least cost with a price for each step of disparity between neighbours."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("j")
        c = np.stack(pdf["costs"].to_numpy()).astype(float)
        n = c.shape[1]
        price = jump * np.abs(np.arange(n)[:, None] - np.arange(n)[None, :])
        total, came = c[0], np.zeros(c.shape, dtype=np.int64)
        for j in range(1, len(c)):
            both = total[None, :] + price
            came[j] = both.argmin(axis=1)
            total = c[j] + both.min(axis=1)
        d = np.empty(len(c), dtype=np.int32)
        d[-1] = total.argmin()
        for j in range(len(c) - 1, 0, -1):
            d[j - 1] = came[j, d[j]]
        return pd.DataFrame({"img": pdf["img"], "i": pdf["i"], "j": pdf["j"], "d": d})

    return volume.select(*VOLUME).groupBy("img", "i").applyInPandas(run, "img int, i int, j int, d int")


#: Steps of a scan-line path: a match, a target passed over, a source passed over.
MATCH, PAST_TARGET, PAST_SOURCE = range(3)


def match_and_skip(cost: np.ndarray, first: float, further: float) -> np.ndarray:
    """Disparities of one line (columns, disparities) along the path of least cost from disparity 0 to 0; -1 where the source has no partner.

    A step matches a column, passes over a target (the disparity grows by one, in the same column) or over a source (it
    falls by one, in the next). The first step of a run of passes of one kind costs first, each that follows further.
    """
    w, n = cost.shape
    best = np.full((w + 1, n, 3), np.inf)
    came = np.zeros((w + 1, n, 3), dtype=np.int8)
    best[0, 0, MATCH] = 0
    for j in range(w + 1):
        if j:
            # In from the column before: a match at the same disparity, or a source passed over from the one above.
            best[j, :, MATCH] = best[j - 1].min(axis=1) + cost[j - 1]
            came[j, :, MATCH] = best[j - 1].argmin(axis=1)
            over = best[j - 1, 1:] + np.array([first, first, further])
            best[j, :-1, PAST_SOURCE], came[j, :-1, PAST_SOURCE] = over.min(axis=1), over.argmin(axis=1)
        for d in range(1, n):
            over = best[j, d - 1] + np.array([first, further, first])
            best[j, d, PAST_TARGET], came[j, d, PAST_TARGET] = over.min(), over.argmin()
    out, j, d, kind = np.full(w, -1, dtype=np.int32), w, 0, int(best[w, 0].argmin())
    while j or d:
        before = int(came[j, d, kind])
        if kind == MATCH:
            out[j - 1] = d
            j -= 1
        elif kind == PAST_SOURCE:
            j, d = j - 1, d + 1
        else:
            d -= 1
        kind = before
    return out


def scanline_paths(volume: DataFrame, first: float, further: float) -> DataFrame:
    """img, i, j, d of match_and_skip() along each row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("j")
        d = match_and_skip(np.stack(pdf["costs"].to_numpy()).astype(float), first, further)
        return pd.DataFrame({"img": pdf["img"], "i": pdf["i"], "j": pdf["j"], "d": d})

    return volume.select(*VOLUME).groupBy("img", "i").applyInPandas(run, "img int, i int, j int, d int")


def fast_match(volume: DataFrame) -> DataFrame:
    """img, i, j, d along each row: the left neighbour's disparity or one beside it; the whole range after two jumps in a row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("j")
        c = np.stack(pdf["costs"].to_numpy()).astype(float)
        d, jumps = [int(c[0].argmin())], 0
        for row in c[1:]:
            lo, hi = max(d[-1] - 1, 0), min(d[-1] + 2, len(row))
            best = lo + int(row[lo:hi].argmin())
            jumps = jumps + 1 if best != d[-1] else 0
            if jumps >= 2:
                best, jumps = int(row.argmin()), 0
            d.append(best)
        return pd.DataFrame({"img": pdf["img"], "i": pdf["i"], "j": pdf["j"], "d": np.array(d, dtype=np.int32)})

    return volume.select(*VOLUME).groupBy("img", "i").applyInPandas(run, "img int, i int, j int, d int")


def patch_match(volume: DataFrame, iterations: int = 5, searches: int = 4, seed: int = 1) -> DataFrame:
    """img, i, j, d: random starts; scans along rows, then along columns, in alternating directions, in which a cell takes its forerunner's disparity where that is better; and shrinking random searches."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = cube(pdf)
        h, w, n = c.shape
        rng = np.random.default_rng(seed + int(pdf["img"].iloc[0]))
        d = rng.integers(0, n, (h, w))
        at = np.ogrid[:h, :w]

        def scan(axis: int, forward: bool) -> bool:
            """All lines at once, cell after cell; the first of a line has no forerunner."""
            cost, own = (c, d) if axis == 1 else (c.transpose(1, 0, 2), d.T)
            lines, moved = np.arange(own.shape[0]), False
            order = range(1, own.shape[1]) if forward else range(own.shape[1] - 2, -1, -1)
            for k in order:
                other = own[:, k - 1 if forward else k + 1]
                better = cost[lines, k, other] < cost[lines, k, own[:, k]]
                own[better, k] = other[better]
                moved |= bool(better.any())
            return moved

        def keep(other: np.ndarray) -> bool:
            better = c[at[0], at[1], other] < c[at[0], at[1], d]
            d[better] = other[better]
            return bool(better.any())

        for k in range(iterations):
            moved = False
            for axis in (1, 0):
                moved |= scan(axis, k % 2 == 0)
            reach = n
            for _ in range(searches):
                moved |= keep(np.clip(d + rng.integers(-reach, reach + 1, (h, w)), 0, n - 1))
                reach = max(1, reach // 2)
            if not moved:
                break
        return _long(pdf["img"].iloc[0], d=d.astype(np.int32))

    return volume.select(*VOLUME).groupBy("img").applyInPandas(run, "img int, i int, j int, d int")


def _per_image(cells: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _long(pdf["img"].iloc[0], value=f(image(pdf)))

    return cells.select("img", "i", "j", "value").groupBy("img").applyInPandas(run, "img int, i int, j int, value double")


def l0_fusion(cells: DataFrame, penalty: float, rounds: int = 20) -> DataFrame:
    """Piecewise constant values: regions merge where what merging costs is below a share of their border that grows each round."""

    def fuse(x: np.ndarray) -> np.ndarray:
        h, w = x.shape
        n = h * w
        parent, mean, size = list(range(n)), x.ravel().astype(float).tolist(), [1] * n
        border: list[dict[int, int]] = [{} for _ in range(n)]
        for i in range(h):
            for j in range(w):
                for a, b in ((i, j + 1), (i + 1, j)):
                    if a < h and b < w:
                        border[i * w + j][a * w + b] = border[a * w + b][i * w + j] = 1
        for k in range(rounds):
            beta = penalty * (k + 1) / rounds
            for a in range(n):
                if parent[a] != a:
                    continue
                for b in sorted(border[a]):
                    if parent[b] != b or b not in border[a]:
                        continue
                    gap = mean[a] - mean[b]
                    if gap * gap * size[a] * size[b] <= beta * border[a][b] * (size[a] + size[b]):
                        mean[a] = (mean[a] * size[a] + mean[b] * size[b]) / (size[a] + size[b])
                        size[a] += size[b]
                        parent[b] = a
                        for c, length in border[b].items():
                            del border[c][b]
                            if c != a:
                                border[a][c] = border[c][a] = border[a].get(c, 0) + length
                        border[b] = {}
        def root(a: int) -> int:
            while parent[a] != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            return a
        return np.array([mean[root(a)] for a in range(n)]).reshape(h, w)

    return _per_image(cells, fuse)


def conjugate_gradient(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int | None = None, tol: float = 1e-10) -> np.ndarray:
    """x with apply(x) = b, to a squared residual of tol; an error if it is not reached in 20 steps an unknown."""
    x = np.zeros_like(b)
    r = b - apply(x)
    p, rr = r.copy(), float((r * r).sum())
    for _ in range(steps or 20 * b.size + 100):
        if rr < tol:
            return x
        ap = apply(p)
        a = rr / float((p * ap).sum())
        x, r = x + a * p, r - a * ap
        new = float((r * r).sum())
        p, rr = r + new / rr * p, new
    raise NotSettled("conjugate gradients ended at their limit")


def _laplace(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for axis in (0, 1):
        d = np.diff(x, axis=axis)
        lo, hi = [slice(None)] * 2, [slice(None)] * 2
        lo[axis], hi[axis] = slice(None, -1), slice(1, None)
        out[tuple(lo)] -= d
        out[tuple(hi)] += d
    return out


def inpaint_diffusion(cells: DataFrame) -> DataFrame:
    """Unknown cells (null) between known ones, by least squares of the values and of neighbours' differences."""

    def fill(x: np.ndarray) -> np.ndarray:
        known = ~np.isnan(x)
        return conjugate_gradient(lambda v: np.where(known, v, 0) + _laplace(v), np.where(known, x, 0))

    return _per_image(cells, fill)


def fft_rows(cells: DataFrame) -> DataFrame:
    """img, i, k, re, im: the transform of each row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = np.fft.fft(pdf.sort_values("j")["value"].to_numpy())
        return pd.DataFrame({"img": pdf["img"].iloc[0], "i": pdf["i"].iloc[0], "k": np.arange(len(f), dtype=np.int32), "re": f.real, "im": f.imag})

    return cells.select("img", "i", "j", "value").groupBy("img", "i").applyInPandas(run, "img int, i int, k int, re double, im double")


def circle_descriptors(cells: DataFrame, points: DataFrame, levels: tuple[int, ...] = (16, 8)) -> DataFrame:
    """img, i, j, f: amplitudes of the transforms of samples on circles around points, which a rotation leaves alone."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"img": [], "i": [], "j": [], "f": pd.Series([], dtype=object)})
        x = np.pad(image(left), len(levels) + 2)
        rows = []
        for p in right.itertuples():
            parts = []
            for r, n in enumerate(levels, start=1):
                t = 2 * np.pi * np.arange(n) / n
                y, z = p.i + r * np.sin(t) + len(levels) + 2, p.j + r * np.cos(t) + len(levels) + 2
                a, b = np.floor(y).astype(int), np.floor(z).astype(int)
                u, v = y - a, z - b
                s = (1 - u) * (1 - v) * x[a, b] + (1 - u) * v * x[a, b + 1] + u * (1 - v) * x[a + 1, b] + u * v * x[a + 1, b + 1]
                parts.append(np.abs(np.fft.rfft(s)))
            rows.append((p.img, p.i, p.j, np.concatenate(parts).tolist()))
        return pd.DataFrame(rows, columns=["img", "i", "j", "f"])

    return cells.select("img", "i", "j", "value").groupBy("img").cogroup(points.select("img", "i", "j").groupBy("img")).applyInPandas(run, "img int, i int, j int, f array<double>")


def brief(cells: DataFrame, points: DataFrame, pairs: list[tuple[int, int, int, int]]) -> DataFrame:
    """img, i, j, words: bits of comparisons between pairs of places around points, 32 to a word."""
    taps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(v).alias(c) for c, v in zip("abcd", p, strict=True)]) for k, p in enumerate(pairs)]))
    asked = points.select("img", "i", "j", taps.alias("t"))
    x = cells.select("img", F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("value").alias("_v"))
    for n, (a, b) in (("u", ("a", "b")), ("v", ("c", "d"))):
        asked = asked.withColumns({"_i": F.col("i") + F.col(f"t.{a}"), "_j": F.col("j") + F.col(f"t.{b}")}).join(x, ["img", "_i", "_j"], "left").withColumn(n, F.coalesce("_v", F.lit(0.0))).drop("_i", "_j", "_v")
    bit = F.when(F.col("u") > F.col("v"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("t.k") % 32)).otherwise(0)
    words = asked.groupBy("img", "i", "j", F.floor(F.col("t.k") / 32).alias("w")).agg(F.sum(bit).alias("bits"))
    return words.groupBy("img", "i", "j").agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "bits"))), lambda s: s["bits"]).alias("words"))


def line_pixels(a: tuple[int, int], b: tuple[int, int]) -> list[tuple[int, int]]:
    """Pixels nearest to a line, one for each step of its longer axis."""
    n = max(abs(b[0] - a[0]), abs(b[1] - a[1]))
    return [(round(a[0] + (b[0] - a[0]) * k / max(n, 1)), round(a[1] + (b[1] - a[1]) * k / max(n, 1))) for k in range(n + 1)]


def triangle_pixels(corners: list[tuple[float, float]]) -> list[tuple[int, int]]:
    """Pixels whose centres a triangle holds."""
    (ay, ax), (by, bx), (cy, cx) = corners
    out = []
    for i in range(int(min(ay, by, cy)), int(max(ay, by, cy)) + 1):
        for j in range(int(min(ax, bx, cx)), int(max(ax, bx, cx)) + 1):
            s = [(q[1] - p[1]) * (i - p[0]) - (q[0] - p[0]) * (j - p[1]) for p, q in zip(corners, [*corners[1:], corners[0]], strict=True)]
            if all(v >= 0 for v in s) or all(v <= 0 for v in s):
                out.append((i, j))
    return out


def rasterise_lines(lines: DataFrame) -> DataFrame:
    """line, i, j of the pixels of lines (line, i0, j0, i1, j1)."""

    def run(batches):
        for pdf in batches:
            rows = [(r.line, i, j) for r in pdf.itertuples() for i, j in line_pixels((r.i0, r.j0), (r.i1, r.j1))]
            yield pd.DataFrame(rows, columns=["line", "i", "j"])

    return lines.select("line", "i0", "j0", "i1", "j1").mapInPandas(run, "line long, i int, j int")


def shifted_means(points: np.ndarray, places: np.ndarray, radius: float) -> np.ndarray:
    """Means of the points within radius of each place; a place without any stays.

    Places are halved along their box's longest side. What lies within radius of all of a box is added up once for it, and only
    what lies within radius of a part of it is handed on to the halves and, in the end, held against each place.
    """
    out, axes = places.copy(), range(places.shape[1])
    todo = [(np.arange(len(places)), np.vstack([points.T, np.ones(len(points))]), np.zeros(len(axes) + 1))]
    while todo:
        own, near, base = todo.pop()
        at = places[own]
        low, high = at.min(axis=0), at.max(axis=0)
        least, most = np.zeros(near.shape[1]), np.zeros(near.shape[1])
        for c in axes:
            below, above = low[c] - near[c], near[c] - high[c]
            least += np.maximum(np.maximum(below, above), 0) ** 2
            most += np.minimum(below, above) ** 2
        whole = most <= (radius * (1 - 1e-9)) ** 2
        base = base + near[:, np.flatnonzero(whole)].sum(axis=1)
        near = near[:, np.flatnonzero(~whole & (least <= (radius * (1 + 1e-9)) ** 2))]
        if len(own) > 8 and len(own) * near.shape[1] > 200_000 and (high > low).any():
            longest = int(np.argmax(high - low))
            order, half = np.argpartition(at[:, longest], len(own) // 2), len(own) // 2
            todo += [(own[order[:half]], near, base), (own[order[half:]], near, base)]
            continue
        for some in np.split(own, range(0, len(own), max(1, 500_000 // max(near.shape[1], 1)))[1:]):
            inside = (sum((places[some, c, None] - near[c]) ** 2 for c in axes) <= radius * radius).astype(float)
            sums = inside @ near.T + base
            n = sums[:, -1]
            out[some[n > 0]] = sums[n > 0, :-1] / n[n > 0, None]
    return out


def mean_shift(points: DataFrame, columns: list[str], radius: float, tol: float = 1e-3) -> DataFrame:
    """Points moved to the mean of those within radius, each until its own step is no longer than tol, however many that takes.

    A tile holds the points that its places can need; places move there until they are done or have left it by more than a
    margin, and the latter go on in the tile that they came to. One written step for each such change, not for each move.
    Places of a crowded tile are dealt over several groups, each with the tile's points.
    """
    from ocellus.operators.iteration import Step
    from ocellus.operators.spatial import _cell

    side, margin, most = 2 * radius, radius / 2, 20_000
    reach, keys = (radius + margin) * (1 + 1e-9), ["_x", "_y", "_z"]
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        at, p = left[list("xyz")].to_numpy(dtype=float, copy=True), right[list("xyz")].to_numpy(dtype=float)
        done = np.zeros(len(at), dtype=bool)
        if len(at):
            tile = left[keys].iloc[0].to_numpy(dtype=float)
            low, high = tile * side - margin, (tile + 1) * side + margin
            live = np.arange(len(at))
            while len(live):
                new = shifted_means(p, at[live], radius)
                moved = np.sqrt(((new - at[live]) ** 2).sum(axis=1))
                at[live], done[live] = new, moved <= tol
                live = live[(moved > tol) & ((new >= low) & (new <= high)).all(axis=1)]
        return pd.DataFrame({"pt": left["pt"], "x": at[:, 0], "y": at[:, 1], "z": at[:, 2], "done": done})

    base = Step(points.select("pt", *[F.col(c).cast("double").alias(n) for c, n in zip(columns, "xyz", strict=True)]).dropna(subset=list("xyz")))
    tiled = base.read().drop("pt")
    for c in "xyz":
        tiled = tiled.withColumn(f"_{c}", F.explode(F.sequence(_cell(F.col(c) - reach, side), _cell(F.col(c) + reach, side))))
    left, found = base.read(), None
    while not left.isEmpty():
        asked = left.withColumns({f"_{c}": _cell(F.col(c), side) for c in "xyz"})
        parts = asked.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts"))
        near = tiled.join(parts, keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        asked = asked.join(parts, keys).withColumn("_part", F.pmod(F.xxhash64("pt", *"xyz"), F.col("_parts")).cast("int")).drop("_parts")
        # So many partitions that crowded tiles seldom share one: by bytes, all would be few.
        asked, near = (rows.repartition(n, *keys, "_part").groupBy(*keys, "_part") for rows in (asked, near))
        moved = Step(asked.cogroup(near).applyInPandas(run, f"pt {dict(base.read().dtypes)['pt']}, x double, y double, z double, done boolean"))
        ended = moved.read().where("done").drop("done")
        found = ended if found is None else found.unionByName(ended)
        left = moved.read().where("NOT done").drop("done")
    return base.read() if found is None else found
