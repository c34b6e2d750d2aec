"""Queries of priced scan-line paths and of refinements by other costs and in two directions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ocellus.functions import affine, vectors
from ocellus.operators import mixtures, scanlines
from ocellus.operators import volumes as v
from ocellus.operators.raster import CELL
from ocellus.operators.scanlines import MATCH, PAST_SOURCE, PAST_TARGET, Policy
from ocellus.plans.registry import Registry
from ocellus.plans.standins import H, W, raster
from ocellus.plans.stereo_queries import _V2 as V2_SQL
from ocellus.plans.stereo_queries import PAIR_SQL, VOLUME_SQL, WIN_SQL, D, _pair, _volume

R = Registry()
_LISTS = "v AS (SELECT img, i, j, list(CAST(cost AS DOUBLE) ORDER BY d) AS c FROM vol GROUP BY img, i, j)"
_FAR = "1e300"


def _paths_sql(policy: Policy, weights: str) -> str:
    """Least prices of every state of each column from those of the column before, then the path from its end; weights: a table wt(img, i, j, w)."""
    runs, size = policy.runs, 3 * (policy.runs + 1)
    place = lambda of, d, state: f"{of}[({d}) * {size} + {state + 1}]"
    least = lambda terms: f"least({', '.join(terms)})" if len(terms) > 1 else terms[0]

    def branch(kind: int, term) -> str:
        return " ".join(f"WHEN {policy.state(kind, run)} THEN {term(run)}" for run in range(1, runs + 1) if policy.ways(kind, run))

    d = f"(x // {size})"
    matched = branch(MATCH, lambda run: least([f"{place('f.s', d, st)} + {p}" for st, p in policy.ways(MATCH, run)]) + f" + v.c[{d} + 1]")
    passed = branch(PAST_SOURCE, lambda run: f"CASE WHEN {d} = {D - 1} THEN {_FAR} ELSE " + least([f"{place('f.s', f'{d} + 1', st)} + {p} * w" for st, p in policy.ways(PAST_SOURCE, run)]) + " END")
    base = f"list_transform(range({D * size}), lambda x: CASE x % {size} {matched} {passed} ELSE {_FAR} END)"

    def over(run: int) -> str:
        """All runs of passes over targets that end here, from the match or pass over a source before them."""
        terms = []
        for length in range(1, D):
            if min(length, runs) == run:
                more = sum(float(policy.prices[PAST_TARGET, PAST_TARGET, min(s, runs)]) for s in range(1, length))
                starts = [(policy.state(b, past), float(policy.prices[PAST_TARGET, b, past])) for b in (MATCH, PAST_SOURCE) for past in range(runs + 1)]
                terms += [f"CASE WHEN {d} >= {length} THEN {place('q', f'{d} - {length}', st)} + {p + more} * w ELSE {_FAR} END" for st, p in starts]
        return least(terms) if terms else _FAR

    full = f"list_transform(range({D * size}), lambda x: CASE x % {size} {' '.join(f'WHEN {policy.state(PAST_TARGET, run)} THEN {over(run)}' for run in range(1, runs + 1))} ELSE q[x + 1] END)"
    start = f"list_transform(range({D * size}), lambda x: CASE x WHEN 0 THEN 0.0::DOUBLE ELSE {_FAR} END)"
    to = f"(b.d + CASE b.st // {runs + 1} WHEN {MATCH} THEN 0 WHEN {PAST_SOURCE} THEN 1 ELSE -1 END)"
    steps = []
    for kind in range(3):
        for run in range(1, runs + 1):
            if ways := policy.ways(kind, run):
                prices = f"[{', '.join(place('f.s', to, st) + f' + {p}' + (' * wt.w' if kind else '') for st, p in ways)}]"
                steps.append(f"WHEN {policy.state(kind, run)} THEN [{', '.join(str(st) for st, _ in ways)}][list_position({prices}, list_min({prices}))]")
    back = f"CASE b.st {' '.join(steps)} END"
    ends = f"list_position(s[1:{size}], list_min(s[1:{size}])) - 1"
    return "WITH RECURSIVE " + ",\n".join([
        *PAIR_SQL, VOLUME_SQL, _LISTS, weights,
        f"""f(img, i, j, s) AS (SELECT img, i, 0::BIGINT, {full} FROM (SELECT img, i, w, {start} AS q FROM wt WHERE j = 0)
  UNION ALL SELECT img, i, j, {full} FROM (SELECT f.img, f.i, f.j + 1 AS j, wt.w, {base} AS q FROM f JOIN v ON v.img = f.img AND v.i = f.i AND v.j = f.j JOIN wt ON wt.img = f.img AND wt.i = f.i AND wt.j = f.j))""",
        f"""b(img, i, j, d, st) AS (SELECT img, i, j, 0::BIGINT, {ends} FROM f WHERE j = {W}
  UNION ALL SELECT b.img, b.i, f.j, {to}, {back} FROM b JOIN f ON f.img = b.img AND f.i = b.i AND f.j = b.j - CASE b.st // {runs + 1} WHEN {PAST_TARGET} THEN 0 ELSE 1 END
  JOIN wt ON wt.img = b.img AND wt.i = b.i AND wt.j = greatest(b.j - 1, 0) WHERE b.j > 0 OR b.d > 0)""",
    ]) + f"\nSELECT v.img, v.i, v.j, CAST(coalesce(b.d, -1) AS INT) AS d FROM v LEFT JOIN b ON b.st // {runs + 1} = {MATCH} AND b.img = v.img AND b.i = v.i AND b.j = v.j + 1 AND b.st > 0"


_EVEN = "wt AS (SELECT img, i, j, 1.0::DOUBLE AS w FROM v)"
#: Weights in whole 64ths, so that sums of prices are exact.
_GUIDED = "wt AS (SELECT img, i, j, round(64 * (8.0::DOUBLE / (8 + abs(value - coalesce(lag(value) OVER (PARTITION BY img, i ORDER BY j), value))))) / 64 AS w FROM cells)"


def _guided(spark, sf_dir):
    weight = scanlines.edge_weight(raster(spark, sf_dir), 8.0).withColumn("weight", F.round(64 * F.col("weight")) / 64)
    return scanlines.priced_paths(_volume()(spark, sf_dir), scanlines.two_prices(32.0, 16.0), weight)


for _name, _policy in (("scanline_free_after", scanlines.free_after(24.0, 12.0, 2)), ("scanline_growing", scanlines.growing(16.0, 8.0, 2))):
    R.add(_name, lambda s, d, p=_policy: scanlines.priced_paths(_volume()(s, d), p), _paths_sql(_policy, _EVEN))
R.add("scanline_guided", _guided, _paths_sql(scanlines.two_prices(32.0, 16.0), _GUIDED))


# --- refinements

#: Rows and columns of a window of nine entries.
_PARTS = [[0, 1, 2], [3, 4, 5], [6, 7, 8], [0, 3, 6], [1, 4, 7], [2, 5, 8]]
_SAD, _MEDAD = "sum(abs({0}))", "list(abs({0}) ORDER BY abs({0}))[5]"


def _beside_sql(cost: str) -> list[str]:
    """b: each entry k of the window at its source s, the winner's target a, and those beside it; win: the winners."""
    entry = "s.v - coalesce(t.v, 0)"
    partner = "LEFT JOIN nt {0} ON {0}.img = w.img AND {0}.i = w.i AND {0}.j = w.j + w.d + {1} AND {0}.di = s.di AND {0}.dj = s.dj"
    return [
        *PAIR_SQL, VOLUME_SQL.replace("sum(abs(s.v - coalesce(t.v, 0)))", cost.format(entry)), WIN_SQL,
        f"""b AS (SELECT w.img, w.i, w.j, w.d, (s.di + 1) * 3 + s.dj + 1 AS k, s.v - coalesce(a.v, 0) AS g, coalesce(u.v, 0) - coalesce(a.v, 0) AS up, coalesce(o.v, 0) - coalesce(a.v, 0) AS down
  FROM win w JOIN ns s ON s.img = w.img AND s.i = w.i AND s.j = w.j {partner.format('a', 0)} {partner.format('u', 1)} {partner.format('o', -1)})""",
    ]


def _one_sided_sql(cost: str, shares: list[str]) -> str:
    """shares: tables that end in side(img, i, j, side, r), from sides(img, i, j, d, k, g, side, step)."""
    both = "sides AS (SELECT img, i, j, d, k, g, 1 AS side, up AS step FROM b UNION ALL SELECT img, i, j, d, k, g, -1, down FROM b)"
    return "WITH " + ",\n".join([
        *_beside_sql(cost), both, *shares,
        f"own AS (SELECT img, i, j, any_value(d) AS d, round({cost.format('g')}, 9) AS c FROM b GROUP BY img, i, j)",
        f"priced AS (SELECT img, i, j, side, any_value(r) AS r, round({cost.format('(g - r * step)')}, 9) AS c FROM sides JOIN side USING (img, i, j, side) WHERE r > 0 AND r < 1 GROUP BY img, i, j, side)",
        """best AS (SELECT o.*, u.r AS ur, l.r AS lr, coalesce(u.c < o.c, false) AS is_up, coalesce(l.c < least(o.c, u.c), false) AS is_down
  FROM own o LEFT JOIN priced u ON u.img = o.img AND u.i = o.i AND u.j = o.j AND u.side = 1 LEFT JOIN priced l ON l.img = o.img AND l.i = o.i AND l.j = o.j AND l.side = -1)""",
    ]) + f"\nSELECT img, i, j, round(d + CASE WHEN j + d < 1 OR j + d + 1 >= {W} THEN 0 WHEN is_down THEN -lr WHEN is_up THEN ur ELSE 0 END, 5) + 0.0 AS disparity FROM best"


_ABSOLUTE = [
    "ratios AS (SELECT *, g / step AS r, abs(step) AS w FROM sides WHERE step <> 0)",
    "summed AS (SELECT *, sum(w) OVER (PARTITION BY img, i, j, side ORDER BY r ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY img, i, j, side) AS whole FROM ratios)",
    "side AS (SELECT img, i, j, side, min(r) AS r FROM summed WHERE 2 * upto >= whole GROUP BY img, i, j, side)",
]


def _median_sql(tried: str) -> list[str]:
    """tried: rows img, i, j, side, c, r."""
    return [
        f"tried AS ({tried})",
        "held AS (SELECT t.img, t.i, t.j, t.side, t.c, any_value(t.r) AS r, round(list(abs(s.g - t.r * s.step) ORDER BY abs(s.g - t.r * s.step))[5], 9) AS m FROM tried t JOIN sides s USING (img, i, j, side) WHERE t.r IS NOT NULL GROUP BY t.img, t.i, t.j, t.side, t.c)",
        "side AS (SELECT img, i, j, side, arg_min(r, (m, c)) AS r FROM held GROUP BY img, i, j, side)",
    ]


_SINGLE = _median_sql("SELECT img, i, j, side, k AS c, g / step AS r FROM sides WHERE step <> 0")
_PARTS_ROWS = "(VALUES " + ", ".join(f"({c}, {k})" for c, part in enumerate(_PARTS) for k in part) + ") AS p(c, k)"
_BY_PARTS = _median_sql(f"SELECT img, i, j, side, c, sum(g * step) / nullif(sum(step * step), 0) AS r FROM sides JOIN {_PARTS_ROWS} USING (k) GROUP BY img, i, j, side, c")


def _two_sided_sql(cost: str) -> str:
    return "WITH " + ",\n".join([
        *_beside_sql(cost),
        """solved AS (SELECT x.img, x.i, x.j, x.k * 9 + y.k AS c, (x.g * y.up - x.up * y.g) / (x.down * y.up - x.up * y.down) AS p, (x.down * y.g - x.g * y.down) / (x.down * y.up - x.up * y.down) AS q
  FROM b x JOIN b y ON y.img = x.img AND y.i = x.i AND y.j = x.j AND y.k > x.k WHERE x.down * y.up - x.up * y.down <> 0)""",
        f"held AS (SELECT s.img, s.i, s.j, s.c, any_value(s.q - s.p) AS move, round({cost.format('(e.g - s.p * e.down - s.q * e.up)')}, 9) AS m FROM solved s JOIN b e USING (img, i, j) GROUP BY s.img, s.i, s.j, s.c)",
        "best AS (SELECT img, i, j, arg_min(move, (m, c)) AS move FROM held GROUP BY img, i, j)",
    ]) + f"\nSELECT w.img, w.i, w.j, round(d + CASE WHEN w.j + d >= 1 AND w.j + d + 1 < {W} AND abs(move) < 1 THEN move ELSE 0 END, 5) + 0.0 AS disparity FROM win w LEFT JOIN best USING (img, i, j)"


def _refined(f):
    return lambda s, d: f(_pair(s, d)).select(*CELL, (F.round("disparity", 5) + 0.0).alias("disparity"))


R.add("refine_barycentric_sad", _refined(lambda p: mixtures.one_sided(p, vectors.sad, affine.by_absolutes, D)), _one_sided_sql(_SAD, _ABSOLUTE))
R.add("refine_barycentric_medad", _refined(lambda p: mixtures.one_sided(p, vectors.medad, affine.by_median, D)), _one_sided_sql(_MEDAD, _SINGLE))
R.add("refine_barycentric_parts", _refined(lambda p: mixtures.one_sided(p, vectors.medad, lambda g, u: affine.by_median(g, u, _PARTS), D)), _one_sided_sql(_MEDAD, _BY_PARTS))
R.add("refine_barycentric_symmetric_sad", _refined(lambda p: mixtures.two_sided(p, vectors.sad, affine.two_by_absolutes(9), D)), _two_sided_sql(_SAD))
R.add("refine_barycentric_symmetric_medad", _refined(lambda p: mixtures.two_sided(p, vectors.medad, affine.two_by_median(9), D)), _two_sided_sql(_MEDAD))


def _kernel_2d(s, d):
    pair = _pair(s, d)
    winners = v.winner_2d(v.cost_volume_2d(pair, vectors.sad, (-1, 1), (0, 3)))
    made = mixtures.kernel_refined_2d(pair, winners, vectors.ssd, lambda t: F.greatest(1 - F.abs(t), F.lit(0.0)), 1, 2)
    return made.select(*CELL, (F.round("y", 5) + 0.0).alias("y"), (F.round("x", 5) + 0.0).alias("x"))


_KERNEL_2D = "WITH " + ",\n".join([
    *PAIR_SQL, V2_SQL, "win AS (SELECT img, i, j, d.d1, d.d2 FROM (SELECT img, i, j, max_by(struct_pack(d1 := d1, d2 := d2), struct_pack(c := -cost, d1 := d1, d2 := d2)) AS d FROM vol2 GROUP BY img, i, j))",
    "m AS (SELECT a.m AS y, b.m AS x FROM (SELECT unnest([-0.5, 0.0, 0.5]) AS m) a CROSS JOIN (SELECT unnest([-0.5, 0.0, 0.5]) AS m) b)",
    f"near AS (SELECT w.img, w.i, w.j, m.y, m.x, s.di, s.dj, s.v AS s, t.v * greatest(1 - abs(t.i - w.i - w.d1 - m.y), 0) * greatest(1 - abs(t.j - w.j - w.d2 - m.x), 0) AS t FROM win w CROSS JOIN m JOIN ns s ON s.img = w.img AND s.i = w.i AND s.j = w.j"
    f" JOIN nt t ON t.img = w.img AND abs(t.i - w.i - w.d1) <= 1 AND abs(t.j - w.j - w.d2) <= 1 AND t.di = s.di AND t.dj = s.dj WHERE w.i + w.d1 BETWEEN 1 AND {H - 2} AND w.j + w.d2 BETWEEN 1 AND {W - 2})",
    "mixed AS (SELECT img, i, j, y, x, any_value(s) - sum(t) AS e FROM near GROUP BY img, i, j, y, x, di, dj)",
    "priced AS (SELECT img, i, j, y, x, round(sum(CAST(e AS DOUBLE) * e), 9) AS c FROM mixed GROUP BY img, i, j, y, x)",
    "best AS (SELECT img, i, j, arg_min(y, (c, y * y + x * x, y, x)) AS y, arg_min(x, (c, y * y + x * x, y, x)) AS x FROM priced GROUP BY img, i, j)",
]) + "\nSELECT w.img, w.i, w.j, CAST(d1 + coalesce(y, 0) AS DOUBLE) AS y, CAST(d2 + coalesce(x, 0) AS DOUBLE) AS x FROM win w LEFT JOIN best USING (img, i, j)"
R.add("refine_kernel_2d", _kernel_2d, _KERNEL_2D)
