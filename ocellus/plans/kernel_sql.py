"""SQL for the sequential kernels and solvers: recursions along rows, columns and states, transforms as sums, and closed forms."""

from __future__ import annotations

from ocellus.operators.sequential import DIRECTIONS
from ocellus.plans.registry import with_
from ocellus.plans.standins import POINTS_SQL, W, around_sql, raster_sql
from ocellus.plans.stereo_queries import PAIR_SQL, VOLUME_SQL, D

CELLS = raster_sql()
_LISTS = "v AS (SELECT img, i, j, list(CAST(cost AS DOUBLE) ORDER BY d) AS c FROM vol GROUP BY img, i, j)"
_ALL_D = f"range({D})"


def _recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


FFT_ROWS = with_(CELLS) + f"""SELECT img, i, CAST(k AS INT) AS k, round(sum(value * cos(2 * pi() * k * j / {W})), 4) + 0.0 AS re, round(0 - sum(value * sin(2 * pi() * k * j / {W})), 4) + 0.0 AS im
FROM cells CROSS JOIN range({W}) r(k) GROUP BY img, i, k"""

LINE_PIXELS = """WITH l AS (SELECT CAST(n_nationkey AS BIGINT) AS line, 0 AS i0, n_regionkey AS j0, n_nationkey AS i1, 9 AS j1 FROM nation),
s AS (SELECT *, greatest(abs(i1 - i0), abs(j1 - j0)) AS n FROM l), k AS (SELECT *, unnest(range(n + 1)) AS k FROM s)
SELECT line, CAST(round_even(i0 + (i1 - i0) * k / greatest(n, 1), 0) AS INT) AS i, CAST(round_even(j0 + (j1 - j0) * k / greatest(n, 1), 0) AS INT) AS j FROM k"""


def brief(pairs: list[tuple[int, int, int, int]], keys: str) -> str:
    taps = ", ".join(f"({k}, {a}, {b}, {c}, {d})" for k, (a, b, c, d) in enumerate(pairs))
    return with_(CELLS, f"p(k, a, b, c, d) AS (VALUES {taps})", f"q AS (SELECT img, i, j FROM cells WHERE {keys})") + """
SELECT q.img, q.i, q.j, CAST(sum(CASE WHEN k < 32 AND coalesce(u.value, 0) > coalesce(w.value, 0) THEN 1::BIGINT << k ELSE 0 END) AS BIGINT) AS w0,
  CAST(sum(CASE WHEN k >= 32 AND coalesce(u.value, 0) > coalesce(w.value, 0) THEN 1::BIGINT << (k - 32) ELSE 0 END) AS BIGINT) AS w1
FROM q CROSS JOIN p LEFT JOIN cells u ON u.img = q.img AND u.i = q.i + a AND u.j = q.j + b LEFT JOIN cells w ON w.img = q.img AND w.i = q.i + c AND w.j = q.j + d GROUP BY q.img, q.i, q.j"""


def circle_descriptor(keys: str, samples: int, length: int) -> str:
    return with_(CELLS, f"q AS (SELECT img, i, j, i + sin(2 * pi() * t / {samples}) AS y, j + cos(2 * pi() * t / {samples}) AS x FROM cells CROSS JOIN range({samples}) r(t) WHERE {keys})") + f"""
SELECT q.img, q.i, q.j, round(abs(sum((1 - abs(y - n.i)) * (1 - abs(x - n.j)) * n.value)), 4) AS f0, CAST({length} AS INT) AS n
FROM q JOIN cells n ON n.img = q.img AND n.i BETWEEN floor(y) AND floor(y) + 1 AND n.j BETWEEN floor(x) AND floor(x) + 1 AND abs(y - n.i) < 1 AND abs(x - n.j) < 1 GROUP BY q.img, q.i, q.j"""


def _argmin(values: str) -> str:
    """The place, from 0, of the first least entry of a list."""
    return f"list_position({values}, list_min({values})) - 1"


_LEAST = "greatest(r.d - 1, 0)"
_NEAR = f"v.c[{_LEAST} + 1:r.d + 2]"
FAST_MATCH = _recursive(
    *PAIR_SQL, VOLUME_SQL, _LISTS,
    f"""r(img, i, j, d, jumps) AS (SELECT img, i, j, {_argmin('c')}, 0 FROM v WHERE j = 0
  UNION ALL SELECT img, i, j, CASE WHEN near <> d AND jumps >= 1 THEN {_argmin('c')} ELSE near END, CASE WHEN near = d OR jumps >= 1 THEN 0 ELSE 1 END
  FROM (SELECT v.img, v.i, v.j, v.c, r.d, r.jumps, {_LEAST} + {_argmin(_NEAR)} AS near FROM r JOIN v ON v.img = r.img AND v.i = r.i AND v.j = r.j + 1))""",
) + "SELECT img, i, j, CAST(d AS INT) AS d FROM r"


def dp_scanline(jump: float) -> str:
    price = lambda t, d: f"list_transform({_ALL_D}, lambda e: {t}[e + 1] + {jump} * abs({d} - e))"
    return _recursive(
        *PAIR_SQL, VOLUME_SQL, _LISTS,
        f"""f(img, i, j, t, came) AS (SELECT img, i, j, c, CAST([] AS BIGINT[]) FROM v WHERE j = 0
  UNION ALL SELECT v.img, v.i, v.j, list_transform({_ALL_D}, lambda d: v.c[d + 1] + list_min({price('f.t', 'd')})), list_transform({_ALL_D}, lambda d: {_argmin(price('f.t', 'd'))})
  FROM f JOIN v ON v.img = f.img AND v.i = f.i AND v.j = f.j + 1)""",
        f"""b(img, i, j, d) AS (SELECT img, i, j, {_argmin('t')} FROM f WHERE j = {W - 1}
  UNION ALL SELECT b.img, b.i, b.j - 1, f.came[b.d + 1] FROM b JOIN f ON f.img = b.img AND f.i = b.i AND f.j = b.j WHERE b.j > 0)""",
    ) + "SELECT img, i, j, CAST(d AS INT) AS d FROM b"


def scanline_paths(first: float, further: float) -> str:
    """Least costs of reaching each column and disparity by each kind of step, then the path from its end."""
    far = 1e300
    start, none = f"[{', '.join(['0.0'] + [str(far)] * (D - 1))}]", f"[{', '.join([str(far)] * D)}]"

    def past_target(m: str, s: str) -> str:
        return f"list_transform({_ALL_D}, lambda d: CASE WHEN d = 0 THEN {far} ELSE list_min(list_transform(range(d), lambda e: least({m}[e + 1], {s}[e + 1]) + {first} + (d - 1 - e) * {further})) END)"

    which = "CASE WHEN {0} <= {1} AND {0} <= {2} THEN 0 WHEN {1} <= {2} THEN 1 ELSE 2 END"
    matched = f"list_transform({_ALL_D}, lambda d: least(f.m[d + 1], f.t[d + 1], f.s[d + 1]) + v.c[d + 1])"
    passed = f"list_transform({_ALL_D}, lambda d: CASE WHEN d = {D - 1} THEN {far} ELSE least(f.m[d + 2] + {first}, f.t[d + 2] + {first}, f.s[d + 2] + {further}) END)"
    to = "CASE b.kind WHEN 0 THEN b.d WHEN 2 THEN b.d + 1 ELSE b.d - 1 END"
    price = lambda kind: f"CASE b.kind WHEN 0 THEN 0 WHEN {kind} THEN {further} ELSE {first} END"
    back = which.format(f"f.m[{to} + 1] + {price(3)}", f"f.t[{to} + 1] + {price(1)}", f"f.s[{to} + 1] + {price(2)}")
    return _recursive(
        *PAIR_SQL, VOLUME_SQL, _LISTS,
        f"""f(img, i, j, m, t, s) AS (SELECT DISTINCT img, i, 0::BIGINT, CAST({start} AS DOUBLE[]), {past_target(f'CAST({start} AS DOUBLE[])', none)}, CAST({none} AS DOUBLE[]) FROM v
  UNION ALL SELECT img, i, j, m, {past_target('m', 's')}, s FROM (SELECT f.img, f.i, f.j + 1 AS j, {matched} AS m, {passed} AS s FROM f JOIN v ON v.img = f.img AND v.i = f.i AND v.j = f.j))""",
        f"""b(img, i, j, d, kind) AS (SELECT img, i, j, 0::BIGINT, {which.format('m[1]', 't[1]', 's[1]')} FROM f WHERE j = {W}
  UNION ALL SELECT b.img, b.i, f.j, {to}, {back} FROM b JOIN f ON f.img = b.img AND f.i = b.i AND f.j = CASE b.kind WHEN 1 THEN b.j ELSE b.j - 1 END WHERE b.j > 0 OR b.d > 0)""",
    ) + "SELECT v.img, v.i, v.j, CAST(coalesce(b.d, -1) AS INT) AS d FROM v LEFT JOIN b ON b.kind = 0 AND b.img = v.img AND b.i = v.i AND b.j = v.j + 1"


def sgm(p1: float, p2: float, directions: int = 8) -> str:
    """A recursion for each direction: a cell's path costs from those of the cell before, which may lie outside."""
    parts = []
    for k, (di, dj) in enumerate(DIRECTIONS[directions]):
        before = f"list_transform({_ALL_D}, lambda d: least(r.t[d + 1], coalesce(r.t[d], 1e300) + {p1}, coalesce(r.t[d + 2], 1e300) + {p1}, list_min(r.t) + {p2}) - list_min(r.t))"
        # What has no cell before it begins a path.
        first = " OR ".join(["x.img IS NULL"])
        starts = f"SELECT v.img, v.i, v.j, v.c FROM v LEFT JOIN v x ON x.img = v.img AND x.i = v.i - ({di}) AND x.j = v.j - ({dj}) WHERE {first}"
        step = f"SELECT v.img, v.i, v.j, list_transform({_ALL_D}, lambda d: v.c[d + 1] + b[d + 1]) FROM (SELECT r.img, r.i, r.j, {before} AS b FROM p{k} r) q JOIN v ON v.img = q.img AND v.i = q.i + ({di}) AND v.j = q.j + ({dj})"
        parts.append(f"p{k}(img, i, j, t) AS ({starts} UNION ALL {step})")
    union = " UNION ALL ".join(f"SELECT img, i, j, unnest({_ALL_D}) AS d, unnest(t) AS cost FROM p{k}" for k in range(directions))
    return _recursive(*PAIR_SQL, VOLUME_SQL, _LISTS, *parts, f"s AS (SELECT img, i, j, d, sum(cost) AS cost FROM ({union}) GROUP BY ALL)") + "SELECT img, i, j, CAST(max_by(d, struct_pack(c := -cost, d := d)) AS INT) AS d FROM s GROUP BY img, i, j"


ASSIGNMENT = """WITH RECURSIVE c AS (SELECT o_custkey % 25 AS g, o_orderkey % 6 AS a, CAST(trunc(o_orderkey / 7 % 8) AS BIGINT) AS b, min(o_totalprice) AS cost FROM orders GROUP BY ALL),
big AS (SELECT g, max(abs(cost)) * 48 + 1 AS big FROM c GROUP BY g),
m AS (SELECT g.g, a, b, cost, coalesce(cost, big) AS price FROM big g CROSS JOIN (SELECT DISTINCT a FROM c) CROSS JOIN (SELECT DISTINCT b FROM c) LEFT JOIN c USING (g, a, b)),
r(g, a, used, total, path) AS (SELECT g, -1::BIGINT, 0::BIGINT, 0.0::DOUBLE, CAST([] AS BIGINT[]) FROM big
  UNION ALL SELECT r.g, m.a, r.used | (1::BIGINT << m.b), r.total + m.price, list_append(r.path, m.b) FROM r JOIN m ON m.g = r.g AND m.a = r.a + 1 AND (r.used & (1::BIGINT << m.b)) = 0),
best AS (SELECT g, min_by(path, total) AS path FROM r WHERE a = 5 GROUP BY g)
SELECT m.g, m.a, m.b, m.cost FROM best JOIN m ON m.g = best.g AND m.b = path[m.a + 1] WHERE m.cost IS NOT NULL"""

BALANCED = """, h AS (SELECT img, list(n ORDER BY bin) AS n FROM {histogram} GROUP BY img),
s0 AS (SELECT img, n, 0::BIGINT AS lo, len(n) - 1 AS hi, (len(n) - 1) // 2 AS mid FROM h),
r(img, n, lo, hi, mid, l, x) AS (SELECT img, n, lo, hi, mid, list_sum(n[1:mid + 1]), coalesce(list_sum(n[mid + 2:]), 0) FROM s0
  UNION ALL SELECT img, n,
    CASE WHEN x > l THEN lo ELSE lo + 1 END, CASE WHEN x > l THEN hi - 1 ELSE hi END,
    CASE WHEN x > l AND (lo + hi - 1) // 2 < mid THEN mid - 1 WHEN x <= l AND (lo + 1 + hi) // 2 >= mid AND mid + 1 <= hi THEN mid + 1 ELSE mid END,
    CASE WHEN x > l THEN l - CASE WHEN (lo + hi - 1) // 2 < mid THEN n[mid + 1] ELSE 0 END ELSE l - n[lo + 1] + CASE WHEN (lo + 1 + hi) // 2 >= mid AND mid + 1 <= hi THEN n[mid + 2] ELSE 0 END END,
    CASE WHEN x > l THEN x - n[hi + 1] + CASE WHEN (lo + hi - 1) // 2 < mid THEN n[mid + 1] ELSE 0 END ELSE x - CASE WHEN (lo + 1 + hi) // 2 >= mid AND mid + 1 <= hi THEN n[mid + 2] ELSE 0 END END
  FROM r WHERE lo < hi)
SELECT img, CAST(mid AS BIGINT) AS bin FROM r WHERE lo >= hi"""

_XY = "q AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem)"
GAUSS_NEWTON = with_(_XY, "f AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM q)") + "SELECT 0::INT AS k, round(a, 6) AS value FROM f UNION ALL SELECT 1, round(b, 6) FROM f"

PCA = """WITH m AS (SELECT var_samp(l_quantity) AS a, var_samp(l_discount) AS d, var_samp(l_tax) AS f, covar_samp(l_quantity, l_discount) AS b, covar_samp(l_quantity, l_tax) AS c, covar_samp(l_discount, l_tax) AS e FROM lineitem),
q AS (SELECT *, (a + d + f) / 3 AS q FROM m), p AS (SELECT *, sqrt(((a - q) ** 2 + (d - q) ** 2 + (f - q) ** 2 + 2 * (b * b + c * c + e * e)) / 6) AS p FROM q),
r AS (SELECT q, p, least(1, greatest(-1, ((a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - c * e) + c * (b * e - c * (d - q))) / (2 * p * p * p))) AS r FROM p)
SELECT CAST(k AS INT) AS k, round(q + 2 * p * cos(acos(r) / 3 + CASE k WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE 2 END * pi() / 3), 6) AS value FROM r CROSS JOIN range(3) s(k)"""


def _vector(values: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {k}::INT AS k, round({v}, 6) + 0.0 AS value" for k, v in enumerate(values))


#: The turn and move of the second camera of the tie points, as Rodrigues' formula writes them out.
_R = (0.02, -0.05, 0.01)
_T = (-0.4, 0.1, 0.05)
_N = "sqrt(0.02 * 0.02 + 0.05 * 0.05 + 0.01 * 0.01)"
_A, _B = f"(sin({_N}) / {_N})", f"((1 - cos({_N})) / ({_N} * {_N}))"
_x, _y, _z = (f"({v})" for v in _R)
TURN = [
    f"1 - {_B} * ({_y} * {_y} + {_z} * {_z})", f"{_B} * {_x} * {_y} - {_A} * {_z}", f"{_B} * {_x} * {_z} + {_A} * {_y}", f"{_B} * {_x} * {_y} + {_A} * {_z}", f"1 - {_B} * ({_x} * {_x} + {_z} * {_z})",
    f"{_B} * {_y} * {_z} - {_A} * {_x}", f"{_B} * {_x} * {_z} - {_A} * {_y}", f"{_B} * {_y} * {_z} + {_A} * {_x}", f"1 - {_B} * ({_x} * {_x} + {_y} * {_y})",
]
_LONG = "sqrt(0.4 * 0.4 + 0.1 * 0.1 + 0.05 * 0.05)"
ESSENTIAL = _vector([*TURN, *[f"({v}) / {_LONG}" for v in _T]])
SIMILARITY = _vector(["2", *TURN, *[f"2 * ({v})" + (" + 1" if k == 0 else "") for k, v in enumerate(_T)]])
PNP = with_(POINTS_SQL, "v AS (SELECT pt % 10 AS g, count(*) AS n FROM points GROUP BY 1)") + f"SELECT g, {_T[0]}::DOUBLE AS t0, {_T[1]}::DOUBLE AS t1, {_T[2]}::DOUBLE AS t2 FROM v WHERE n >= 4"

_DRAWN = [
    "q AS (SELECT l_suppkey AS g, l_quantity AS x, l_extendedprice / 1000 AS y, l_orderkey * 100 + l_linenumber AS k FROM lineitem)",
    "o AS (SELECT g, x, y, k, t, (k % 2147483647 + t * 7919 + 7 * 104729) * 2654435761 % 4294967296 AS h FROM q CROSS JOIN range(20) r(t))",
    "d AS (SELECT g, x, y, k, t, xor(h, h >> 16) * 40503 % 4294967296 AS h FROM o)",
    "e AS (SELECT g, t, min(struct_pack(h := h, x := x, y := y)) AS p, max(struct_pack(h := h, x := x, y := y)) AS q FROM d GROUP BY g, t)",
    "l AS (SELECT g, t, (q.y - p.y) / (q.x - p.x) AS a, p.y - (q.y - p.y) / (q.x - p.x) * p.x AS b FROM e WHERE q.x <> p.x)",
]
RANSAC = with_(*_DRAWN, "n AS (SELECT l.g, t, a, b, count(*) FILTER (WHERE abs(y - a * x - b) < 5) AS inliers FROM q JOIN l ON l.g = q.g GROUP BY ALL)") + (
    "SELECT g, round(a, 6) AS slope, round(b, 6) AS intercept, inliers FROM n QUALIFY row_number() OVER (PARTITION BY g ORDER BY inliers DESC, t) = 1"
)
LMEDS = with_(*_DRAWN, "n AS (SELECT l.g, t, a, b, quantile_disc((y - a * x - b) ** 2, 0.5) AS median FROM q JOIN l ON l.g = q.g GROUP BY ALL)") + (
    "SELECT g, round(a, 6) AS slope, round(b, 6) AS intercept, round(median, 6) AS median FROM n QUALIFY row_number() OVER (PARTITION BY g ORDER BY median, t) = 1"
)

MEAN_SHIFT = _recursive(
    POINTS_SQL,
    """s(pt, x, y, z, done) AS (SELECT pt, x, y, z, false FROM points
  UNION ALL SELECT pt, nx, ny, nz, sqrt((nx - x) ** 2 + (ny - y) ** 2 + (nz - z) ** 2) <= 1e-3 FROM (
    SELECT s.pt, s.x, s.y, s.z, avg(p.x) AS nx, avg(p.y) AS ny, avg(p.z) AS nz FROM s JOIN points p ON (s.x - p.x) ** 2 + (s.y - p.y) ** 2 + (s.z - p.z) ** 2 <= 6400 WHERE NOT s.done GROUP BY s.pt, s.x, s.y, s.z))""",
) + "SELECT pt, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM s WHERE done"

#: Twenty rounds of weighted regression, as the fit takes at most.
GAUSS_NEWTON_HUBER = _recursive(
    _XY,
    """s(k, a, b) AS (SELECT 0, 1.0::DOUBLE, 0.0::DOUBLE
  UNION ALL SELECT k + 1, (sw * sxy - sx * sy) / (sw * sxx - sx * sx), (sxx * sy - sx * sxy) / (sw * sxx - sx * sx) FROM (
    SELECT k, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy
    FROM (SELECT k, x, y, CASE WHEN abs(a * x + b - y) <= 5 THEN 1 ELSE 5 / abs(a * x + b - y) END AS w FROM s CROSS JOIN q WHERE k < 20) GROUP BY k))""",
) + "SELECT 0::INT AS k, round(a, 6) AS value FROM s WHERE k = 20 UNION ALL SELECT 1, round(b, 6) FROM s WHERE k = 20"


def _rectify() -> str:
    """The common frame: its x along the baseline, its z the mean of both views' parts across it."""
    cells = ", ".join(f"{v} AS r{k}" for k, v in enumerate(TURN))
    base = ", ".join(f"0 - (r{k} * {_T[0]} + r{3 + k} * {_T[1]} + r{6 + k} * {_T[2]}) AS b{k}" for k in range(3))
    unit = lambda n, names: ", ".join(f"{n}{k} / sqrt({n}0 ** 2 + {n}1 ** 2 + {n}2 ** 2) AS {m}{k}" for k, m in enumerate([names] * 3))
    first = ", ".join(f"CASE {k} WHEN 2 THEN 1 ELSE 0 END - x2 * x{k} AS p{k}" for k in range(3))
    second = ", ".join(f"r{6 + k} - (r6 * x0 + r7 * x1 + r8 * x2) * x{k} AS q{k}" for k in range(3))
    total = ", ".join(f"p{k} / sqrt(p0 ** 2 + p1 ** 2 + p2 ** 2) + q{k} / sqrt(q0 ** 2 + q1 ** 2 + q2 ** 2) AS s{k}" for k in range(3))
    rows = [["x0", "x1", "x2"], ["z1 * x2 - z2 * x1", "z2 * x0 - z0 * x2", "z0 * x1 - z1 * x0"], ["z0", "z1", "z2"]]
    values = [c for row in rows for c in row] + [" + ".join(f"({row[k]}) * r{3 * c + k}" for k in range(3)) for row in rows for c in range(3)]
    listed = ", ".join(values)
    return with_(f"r AS (SELECT {cells})", f"b AS (SELECT *, {base} FROM r)", f"x AS (SELECT *, {unit('b', 'x')} FROM b)", f"v AS (SELECT *, {first}, {second} FROM x)", f"t AS (SELECT *, {total} FROM v)", f"z AS (SELECT *, {unit('s', 'z')} FROM t)") + (
        f"SELECT CAST(k AS INT) AS k, round(l[k + 1], 6) + 0.0 AS value FROM (SELECT [{listed}] AS l FROM z) CROSS JOIN range(18) i(k)"
    )


RECTIFY = _rectify()

CHECKERBOARD = with_(
    CELLS, around_sql("nb", 1, 1),
    "h AS (SELECT img, i, j, sum(CASE WHEN dj = 0 THEN (3 * di * di - 2) * v ELSE 0 END) AS yy, sum(CASE WHEN di = 0 THEN (3 * dj * dj - 2) * v ELSE 0 END) AS xx, sum(di * dj * v) / 4 AS xy FROM nb GROUP BY img, i, j)",
    "det AS (SELECT img, i, j, xx * yy - xy * xy AS value, (xx + yy) / 2 - sqrt(((xx - yy) / 2) ** 2 + xy * xy) AS lo, (xx + yy) / 2 + sqrt(((xx - yy) / 2) ** 2 + xy * xy) AS hi FROM h)",
    around_sql("near", 1, 1, "det"), "least_ AS (SELECT img, i, j, min(v) AS m FROM near GROUP BY img, i, j)",
) + "SELECT d.img, d.i, d.j, d.value FROM det d JOIN least_ USING (img, i, j) WHERE lo <= -10 AND hi >= 10 AND d.value = m"
