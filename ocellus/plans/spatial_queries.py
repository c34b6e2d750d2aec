"""Queries over points, boxes, graphs, geometry, attributes and streams of rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ocellus.functions import geometry as g
from ocellus.functions import kernels
from ocellus.operators import attributes, graphs, solve, spatial
from ocellus.plans.registry import Registry, with_
from ocellus.plans.standins import EDGES_SQL, POINTS_SQL, edges, points, raster, raster_sql, table
from ocellus.plans.stereo_queries import PAIR_SQL, VOLUME_SQL, WIN_SQL, _volume
from ocellus.operators import volumes

R = Registry()
CELLS = raster_sql()
D2 = "((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"


def _r(c):
    return F.round(c, 6)


R.add("box_query", lambda s, d: spatial.box(points(s, d), {"x": -100, "y": -100, "z": -100}, {"x": 100, "y": 100, "z": 100}), with_(POINTS_SQL) + "SELECT * FROM points WHERE x BETWEEN -100 AND 100 AND y BETWEEN -100 AND 100 AND z BETWEEN -100 AND 100")
R.add(
    "nearest",
    lambda s, d: spatial.nearest(points(s, d), points(s, d), 60.0, 2000.0),
    (
        with_(
            POINTS_SQL,
            f"p AS (SELECT a.pt, b.pt AS nearest, {D2} AS d2, row_number() OVER (PARTITION BY a.pt ORDER BY {D2}, b.pt) AS k FROM points a JOIN points b ON a.pt <> b.pt)",
        )
        + "SELECT pt, nearest, d2 FROM p WHERE k = 1"
    ),
)
R.add("nearest_in_box", lambda s, d: spatial.nearest_in_box(points(s, d), points(s, d), 40.0).select("pt", F.coalesce("nearest", F.lit(-1).cast("bigint")).alias("nearest"), F.coalesce("d2", F.lit(-1.0)).alias("d2")), with_(POINTS_SQL, f"p AS (SELECT a.pt, b.pt AS nearest, {D2} AS d2, row_number() OVER (PARTITION BY a.pt ORDER BY {D2}, b.pt) AS k FROM points a JOIN points b ON a.pt <> b.pt AND abs(a.x - b.x) <= 40 AND abs(a.y - b.y) <= 40 AND abs(a.z - b.z) <= 40)") +
      "SELECT points.pt, coalesce(nearest, -1) AS nearest, coalesce(d2, -1) AS d2 FROM points LEFT JOIN p ON p.pt = points.pt AND k = 1")


def _boxes(s, d):
    p = points(s, d)
    return p.groupBy(F.col("cluster").cast("bigint").alias("box")).agg(*[F.expr(f"avg({c}) - 60").alias(f"{c}0") for c in "xyz"], *[F.expr(f"avg({c}) + 60").alias(f"{c}1") for c in "xyz"])


_BOXES = "boxes AS (SELECT CAST(cluster AS BIGINT) AS box, " + ", ".join(f"avg({c}) - 60 AS {c}0, avg({c}) + 60 AS {c}1" for c in "xyz") + " FROM points GROUP BY cluster)"
_IN = " AND ".join(f"{c} BETWEEN {c}0 AND {c}1" for c in "xyz")
R.add("bvh_contains", lambda s, d: spatial.containing(_boxes(s, d), points(s, d), 50.0), with_(POINTS_SQL, _BOXES) + f"SELECT pt, box FROM points JOIN boxes ON {_IN}")
R.add("bvh_any", lambda s, d: spatial.in_any(_boxes(s, d), points(s, d), 50.0), with_(POINTS_SQL, _BOXES) + f"SELECT * FROM points WHERE EXISTS (SELECT 1 FROM boxes WHERE {_IN})")


def _rays(s, d):
    p = points(s, d)
    return p.select(F.col("pt").alias("ray"), *[(F.col(c) * 3).alias(f"o{c}") for c in "xyz"], *[(-F.col(c)).alias(f"d{c}") for c in "xyz"])


_RAYS = "rays AS (SELECT pt AS ray, x * 3 AS ox, y * 3 AS oy, z * 3 AS oz, -x AS dx, -y AS dy, -z AS dz FROM points)"
_slab = ", ".join(f"CASE WHEN d{c} = 0 THEN (CASE WHEN o{c} BETWEEN {c}0 AND {c}1 THEN -1e300 ELSE 1e300 END) ELSE least(({c}0 - o{c}) / d{c}, ({c}1 - o{c}) / d{c}) END AS n{c}, CASE WHEN d{c} = 0 THEN (CASE WHEN o{c} BETWEEN {c}0 AND {c}1 THEN 1e300 ELSE -1e300 END) ELSE greatest(({c}0 - o{c}) / d{c}, ({c}1 - o{c}) / d{c}) END AS f{c}" for c in "xyz")
R.add(
    "ray_first_hit",
    lambda s, d: spatial.first_hit(_boxes(s, d), _rays(s, d)).select("ray", "box", _r("t").alias("t")),
    (
        with_(
            POINTS_SQL,
            _BOXES,
            _RAYS,
            f"h AS (SELECT ray, box, {_slab} FROM rays CROSS JOIN boxes)",
            "k AS (SELECT ray, box, greatest(nx, ny, nz, 0) AS t, least(fx, fy, fz) AS t1 FROM h)",
            "o AS (SELECT *, row_number() OVER (PARTITION BY ray ORDER BY t, box) AS n FROM k WHERE t <= t1)",
        )
        + "SELECT ray, box, round(t, 6) AS t FROM o WHERE n = 1"
    ),
)
R.add(
    "context_split",
    lambda s, d: spatial.with_context(points(s, d), 50.0),
    (
        with_(POINTS_SQL)
        + (
            f"SELECT cluster AS set, pt, true AS member FROM points WHERE cluster > 0 UNION ALL SELECT DISTINCT b.cluster, a.pt, false FROM points a JOIN "
            f"points b ON b.cluster > 0 AND a.cluster <> b.cluster AND {D2} <= 2500"
        )
    ),
)
R.add(
    "raster_nearest",
    lambda s, d: spatial.raster_nearest(points(s, d), 20.0, 8),
    (
        with_(
            POINTS_SQL,
            (
                "w AS (SELECT pt, x / 20 AS x, y / 20 AS y, CAST(floor(y / 20) AS BIGINT) + a AS i, CAST(floor(x / 20) AS BIGINT) + b AS j FROM points CROSS "
                "JOIN (SELECT unnest(range(-8, 9)) AS a) CROSS JOIN (SELECT unnest(range(-8, 9)) AS b))"
            ),
            (
                "k AS (SELECT i, j, pt, row_number() OVER (PARTITION BY i, j ORDER BY round((x - j - 0.5) ** 2 + (y - i - 0.5) ** 2, 9), pt) AS n FROM w WHERE "
                "(x - j - 0.5) ** 2 + (y - i - 0.5) ** 2 <= 64)"
            ),
        )
        + "SELECT i, j, pt FROM k WHERE n = 1"
    ),
)
R.add(
    "raster_zbuffer",
    lambda s, d: spatial.depth_layers(points(s, d), 64.0, 2).select("i", "j", "layer", "z", "pt"),
    (
        with_(
            POINTS_SQL,
            "c AS (SELECT CAST(round(y / 64) AS BIGINT) AS i, CAST(round(x / 64) AS BIGINT) AS j, z, min(pt) AS pt FROM points GROUP BY ALL)",
            "k AS (SELECT *, CAST(row_number() OVER (PARTITION BY i, j ORDER BY z DESC) - 1 AS INT) AS layer FROM c)",
        )
        + "SELECT i, j, layer, z, pt FROM k WHERE layer < 2"
    ),
)
_cub = "(CASE WHEN abs({0}) <= 1 THEN 1.5 * abs({0}) ** 3 - 2.5 * abs({0}) ** 2 + 1 ELSE -0.5 * abs({0}) ** 3 + 2.5 * abs({0}) ** 2 - 4 * abs({0}) + 2 END)"
R.add("detrend", lambda s, d: spatial.detrend(points(s, d), 64.0).select("pt", F.round("height", 3).alias("height")), with_(POINTS_SQL, "seen AS (SELECT CAST(floor(y / 64) AS INT) AS i, CAST(floor(x / 64) AS INT) AS j, min(z) AS v FROM points GROUP BY ALL)",
      "grid AS (SELECT i, j FROM (SELECT unnest(range((SELECT min(i) FROM seen), (SELECT max(i) + 1 FROM seen))) AS i) CROSS JOIN (SELECT unnest(range((SELECT min(j) FROM seen), (SELECT max(j) + 1 FROM seen))) AS j))",
      "low AS (SELECT g.i, g.j, v FROM grid g CROSS JOIN seen s QUALIFY row_number() OVER (PARTITION BY g.i, g.j ORDER BY (s.i - g.i) ** 2 + (s.j - g.j) ** 2, s.i, s.j) = 1)", "q AS (SELECT pt, z, y / 64 - 0.5 AS y, x / 64 - 0.5 AS x FROM points)") +
      f"SELECT pt, round(any_value(z) - coalesce(sum({_cub.format('(y - i)')} * {_cub.format('(x - j)')} * v), 0), 3) AS height FROM q LEFT JOIN low ON abs(y - i) < 2 AND abs(x - j) < 2 GROUP BY pt")


def _holes(s, d):
    return raster(s, d).withColumn("value", F.when((F.col("i") * 7 + F.col("j") * 3) % 5 != 0, F.col("value")))


R.add("inpaint_nearest", lambda s, d: spatial.inpaint_nearest(_holes(s, d), 3), with_(CELLS, "h AS (SELECT img, i, j, CASE WHEN (i * 7 + j * 3) % 5 <> 0 THEN value END AS value FROM cells)",
      "f AS (SELECT u.img, u.i, u.j, k.value, row_number() OVER (PARTITION BY u.img, u.i, u.j ORDER BY (k.i - u.i) ** 2 + (k.j - u.j) ** 2, k.i, k.j) AS n FROM h u JOIN h k ON k.img = u.img AND abs(k.i - u.i) <= 3 AND abs(k.j - u.j) <= 3 AND u.value IS NULL AND k.value IS NOT NULL)") +
      "SELECT h.img, h.i, h.j, coalesce(h.value, f.value) AS value FROM h LEFT JOIN f ON f.img = h.img AND f.i = h.i AND f.j = h.j AND n = 1")
R.add("covering", lambda s, d: spatial.covering(volumes.disparity(_volume()(s, d)).withColumn("disparity", F.col("disparity") * 0.5), 0.5).select("img", _r("covered").alias("covered")),
      with_(*PAIR_SQL, VOLUME_SQL, WIN_SQL, "t AS (SELECT img, i, CAST(floor(j - d * 0.5) AS INT) AS j, floor(j - d * 0.5) + 1 - (j - d * 0.5) AS w FROM win UNION ALL SELECT img, i, CAST(floor(j - d * 0.5) AS INT) + 1, j - d * 0.5 - floor(j - d * 0.5) FROM win)", "h AS (SELECT img, i, j, sum(w) AS w FROM t GROUP BY ALL)") +
      "SELECT c.img, round(avg(CASE WHEN coalesce(w, 0) >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS covered FROM win c LEFT JOIN h ON h.img = c.img AND h.i = c.i AND h.j = c.j GROUP BY c.img")

R.add("degree", lambda s, d: graphs.degrees(edges(s, d)), with_(EDGES_SQL) + "SELECT node, count(*) AS degree, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT u AS node, w FROM edges UNION ALL SELECT v, w FROM edges) GROUP BY node")
R.add("edge_index", lambda s, d: graphs.edge_index(edges(s, d)), with_(EDGES_SQL, "b AS (SELECT u AS node, v AS other FROM edges UNION ALL SELECT v, u FROM edges)") + "SELECT node, other, CAST(row_number() OVER (PARTITION BY node ORDER BY other) - 1 AS INT) AS k FROM b")
R.add(
    "edge_lookup",
    lambda s, d: graphs.lookup(edges(s, d), table(s, d, "orders").select((-1 - F.col("o_custkey") % 10).alias("a"), (F.col("o_orderkey") % 200).alias("b"))).select("a", "b", F.coalesce("w", F.lit(0).cast("bigint")).alias("w")),
    with_(EDGES_SQL) + "SELECT a, b, coalesce(w, 0) AS w FROM (SELECT -1 - o_custkey % 10 AS a, o_orderkey % 200 AS b FROM orders) q LEFT JOIN edges ON (u = b AND v = a)",
)


def _reach(s, d):
    e = edges(s, d)
    return graphs.reachable(e, e.where("w < 2"), table(s, d, "supplier").agg((-1 - F.min("s_suppkey")).alias("node")))


R.add("reachable_without_cut", _reach, "WITH RECURSIVE " + EDGES_SQL + """, kept AS (SELECT u, v FROM edges WHERE w >= 2 UNION SELECT v, u FROM edges WHERE w >= 2),
seen(node) AS (SELECT -1 - min(s_suppkey) FROM supplier UNION SELECT k.v FROM seen s JOIN kept k ON k.u = s.node) SELECT node FROM seen""")
R.add("graph_components", lambda s, d: graphs.components(edges(s, d).where("w > 2")), "WITH RECURSIVE " + EDGES_SQL + """, e AS (SELECT u, v FROM edges WHERE w > 2), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r(a, z) AS (SELECT u, u FROM b UNION SELECT r.a, b.v FROM r JOIN b ON b.u = r.z) SELECT a AS node, min(z) AS component FROM r GROUP BY a""")
_MASKED = "m AS (SELECT img, i, j, i * 1048576 + j AS k FROM cells WHERE value > 32)"
R.add("components", lambda s, d: graphs.mask_components(raster(s, d).where("value > 32")), "WITH RECURSIVE " + CELLS + f""", {_MASKED},
r(img, i, j, z) AS (SELECT img, i, j, k FROM m UNION SELECT r.img, n.i, n.j, r.z FROM r JOIN m n ON n.img = r.img AND abs(n.i - r.i) + abs(n.j - r.j) = 1) SELECT img, i, j, CAST(min(z) AS BIGINT) AS label FROM r GROUP BY img, i, j""")


def _stats(s, d):
    c = raster(s, d)
    return attributes.component_stats(graphs.mask_components(c.where("value > 32")).join(c, ["img", "i", "j"]))


R.add("component_stats", _stats, "WITH RECURSIVE " + CELLS + f""", {_MASKED}, r(img, i, j, z) AS (SELECT img, i, j, k FROM m UNION SELECT r.img, n.i, n.j, r.z FROM r JOIN m n ON n.img = r.img AND abs(n.i - r.i) + abs(n.j - r.j) = 1),
l AS (SELECT img, i, j, min(z) AS label FROM r GROUP BY img, i, j), a AS (SELECT l.img, label, count(*) AS n, avg(l.i) AS ci, avg(l.j) AS cj, avg(value) AS mean_value, var_pop(l.i) AS vi, var_pop(l.j) AS vj, covar_pop(l.i, l.j) AS vij FROM l JOIN cells c ON c.img = l.img AND c.i = l.i AND c.j = l.j GROUP BY l.img, label)
SELECT img, CAST(label AS BIGINT) AS label, n, round(ci, 6) AS ci, round(cj, 6) AS cj, round(mean_value, 6) AS mean_value, round((vi + vj) / 2 + sqrt(((vi - vj) / 2) ** 2 + vij * vij), 6) AS major, round((vi + vj) / 2 - sqrt(((vi - vj) / 2) ** 2 + vij * vij), 6) + 0.0 AS minor FROM a""")


def _faces(s, d):
    """Two triangles for each square of nodes on the grid of suppliers and nations."""
    k = F.col("s_suppkey")
    p = lambda a, b: ((k + a) * 1000 + F.col("s_nationkey") * 0 + b).cast("bigint")
    t = table(s, d, "supplier")
    return t.select((2 * k).alias("face"), F.array(p(0, 0), p(1, 0), p(1, 1)).alias("corners")).unionByName(t.select((2 * k + 1).alias("face"), F.array(p(0, 0), p(1, 1), p(0, 1)).alias("corners")))


R.add("half_edge_twin", lambda s, d: graphs.twins(graphs.polygon_edges(_faces(s, d), 16)).select("edge", F.coalesce("twin", F.lit(-1).cast("bigint")).alias("twin")), """WITH f AS (SELECT 2 * s_suppkey AS face, [s_suppkey * 1000, (s_suppkey + 1) * 1000, (s_suppkey + 1) * 1000 + 1] AS c FROM supplier
UNION ALL SELECT 2 * s_suppkey + 1, [s_suppkey * 1000, (s_suppkey + 1) * 1000 + 1, s_suppkey * 1000 + 1] FROM supplier),
e AS (SELECT face * 16 + k AS edge, c[k + 1] AS a, c[(k + 1) % 3 + 1] AS b FROM f CROSS JOIN range(3) r(k)) SELECT x.edge, coalesce(y.edge, -1) AS twin FROM e x LEFT JOIN e y ON y.a = x.b AND y.b = x.a""")


#: Every cut of the seven inner nodes; the least one is the greatest flow.
MAX_FLOW = """WITH o AS (SELECT o_custkey % 50 AS g, o_orderkey % 4 AS mid, 10 + o_custkey % 3 AS last, CAST(floor(o_totalprice / 50000) AS DOUBLE) AS w FROM orders),
e AS (SELECT g, -1 AS u, mid AS v, w FROM o UNION ALL SELECT g, mid, last, w / 2 FROM o UNION ALL SELECT g, last, -2, w FROM o),
w AS (SELECT g, u, v, sum(w) AS w FROM e GROUP BY ALL),
place(node, bit) AS (VALUES (0, 1), (1, 2), (2, 4), (3, 8), (10, 16), (11, 32), (12, 64)),
cuts AS (SELECT w.g, s, sum(CASE WHEN (u = -1 OR (s & coalesce(a.bit, 0)) > 0) AND (v = -2 OR (s & coalesce(b.bit, 0)) = 0) THEN w ELSE 0 END) AS cut
  FROM w LEFT JOIN place a ON a.node = u LEFT JOIN place b ON b.node = v CROSS JOIN range(128) r(s) GROUP BY w.g, s)
SELECT g, min(cut) AS flow FROM cuts GROUP BY g"""


def _flow_edges(s, d):
    o = table(s, d, "orders")
    g_ = (F.col("o_custkey") % 50).alias("g")
    mid, last = (F.col("o_orderkey") % 4), 10 + F.col("o_custkey") % 3
    w = F.floor(F.col("o_totalprice") / 50000).cast("double")
    rows = o.select(g_, F.lit(-1).cast("bigint").alias("u"), mid.alias("v"), w.alias("w")).unionByName(o.select(g_, mid.alias("u"), last.alias("v"), (w / 2).alias("w"))).unionByName(o.select(g_, last.alias("u"), F.lit(-2).cast("bigint").alias("v"), w.alias("w")))
    return rows.groupBy("g", "u", "v").agg(F.sum("w").alias("w"))


R.add("max_flow", lambda s, d: graphs.max_flow(_flow_edges(s, d)).select("g", "flow"), MAX_FLOW)

_P = "SELECT pt, x / 100 AS x, y / 100 AS y, z / 100 + 8 AS z FROM points"


def _geo(build):
    def run(s, d):
        p = points(s, d).select("pt", *[(F.col(c) / 100).alias(c) for c in "xy"], (F.col("z") / 100 + 8).alias("z"))
        out = build(g.vec(F.col("x") / 10, F.col("y") / 10, (F.col("z") - 8) / 10), g.vec(*[F.col(c) for c in "xyz"]))
        return p.select("pt", *[(F.round(c, 5) + 0.0).alias(n) for n, c in out.items()])

    return run


def _named(prefix, array, n=3):
    return {f"{prefix}{k}": g.at(array, k) for k in range(n)}


_GEO = with_(POINTS_SQL, f"p AS ({_P})", "r AS (SELECT pt, x, y, z, x / 10 AS rx, y / 10 AS ry, (z - 8) / 10 AS rz, sqrt((x / 10) ** 2 + (y / 10) ** 2 + ((z - 8) / 10) ** 2) AS th FROM p)",
             "k AS (SELECT *, CASE WHEN th < 1e-8 THEN 1 ELSE sin(th) / th END AS a, CASE WHEN th < 1e-8 THEN 0.5 ELSE (1 - cos(th)) / (th * th) END AS b FROM r)")
_ROT = ["1 - b * (ry * ry + rz * rz)", "b * rx * ry - a * rz", "b * rx * rz + a * ry", "b * rx * ry + a * rz", "1 - b * (rx * rx + rz * rz)", "b * ry * rz - a * rx", "b * rx * rz - a * ry", "b * ry * rz + a * rx", "1 - b * (rx * rx + ry * ry)"]


def _geo_sql(columns):
    return _GEO + "SELECT pt, " + ", ".join(f"round({c}, 5) + 0.0 AS {n}" for n, c in columns.items()) + " FROM k"


R.add("rodrigues", _geo(lambda r, v: _named("m", g.rodrigues(r), 9)), _geo_sql({f"m{k}": c for k, c in enumerate(_ROT)}))
R.add("rodrigues_inverse", _geo(lambda r, v: _named("r", g.inverse_rodrigues(g.rodrigues(r)))), _geo_sql({"r0": "rx", "r1": "ry", "r2": "rz"}))
R.add("quaternion", _geo(lambda r, v: _named("q", g.quaternion(r), 4)), _geo_sql({"q0": "cos(th / 2)", **{f"q{k + 1}": f"r{c} * CASE WHEN th < 1e-8 THEN 0.5 ELSE sin(th / 2) / th END" for k, c in enumerate("xyz")}}))
R.add("quaternion_inverse", _geo(lambda r, v: _named("r", g.from_quaternion(g.quaternion(r)))), _geo_sql({"r0": "rx", "r1": "ry", "r2": "rz"}))
R.add("euler", _geo(lambda r, v: {**_named("m", g.euler(*[g.at(r, k) for k in range(3)]), 9), **g.to_euler_zyx(g.euler(*[g.at(r, k) for k in range(3)]))}), _geo_sql({
    "m0": "cos(rz) * cos(ry)", "m1": "cos(rz) * sin(ry) * sin(rx) - sin(rz) * cos(rx)", "m2": "cos(rz) * sin(ry) * cos(rx) + sin(rz) * sin(rx)", "m3": "sin(rz) * cos(ry)", "m4": "sin(rz) * sin(ry) * sin(rx) + cos(rz) * cos(rx)",
    "m5": "sin(rz) * sin(ry) * cos(rx) - cos(rz) * sin(rx)", "m6": "-sin(ry)", "m7": "cos(ry) * sin(rx)", "m8": "cos(ry) * cos(rx)", "ex": "rx", "ey": "ry", "ez": "rz"}))


def _composed(r, v):
    m, t, _ = g.compose(g.rodrigues(r), v, g.axis_rotation(2, F.lit(0.5)), g.vec(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return {**_named("m", m, 9), **_named("t", t)}


_c, _s = "cos(0.5)", "sin(0.5)"
R.add("rigid_compose", _geo(_composed), _geo_sql({**{f"m{3 * i}": f"({_ROT[3 * i]}) * {_c} + ({_ROT[3 * i + 1]}) * {_s}" for i in range(3)}, **{f"m{3 * i + 1}": f"({_ROT[3 * i + 1]}) * {_c} - ({_ROT[3 * i]}) * {_s}" for i in range(3)}, **{f"m{3 * i + 2}": _ROT[3 * i + 2] for i in range(3)},
      **{f"t{i}": f"({_ROT[3 * i]}) + 2 * ({_ROT[3 * i + 1]}) + 3 * ({_ROT[3 * i + 2]}) + {'xyz'[i]}" for i in range(3)}}))
R.add("rigid_inverse", _geo(lambda r, v: _named("t", g.inverse(g.rodrigues(r), v)[1])), _geo_sql({f"t{i}": f"-(({_ROT[i]}) * x + ({_ROT[3 + i]}) * y + ({_ROT[6 + i]}) * z)" for i in range(3)}))
R.add("pose_interpolate", _geo(lambda r, v: _named("r", g.interpolate(r, v, g.scale(r, 1.5), v, 0.5)[0])), _geo_sql({"r0": "rx * 1.25", "r1": "ry * 1.25", "r2": "rz * 1.25"}))
R.add("project", _geo(lambda r, v: g.project(v)), _geo_sql({"px": "x / z", "py": "y / z"}))
R.add(
    "triangulate",
    _geo(
        lambda r, v: _named("p", g.triangulate(g.at(v, 0) / g.at(v, 2), g.at(v, 1) / g.at(v, 2), (g.at(v, 0) - 1) / g.at(v, 2), g.at(v, 1) / g.at(v, 2), F.array(*[F.lit(float(k % 4 == 0)) for k in range(9)]), g.vec(F.lit(-1.0), F.lit(0.0), F.lit(0.0)))),
    ),
    _geo_sql({"p0": "x", "p1": "y", "p2": "z"}),
)
_LENS = ((-0.1, 0.02, 0.0), (0.001, -0.002))
R.add(
    "lens_forward",
    _geo(lambda r, v: g.distort(g.at(r, 0), g.at(r, 1), *_LENS)),
    _geo_sql(
        {"dx": "rx * (1 + (rx * rx + ry * ry) * (-0.1 + (rx * rx + ry * ry) * 0.02)) + 0.002 * rx * ry - 0.002 * (3 * rx * rx + ry * ry)", "dy": "ry * (1 + (rx * rx + ry * ry) * (-0.1 + (rx * rx + ry * ry) * 0.02)) + 0.001 * (rx * rx + 3 * ry * ry) - 0.004 * rx * ry"},
    ),
)


def _undone(r, v):
    d = g.distort(g.at(r, 0) / 2, g.at(r, 1) / 2, *_LENS)
    return g.undistort(d["dx"], d["dy"], *_LENS)


R.add("lens_inverse", _geo(_undone), _geo_sql({"ux": "rx / 2", "uy": "ry / 2"}))
R.add("frame_convert", _geo(lambda r, v: _named("b", g.change_frame(v, "camera", "body"))), _geo_sql({"b0": "z", "b1": "x", "b2": "y"}))
R.add("image_normalise", _geo(lambda r, v: g.image_to_normalised(g.at(v, 0), g.at(v, 1), 50.0, 48, 32, "top_left")), _geo_sql({"nx": "(x - 0.5 - 23.5) / 50", "ny": "(y - 0.5 - 15.5) / 50"}))


def _speed(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.select("event_id", (F.col("value") / 200).alias("a"), F.lag(F.col("value") / 200).over(own).alias("b"), (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(own))).cast("double").alias("us"))
    z = F.lit(0.0)
    speed = g.rotation_speed(g.vec(z, z, F.col("b")), g.vec(z, z, F.col("a")), F.col("us") / 1e9)
    return rows.where("b IS NOT NULL AND us > 0").select("event_id", (F.round(g.at(speed, 2), 4) + 0.0).alias("speed"))


R.add(
    "rotation_speed",
    _speed,
    (
        "WITH l AS (SELECT event_id, value / 200 AS a, lag(value / 200) OVER w AS b, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS us FROM events WINDOW "
        "w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, round((a - b) / (us / 1e9), 4) + 0.0 AS speed FROM l WHERE b IS NOT NULL "
        "AND us > 0"
    ),
)
_XY = "SELECT CAST(l_suppkey AS BIGINT) AS g, l_quantity AS x1, l_discount * 100 AS x2, l_extendedprice / 1000 AS y FROM lineitem"
R.add(
    "least_squares",
    lambda s, d: solve.line_fit(table(s, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))).select("g", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept")),
    f"WITH q AS ({_XY}) SELECT g, round(regr_slope(y, x1), 5) AS slope, round(regr_intercept(y, x1), 5) AS intercept FROM q GROUP BY g",
)
_k = "SELECT event_id, round({0}, 6) AS rho FROM events"
for _n, _f, _q in (("huber", kernels.huber, "CASE WHEN value <= 50 THEN value * value / 2 ELSE 50 * (value - 25) END"), ("pseudo_huber", kernels.pseudo_huber, "2500 * (sqrt(1 + (value / 50) ** 2) - 1)"), ("sqrt_huber", kernels.sqrt_huber, "sqrt(CASE WHEN value <= 50 THEN value * value / 2 ELSE 50 * (value - 25) END)")):
    R.add(_n, lambda s, d, f=_f: table(s, d, "events").select("event_id", _r(f(F.col("value"), 50.0)).alias("rho")), _k.format(_q))
R.add("huber_derivative", lambda s, d: table(s, d, "events").select("event_id", _r(kernels.huber_derivative(F.col("value"), 50.0)).alias("rho")), _k.format("least(value, 50)"))
for _n, _nu, _q in (("matern12", 0.5, "exp(0 - value / 80)"), ("matern32", 1.5, "(1 + sqrt(3) * value / 80) * exp(0 - sqrt(3) * value / 80)"), ("matern52", 2.5, "(1 + sqrt(5) * value / 80 + 5 * value * value / 19200) * exp(0 - sqrt(5) * value / 80)")):
    R.add(_n, lambda s, d, nu=_nu: table(s, d, "events").select("event_id", _r(kernels.matern(F.col("value"), 80.0, nu)).alias("rho")), _k.format(_q))
R.add("choose_index", lambda s, d: kernels.choose_indices(s, 7, 3), """SELECT CAST(row_number() OVER (ORDER BY a, b, c) - 1 AS BIGINT) AS k, a, b, c FROM (SELECT x AS a, y AS b, z AS c FROM range(7) p(x), range(7) q(y), range(7) r(z) WHERE x < y AND y < z)""")
R.add("attr_rename", lambda s, d: attributes.rename(table(s, d, "part"), {"p_partkey": "id", "p_size": "extent"}, only=True), "SELECT p_partkey AS id, p_size AS extent FROM part")
R.add("attr_drop", lambda s, d: attributes.drop(table(s, d, "part"), ["p_type", "p_brand", "absent"]), "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
R.add(
    "attr_cast",
    lambda s, d: attributes.cast(table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), {"o_totalprice": "int", "o_orderstatus": "double", "o_orderkey": "string"}),
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(trunc(o_totalprice) AS INT) AS o_totalprice, TRY_CAST(o_orderstatus AS DOUBLE) AS o_orderstatus FROM orders",
)
R.add(
    "union_members",
    lambda s, d: attributes.union([table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")), table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))]),
    "SELECT s_suppkey AS id, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer",
)
R.add(
    "packed_rgb",
    lambda s, d: table(s, d, "part").select("p_partkey", *[c.cast("int").alias(n) for n, c in attributes.unpack_argb(F.col("p_partkey") * 65793 + 255).items()]),
    (
        "SELECT p_partkey, CAST(((p_partkey * 65793 + 255) >> 16) & 255 AS INT) AS r, CAST(((p_partkey * 65793 + 255) >> 8) & 255 AS INT) AS g, CAST((p_partkey "
        "* 65793 + 255) & 255 AS INT) AS b, CAST(((p_partkey * 65793 + 255) >> 24) & 255 AS INT) AS a FROM part"
    ),
)
R.add("las_scale_nan", lambda s, d: table(s, d, "part").select("p_partkey", _r(attributes.las_position(F.when(F.col("p_size") == 1, 2147483647).otherwise(F.col("p_size")), 0.01, 5.0)).alias("x")), "SELECT p_partkey, CASE WHEN p_size <> 1 THEN round(p_size * 0.01 + 5, 6) END AS x FROM part")
