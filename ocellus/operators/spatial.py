"""Nearest, containing and ray queries over points and boxes, by grid-keyed joins.

A point has the key of its grid cell; a query asks for the cells that it can
reach, so joins are equi-joins whatever the data's size. Distances are squared
until they are returned. Cells that are hot are skewed keys of an inner or left
join, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("bigint")


def _d2(a: str, b: str) -> Column:
    out = F.lit(0.0)
    for c in XYZ:
        out = out + (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}"))
    return out


def box(points: DataFrame, low: dict[str, float], high: dict[str, float]) -> DataFrame:
    """Points within a box, ends included; ranges reach the scan."""
    keep = F.lit(True)
    for c in low:
        keep = keep & F.col(c).between(low[c], high[c])
    return points.where(keep)


def _near_cells(queries: DataFrame, size: float, dealt: bool = False) -> DataFrame:
    """A row for each of the 27 cells around a query. Dealt out by cell, a join weighs these rows and not the few queries that they come of, but does not split hot cells."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    out = queries.withColumn("_s", F.explode(steps))
    out = out.select(F.struct(*queries.columns).alias("q"), *[(_cell(F.col(c), size) + F.col(f"_s.{k}")).alias(f"_{c}") for c, k in zip(XYZ, "abc", strict=True)])
    return out.repartition(*[f"_{c}" for c in XYZ]) if dealt else out


def within(points: DataFrame, queries: DataFrame, distance: float, dealt: bool = False) -> DataFrame:
    """q, p (structs) and d2 of all pairs no farther apart than distance."""
    p = points.select(F.struct(*points.columns).alias("p"), *[_cell(F.col(c), distance).alias(f"_{c}") for c in XYZ])
    return _near_cells(queries, distance, dealt).join(p, [f"_{c}" for c in XYZ]).select("q", "p", _d2("q", "p").alias("d2")).where(F.col("d2") <= distance * distance)


def _places(points: DataFrame) -> DataFrame:
    """x, y, z of the places that hold points, with the two least pts of each."""
    pt = points.select("pt", *XYZ).dropna()
    least = pt.groupBy(*XYZ).agg(F.min("pt").alias("_m1"))
    second = pt.join(least, [*XYZ]).where("pt > _m1").groupBy(*XYZ).agg(F.min("pt").alias("_m2"))
    return least.join(second, [*XYZ], "left")


def _uncrowded(places: DataFrame, size: float, most: float = 4.0) -> list[float]:
    """Sizes from one that leaves a place at most so many others in its cell, on average, up to size; each is four times the one before."""
    sizes = [size]
    while True:
        cells = places.groupBy(*[_cell(F.col(c), sizes[0]).alias(f"_{c}") for c in XYZ]).agg(F.count("*").cast("double").alias("n"))
        n, squares = cells.agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
        if n is None or squares <= (most + 1) * n or sizes[0] < size * 1e-9:
            return sizes
        sizes.insert(0, sizes[0] / 4)


def _closest(places: DataFrame, queries: DataFrame, near) -> DataFrame:
    """pt, nearest, d2 of queries that near(places, queries), pairs of q and p, brings another point to; ties to the least pt.

    A least struct would have all pairs sorted; least numbers are kept in a hash table of the queries. So the distance is found first, and then who has it.
    """

    def pairs(asked: DataFrame) -> DataFrame:
        other = F.when(F.col("p._m1") == F.col("q.pt"), F.col("p._m2")).otherwise(F.col("p._m1"))
        return near(places, asked).select("q", _d2("q", "p").alias("d2"), other.alias("nearest")).where("nearest IS NOT NULL")

    least = queries.join(pairs(queries).groupBy("q.pt").agg(F.min("d2").alias("_least")), "pt")
    return pairs(least).where("d2 = q._least").groupBy("q.pt", "d2").agg(F.min("nearest").alias("nearest")).select("pt", "nearest", "d2")


def _search(places: DataFrame, queries: DataFrame, sizes: list[float]) -> tuple[DataFrame | None, DataFrame]:
    """What is found within each size in turn, by cells of that size, and the queries that are left. Each round is written, so none is repeated."""
    from ocellus.operators.iteration import Step

    found, left = None, queries
    for size in sizes:
        hit = Step(_closest(places, left, lambda p, q, s=size: within(p, q, s, dealt=True))).read()
        found = hit if found is None else found.unionByName(hit)
        left = Step(left.join(hit.select("pt"), "pt", "left_anti")).read()
        if left.isEmpty():
            break
    return found, left


def nearest(points: DataFrame, queries: DataFrame, size: float, reach: float) -> DataFrame:
    """For each query pt the nearest other point: pt, nearest, d2; ties to the least pt.

    Cells of size are searched first, or smaller ones where those are crowded; only queries whose answer may lie beyond
    the 27 cells are searched in cells of four times the size, and so on until none is left or reach, the extent of
    points and queries, is passed; a query without any other point by then is null.
    """
    from ocellus.operators.iteration import Step

    places = Step(_places(points)).read()
    sizes = _uncrowded(places, size)
    while sizes[-1] <= reach:
        sizes.append(sizes[-1] * 4)
    found, left = _search(places, Step(queries.select("pt", *XYZ)).read(), sizes)
    return found.unionByName(left.select("pt", F.lit(None).cast(found.schema["nearest"].dataType).alias("nearest"), F.lit(None).cast("double").alias("d2")))


def nearest_in_box(points: DataFrame, queries: DataFrame, half: float) -> DataFrame:
    """The nearest other point within a cube around each query; null where there is none.

    What is found within half is in the cube; only the other queries are held against all of the cube, which has points in its corners alone.
    """
    from ocellus.operators.iteration import Step

    places, asked = Step(_places(points)).read(), Step(queries.select("pt", *XYZ)).read()
    found, left = _search(places, asked, _uncrowded(places, half))

    def inside(p: DataFrame, q: DataFrame) -> DataFrame:
        p = p.select(F.struct(*p.columns).alias("p"), *[_cell(F.col(c), half).alias(f"_{c}") for c in XYZ])
        cube = F.lit(True)
        for c in XYZ:
            cube = cube & (F.abs(F.col(f"p.{c}") - F.col(f"q.{c}")) <= half)
        return _near_cells(q, half).join(p, [f"_{c}" for c in XYZ]).where(cube)

    found = found.unionByName(_closest(places, left, inside))
    return asked.select("pt").join(found, "pt", "left").select("pt", "nearest", "d2")


def _levelled(boxes: DataFrame, size: float, low: tuple[str, ...], high: tuple[str, ...]) -> DataFrame:
    """boxes with a row for each cell that they meet, of a grid whose cells (size times a power of two) are no smaller than the box: eight rows at most."""
    extent = F.greatest(*[F.col(h) - F.col(l) for l, h in zip(low, high, strict=True)], F.lit(0.0))
    level = F.greatest(F.ceil(F.log2(F.greatest(extent / size, F.lit(1e-300)))), F.lit(0)).cast("int")
    out = boxes.withColumn("_level", level)
    cell = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("_level"))
    for k, (l, h) in enumerate(zip(low, high, strict=True)):
        out = out.withColumn(f"_k{k}", F.explode(F.sequence(F.floor(F.col(l) / cell).cast("bigint"), F.floor(F.col(h) / cell).cast("bigint"))))
    return out


def containing(boxes: DataFrame, points: DataFrame, size: float) -> DataFrame:
    """pt, box of boxes (box, x0..z1) that contain a point. A box has the keys of the cells on all axes that it meets, in a grid of its own extent; a point has a key in each grid that has boxes."""
    b = _levelled(boxes, size, tuple(f"{c}0" for c in XYZ), tuple(f"{c}1" for c in XYZ))
    # As many rows as there are sizes of boxes, by powers of two.
    levels = [r[0] for r in b.select("_level").distinct().collect()]
    p = points.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in sorted(levels)]).cast("array<int>")))
    cell = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("_level"))
    p = p.withColumns({f"_k{k}": F.floor(F.col(c) / cell).cast("bigint") for k, c in enumerate(XYZ)})
    inside = F.lit(True)
    for c in XYZ:
        inside = inside & F.col(c).between(F.col(f"{c}0"), F.col(f"{c}1"))
    return p.join(b, ["_level", "_k0", "_k1", "_k2"]).where(inside).select("pt", "box")


def in_any(boxes: DataFrame, points: DataFrame, size: float) -> DataFrame:
    """Points that some box contains."""
    return points.join(containing(boxes, points, size).select("pt").distinct(), "pt", "left_semi")


def _slabs(low: str, high: str) -> tuple[Column, Column]:
    """Where a ray (ox..oz, dx..dz) enters and leaves a box, by slabs; the entry is not before the ray's origin."""
    near, far = [], []
    for c in XYZ:
        o, d, l, h = F.col(f"o{c}"), F.col(f"d{c}"), F.col(low.format(c)), F.col(high.format(c))
        a, b = F.try_divide(l - o, d), F.try_divide(h - o, d)
        outside = (d == 0) & ~o.between(l, h)
        near.append(F.when(outside, F.lit(float("inf"))).otherwise(F.coalesce(F.least(a, b), F.lit(float("-inf")))))
        far.append(F.when(outside, F.lit(float("-inf"))).otherwise(F.coalesce(F.greatest(a, b), F.lit(float("inf")))))
    return F.greatest(*near, F.lit(0.0)), F.least(*far)


def _cells_along(rays: DataFrame) -> DataFrame:
    """rays with a row for each cell (of _cell) that they pass or touch between _t0 and _t1."""

    def crossed(c: str) -> Column:
        o, d = F.col(f"o{c}"), F.col(f"d{c}")
        ends = [F.floor((o + F.col(t) * d) / F.col("_cell")).cast("bigint") for t in ("_t0", "_t1")]
        planes = F.sequence(F.least(*ends), F.greatest(*ends) + 1)
        return F.when(d == 0, F.array().cast("array<double>")).otherwise(F.transform(planes, lambda k: (k * F.col("_cell") - o) / d))

    inside = F.filter(F.concat(*[crossed(c) for c in XYZ]), lambda t: (t > F.col("_t0")) & (t < F.col("_t1")))
    rows = rays.withColumn("_ts", F.array_sort(F.concat(F.array("_t0", "_t1"), inside)))
    # A cell is known by the middle of the way through it; one that is only touched, by the point itself.
    ways = F.zip_with(F.slice("_ts", F.lit(1), F.size("_ts") - 1), F.slice("_ts", F.lit(2), F.size("_ts") - 1), lambda x, y: (x + y) / 2)
    cells = F.array_distinct(F.transform(F.concat("_ts", ways), lambda t: F.struct(*[F.floor((F.col(f"o{c}") + t * F.col(f"d{c}")) / F.col("_cell")).cast("bigint").alias(f"_k{k}") for k, c in enumerate(XYZ)])))
    return rows.withColumn("_c", F.explode(cells)).select("ray", *[f"{n}{c}" for n in "od" for c in XYZ], "_level", "_c.*")


def first_hit(boxes: DataFrame, rays: DataFrame, size: float | None = None) -> DataFrame:
    """ray, box, t of the first box that each ray (ox..oz, dx..dz) enters; ties to the least box.

    A ray is followed through the cells of a grid for each size of boxes (by powers of two), and held against the boxes
    of those cells alone. size is of the finest cells; None takes the boxes' mean extent.
    """
    if size is None:
        size = boxes.agg(F.avg(F.greatest(*[F.col(f"{c}1") - F.col(f"{c}0") for c in XYZ]))).first()[0] or 1.0
    b = _levelled(boxes, size, tuple(f"{c}0" for c in XYZ), tuple(f"{c}1" for c in XYZ))
    # A row for each size of boxes, with the extent of those.
    scene = b.groupBy("_level").agg(*[F.min(f"{c}0").alias(f"_lo{c}") for c in XYZ], *[F.max(f"{c}1").alias(f"_hi{c}") for c in XYZ])
    t0, t1 = _slabs("_lo{}", "_hi{}")
    each = F.array_sort(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in r.asDict().items()]) for r in scene.collect()] or [F.lit(None).cast(scene.schema)]))
    rows = rays.withColumn("_s", F.explode(F.filter(each, lambda x: x.isNotNull()))).select(*rays.columns, "_s.*")
    rows = rows.withColumns({"_t0": t0, "_t1": t1}).where("_t0 <= _t1").withColumn("_cell", F.lit(float(size)) * F.pow(F.lit(2.0), F.col("_level")))
    t0, t1 = _slabs("{}0", "{}1")
    hit = _cells_along(rows).join(b, ["_level", "_k0", "_k1", "_k2"]).where(t0 <= t1).select("ray", "box", t0.alias("t"))
    return hit.groupBy("ray").agg(F.min(F.struct("t", "box")).alias("m")).select("ray", "m.box", "m.t")


def with_context(points: DataFrame, distance: float) -> DataFrame:
    """set, pt, member: each cluster above 0 with its points, and the others within distance of one of them."""
    members = points.where("cluster > 0").select(F.col("cluster").alias("set"), "pt", F.lit(True).alias("member"))
    near = within(points.where("cluster > 0"), points, distance).where("q.cluster != p.cluster")
    return members.unionByName(near.select(F.col("p.cluster").alias("set"), "q.pt", F.lit(False).alias("member")).distinct())


def raster_nearest(points: DataFrame, size: float, reach: int) -> DataFrame:
    """i, j, pt: the point nearest to the centre of each cell that has one within reach cells; ties to the least pt.

    A point goes to the nine cells around it; where one lies nearer than a cell and a half, none farther off can be nearer.
    Only the other cells that an occupied one reaches look further, each cell once, so a crowded cell is not repeated.
    """
    key = points.select("pt", "x", "y", _cell(F.col("y"), size).alias("_i"), _cell(F.col("x"), size).alias("_j"))

    def around(n: int, i: str, j: str) -> list[Column]:
        return [F.struct((F.col(i) + a).alias("i"), (F.col(j) + b).alias("j")) for a in range(-n, n + 1) for b in range(-n, n + 1)]

    def best(rows: DataFrame) -> DataFrame:
        dy, dx = F.col("y") / size - (F.col("i") + 0.5), F.col("x") / size - (F.col("j") + 0.5)
        near = rows.withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= reach * reach)
        return near.groupBy("i", "j").agg(F.min(F.struct(F.round("d2", 9).alias("d2"), "pt")).alias("m"))

    close = best(key.select("pt", "x", "y", F.explode(F.array(*around(1, "_i", "_j"))).alias("_c")).select("pt", "x", "y", "_c.*")).where(F.col("m.d2") < min(2.249, reach * reach + 1e-9))
    occupied = key.select("_i", "_j").distinct()
    open_cells = occupied.select(F.explode(F.array(*around(reach, "_i", "_j"))).alias("_c")).select("_c.*").distinct().join(close, ["i", "j"], "left_anti")
    sources = open_cells.select("i", "j", F.explode(F.array(*[F.struct((F.col("i") + a).alias("_i"), (F.col("j") + b).alias("_j")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)])).alias("_s")).select("i", "j", "_s.*")
    far = best(sources.join(occupied, ["_i", "_j"], "left_semi").join(key, ["_i", "_j"]))
    return close.unionByName(far).select("i", "j", "m.pt")


def depth_layers(points: DataFrame, size: float, layers: int) -> DataFrame:
    """i, j, layer, z, pt: the largest distinct heights of each cell, in layers; ties of a height to the least pt."""
    from pyspark.sql import Window

    cell = points.select(F.round(F.col("y") / size).cast("bigint").alias("i"), F.round(F.col("x") / size).cast("bigint").alias("j"), "z", "pt")
    own = Window.partitionBy("i", "j").orderBy(F.col("z").desc())
    tops = cell.groupBy("i", "j", "z").agg(F.min("pt").alias("pt"))
    return tops.withColumn("layer", F.row_number().over(own) - 1).where(F.col("layer") < layers)


def depth_buffer(points: DataFrame, height: int, width: int, layers: int, focal: float | None = None, size: float = 1.0) -> DataFrame:
    """i, j, layer, depth of an image: the least distinct depths (z) of each cell, in layers; -1 where there is none.

    With a focal length the camera is a pinhole before which z is positive; without, cells are size wide, the camera looks
    along z and the image's middle is the origin.
    """
    scale = F.lit(focal) / F.col("z") if focal is not None else F.lit(1.0 / size)
    ahead = points.where("z > 0") if focal is not None else points
    cell = ahead.select(F.round(F.col("y") * scale + (height - 1) / 2).cast("int").alias("i"), F.round(F.col("x") * scale + (width - 1) / 2).cast("int").alias("j"), "z")
    seen = cell.where((F.col("i") >= 0) & (F.col("i") < height) & (F.col("j") >= 0) & (F.col("j") < width)).groupBy("i", "j", "z").agg(F.count("*").alias("_n"))
    from pyspark.sql import Window

    ranked = seen.withColumn("layer", F.row_number().over(Window.partitionBy("i", "j").orderBy("z")) - 1).where(F.col("layer") < layers)
    k = F.col("id")
    whole = points.sparkSession.range(height * width * layers).select((k / (width * layers)).cast("int").alias("i"), (k / layers % width).cast("int").alias("j"), (k % layers).cast("int").alias("layer"))
    return whole.join(ranked, ["i", "j", "layer"], "left").select("i", "j", "layer", F.coalesce("z", F.lit(-1.0)).alias("depth"))


def detrend(points: DataFrame, tile: float) -> DataFrame:
    """pt and the height above the terrain: least heights of tiles, interpolated bicubically; empty tiles of the points' extent take the nearest one's."""
    from ocellus.operators.raster import interpolate

    low = points.groupBy(_cell(F.col("y"), tile).cast("int").alias("i"), _cell(F.col("x"), tile).cast("int").alias("j")).agg(F.min("z").alias("value")).withColumn("img", F.lit(0))
    ends = low.agg(*[f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "ij"])
    whole = ends.select(F.explode(F.sequence("loi", "hii")).alias("i"), "loj", "hij").select(F.lit(0).alias("img"), "i", F.explode(F.sequence("loj", "hij")).alias("j"))
    low = inpaint_nearest(whole.join(low, ["img", "i", "j"], "left"), 2)
    at = points.select("pt", F.lit(0).alias("img"), (F.col("y") / tile - 0.5).alias("y"), (F.col("x") / tile - 0.5).alias("x"))
    ground = interpolate(low, at, "cubic").select("pt", F.col("value").alias("_g"))
    return points.join(ground, "pt").select("pt", (F.col("z") - F.col("_g")).alias("height"))


def _rim(known: DataFrame) -> DataFrame:
    """Known cells that lack a known one beside them; no other can be nearest to an unknown cell."""
    from pyspark.sql import Window

    full = F.lit(True)
    for line, along in (("i", "j"), ("j", "i")):
        own = Window.partitionBy("img", line).orderBy(along)
        full = full & F.coalesce((F.lag(along).over(own) == F.col(along) - 1) & (F.lead(along).over(own) == F.col(along) + 1), F.lit(False))
    return known.withColumn("_full", full).where("NOT _full").drop("_full")


def inpaint_nearest(cells: DataFrame, reach: int) -> DataFrame:
    """Unknown cells (null value) take the nearest known one's value; ties to the least (i, j). Null only in an image without known cells.

    Windows of reach are searched first; what may have a nearer cell outside them is searched in grids of growing size until none is left.
    """
    from ocellus.operators.iteration import Step

    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]))
    unknown, known = cells.where("value IS NULL").select("img", "i", "j"), cells.where("value IS NOT NULL").select("img", F.col("i").alias("ki"), F.col("j").alias("kj"), "value")
    best = F.min(F.struct(((F.col("ki") - F.col("i")) * (F.col("ki") - F.col("i")) + (F.col("kj") - F.col("j")) * (F.col("kj") - F.col("j"))).cast("bigint").alias("d2"), "ki", "kj", "value")).alias("m")
    # Exploded rows are dealt out before a join weighs its sides: it would take them for as few as they come of, and broadcast them.
    asked = unknown.select("img", "i", "j", steps.alias("_s")).select("img", "i", "j", (F.col("i") + F.col("_s.a")).alias("ki"), (F.col("j") + F.col("_s.b")).alias("kj")).repartition("img", "ki", "kj")
    near = asked.join(known, ["img", "ki", "kj"]).groupBy("img", "i", "j").agg(best).where(F.col("m.d2") < (reach + 1) * (reach + 1))
    found = near.select("img", "i", "j", F.col("m.value").alias("_v"))
    left = Step(unknown.join(found, ["img", "i", "j"], "left_anti").join(known.select("img").distinct(), "img", "left_semi")).read()
    size, rim = 2 * (reach + 1), None
    while not left.isEmpty():
        rim = rim or Step(_rim(cells.where("value IS NOT NULL").select("img", "i", "j", "value")).withColumnsRenamed({"i": "ki", "j": "kj"}))
        around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
        asked = left.withColumn("_s", around).select("img", "i", "j", (_cell(F.col("i"), size) + F.col("_s.a")).alias("_i"), (_cell(F.col("j"), size) + F.col("_s.b")).alias("_j")).repartition("img", "_i", "_j")
        keyed = rim.read().withColumns({"_i": _cell(F.col("ki"), size), "_j": _cell(F.col("kj"), size)})
        near = Step(asked.join(keyed, ["img", "_i", "_j"]).groupBy("img", "i", "j").agg(best).where(F.col("m.d2") <= size * size).select("img", "i", "j", F.col("m.value").alias("_v"))).read()
        found = found.unionByName(near)
        left = Step(left.join(near, ["img", "i", "j"], "left_anti")).read()
        size *= 2
    return cells.join(found, ["img", "i", "j"], "left").select("img", "i", "j", F.coalesce("value", "_v").alias("value"))


def covering(disparities: DataFrame, share: float) -> DataFrame:
    """img and the share of cells that the forward-warped ones (img, i, j, disparity) cover by share or more, splatted linearly."""
    x = F.col("j") - F.col("disparity")
    low = F.floor(x).cast("int")
    targets = F.explode(F.array(F.struct(low.alias("j"), (low + 1 - x).alias("w")), F.struct((low + 1).alias("j"), (x - low).alias("w"))))
    hit = disparities.select("img", "i", targets.alias("t")).groupBy("img", "i", "t.j").agg(F.sum("t.w").alias("w"))
    seen = disparities.select("img", "i", "j").join(hit, ["img", "i", "j"], "left")
    return seen.groupBy("img").agg(F.avg(F.when(F.coalesce("w", F.lit(0.0)) >= share, 1.0).otherwise(0.0)).alias("covered"))
