"""Windows over rasters: relations (img, i, j, value) with one row for each cell of a dense grid.

A neighbourhood is gathered by two sorts, one along rows and one along columns
of each image, so a cell's row is never repeated for its neighbours; what lies
outside the image counts as 0, as the window family defines. gather() serves
other paddings and sparse offsets by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.operators.histograms import order_statistics

CELL = ["img", "i", "j"]


def neighbourhood(cells: DataFrame, ri: int, rj: int, value: str = "value", out: str = "f", outside: float | None = 0.0) -> DataFrame:
    """cells with an array of the (2ri+1)(2rj+1) values around each, row by row; outside=None gives nulls there."""
    fill = F.lit(outside).cast("double")
    along = Window.partitionBy("img", "i").orderBy("j")
    across = Window.partitionBy("img", "j").orderBy("i")
    row = F.array(*[F.coalesce(F.lag(value, -d).over(along), fill) if d else F.col(value) for d in range(-rj, rj + 1)])
    blank = F.array(*[fill] * (2 * rj + 1))
    rows = cells.withColumn("_row", row)
    return rows.withColumn(out, F.concat(*[F.coalesce(F.lag("_row", -d).over(across), blank) if d else F.col("_row") for d in range(-ri, ri + 1)])).drop("_row")


def sizes(cells: DataFrame) -> DataFrame:
    """img, h, w."""
    return cells.groupBy("img").agg((F.max("i") + 1).alias("h"), (F.max("j") + 1).alias("w"))


def width() -> Column:
    """The image's width, from a cell's own line: windows along rows have its rows at hand, and no image is joined to its size."""
    return F.max("j").over(Window.partitionBy("img", "i")) + 1


def height() -> Column:
    """The image's height, from a cell's own column."""
    return F.max("i").over(Window.partitionBy("img", "j")) + 1


def _inside(x: Column, n: Column, padding: str) -> Column:
    """The place that stands for place x of an axis of n."""
    if padding == "periodic":
        return F.pmod(x, n)
    if padding == "mirror":
        folded = F.pmod(x, 2 * n)
        return F.when(folded < n, folded).otherwise(2 * n - 1 - folded)
    return x


def gather(cells: DataFrame, offsets: list[tuple[int, int, float]], padding: str = "constant", fill: float = 0.0) -> DataFrame:
    """img, i, j and the weighted sum over offsets (di, dj, weight): a correlation, the kernel not flipped.

    Each cell goes to the targets that it counts for; padded targets take what stands for them.
    """
    taps = F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(float(w)).alias("k")) for a, b, w in offsets]))
    asked = cells.select(*CELL).join(sizes(cells), "img").withColumn("t", taps)
    source = asked.select(*CELL, F.col("t.k").alias("k"), _inside(F.col("i") + F.col("t.di"), F.col("h"), padding).cast("int").alias("si"), _inside(F.col("j") + F.col("t.dj"), F.col("w"), padding).cast("int").alias("sj"))
    values = cells.select("img", F.col("i").alias("si"), F.col("j").alias("sj"), "value")
    return source.join(values, ["img", "si", "sj"], "left").groupBy(*CELL).agg(F.sum(F.col("k") * F.coalesce(F.col("value"), F.lit(fill))).alias("value"))


def gather_channels(cells: DataFrame, taps: list[tuple[int, int, int | None, float]], channel: str = "c") -> DataFrame:
    """img, i, j and a channel's place, value: weighted sums over offsets and channels of cells with a channel column; 0 outside.

    taps: (di, dj, k, weight). With k None a tap is a batch's: it goes from each channel to the same one of the result. With
    a number it is summed over: from that channel into the one result, whose channel is 0.
    """
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(k).cast("int").alias("k"), F.lit(float(w)).alias("w")) for a, b, k, w in taps]))
    # Each cell goes to the places that it counts for; those that lie outside are no cells of the image.
    sent = cells.select(*CELL, channel, "value", steps.alias("t")).where(F.col("t.k").isNull() | (F.col("t.k") == F.col(channel)))
    sent = sent.select("img", (F.col("i") - F.col("t.di")).alias("i"), (F.col("j") - F.col("t.dj")).alias("j"), F.when(F.col("t.k").isNull(), F.col(channel)).otherwise(0).alias(channel), (F.col("t.w") * F.col("value")).alias("value"))
    sums = sent.groupBy(*CELL, channel).agg(F.sum("value").alias("value"))
    batched = any(k is None for _, _, k, _ in taps)
    places = cells.select(*CELL, channel) if batched else cells.select(*CELL).distinct().withColumn(channel, F.lit(0))
    return places.join(sums, [*CELL, channel], "left").select(*CELL, channel, F.coalesce("value", F.lit(0.0)).alias("value"))


def weighted(f: str, weights: list[float]) -> Column:
    """Sum of an array's entries by fixed weights."""
    out = F.lit(0.0)
    for k, w in enumerate(weights):
        if w:
            out = out + F.get(F.col(f), F.lit(k)) * F.lit(float(w))
    return out


def separable(cells: DataFrame, taps: list[float]) -> DataFrame:
    """The kernel taps x taps, a pass along each axis; 0 outside."""
    r = len(taps) // 2
    rows = neighbourhood(cells, 0, r, out="_f").withColumn("value", weighted("_f", taps)).drop("_f")
    return neighbourhood(rows, r, 0, out="_f").withColumn("value", weighted("_f", taps)).drop("_f")


def box_mean(cells: DataFrame, r: int) -> DataFrame:
    """Means of (2r+1)^2 windows that lie within the image; other cells are left out. Running frames, so r costs nothing."""
    along = Window.partitionBy("img", "i").orderBy("j").rowsBetween(-r, r)
    across = Window.partitionBy("img", "j").orderBy("i").rowsBetween(-r, r)
    rows = cells.withColumns({"_s": F.sum("value").over(along), "_n": F.count("*").over(along)})
    sums = rows.withColumns({"_t": F.sum("_s").over(across), "_m": F.sum("_n").over(across)})
    return sums.where(F.col("_m") == (2 * r + 1) ** 2).select(*CELL, (F.col("_t") / F.col("_m")).alias("value"))


def sigma(cells: DataFrame, r: int) -> DataFrame:
    """Root of the summed squared distances to the window's mean, within the radius border; not divided by the count."""
    f = neighbourhood(cells, r, r, outside=None).where(~F.exists("f", lambda v: v.isNull()))
    n = (2 * r + 1) ** 2
    mean = F.aggregate("f", F.lit(0.0), lambda acc, v: acc + v) / n
    spread = F.aggregate("f", F.lit(0.0), lambda acc, v: acc + (v - F.col("_m")) * (v - F.col("_m")))
    return f.withColumn("_m", mean).select(*CELL, F.sqrt(spread).alias("value"))


def erode(cells: DataFrame, r: int) -> DataFrame:
    """Least value of the window, 0 outside counted."""
    return neighbourhood(cells, r, r).select(*CELL, F.array_min("f").alias("value"))


def dilate(cells: DataFrame, r: int) -> DataFrame:
    return neighbourhood(cells, r, r).select(*CELL, F.array_max("f").alias("value"))


def _element(f: DataFrame, r: int) -> Column:
    """Values under a disc, what lies outside the image left out."""
    keep = [k for k, (a, b) in enumerate((a, b) for a in range(-r, r + 1) for b in range(-r, r + 1)) if a * a + b * b <= r * r]
    return F.filter(F.array(*[F.get("f", F.lit(k)) for k in keep]), lambda v: v.isNotNull())


def erode_disc(cells: DataFrame, r: int) -> DataFrame:
    f = neighbourhood(cells, r, r, outside=None)
    return f.select(*CELL, F.array_min(_element(f, r)).alias("value"))


def dilate_disc(cells: DataFrame, r: int) -> DataFrame:
    f = neighbourhood(cells, r, r, outside=None)
    return f.select(*CELL, F.array_max(_element(f, r)).alias("value"))


def median(cells: DataFrame, r: int) -> DataFrame:
    """The upper median of the window."""
    n = (2 * r + 1) ** 2
    return neighbourhood(cells, r, r).select(*CELL, F.get(F.array_sort("f"), F.lit(n // 2)).alias("value"))


def sobel(cells: DataFrame) -> DataFrame:
    """gx and gy: a central difference, then [1 2 1] across, edges repeated."""
    along = Window.partitionBy("img", "i").orderBy("j")
    across = Window.partitionBy("img", "j").orderBy("i")

    def near(c: str, w, d: int) -> Column:
        return F.coalesce(F.lag(c, -d).over(w), F.col(c))

    d = cells.withColumns({"_dx": near("value", along, 1) - near("value", along, -1), "_sx": near("value", along, -1) + 2 * F.col("value") + near("value", along, 1)})
    gx = near("_dx", across, -1) + 2 * F.col("_dx") + near("_dx", across, 1)
    return d.select(*CELL, "value", gx.alias("gx"), (near("_sx", across, 1) - near("_sx", across, -1)).alias("gy"))


def gradient_edges(cells: DataFrame, share: float) -> DataFrame:
    """Cells whose squared gradient reaches the image's order statistic at 1 - share."""
    amp = sobel(cells).withColumn("amp", F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    level = order_statistics(amp, "amp", {"_level": lambda n: F.floor((1 - share) * (n - 1))})
    return amp.join(level, "img").where(F.col("amp") >= F.col("_level")).select(*CELL, "amp")


def local_maxima(cells: DataFrame, r: int, least: float, n: int) -> DataFrame:
    """The n best cells of each image that exceed least and equal their window's maximum; ties by place."""
    f = neighbourhood(cells, r, r).where((F.col("value") == F.array_max("f")) & (F.col("value") > least))
    order = Window.partitionBy("img").orderBy(F.col("value").desc(), "i", "j")
    return f.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(*CELL, "value", "rank")


def average_pool(cells: DataFrame, size: int) -> DataFrame:
    """Means of size x size windows, the last ones of what is there."""
    cell = [F.floor(F.col(c) / size).cast("int").alias(c) for c in ("i", "j")]
    return cells.groupBy("img", *cell).agg(F.avg("value").alias("value"))


def structure_tensor(cells: DataFrame, mask: str | None = None) -> DataFrame:
    """img, i, j, xx, xy, yy: products of the gradients; 0 where a mask (the name of a boolean column) is not true."""
    products = [(F.col(a) * F.col(b)).alias(n) for n, a, b in (("xx", "gx", "gx"), ("xy", "gx", "gy"), ("yy", "gy", "gy"))]
    t = sobel(cells).select(*CELL, *products)
    if mask is None:
        return t
    kept = cells.select(*CELL, F.coalesce(F.col(mask), F.lit(False)).alias("_kept"))
    return t.join(kept, CELL).select(*CELL, *[F.when(F.col("_kept"), F.col(n)).otherwise(0.0).alias(n) for n in ("xx", "xy", "yy")])


def harris(cells: DataFrame, r: int = 1, mask: str | None = None) -> DataFrame:
    """Determinant over trace of the structure tensor summed over a window; 0 where it is not finite, and outside of a mask."""
    t = structure_tensor(cells, mask)
    for c in ("xx", "xy", "yy"):
        t = neighbourhood(t, r, r, value=c, out="_f").withColumn(f"s{c}", F.aggregate("_f", F.lit(0.0), lambda acc, v: acc + v)).drop("_f")
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    return t.select(*CELL, F.coalesce(F.try_divide(det, F.col("sxx") + F.col("syy")), F.lit(0.0)).alias("value"))


#: The sixteen places of the circle of radius 3, clockwise from the top.
CIRCLE = ((-3, 0), (-3, 1), (-2, 2), (-1, 3), (0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1))


def _longest_run(flags: Column) -> Column:
    """The longest circular run of true values."""
    step = F.aggregate(
        F.concat(flags, flags), F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda acc, x: F.struct(F.when(x, acc["now"] + 1).otherwise(0).alias("now"), F.greatest(acc["best"], F.when(x, acc["now"] + 1).otherwise(0)).alias("best")),
    )
    return F.least(step["best"], F.size(flags))


def fast_corner(cells: DataFrame, threshold: float) -> DataFrame:
    """The longest circular run of places brighter, or darker, by threshold; outside the image a place is like the centre."""
    f = neighbourhood(cells, 3, 3, outside=None)
    ring = [F.coalesce(F.get("f", F.lit((a + 3) * 7 + b + 3)), F.col("value")) for a, b in CIRCLE]
    up = F.array(*[x > F.col("value") + threshold for x in ring])
    down = F.array(*[x < F.col("value") - threshold for x in ring])
    return f.select(*CELL, F.greatest(_longest_run(up), _longest_run(down)).alias("run"))


def orientation(cells: DataFrame, r: int) -> DataFrame:
    """The direction of the intensity-weighted offset within the window, as a unit vector; null where there is none."""
    f = neighbourhood(cells, r, r)
    offsets = [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1)]
    m = f.select(*CELL, weighted("f", [a for a, _ in offsets]).alias("_y"), weighted("f", [b for _, b in offsets]).alias("_x"))
    size = F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))
    return m.select(*CELL, F.try_divide("_y", size).alias("oy"), F.try_divide("_x", size).alias("ox"))


def _unit(v: Column) -> Column:
    """A list less its mean, over the root of its mean square; null where that is 0."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    mean = total(v) / F.size(v)
    centred = F.transform(v, lambda x: x - mean)
    norm = F.sqrt(total(F.transform(centred, lambda x: x * x)) / F.size(v))
    return F.when(norm > 0, F.transform(centred, lambda x: x / norm))


def whitened_patches(cells: DataFrame, points: DataFrame, r: int) -> DataFrame:
    """img, i, j, f: the window's values around each point (img, i, j), 0 outside the image, with mean 0 and mean square 1."""
    f = neighbourhood(cells, r, r).select(*CELL, F.col("f"))
    return f.join(points.select(*CELL), CELL, "left_semi").select(*CELL, _unit(F.col("f")).alias("f"))


def oriented_patches(cells: DataFrame, points: DataFrame, offsets: list[tuple[float, float]]) -> DataFrame:
    """img, i, j, f: values at offsets (y, x) turned by each point's direction (oy, ox, a unit vector), between cells linearly, 0 outside, with mean 0 and mean square 1.

    The offset (0, 1) lies in the point's direction.
    """
    taps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for k, (a, b) in enumerate(offsets)]))
    at = points.select(*CELL, "oy", "ox", taps.alias("t"))
    at = at.select(F.struct(*CELL, F.col("t.k").alias("k")).alias("pt"), "img", (F.col("i") + F.col("t.a") * F.col("ox") + F.col("t.b") * F.col("oy")).alias("y"), (F.col("j") - F.col("t.a") * F.col("oy") + F.col("t.b") * F.col("ox")).alias("x"))
    values = interpolate(cells, at, "linear").groupBy("pt.img", "pt.i", "pt.j").agg(F.sort_array(F.collect_list(F.struct("pt.k", "value"))).alias("v"))
    return values.select(*CELL, _unit(F.transform("v", lambda x: x["value"])).alias("f"))


def flatten_heights(cells: DataFrame) -> DataFrame:
    """img, i, j, value: heights (value) in a mask (boolean column mask) above the plane that is nearest to them, from 0 up; 0 outside the mask. One aggregation of products for each image."""
    own = cells.where("mask")
    sums = own.groupBy("img").agg(*[F.avg(c).alias(f"m{c}") for c in ("i", "j", "value")], *[F.covar_pop(a, b).alias(f"c{n}") for n, (a, b) in {"ii": ("i", "i"), "ij": ("i", "j"), "jj": ("j", "j"), "iv": ("i", "value"), "jv": ("j", "value")}.items()])
    det = F.col("cii") * F.col("cjj") - F.col("cij") * F.col("cij")
    a = F.coalesce(F.try_divide(F.col("civ") * F.col("cjj") - F.col("cjv") * F.col("cij"), det), F.lit(0.0))
    b = F.coalesce(F.try_divide(F.col("cjv") * F.col("cii") - F.col("civ") * F.col("cij"), det), F.lit(0.0))
    plane = sums.select("img", "mi", "mj", "mvalue", a.alias("_a"), b.alias("_b"))
    left = F.col("value") - F.col("mvalue") - F.col("_a") * (F.col("i") - F.col("mi")) - F.col("_b") * (F.col("j") - F.col("mj"))
    rest = cells.join(plane, "img", "left").select(*CELL, "mask", left.alias("_r"))
    low = rest.where("mask").groupBy("img").agg(F.min("_r").alias("_low"))
    return rest.join(low, "img", "left").select(*CELL, F.when(F.col("mask"), F.col("_r") - F.col("_low")).otherwise(0.0).alias("value"))


def _cubic(t: Column) -> Column:
    """Keys' kernel with a = -1/2."""
    x = F.abs(t)
    near = 1.5 * x * x * x - 2.5 * x * x + 1
    far = -0.5 * x * x * x + 2.5 * x * x - 4 * x + 2
    return F.when(x <= 1, near).when(x < 2, far).otherwise(0.0)


def _linear(t: Column) -> Column:
    return F.greatest(1 - F.abs(t), F.lit(0.0))


def interpolate(cells: DataFrame, points: DataFrame, kernel: str = "linear", fill: float = 0.0) -> DataFrame:
    """points (pt, img, y, x) with the raster's value there; fill stands for what lies outside. Each point joins the 4 or 16 cells around it."""
    k, reach = (_linear, (0, 1)) if kernel == "linear" else (_cubic, (-1, 2))
    steps = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(reach[0], reach[1] + 1) for b in range(reach[0], reach[1] + 1)]
    near = points.withColumn("_o", F.explode(F.array(*steps)))
    near = near.withColumns({"i": (F.floor("y") + F.col("_o.a")).cast("int"), "j": (F.floor("x") + F.col("_o.b")).cast("int")})
    hit = near.join(cells.select(*CELL, "value"), CELL, "left")
    weight = k(F.col("y") - F.col("i")) * k(F.col("x") - F.col("j"))
    return hit.groupBy("pt", "img", "y", "x").agg(F.sum(weight * F.coalesce("value", F.lit(float(fill)))).alias("value"))


def triangle_cells(triangles: DataFrame) -> DataFrame:
    """triangle, i, j of the cells whose centres lie in triangles (triangle, y0, x0 ... y2, x2), borders included."""
    ys, xs = [F.col(f"y{k}") for k in range(3)], [F.col(f"x{k}") for k in range(3)]
    rows = triangles.withColumn("i", F.explode(F.sequence(F.ceil(F.least(*ys)).cast("int"), F.greatest(F.ceil(F.least(*ys)), F.floor(F.greatest(*ys))).cast("int"))))
    rows = rows.withColumn("j", F.explode(F.sequence(F.ceil(F.least(*xs)).cast("int"), F.greatest(F.ceil(F.least(*xs)), F.floor(F.greatest(*xs))).cast("int"))))
    sides = [(xs[(k + 1) % 3] - xs[k]) * (F.col("i") - ys[k]) - (ys[(k + 1) % 3] - ys[k]) * (F.col("j") - xs[k]) for k in range(3)]
    held = (F.least(*sides) >= 0) | (F.greatest(*sides) <= 0)
    inside = F.col("i").between(F.least(*ys), F.greatest(*ys)) & F.col("j").between(F.least(*xs), F.greatest(*xs))
    return rows.where(held & inside).select("triangle", "i", "j")


#: The windows of seventeen labels of radius 3 and 4, one character a cell (1 to 9, then a to h).
MASK_R3 = ["eeaaagg", "ee647gg", "b66477d", "b22133d", "b88599d", "ff859hh", "ffccchh"]
MASK_R4 = ["eeeaaaggg", "eeeaaaggg", "ee66477gg", "bb66477dd", "bb22133dd", "bb88599dd", "ff88599hh", "fffccchhh", "fffccchhh"]


def labels(mask: list[str]) -> list[list[int]]:
    """A window of labels as numbers."""
    return [[int(x, 36) for x in row] for row in mask]


def superpixel_features(cells: DataFrame, mask: list[list[int]]) -> DataFrame:
    """Means over the window's cells of each label above 0, labels ascending; mask is the odd-sized window of labels."""
    ri, rj = len(mask) // 2, len(mask[0]) // 2
    flat = [x for row in mask for x in row]
    means = []
    for label in sorted({x for x in flat if x > 0}):
        n = flat.count(label)
        means.append(weighted("f", [1.0 if x == label else 0.0 for x in flat]) / n)
    return neighbourhood(cells, ri, rj).select(*CELL, F.array(*means).alias("f"))


def rotate_window(f: Column, r: int, quarter_turns: int) -> Column:
    """A (2r+1)^2 window turned counter-clockwise by quarters."""
    n = 2 * r + 1
    place = {0: lambda a, b: a * n + b, 1: lambda a, b: b * n + n - 1 - a, 2: lambda a, b: (n - 1 - a) * n + n - 1 - b, 3: lambda a, b: (n - 1 - b) * n + a}[quarter_turns % 4]
    return F.array(*[F.get(f, F.lit(place(a, b))) for a in range(n) for b in range(n)])


def sub_windows(n: int, size: int) -> list[list[int]]:
    """Flat places of each size x size window inside an n x n window."""
    return [[(a + x) * n + b + y for x in range(size) for y in range(size)] for a in range(n - size + 1) for b in range(n - size + 1)]
