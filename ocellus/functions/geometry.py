"""Rigid and projective geometry as column expressions.

A vector is an array of 3 doubles, a matrix an array of 9 by rows, a
quaternion (w, x, y, z). All functions stay on the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Column
Matrix = Column


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _pair(a: Column, b: Column, body: Callable[[Column, Column], Column]) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: body(p["a"], p["b"]))


def vec(*c: Column) -> Vector:
    return F.array(*c)


def at(x: Column, k: int) -> Column:
    return F.get(x, F.lit(k))


def dot(a: Vector, b: Vector) -> Column:
    return _pair(a, b, lambda a, b: at(a, 0) * at(b, 0) + at(a, 1) * at(b, 1) + at(a, 2) * at(b, 2))


def cross(a: Vector, b: Vector) -> Vector:
    return _pair(a, b, lambda a, b: vec(*[at(a, i) * at(b, j) - at(a, j) * at(b, i) for i, j in ((1, 2), (2, 0), (0, 1))]))


def scale(a: Vector, s: Column | float) -> Vector:
    return _pair(a, F.lit(s) if isinstance(s, (int, float)) else s, lambda a, s: vec(*[at(a, k) * s for k in range(3)]))


def add(a: Vector, b: Vector) -> Vector:
    return F.zip_with(a, b, lambda x, y: x + y)


def apply(m: Matrix, v: Vector) -> Vector:
    return _pair(m, v, lambda m, v: vec(*[at(m, 3 * r) * at(v, 0) + at(m, 3 * r + 1) * at(v, 1) + at(m, 3 * r + 2) * at(v, 2) for r in range(3)]))


def multiply(a: Matrix, b: Matrix) -> Matrix:
    return _pair(a, b, lambda a, b: F.array(*[at(a, 3 * r) * at(b, c) + at(a, 3 * r + 1) * at(b, 3 + c) + at(a, 3 * r + 2) * at(b, 6 + c) for r in range(3) for c in range(3)]))


def transpose(m: Matrix) -> Matrix:
    return let(m, lambda m: F.array(*[at(m, 3 * c + r) for r in range(3) for c in range(3)]))


def skew(v: Vector) -> Matrix:
    x, y, z = (at(v, k) for k in range(3))
    o = F.lit(0.0)
    return F.array(o, -z, y, z, o, -x, -y, x, o)


def unskew(m: Matrix) -> Vector:
    return let(m, lambda m: vec((at(m, 7) - at(m, 5)) / 2, (at(m, 2) - at(m, 6)) / 2, (at(m, 3) - at(m, 1)) / 2))


def _sinc(angle: Column) -> Column:
    return F.when(angle < 1e-8, 1.0).otherwise(F.try_divide(F.sin(angle), angle))


def rodrigues(r: Vector) -> Matrix:
    """The rotation about r by its length."""

    def matrix(p: Column) -> Matrix:
        angle = p["n"]
        a = _sinc(angle)
        b = F.when(angle < 1e-8, 0.5).otherwise(F.try_divide(1 - F.cos(angle), angle * angle))
        return let(F.struct(a.alias("a"), b.alias("b"), p["r"].alias("r")), entries)

    def entries(p: Column) -> Matrix:
        a, b = p["a"], p["b"]
        x, y, z = (at(p["r"], k) for k in range(3))
        return F.array(
            1 - b * (y * y + z * z), b * x * y - a * z, b * x * z + a * y,
            b * x * y + a * z, 1 - b * (x * x + z * z), b * y * z - a * x,
            b * x * z - a * y, b * y * z + a * x, 1 - b * (x * x + y * y),
        )

    return let(r, lambda r: let(F.struct(F.sqrt(dot(r, r)).alias("n"), r.alias("r")), matrix))


def rodrigues_jacobian(r: Vector) -> Column:
    """Derivatives of the rotation's nine entries by r: an array of 27, entry by entry. Series near no rotation."""

    def factors(p: Column) -> Column:
        n = p["n"]
        small, n2 = n < 1e-4, n * n
        a, b = _sinc(n), F.when(n < 1e-8, 0.5).otherwise(F.try_divide(1 - F.cos(n), n2))
        # Derivatives of a and b by the angle, over the angle.
        da = F.when(small, -1 / 3 + n2 / 30).otherwise(F.try_divide(n * F.cos(n) - F.sin(n), n2 * n))
        db = F.when(small, -1 / 12 + n2 / 180).otherwise(F.try_divide(n * F.sin(n) - 2 * (1 - F.cos(n)), n2 * n2))
        return let(F.struct(a.alias("a"), b.alias("b"), da.alias("da"), db.alias("db"), p["r"].alias("r")), entries)

    def entries(p: Column) -> Column:
        r = [at(p["r"], k) for k in range(3)]
        turn = {(0, 1): -r[2], (0, 2): r[1], (1, 0): r[2], (1, 2): -r[0], (2, 0): -r[1], (2, 1): r[0]}
        sign = {(0, 1): (2, -1.0), (0, 2): (1, 1.0), (1, 0): (2, 1.0), (1, 2): (0, -1.0), (2, 0): (1, -1.0), (2, 1): (0, 1.0)}
        norm = r[0] * r[0] + r[1] * r[1] + r[2] * r[2]
        out = []
        for i in range(3):
            for j in range(3):
                square = r[i] * r[j] - norm * float(i == j)
                for k in range(3):
                    d = r[k] * (p["da"] * turn.get((i, j), F.lit(0.0)) + p["db"] * square)
                    axis, s = sign.get((i, j), (None, 0.0))
                    if axis == k:
                        d = d + p["a"] * s
                    d = d + p["b"] * (r[j] * float(i == k) + r[i] * float(j == k) - 2 * r[k] * float(i == j))
                    out.append(d)
        return F.array(*out)

    return let(r, lambda r: let(F.struct(F.sqrt(dot(r, r)).alias("n"), r.alias("r")), factors))


def rotated_jacobian(r: Vector, v: Vector) -> Column:
    """Derivatives of the rotated v by r: an array of 9, row by row."""
    return _pair(rodrigues_jacobian(r), v, lambda d, v: F.array(*[at(d, 9 * i + k) * at(v, 0) + at(d, 9 * i + 3 + k) * at(v, 1) + at(d, 9 * i + 6 + k) * at(v, 2) for i in range(3) for k in range(3)]))


def quaternion_jacobian(r: Vector) -> Column:
    """Derivatives of the quaternion by r: an array of 12, entry by entry."""

    def entries(p: Column) -> Column:
        n, r = p["n"], [at(p["r"], k) for k in range(3)]
        s = F.when(n < 1e-8, 0.5).otherwise(F.try_divide(F.sin(n / 2), n))
        ds = F.when(n < 1e-4, -1 / 24 + n * n / 960).otherwise(F.try_divide(n * F.cos(n / 2) / 2 - F.sin(n / 2), n * n * n))
        return F.array(*[-s / 2 * r[k] for k in range(3)], *[ds * r[i] * r[k] + s * float(i == k) for i in range(3) for k in range(3)])

    return let(r, lambda r: let(F.struct(F.sqrt(dot(r, r)).alias("n"), r.alias("r")), entries))


def inverse_rodrigues(m: Matrix) -> Vector:
    """The axis times the angle of a rotation by less than half a turn."""

    def vector(m: Matrix) -> Vector:
        cosine = F.least(F.greatest((at(m, 0) + at(m, 4) + at(m, 8) - 1) / 2, F.lit(-1.0)), F.lit(1.0))
        return let(F.acos(cosine), lambda angle: scale(unskew(m), F.when(angle < 1e-8, 1.0).otherwise(F.try_divide(angle, F.sin(angle)))))

    return let(m, vector)


def quaternion(r: Vector) -> Column:
    def parts(p: Column) -> Column:
        half = p["h"]
        s = F.when(half < 1e-8, 0.5).otherwise(F.try_divide(F.sin(half), 2 * half))
        return F.array(F.cos(half), *[at(p["r"], k) * s for k in range(3)])

    return let(r, lambda r: let(F.struct((F.sqrt(dot(r, r)) / 2).alias("h"), r.alias("r")), parts))


def from_quaternion(q: Column) -> Vector:
    def vector(p: Column) -> Vector:
        n = p["n"]
        return scale(p["v"], F.when(n < 1e-8, 2.0).otherwise(F.try_divide(2 * F.atan2(n, p["w"]), n)))

    def lengths(q: Column) -> Vector:
        v = vec(at(q, 1), at(q, 2), at(q, 3))
        return let(F.struct(v.alias("v"), F.sqrt(dot(v, v)).alias("n"), at(q, 0).alias("w")), vector)

    return let(q, lengths)


def axis_rotation(axis: int, angle: Column) -> Matrix:
    c, s, o, i = F.cos(angle), F.sin(angle), F.lit(0.0), F.lit(1.0)
    return F.array(*{0: (i, o, o, o, c, -s, o, s, c), 1: (c, o, s, o, i, o, -s, o, c), 2: (c, -s, o, s, c, o, o, o, i)}[axis])


def euler(x: Column, y: Column, z: Column, order: str = "zyx") -> Matrix:
    """The product of the axes' rotations in order, the first leftmost."""
    parts = [axis_rotation("xyz".index(c), {"x": x, "y": y, "z": z}[c]) for c in order]
    return multiply(multiply(parts[0], parts[1]), parts[2])


def to_euler_zyx(m: Matrix) -> dict[str, Column]:
    return {"ex": F.atan2(at(m, 7), at(m, 8)), "ey": F.asin(F.least(F.greatest(-at(m, 6), F.lit(-1.0)), F.lit(1.0))), "ez": F.atan2(at(m, 3), at(m, 0))}


def compose(r1: Matrix, t1: Vector, r2: Matrix, t2: Vector, s1: Column | float = 1.0, s2: Column | float = 1.0) -> tuple[Matrix, Vector, Column]:
    """The similarity that applies the second, then the first: s R x + t."""
    return multiply(r1, r2), add(scale(apply(r1, t2), s1), t1), F.lit(s1) * s2 if isinstance(s1, float) else s1 * s2


def inverse(r: Matrix, t: Vector, s: Column | float = 1.0) -> tuple[Matrix, Vector]:
    """Rotation and translation of the inverse (its scale is 1 / s)."""
    back = transpose(r)
    return back, scale(apply(back, t), F.lit(-1.0) / s)


def interpolate(r1: Vector, t1: Vector, r2: Vector, t2: Vector, share: float) -> tuple[Vector, Vector]:
    """A pose between two, along the rotation (axis-angle) from the first to the second."""
    m1 = rodrigues(r1)
    step = inverse_rodrigues(multiply(transpose(m1), rodrigues(r2)))
    turned = inverse_rodrigues(multiply(m1, rodrigues(scale(step, share))))
    return turned, vec(*[at(t1, k) * (1 - share) + at(t2, k) * share for k in range(3)])


def project(v: Vector) -> dict[str, Column]:
    return {"px": F.try_divide(at(v, 0), at(v, 2)), "py": F.try_divide(at(v, 1), at(v, 2))}


def triangulate(x1: Column, y1: Column, x2: Column, y2: Column, r: Matrix, t: Vector) -> Vector:
    """The midpoint of the shortest segment between the rays of normalised points; R, t take the first frame to the second."""
    a = vec(x1, y1, F.lit(1.0))
    b = apply(transpose(r), vec(x2, y2, F.lit(1.0)))
    c = scale(apply(transpose(r), t), -1.0)

    def midpoint(p: Column) -> Vector:
        den = p["aa"] * p["bb"] - p["ab"] * p["ab"]
        s = F.try_divide(p["ac"] * p["bb"] - p["ab"] * p["bc"], den)
        u = F.try_divide(p["ab"] * p["ac"] - p["aa"] * p["bc"], den)
        return vec(*[(at(p["a"], k) * s + at(p["c"], k) + at(p["b"], k) * u) / 2 for k in range(3)])

    def products(p: Column) -> Vector:
        own = {"aa": dot(p["a"], p["a"]), "bb": dot(p["b"], p["b"]), "ab": dot(p["a"], p["b"]), "ac": dot(p["a"], p["c"]), "bc": dot(p["b"], p["c"])}
        return let(F.struct(*[p[k].alias(k) for k in "abc"], *[v.alias(k) for k, v in own.items()]), midpoint)

    return let(F.struct(a.alias("a"), b.alias("b"), c.alias("c")), products)


def distort(x: Column, y: Column, radial: tuple[float, float, float], tangential: tuple[float, float] = (0.0, 0.0), thin: tuple[float, float] = (0.0, 0.0)) -> dict[str, Column]:
    """Radial, tangential and skew distortion of normalised points."""
    r2 = x * x + y * y
    k = 1 + r2 * (radial[0] + r2 * (radial[1] + r2 * radial[2]))
    p1, p2 = tangential
    return {
        "dx": x * k + 2 * p1 * x * y + p2 * (r2 + 2 * x * x) + thin[0] * x + thin[1] * y,
        "dy": y * k + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y + thin[1] * x,
    }


def undistort(x: Column, y: Column, radial: tuple[float, float, float], tangential: tuple[float, float] = (0.0, 0.0), steps: int = 20) -> dict[str, Column]:
    """The points that distort to x, y, by fixed-point steps."""

    def step(p: Column, _: Column) -> Column:
        d = distort(p["ux"], p["uy"], radial, tangential)
        return F.struct((p["ux"] - (d["dx"] - x)).alias("ux"), (p["uy"] - (d["dy"] - y)).alias("uy"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(x.alias("ux"), y.alias("uy")), step)
    return {"ux": found["ux"], "uy": found["uy"]}


#: Rotations between sensor frame conventions, as axes of the first in the second.
FRAMES = {("camera", "body"): (0, 0, 1, 1, 0, 0, 0, 1, 0), ("body", "camera"): (0, 1, 0, 0, 0, 1, 1, 0, 0), ("ned", "enu"): (0, 1, 0, 1, 0, 0, 0, 0, -1), ("enu", "ned"): (0, 1, 0, 1, 0, 0, 0, 0, -1)}


def change_frame(v: Vector, source: str, target: str) -> Vector:
    return apply(F.array(*[F.lit(float(x)) for x in FRAMES[(source, target)]]), v)


def image_to_normalised(px: Column, py: Column, focal: float, width: int, height: int, anchor: str = "center") -> dict[str, Column]:
    """Pixel to normalised coordinates, the principal point in the middle; anchor: where pixel (0, 0) counts as standing."""
    ox, oy = {"center": (0.0, 0.0), "top_left": (-0.5, -0.5), "top_right": (0.5, -0.5), "bottom_left": (-0.5, 0.5)}[anchor]
    return {"nx": (px + ox - (width - 1) / 2) / focal, "ny": (py + oy - (height - 1) / 2) / focal}


def rotation_speed(r0: Vector, r1: Vector, dt: Column) -> Vector:
    """Axis-angle per unit of time that takes the first rotation to the second.

    About one axis, and less than half a turn apart, it is the difference of the two, which no matrix rounds.
    """
    step = inverse_rodrigues(multiply(rodrigues(r1), transpose(rodrigues(r0))))
    gap, turn = [at(r1, k) - at(r0, k) for k in range(3)], cross(r0, r1)
    plain = (dot(turn, turn) == 0) & (F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]) < math.pi)
    return vec(*[F.try_divide(F.when(plain, gap[k]).otherwise(at(step, k)), dt) for k in range(3)])
