"""Colour models as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of gray, and the fixed-point factors of YUV.
GRAY = (0.2989, 0.5870, 0.1140)
YUV = {"rv": 351, "gv": 179, "gu": 86, "bu": 443}


def log_colour(c: Column) -> Column:
    return F.ln(c)


def exp_colour(c: Column) -> Column:
    return F.exp(c)


def normalised_rgb(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Channels over the mean intensity; null for black."""
    return {f"n{n}": F.try_divide(c, (r + g + b) / 3) for n, c in (("r", r), ("g", g), ("b", b))}


def chromaticity(r: Column, g: Column, b: Column) -> dict[str, Column]:
    return {"cr": F.try_divide(r, r + g + b), "cg": F.try_divide(g, r + g + b)}


def rgb_to_hsi(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Hue in degrees (0 for gray), saturation 1 - min / intensity, intensity."""
    mean = (r + g + b) / 3
    ratio = F.try_divide((r - g + r - b) / 2, F.sqrt((r - g) * (r - g) + (r - b) * (g - b)))
    angle = F.when(ratio.isNull(), 0.0).otherwise(F.degrees(F.acos(F.least(F.greatest(ratio, F.lit(-1.0)), F.lit(1.0)))))
    return {"hue": F.when(b > g, 360 - angle).otherwise(angle), "saturation": F.coalesce(1 - F.try_divide(F.least(r, g, b), mean), F.lit(0.0)), "intensity": mean}


def gray(r: Column, g: Column, b: Column) -> Column:
    return GRAY[0] * r + GRAY[1] * g + GRAY[2] * b


#: The channels of a pixel in each colour model; the packed ones have two values for a pixel.
CHANNELS = {"rgb": "rgb", "bgr": "bgr", "rgba": "rgba", "bgra": "bgra", "cmyk": "cmyk", "hsi": "hsi", "hsv": "hsv", "yuv": "yuv", "yuyv": "yu", "yvyu": "yv"}


def in_order(channels: dict[str, Column], model: str) -> Column:
    """An array of a pixel's channels (by their letters) in a model's order."""
    return F.array(*[channels[c] for c in CHANNELS[model]])


def swap_red_blue(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return b, g, r


def yuv_to_rgb(y: Column, u: Column, v: Column) -> dict[str, Column]:
    """Integers 0 to 255, in fixed point."""
    u, v = u - 128, v - 128

    def held(c: Column) -> Column:
        return F.least(F.greatest(c, F.lit(0)), F.lit(255))

    return {
        "r": held(y + F.shiftright(YUV["rv"] * v, 8)),
        "g": held(y - F.shiftright(YUV["gv"] * v + YUV["gu"] * u, 8)),
        "b": held(y + F.shiftright(YUV["bu"] * u, 8)),
    }


def packed_yuv(pairs: str, order: str = "yuyv") -> Column:
    """Two pixels (y, u, v) from an array of four values in the order yuyv or yvyu."""
    at = (1, 3) if order == "yuyv" else (3, 1)
    u, v = (F.get(F.col(pairs), F.lit(k)) for k in at)
    return F.array(*[F.struct(F.get(F.col(pairs), F.lit(k)).alias("y"), u.alias("u"), v.alias("v")) for k in (0, 2)])
