"""Attributes of point records: renaming, dropping, casting, unions, colours and component statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rename(df: DataFrame, names: dict[str, str], only: bool = False) -> DataFrame:
    """Columns under new names; only keeps no others. The first of two columns that would share a name wins."""
    taken: set[str] = set()
    out = []
    for c in df.columns:
        new = names.get(c, None if only else c)
        if new is not None and new not in taken:
            taken.add(new)
            out.append(df[f"`{c}`"].alias(new))
    return df.select(*out)


def drop(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def drop_colour(df: DataFrame) -> DataFrame:
    colour = {"r", "g", "b", "a", "red", "green", "blue", "alpha", "rgb", "rgba", "nir"}
    return df.drop(*[c for c in df.columns if c.lower() in colour])


def cast(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Values of another type; null where there is none."""
    return df.withColumns({c: F.col(c).cast("double").try_cast(k) if k in ("int", "bigint") and dict(df.dtypes)[c] == "string" else F.col(c).try_cast(k) for c, k in kinds.items()})


def union(members: list[DataFrame]) -> DataFrame:
    """All members' rows, null where a member lacks an attribute."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), members)


def unpack_argb(packed: Column) -> dict[str, Column]:
    return {n: F.shiftright(packed, s).bitwiseAND(255) for n, s in (("r", 16), ("g", 8), ("b", 0), ("a", 24))}


def pack_argb(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.shiftleft(a.cast("bigint"), 24).bitwiseOR(F.shiftleft(r.cast("bigint"), 16)).bitwiseOR(F.shiftleft(g.cast("bigint"), 8)).bitwiseOR(b.cast("bigint"))


def las_position(raw: Column, scale: float, offset: float) -> Column:
    """Null for the raw value that stands for no position."""
    return F.when(raw != 2147483647, raw * scale + offset)


def geometry(df: DataFrame) -> DataFrame:
    """df with x, y, z gathered in one struct column."""
    return df.select(F.struct(*[F.col(c).cast("double").alias(c) for c in "xyz"]).alias("xyz"), *[c for c in df.columns if c not in ("x", "y", "z")])


def component_boxes(labelled: DataFrame) -> DataFrame:
    """img, label and the ends, included, of the rows and columns that labelled cells (img, i, j, label) take."""
    return labelled.groupBy("img", "label").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))


def component_stats(labelled: DataFrame) -> DataFrame:
    """img, label, n, centroid, mean value and principal variances of labelled cells (img, i, j, label, value)."""
    a = labelled.groupBy("img", "label").agg(
        F.count("*").alias("n"), F.avg("i").alias("ci"), F.avg("j").alias("cj"), F.avg("value").alias("mean_value"),
        F.var_pop("i").alias("vi"), F.var_pop("j").alias("vj"), F.covar_pop("i", "j").alias("vij"),
    )
    half = (F.col("vi") + F.col("vj")) / 2
    root = F.sqrt(((F.col("vi") - F.col("vj")) / 2) * ((F.col("vi") - F.col("vj")) / 2) + F.col("vij") * F.col("vij"))
    return a.select("img", "label", "n", *[F.round(c, 6).alias(c) for c in ("ci", "cj", "mean_value")], F.round(half + root, 6).alias("major"), (F.round(half - root, 6) + 0.0).alias("minor"))
