"""Graphs as edge tables (u, v, w)."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ocellus.operators.iteration import Step


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree, weight of all edges at a node."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"), "w")
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("w").alias("weight"))


def edge_index(edges: DataFrame) -> DataFrame:
    """node, k, other: the edges of each node, numbered by the other end."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("other")))
    return both.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("other")) - 1)


def lookup(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (a, b) with the weight of the edge between, whichever way; null without one."""
    e = edges.select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), "w").groupBy("lo", "hi").agg(F.sum("w").alias("w"))
    return asked.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(e, ["lo", "hi"], "left").select("a", "b", "w")


def reachable(edges: DataFrame, cut: DataFrame, start: DataFrame, direction: str = "both") -> DataFrame:
    """Nodes that start (node) reaches without the edges in cut (u, v): breadth first, each level written."""
    e = edges.join(cut.select("u", "v"), ["u", "v"], "left_anti").select("u", "v")
    if direction == "backward":
        e = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
    if direction == "both":
        e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    e = Step(e.distinct())
    seen = front = Step(start.select("node").distinct())
    while True:
        new = Step(front.read().join(e.read(), F.col("node") == F.col("u")).select(F.col("v").alias("node")).distinct().join(seen.read(), "node", "left_anti"))
        if new.read().isEmpty():
            new.drop()
            e.drop()
            return seen.read()
        grown = Step(seen.read().unionByName(new.read()))
        for old in {id(x): x for x in (seen, front)}.values():
            old.drop()
        seen, front = grown, new


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that it is connected with; large and small stars until nothing changes.

    Every step pre-aggregates before it shuffles, and a node with very many links is a skewed join key, which Spark
    splits; rounds grow as the logarithm of the longest path.
    """
    now = Step(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    before = None
    while True:
        said = now.read().agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if said == before:
            break
        before = said
        e = now.read()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = Step(both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        e = large.read()
        m = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(m, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = Step(small.unionByName(m.select("u", F.col("m").alias("v"))).distinct())
        now.drop()
        large.drop()
        now = new
    pairs = now.read().select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(pairs, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def mask_components(mask: DataFrame, full: bool = False) -> DataFrame:
    """img, i, j, label of the cells of a mask: the least cell number (i * 2^20 + j) of the component; faces, or corners too."""
    steps = [(0, 1), (1, 0), (1, 1), (1, -1)] if full else [(0, 1), (1, 0)]
    key = (F.col("img").cast("bigint") * (1 << 40)) + F.col("i").cast("bigint") * (1 << 20) + F.col("j")
    cells = mask.select("img", "i", "j", key.alias("u"))
    near = cells.withColumn("_s", F.explode(F.array(*[F.lit(a * (1 << 20) + b) for a, b in steps]))).select("u", (F.col("u") + F.col("_s")).alias("v"))
    links = near.join(cells.select(F.col("u").alias("v")), "v").select("u", "v")
    found = components(links).withColumnRenamed("node", "u")
    return cells.join(found, "u", "left").select("img", "i", "j", (F.coalesce("component", "u") % (1 << 40)).alias("label"))


def twins(half_edges: DataFrame) -> DataFrame:
    """edge, twin: the half-edge that runs the other way; null on the border."""
    other = half_edges.select(F.col("edge").alias("twin"), F.col("a").alias("b"), F.col("b").alias("a"))
    return half_edges.join(other, ["a", "b"], "left").select("edge", "twin")


def with_exterior(half_edges: DataFrame) -> DataFrame:
    """half_edges (edge, face, a, b) and, for each without a twin, the exterior one that runs the other way: edge -1 - edge, no face."""
    lone = half_edges.join(twins(half_edges).where("twin IS NULL").select("edge"), "edge", "left_semi")
    outside = lone.select((-1 - F.col("edge")).alias("edge"), F.lit(None).cast(half_edges.schema["face"].dataType).alias("face"), F.col("b").alias("a"), F.col("a").alias("b"))
    return half_edges.select("edge", "face", "a", "b").unionByName(outside)


def polygon_edges(faces: DataFrame, stride: int = 1 << 20) -> DataFrame:
    """edge (face * stride + k), face, a, b of faces (face, corners array of fewer than stride)."""
    n = F.size("corners")
    ends = F.transform("corners", lambda a, k: F.struct(k.alias("k"), a.alias("a"), F.get(F.col("corners"), (k + 1) % n).alias("b")))
    return faces.select("face", F.explode(ends).alias("e")).select((F.col("face").cast("bigint") * stride + F.col("e.k")).alias("edge"), "face", "e.a", "e.b")


def flow(edges: list[tuple[int, int, float]], source: int, sink: int) -> tuple[float, list[int]]:
    """Greatest flow, and the places of all saturated edges."""
    total, full, _ = min_cut(edges, source, sink)
    return total, full


def min_cut(edges: list[tuple[int, int, float]], source: int, sink: int) -> tuple[float, list[int], set[int]]:
    """Greatest flow along shortest augmenting paths, the places of all saturated edges, and the nodes on the source's side of the least cut."""
    ends: list[int] = []
    room: list[float] = []
    at: dict[int, list[int]] = {}
    for u, v, w in edges:
        for a, b, c in ((u, v, w), (v, u, 0.0)):
            at.setdefault(a, []).append(len(ends))
            ends.append(b)
            room.append(c)
    total = 0.0
    while True:
        came: dict[int, int] = {source: -1}
        queue = deque([source])
        while queue and sink not in came:
            u = queue.popleft()
            for k in at.get(u, ()):
                if room[k] > 1e-12 and ends[k] not in came:
                    came[ends[k]] = k
                    queue.append(ends[k])
        if sink not in came or source == sink:
            return total, [k for k in range(len(edges)) if room[2 * k] <= 1e-12 and edges[k][2] > 0], set(came)
        path, x = [], sink
        while x != source:
            path.append(came[x])
            x = ends[came[x] ^ 1]
        least = min(room[k] for k in path)
        for k in path:
            room[k] -= least
            room[k ^ 1] += least
        total += least


def source_side(edges: list[tuple[int, int, float]], source: int, sink: int) -> set[int]:
    """The nodes on the source's side of the least cut, the fewest of several, as min_cut(): all shortest paths of one length are filled from one search."""
    ends: list[int] = []
    room: list[float] = []
    at: dict[int, list[int]] = {source: [], sink: []}
    for u, v, w in edges:
        for a, b, c in ((u, v, w), (v, u, 0.0)):
            at.setdefault(a, []).append(len(ends))
            ends.append(b)
            room.append(c)
    while True:
        level, front = {source: 0}, [source]
        while front and sink not in level:
            reached = []
            for u in front:
                for k in at[u]:
                    if room[k] > 1e-12 and ends[k] not in level:
                        level[ends[k]] = level[u] + 1
                        reached.append(ends[k])
            front = reached
        if sink not in level or source == sink:
            return set(level)
        left, path, u = {v: iter(at[v]) for v in level}, [], source
        k = next(left[u], None)
        while k is not None or path:
            if k is None:
                # A dead end: back, and on to the next edge of the node before.
                u = ends[path.pop() ^ 1]
                k = next(left[u], None)
                continue
            v = ends[k]
            if room[k] <= 1e-12 or level.get(v) != level[u] + 1 or (level[v] == level[sink] and v != sink):
                k = next(left[u], None)
                continue
            path.append(k)
            u = v
            if v == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                # Back to before the first edge that is full; those beyond it wait for the next search.
                full = next(n for n, e in enumerate(path) if room[e] <= 1e-12)
                u = ends[path[full] ^ 1]
                del path[full:]
            k = next(left[u], None)


def max_flow(edges: DataFrame) -> DataFrame:
    """g, flow and the number of saturated edges for each group of edges (g, u, v, w) from -1 to -2; a group is one graph."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "v"])
        total, cut = flow(list(pdf[["u", "v", "w"]].itertuples(index=False, name=None)), -1, -2)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "flow": [total], "saturated": [len(cut)]})

    return edges.select("g", "u", "v", F.col("w").cast("double").alias("w")).groupBy("g").applyInPandas(run, "g long, flow double, saturated long")
