"""Near-duplicate documents by banded MinHash and odd sketches.

A document's set is its distinct five-word shingles. HASHES MinHash samples
make bands, and the parities of the same samples make an odd sketch: in a
bitmap each (position, sample) flips one bit, so that the population count of
two sketches' XOR estimates how many samples differ, most precisely where
similarity is high. Documents of one set are a class with one representative.

Within a band's bucket each class is held against the smallest one and against
the one whose sketch is nearest, a block of members at a time; the sketches
discard candidates estimated below SKETCH_FLOOR, sizes those that cannot reach
the wanted similarity, and the full sets of the others decide. That joins most components. Where members of a bucket are then still in
different ones, all pairs of such members are compared and confirmed the same
way: no link between components is lost, and a group of copies, however near
they are to one another, costs few confirmations for each copy.

A pair at similarity 0.75 shares no bucket with probability 5e-6, and the
floor lies 4.8 standard errors below 0.75.

Cases: a null or empty text has an empty set and is linked with nothing; a
document of fewer than five words has its whole sequence as one shingle; a null
doc_id counts as smaller than any other; rows that share a doc_id are one node;
repeated rows come back each; an empty table gives no rows; other columns pass
through or are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocellus.llm._shared import Table, documents, free_name
from ocellus.llm._text import LOWER, NULL_ID, PLAIN, U64, give_back, mix, slices, span_hash, spans, utf8, window_hash
from ocellus.operators.graphs import components

SHINGLE, PERCENT = 5, 75
ROWS, BANDS = 4, 32
#: Samples of a sketch; the bands are made of the first of them.
HASHES = 192
SKETCH_BITS, SKETCH_FLOOR = 768, 0.6
#: Members of a bucket whose sketches are compared at once.
BLOCK = 1024

_rng = np.random.default_rng(77)
_MULT = _rng.integers(1, 1 << 31, HASHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_SET_SALTS = (U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F))


def shingle_sets(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document, in a row, and where each document's begin."""
    low = LOWER[b]
    starts, ends, first = spans(low, off, PLAIN)
    h = span_hash(low, starts, ends)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    w = window_hash(h, SHINGLE)
    whole = doc[: len(w)] == doc[SHINGLE - 1 :] if len(w) else np.zeros(0, dtype=bool)
    values, owner = w[whole], doc[: len(w)][whole]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        values = np.concatenate([values, [window_hash(h[first[d] : first[d + 1]], int(n[d]))[0] for d in short]]).astype(np.uint64)
        owner = np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(off)))


def signatures(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketches (64-bit words) of non-empty sets."""
    x = (values >> U64(32)).astype(np.uint32)
    samples = np.empty((len(first) - 1, HASHES), dtype=np.uint32)
    for k in range(HASHES):
        samples[:, k] = np.minimum.reduceat((x ^ _XOR[k]) * _MULT[k], first[:-1])
    keyed = mix(samples.astype(np.uint64) | (np.arange(HASHES, dtype=np.uint64) << U64(32)))
    bands = np.zeros((len(samples), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        bands = mix(bands ^ keyed[:, r : ROWS * BANDS : ROWS])
    bits = (keyed % U64(SKETCH_BITS)).astype(np.int64)
    flips = np.zeros((len(samples), SKETCH_BITS), dtype=np.uint8)
    np.add.at(flips, (np.arange(len(samples))[:, None], bits), 1)
    return bands, np.packbits(flips & 1, axis=1).view(np.uint64)


def similarity(differing: np.ndarray) -> np.ndarray:
    """The estimate from the XOR's population count."""
    inside = np.maximum(1 - 2 * np.asarray(differing, dtype=float) / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS / (4 * HASHES) * np.log(inside)


#: The largest population count whose estimate reaches the floor.
MAX_DIFFERING = int(np.flatnonzero(similarity(np.arange(SKETCH_BITS // 2)) >= SKETCH_FLOOR).max())


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["k", "n", "s1", "s2", "bands", "sketch"]
    for batch in batches:
        b, off = utf8(batch.column(1))
        for i, j in slices(off):
            values, first = shingle_sets(b[off[i] : off[j]], off[i : j + 1] - off[i])
            n = np.diff(first)
            some = np.flatnonzero(n)
            sums = [np.zeros(j - i, dtype=np.uint64) for _ in _SET_SALTS]
            bands = np.zeros((j - i, BANDS), dtype=np.uint64)
            sketch = np.zeros((j - i, SKETCH_BITS // 64), dtype=np.uint64)
            if len(some):
                at = first[:-1][some]
                for total, salt in zip(sums, _SET_SALTS, strict=True):
                    total[some] = np.add.reduceat(mix(values ^ salt), at)
                bands[some], sketch[some] = signatures(values, np.concatenate((at, [len(values)])))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.view(np.int64).reshape(-1)), x.shape[1]).cast(pa.list_(pa.int64())) for x in (bands, sketch)]
            arrays = [batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), *[pa.array(s.view(np.int64)) for s in sums], *lists]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
    give_back()


def _differing(a: str, b: str) -> Column:
    """The XOR's population count, on the JVM."""
    total = F.lit(0)
    for k in range(SKETCH_BITS // 64):
        total = total + F.bit_count(F.get(F.col(a), F.lit(k)).bitwiseXOR(F.get(F.col(b), F.lit(k))))
    return total


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted shingles of each text, 8 bytes each."""
    for batch in batches:
        b, off = utf8(batch.column(1))
        for i, j in slices(off):
            values, first = shingle_sets(b[off[i] : off[j]], off[i : j + 1] - off[i])
            raw, at = values.tobytes(), (8 * first).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([raw[s:e] for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["k", "shingles"])
    give_back()


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v = (batch.column(k).to_numpy() for k in (0, 1))
        keep = np.zeros(len(u), dtype=bool)
        for r in range(len(u)):
            one, two = (np.frombuffer(batch.column(k)[r].as_buffer(), dtype=np.uint64) for k in (2, 3))
            inter = len(np.intersect1d(one, two, assume_unique=True))
            keep[r] = len(one) > 0 and len(two) > 0 and 100 * inter >= PERCENT * (len(one) + len(two) - inter)
        yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])
    give_back()


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough; texts: k, text. A v of very many pairs is a skewed key that Spark splits.

    Each text in a pair is parsed once: its set is written, and both sides are joined to that table.
    """
    nodes = Table(pairs.select(F.explode(F.array("u", "v")).alias("k")).distinct())
    own = Table(texts.join(nodes.read(), "k", "left_semi").select("k", "text").mapInArrow(_sets, "k long, shingles binary"))
    nodes.drop()
    held = own.read()
    one = pairs.join(held.select(F.col("k").alias("u"), F.col("shingles").alias("a")).hint("merge"), "u")
    two = one.join(held.select(F.col("k").alias("v"), F.col("shingles").alias("b")).hint("merge"), "v")
    out = Table(two.select("u", "v", "a", "b").mapInArrow(_confirm, "u long, v long").distinct())
    own.drop()
    return out


def _sizes_allow(a: str, b: str) -> Column:
    """Whether sets of these sizes can be similar enough at all."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _compare_blocks(best: bool):
    """Pairs of one group (sorted by key) whose sketches are near and components differ: each member's nearest, or all.

    Of all pairs, one that shares several bands comes from the first of them alone.
    """

    def pairs(band: int, rows: list) -> tuple[np.ndarray, np.ndarray]:
        node, component, mine, other, size, sketch, bands = (np.concatenate([r[k] for r in rows]) for k in range(7))
        us, vs = [], []
        for i in range(len(node)):
            possible = 100 * np.minimum(size, size[i]) >= PERCENT * np.maximum(size, size[i])
            at = np.flatnonzero(possible & (component != component[i]) & ((mine != mine[i]) | (other == mine)) & ((node != node[i]) if best else (node < node[i])))
            if not len(at):
                continue
            apart = np.bitwise_count(sketch[at] ^ sketch[i]).sum(axis=1)
            near = at[apart <= MAX_DIFFERING]
            if best and len(near):
                near = at[[np.lexsort((node[at], apart))[0]]]
            elif len(near):
                near = near[bands[i][(bands[near] == bands[i]).argmax(axis=1)] == band]
            us.append(np.maximum(node[near], node[i]))
            vs.append(np.minimum(node[near], node[i]))
        return tuple(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (us, vs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
            data = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3, 8)]
            lists = [batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1) for k in (8, 9)]
            cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if key is not None and tuple(keys[s]) != key:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs(key[0], rows)], names=["u", "v"])
                    rows = []
                key = tuple(keys[s])
                rows.append([x[s:e] for x in (*data, *lists)])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs(key[0], rows)], names=["u", "v"])

    return run


def _rest(shared: DataFrame, found: DataFrame | None, classes: DataFrame, best: bool) -> DataFrame:
    """Candidates among those of a bucket that are in different components (None: each is one); its smallest member is held against all anyway."""
    rows = shared.where("c > 2 AND node != leader")
    if found is None:
        rows = rows.select("band", "node", F.col("node").alias("component"))
    else:
        rows = rows.join(found, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    mixed = rows.groupBy("band").agg(F.count("*").alias("c"), F.min("component").alias("a"), F.max("component").alias("b")).where("a != b")
    open_rows = rows.join(mixed.select("band", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "band").join(classes.select("node", "n", "sketch", "bands").hint("merge"), "node")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = open_rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = dealt.select("band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "component", "mine", "other", "n", "sketch", "bands")
    parts = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(_compare_blocks(best), "u long, v long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("k"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    signed = Table(texts.mapInArrow(_sign, "k long, n long, s1 long, s2 long, bands array<long>, sketch array<long>"))
    sets = signed.read().where("n > 0")
    classes = Table(sets.groupBy("s1", "s2", "n").agg(F.min("k").alias("node"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")))
    c = classes.read()
    buckets = c.select("node", F.explode("bands").alias("band"))
    leaders = buckets.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("c")).where("c > 1")
    # What is in a bucket with others, once; a hot bucket is a skewed key that Spark splits.
    shared = Table(buckets.join(leaders.hint("merge"), "band"))
    pairs = shared.read().where("node != leader").select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct()
    sketches = c.select("node", "n", "sketch").hint("merge")
    sketched = pairs.join(sketches.toDF("u", "nu", "x"), "u").join(sketches.toDF("v", "nv", "y"), "v")
    led = sketched.where(_sizes_allow("nu", "nv")).where(_differing("x", "y") <= MAX_DIFFERING).select("u", "v")
    near = Table(led.unionByName(_rest(shared.read(), None, c, best=True)).distinct())
    links = confirm(near.read(), texts)
    near.drop()
    found = Table(components(links.read()))
    # All pairs of members that are still apart; a pair with the smallest member of a shared bucket was held against it.
    rest = Table(_rest(shared.read(), found.read(), c, best=False))
    if not rest.read().isEmpty():
        more = confirm(rest.read(), texts)
        if not more.read().isEmpty():
            found.drop()
            found = Table(components(links.read().unionByName(more.read())))
        more.drop()
    rest.drop()
    of_class = c.select("s1", "s2", "n", "node").join(found.read(), "node", "left").select("s1", "s2", "n", F.coalesce("component", "node").alias("component"))
    every = signed.read().select("k", "n", "s1", "s2").join(of_class, ["s1", "s2", "n"], "left")
    component = F.coalesce("component", "k")
    out = Table(every.select(F.nullif(F.col("k"), F.lit(NULL_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(component, F.lit(NULL_ID)).alias("component_id"), (F.col("k") == component).alias("kept")))
    for t in (signed, classes, shared, links, found):
        t.drop()
    return out.read()


def first_of_each(docs: DataFrame) -> DataFrame:
    """The documents that are the first of their group, with their own columns."""
    name = free_name(docs, "dropped")
    drop = Table(near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias(name)).distinct()).read()
    return docs.join(drop, docs["doc_id"].eqNullSafe(drop[name]), "left_anti")


def op9_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
