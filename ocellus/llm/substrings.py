"""Removal of word windows that occur earlier, by level-wise doubling.

The first level looks at windows of a quarter of the wanted length, and of those
only at anchors: in each wanted window the short window of least hash. Equal
windows have equal anchors, so a wanted window whose anchor occurs once occurs
once. Where an anchor is repeated, it alone is extended to a window of twice the
length that still lies in the wanted one, and counted again, level by level,
until no candidate survives or the wanted length is reached. There, all windows
of one anchor are a segment; segments of equal words repeat as a whole, and
only where an anchor stands in different segments are single windows compared.
Windows longer than wanted would change nothing that is removed.

Rows that are shuffled are hashes and places, not texts, until the kept words
are written; every group is pre-aggregated to its first place, and what is
joined back on a key of very many rows is a skewed join that Spark splits. Most
segments have an anchor that occurs once, and a bitmap of the repeated ones, of
bounded size, holds back nearly all of these before the shuffle; an exact join
drops those that pass.

Cases: a null or empty text has no words; a document shorter than a window
loses nothing; a null doc_id (or -2**63) counts as smaller than any other; rows
that share a doc_id are ordered by their texts' hashes, so different texts are
different documents; rows alike in both are one document, and each of them is
judged as that document is; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.llm._shared import Table, documents
from ocellus.llm._text import NULL_ID, PLAIN, WINDOW_BASES, give_back, leftmost_least, ranges, sequence_hash, slices, span_hash, spans, utf8, window_hash

WIDTH = 20
#: The shortest windows that a first level looks at.
LEAST = 5
#: Bits of a sieve for each repeated anchor, and the binary logarithms of the least and the most bits in all (4 KB, 16 MB).
SIEVE_SHARE, SIEVE_LEAST, SIEVE_MOST = 16, 15, 27
#: Bytes of a shuffle partition up to which it is hashed for a join, where all are that small.
BUILD_BYTES = 16 << 20
_BUILD = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"


@contextlib.contextmanager
def hashed_joins(spark: SparkSession) -> Iterator[None]:
    """Within, a join hashes a side whose shuffle partitions all turn out small, and does not sort the other."""
    before = spark.conf.get(_BUILD)
    spark.conf.set(_BUILD, str(BUILD_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BUILD, before)


def _keyed(docs: DataFrame) -> DataFrame:
    """k, t and text: a document is known by its id and, where rows share that, its text's hash (else 0, which costs nothing to shuffle)."""
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    shared = Table(docs.select(k.alias("k")).groupBy("k").agg(F.count("*").alias("_c")).where("_c > 1"))
    rows = docs.select(k.alias("k"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(shared.read(), "k", "left")
    return rows.select("k", F.when(F.col("_c").isNull(), 0).otherwise(F.xxhash64("text")).alias("t"), "text")


def levels(width: int, least: int) -> list[int]:
    """Window lengths, each at most twice the one before; the last is the wanted one."""
    out = [width]
    while (half := (out[0] + 1) // 2) >= least:
        out.insert(0, half)
    return out if len(out) > 1 else [max(1, (width + 1) // 2), width]


@dataclass
class Segments:
    """Runs of wanted windows whose anchors agree at every level: the document, the first window, how many, and the anchors' hashes and places."""

    doc: np.ndarray
    start: np.ndarray
    n: np.ndarray
    anchors: list[np.ndarray]
    places: list[np.ndarray]


def segments(h: np.ndarray, first: np.ndarray, lengths: list[int]) -> Segments:
    """h: hashes of the units (words or bytes) of all documents; first: where each document's begin."""
    width = lengths[-1]
    hashes = [window_hash(h, n) for n in lengths[:-1]]
    at = leftmost_least(hashes[0], width - lengths[0] + 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    own = np.flatnonzero(doc[: len(at)] == doc[width - 1 :]) if len(at) else np.zeros(0, np.int64)
    if not len(own):
        z = np.zeros(0, np.int64)
        return Segments(z, z, z, [z.view(np.uint64)] * len(hashes), [z] * len(hashes))
    place = at[own]
    places = [place]
    for n, more in zip(lengths, lengths[1:-1], strict=False):
        # To the right while that lies in the wanted window, else to the left.
        place = np.where(place + more <= own + width, place, place + n - more)
        places.append(place)
    new = np.ones(len(own), dtype=bool)
    new[1:] = own[1:] != own[:-1] + 1
    for p in places:
        new[1:] |= p[1:] != p[:-1]
    start = np.flatnonzero(new)
    return Segments(doc[own[start]], own[start], np.diff(np.concatenate((start, [len(own)]))), [g[p[start]] for g, p in zip(hashes, places, strict=True)], [p[start] for p in places])


def _changes(x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    out[1:] = x[1:] != x[:-1]
    return out


def _emit_anchors(lengths: list[int], units):
    """The hash of each place that is an anchor of the first level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, off = utf8(batch.column(0))
            for i, j in slices(off):
                h, first = units(b[off[i] : off[j]], off[i : j + 1] - off[i])
                made = segments(h, first, [lengths[0], lengths[-1]])
                yield pa.RecordBatch.from_arrays([pa.array(made.anchors[0][_changes(made.places[0])].view(np.int64))], names=["a0"])
        give_back()

    return run


def sieve(anchors: DataFrame) -> np.ndarray:
    """A bitmap with the low bits of the column a0 set, and of others few, or many if there are more anchors than its most bits."""
    bits = min(max((SIEVE_SHARE * anchors.count()).bit_length(), SIEVE_LEAST), SIEVE_MOST)
    at = F.col("a0").bitwiseAND(F.lit((1 << bits) - 1))
    pieces = anchors.select(F.shiftright(at, SIEVE_LEAST).alias("piece"), at.bitwiseAND(F.lit((1 << SIEVE_LEAST) - 1)).alias("bit")).repartition("piece")
    out = np.zeros((1 << bits - SIEVE_LEAST, 1 << SIEVE_LEAST - 3), dtype=np.uint8)
    for piece, part in pieces.groupBy("piece").agg(F.bitmap_construct_agg("bit")).collect():
        out[piece] = np.frombuffer(part, dtype=np.uint8)
    return out.ravel()


def _passes(a: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = a & np.uint64(8 * len(bitmap) - 1)
    return bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) > 0


def _emit_segments(lengths: list[int], units, held: Broadcast | None = None):
    """Segments: anchors of each level and, but for the first, how far into the segment they stand, the hash of all units, the document, and packed place and length.

    held: a sieve that the first anchors pass.
    """
    m = len(lengths) - 1
    names = [*[f"a{j}" for j in range(m)], *[f"at{j}" for j in range(1, m)], "f", "k", "t", "run"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, off = utf8(batch.column(2))
            k, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j in slices(off):
                h, first = units(b[off[i] : off[j]], off[i : j + 1] - off[i])
                made = segments(h, first, lengths)
                on = slice(None) if held is None else _passes(made.anchors[0], held.value)
                doc, start, n = made.doc[on], made.start[on], made.n[on]
                f = sequence_hash(h, start, start + n - 1 + lengths[-1])
                columns = [*[a[on] for a in made.anchors], *[(p[on] - start).astype(np.int32) for p in made.places[1:]], f, k[i + doc], t[i + doc], (start - first[doc]) << 32 | n]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names=names)
        give_back()

    return run


def words(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = spans(b, off, PLAIN)
    return span_hash(b, starts, ends), first


def _emit_windows(width: int):
    """Hashes of the windows of listed segments; rows k, t, text, list of p << 32 | n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, off = utf8(batch.column(2))
            k, t, listed = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for i, j in slices(off):
                h, first = words(b[off[i] : off[j]], off[i : j + 1] - off[i])
                part = listed.slice(i, j - i)
                packed = part.flatten().to_numpy()
                doc = np.repeat(np.arange(j - i), part.value_lengths().to_numpy())
                p, n = packed >> 32, packed & 0xFFFFFFFF
                at = ranges(first[doc] + p, n)
                hashes = [window_hash(h, width, base)[at].view(np.int64) for base in WINDOW_BASES]
                own = np.repeat(i + doc, n)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*hashes, k[own], t[own], ranges(p, n) << 32 | 1)], names=["h1", "h2", "k", "t", "run"])
        give_back()

    return run


def _removed(listed: np.ndarray, n: int, width: int) -> np.ndarray:
    """Flags of the units that the listed runs of windows (p << 32 | n) cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    p = listed >> 32
    np.add.at(edge, p, 1)
    np.add.at(edge, p + (listed & 0xFFFFFFFF) - 1 + width, -1)
    return np.cumsum(edge)[:-1] > 0


def _covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Flags of n places, true in the given ranges, none of which overlap."""
    edge = np.zeros(n + 1, dtype=np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8).view(bool)


def _kept_words(width: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, off = utf8(batch.column(1))
            listed, total, removed, out = batch.column(2), [], [], []
            for i, j in slices(off):
                part = b[off[i] : off[j]]
                starts, ends, first = spans(part, off[i : j + 1] - off[i], PLAIN)
                found = listed.slice(i, j - i)
                # A null list has no values; runs are placed among the words of the whole slice.
                runs_of = np.repeat(first[:-1], found.value_lengths().fill_null(0).to_numpy())
                gone = _removed(found.flatten().to_numpy() + (runs_of << 32), len(starts), width)
                s, e = starts[~gone], ends[~gone]
                to = np.concatenate(([0], np.cumsum(~gone)))[first]
                # Each word with a space after it, which the last of a document leaves out.
                at = np.concatenate(([0], np.cumsum(e - s + 1)))
                kept, word = np.full(at[-1], 0x20, dtype=np.uint8), np.ones(at[-1], dtype=bool)
                word[at[1:] - 1] = False
                kept[word] = part[_covered(s, e, len(part))]
                total.extend(np.diff(first).tolist())
                removed.extend((np.diff(first) - np.diff(to)).tolist())
                for x, y in zip(at[to[:-1]].tolist(), at[to[1:]].tolist(), strict=True):
                    text = kept[x : max(x, y - 1)].tobytes()
                    out.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], names=["k", "n_words", "n_removed", "kept"])
        give_back()

    return run


def repeated_segments(texts: DataFrame, lengths: list[int], units, sieved: bool = False) -> tuple[Table, Table]:
    """Segments whose anchors are repeated at every level, and for each distinct one (a, f) its first place and how often it is there.

    sieved: hold back segments before their shuffle.
    """
    m = len(lengths) - 1
    kinds = [*[f"a{j} long" for j in range(m)], *[f"at{j} int" for j in range(1, m)], "f long", "k long", "t long", "run long"]
    anchors = texts.select("text").mapInArrow(_emit_anchors(lengths, units), "a0 long")
    # A written table has an exchange of its own, so that Spark can split what a frequent anchor is joined to.
    twice = Table(anchors.groupBy("a0").agg(F.count("*").alias("c")).where("c > 1").select("a0"))
    held = texts.sparkSession.sparkContext.broadcast(sieve(twice.read())) if sieved else None
    found = Table(texts.mapInArrow(_emit_segments(lengths, units, held), ", ".join(kinds)).join(twice.read(), "a0", "left_semi").drop(*["a0"] * (m > 1)))
    twice.drop()
    if held is not None:
        held.destroy()
    for j in range(1, m):
        if found.read().isEmpty():
            break
        rows = found.read()
        # An anchor that several segments share is repeated only if it stands at several places.
        place = F.xxhash64("k", "t", F.shiftright("run", 32) + F.col(f"at{j}"))
        again = Table(rows.groupBy(f"a{j}").agg(F.min(place).alias("one"), F.max(place).alias("other")).where("one != other").select(f"a{j}"))
        kept = Table(rows.drop(f"at{j}").join(again.read(), f"a{j}", "left_semi").drop(*[f"a{j}"] * (j < m - 1)))
        again.drop()
        found.drop()
        found = kept
    last = f"a{m - 1}"
    firsts = Table(found.read().groupBy(F.col(last).alias("a"), "f").agg(F.min(F.struct("k", "t", "run")).alias("first"), F.count("*").alias("c")))
    return found, firsts


def shared_anchors(firsts: DataFrame) -> Table:
    """Anchors that stand in different segments."""
    return Table(firsts.groupBy("a").agg(F.count("*").alias("d")).where("d > 1").select("a", "d"))


def later_places(rows: DataFrame, keys: list[str], firsts: DataFrame) -> DataFrame:
    """Rows at a place after the first of their key; a key of very many rows is split by Spark."""
    return rows.join(firsts.where("c > 1").select(*keys, "first"), keys).where(F.struct("k", "t", "run") > F.col("first")).select("k", "t", "run")


def listed(rows: DataFrame) -> DataFrame:
    """k, t and the distinct runs of a document."""
    return rows.groupBy("k", "t").agg(F.collect_set("run").alias("listed"))


def repeats(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """k, t and a list of runs of windows (p << 32 | n) that occur earlier too."""
    lengths = levels(width, LEAST)
    found, firsts = repeated_segments(texts, lengths, words, sieved=True)
    f = firsts.read()
    lists = listed(f.join(shared_anchors(f).read(), "a", "left_semi").select("first.*"))
    windows = Table(texts.join(lists, ["k", "t"]).select("k", "t", "text", "listed").mapInArrow(_emit_windows(width), "h1 long, h2 long, k long, t long, run long"))
    w = windows.read()
    first_windows = Table(w.groupBy("h1", "h2").agg(F.min(F.struct("k", "t", "run")).alias("first"), F.count("*").alias("c")).where("c > 1")).read()
    whole = later_places(found.read().withColumnRenamed(f"a{len(lengths) - 2}", "a"), ["a", "f"], f)
    return listed(whole.unionByName(later_places(w, ["h1", "h2"], first_windows)))


def without_repeats(docs: DataFrame, width: int = WIDTH, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words, joined by a space (or their SHA-256)."""
    with hashed_joins(docs.sparkSession):
        texts = _keyed(docs)
        out = texts.join(repeats(texts, width), ["k", "t"], "left").select("k", "text", "listed")
        made = out.mapInArrow(_kept_words(width, digest), "k long, n_words long, n_removed long, kept string")
        return Table(made.select(F.nullif(F.col("k"), F.lit(NULL_ID)).alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256" if digest else "text"))).read()


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir), digest=True)
