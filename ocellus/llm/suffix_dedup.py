"""Removal of byte strings that occur earlier, by suffix arrays of shards.

Only text around a repeated anchor can repeat: in each string of the wanted
length the half-length string of least hash is the anchor, and all strings of
one anchor are a segment. Segments of equal bytes repeat as a whole. Where an
anchor stands in different segments, the first of each goes, as bytes, to the
shard of its anchor. A shard's suffixes are put in order by external induced
sorting, which carries common prefixes along; suffixes that share the wanted
length are neighbours there, and all but the earliest of them are removed.

An anchor that stands in more than HOT different segments is extended, by half
of what is missing to the wanted length each time, to one side or the other of
each string, which parts its segments and spreads them over the shards. Only
the segments' own bytes are handled again for that.

A shard is a partition of the shuffle, of any size: its text, the places of its
segments and its queues are in scratch files of its worker where they exceed
the memory that they are given. Matches never cross documents, as segments end
in a symbol that no byte has.

Cases: a null or empty text has no bytes; a document shorter than the wanted
length loses nothing; a null doc_id (or -2**63) counts as smaller than any
other; rows that share a doc_id are ordered by their texts' hashes, so
different texts are different documents; rows alike in both are one document,
and each of them is judged as that document is; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.llm._shared import Table, documents
from ocellus.llm._text import NULL_ID, give_back, mix, ranges, runs, sequence_hash, slices, utf8
from ocellus.llm.substrings import _keyed, _removed, later_places, listed, repeated_segments, segments, shared_anchors
from ocellus.llm.suffix import IN_MEMORY, Growing, Scratch, suffix_order

LENGTH = 100
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
#: Symbols of a shard's text: the end, the end of a segment, and the bytes.
END, BREAK, FIRST_BYTE, SYMBOLS = 0, 1, 2, 258
#: Different segments of one anchor beyond which the anchor is extended.
HOT = 512


def byte_units(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _BYTES[b], off


def _binaries(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """Bytes in a row as binaries of these sizes."""
    ends = np.concatenate(([0], np.cumsum(size)))
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _cut_segments(length: int):
    """The bytes of listed segments; rows k, t, text, list of (a, run)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, off = utf8(batch.column(2))
            k, t, found = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for i, j in slices(off):
                part = found.slice(i, j - i)
                flat = part.flatten()
                a, packed = (flat.field(x).to_numpy() for x in range(2))
                doc = i + np.repeat(np.arange(j - i), part.value_lengths().to_numpy())
                size = (packed & 0xFFFFFFFF) + length - 1
                cut = _binaries(b[ranges(off[doc] + (packed >> 32), size)], size)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(k[doc]), pa.array(t[doc]), pa.array(packed), cut], names=["a", "k", "t", "run", "s"])
        give_back()

    return run


def _part_segments(lengths: list[int]):
    """Segments parted by longer anchors; rows a, k, t, run, s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, off = utf8(batch.column(4))
            k, t, packed = (batch.column(x).to_numpy() for x in (1, 2, 3))
            for i, j in slices(off):
                part, first = b[off[i] : off[j]], off[i : j + 1] - off[i]
                h, first = byte_units(part, first)
                made = segments(h, first, lengths)
                size = made.n - 1 + lengths[-1]
                f = sequence_hash(h, made.start, made.start + size)
                own = i + made.doc
                place = (packed[own] >> 32) + made.start - first[made.doc]
                columns = [made.anchors[-1].view(np.int64), f.view(np.int64), k[own], t[own], place << 32 | made.n]
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], _binaries(part[ranges(made.start, size)], size)], names=["a", "f", "k", "t", "run", "s"])
        give_back()

    return run


class _Shard:
    """The segments of a shard, as they come."""

    def __init__(self, limit: int = IN_MEMORY):
        self.scratch = Scratch(limit)
        self.text, self.n = Growing(self.scratch, np.uint16), 0
        self.owner = [Growing(self.scratch, np.int64) for _ in range(5)]

    def add(self, k: np.ndarray, t: np.ndarray, p: np.ndarray, data: np.ndarray, size: np.ndarray) -> None:
        """size: of each segment, whose bytes stand in data in a row."""
        starts = np.concatenate(([0], np.cumsum(size + 1)))
        text = np.full(int(starts[-1]), BREAK, dtype=np.uint16)
        text[ranges(starts[:-1], size)] = data.astype(np.uint16) + FIRST_BYTE
        self.text.add(text)
        for x, values in zip(self.owner, (self.n + starts[:-1], size, k, t, p), strict=True):
            x.add(values)
        self.n += len(text)

    def later(self, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs (k, t, p << 32 | n) of strings that stand earlier in these segments."""
        if not self.n:
            return
        self.text.add(np.array([END]))
        text, (starts, sizes, k, t, p) = self.text.done(), [x.done() for x in self.owner]
        flags = self.scratch.array(len(text), bool)
        held = None  # the earliest place of the group that is open
        for place, lcp in suffix_order(text, SYMBOLS, length, self.scratch):
            together = lcp >= length
            place = place.astype(np.int64)
            if held is not None:
                place, together = np.append(held, place), np.append(False, together)
            # The last entry may go on in the next block.
            member = together | np.append(together[1:], True)
            at, group = place[member], np.cumsum(~together[member])
            owner = np.searchsorted(starts, at, side="right") - 1
            own = np.stack([k[owner], t[owner], p[owner] + at - starts[owner]])
            order = np.lexsort((*own[::-1], group))
            at, group, owner, own = at[order], group[order], owner[order], own[:, order]
            # A repeated row has the same places again, which are not later.
            least = np.searchsorted(group, group)
            again = (own != own[:, least]).any(axis=0)
            # Strings that reach into the next segment are none.
            inside = at - starts[owner] + length <= sizes[owner]
            flags[at[again & inside]] = True
            held = at[np.searchsorted(group, group[-1])]
        step = self.scratch.block
        for i in range(0, len(flags), step):
            s, e = runs(np.ascontiguousarray(flags[i : i + step]))
            if len(s):
                owner = np.searchsorted(starts, s + i, side="right") - 1
                yield k[owner], t[owner], (p[owner] + s + i - starts[owner]) << 32 | e - s


def _sort_shards(length: int):
    """Rows a, k, t, run, s: a partition is a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            data, off = utf8(batch.column(4))
            k, t, packed = (batch.column(x).to_numpy() for x in (1, 2, 3))
            shard.add(k, t, packed >> 32, data, np.diff(off))
        for columns in shard.later(length):
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c)) for c in columns], names=["k", "t", "run"])
        give_back()

    return run


def _anchor_levels(length: int) -> list[int]:
    """Lengths of anchors: half of what is wanted, and each time nearer to it by half of what is missing."""
    out = [(length + 1) // 2]
    while length - out[-1] > 1:
        out.append((length + out[-1] + 1) // 2)
    return out


def spread_anchors(cut: DataFrame, length: int = LENGTH, hot: int = HOT) -> tuple[DataFrame, list[DataFrame]]:
    """Different segments of each anchor (a, k, t, run, s) with those of hot anchors parted; and places that are found to be later on the way."""
    later, settled, lengths = [], [], _anchor_levels(length)
    for m in range(2, len(lengths) + 1):
        many = Table(cut.groupBy("a").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("a")).read()
        if many.isEmpty():
            break
        settled.append(cut.join(many, "a", "left_anti"))
        pieces = Table(cut.join(many, "a", "left_semi").mapInArrow(_part_segments([*lengths[:m], length]), "a long, f long, k long, t long, run long, s binary")).read()
        firsts = Table(pieces.groupBy("a", "f").agg(F.min(F.struct("k", "t", "run", "s")).alias("first"), F.count("*").alias("c"))).read()
        places = firsts.select("a", "f", "c", F.struct("first.k", "first.t", "first.run").alias("first"))
        later.append(later_places(pieces.drop("s"), ["a", "f"], places))
        cut = Table(firsts.join(shared_anchors(firsts).read(), "a", "left_semi").select("a", "first.*")).read()
    for s in settled:
        cut = cut.unionByName(s)
    return cut, later


def repeats(texts: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """k, t and a list of runs of strings (p << 32 | n) that occur earlier too."""
    found, firsts = repeated_segments(texts, [(length + 1) // 2, length], byte_units)
    f = firsts.read()
    lists = f.join(shared_anchors(f).read(), "a", "left_semi").select("a", "first.*").groupBy("k", "t").agg(F.collect_list(F.struct("a", "run")).alias("listed"))
    cut = Table(texts.join(lists, ["k", "t"]).select("k", "t", "text", "listed").mapInArrow(_cut_segments(length), "a long, k long, t long, run long, s binary"))
    parted, later = spread_anchors(cut.read(), length, hot)
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = Table(parted.repartition(parts, "a").mapInArrow(_sort_shards(length), "k long, t long, run long")).read()
    for rows in [later_places(found.read().withColumnRenamed("a0", "a"), ["a", "f"], f), *later]:
        out = out.unionByName(rows)
    runs_ = Table(listed(out))
    for table in (found, firsts, cut):
        table.drop()
    return runs_.read()


def _kept_bytes(length: int, digest: bool):
    names = ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * (not digest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, off = utf8(batch.column(1))
            rows = []
            for d, found in enumerate(batch.column(2)):
                own, spans = b[off[d] : off[d + 1]], 0
                total = len(own)
                if found.values is not None:
                    gone = _removed(found.values.to_numpy(), total, length)
                    spans, own = len(runs(gone)[0]), own[~gone]
                kept = own.tobytes()
                rows.append((total, total - len(own), spans, hashlib.sha256(kept).hexdigest(), *[kept] * (not digest)))
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * (not digest)
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=names)
        give_back()

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, without digest, the kept bytes."""
    texts = _keyed(docs)
    out = texts.join(repeats(texts, length, hot), ["k", "t"], "left").select("k", "text", "listed")
    made = out.mapInArrow(_kept_bytes(length, digest), "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * (not digest))
    return Table(made.withColumn("doc_id", F.nullif(F.col("k"), F.lit(NULL_ID))).select("doc_id", *made.columns[1:])).read()


def op3_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir), digest=True)
