"""Benchmark decontamination by suffix arrays over the training text.

A shard is a batch of documents. Its words, numbered by the benchmark's
vocabulary, form runs that no word outside that vocabulary interrupts; only in
a run as long as the shortest window can a window occur, so the shard's suffix
array is built over those runs alone (prefix doubling over word numbers).
Every suffix of the benchmark is then looked up by binary search, all at once:
the longer of the common prefixes with its two neighbours in the array is its
longest verbatim match there, and the interval of the array that shares it is
every place of that match. Suffixes whose match reaches a window give the hit
words and items of the documents; longest_matches() gives, for each suffix, the
longest match over all shards and its first place. A document lies in one
shard, so documents are never shuffled.

The benchmark is sent to the workers in blocks of at most BLOCK_BYTES of text,
which a count over the table finds out first; an index is arrays over a block's
words, some INDEX_FACTOR times its text, and goes out as a broadcast. With more
blocks than one, the hits of each block are carried along with the documents
through a table.

Cases: a null or empty text has no words; an item without words has no
windows; items that share an id count once; a null item_id counts as an empty
one; a null doc_id is kept; repeated rows are judged each; with an empty
benchmark nothing is hit; other columns pass through or are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocellus.llm._shared import Table, documents, free_name
from ocellus.llm._text import ALNUM, LOWER, NULL_ID, U64, WINDOW_BASES, give_back, ranges, runs, sequence_hash, slices, span_hash, spans, utf8

WINDOW = 13
#: A document is contaminated when this times its hit words reach its words.
SHARE = 20
BLOCK_BYTES = 16 << 20
#: Bytes of an index for each byte of its text, at most; a test holds it.
INDEX_FACTOR = 8
#: Words in runs from which a shard's suffix array is built before its batch ends.
SHARD_WORDS = 4_000_000
_FILTER_BITS = 20


def word_hashes(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and where each document's begin."""
    low = LOWER[b]
    starts, ends, first = spans(low, off, ALNUM)
    return span_hash(low, starts, ends), first


@dataclass
class Index:
    """A block of the benchmark as arrays: its vocabulary, its words, its distinct windows, and which items hold each."""

    vocabulary: np.ndarray
    seen: np.ndarray
    names: list[str]
    #: Word numbers of all items in a row, and where each item's begin.
    words: np.ndarray
    first: np.ndarray
    #: A start in words and a length for each distinct window; the items that hold it stand from owned[w] to owned[w + 1].
    starts: np.ndarray
    lengths: np.ndarray
    owned: np.ndarray
    owners: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str, str]], width: int = WINDOW) -> Index:
        h, first = word_hashes(*utf8(pa.array([t for _, t in rows], pa.large_string())))
        vocabulary, words = np.unique(h, return_inverse=True)
        seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
        seen[(vocabulary & U64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        names = sorted({n for n, _ in rows})
        number = {n: k for k, n in enumerate(names)}
        item = np.array([number[n] for n, _ in rows], dtype=np.int64)
        n = np.diff(first)
        size = np.minimum(n, width)
        count = np.where(n > 0, n - size + 1, 0)
        starts, size, item = ranges(first[:-1], count), np.repeat(size, count), np.repeat(item, count)
        # Windows are told apart by 128 bits.
        one, two = (sequence_hash(h, starts, starts + size, base) for base in WINDOW_BASES)
        order = np.lexsort((item, two, one))
        one, two, starts, size, item = one[order], two[order], starts[order], size[order], item[order]
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        fresh = new.copy()
        fresh[1:] |= item[1:] != item[:-1]
        window = np.cumsum(new) - 1
        owned = np.searchsorted(window[fresh], np.arange(int(new.sum()) + 1))
        return cls(vocabulary, seen, names, words.astype(np.int32), first, starts[new], size[new], owned, item[fresh].astype(np.int32))

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.vocabulary, self.seen, self.words, self.first, self.starts, self.lengths, self.owned, self.owners))

    def wanted(self, starts: np.ndarray, lengths: np.ndarray, deep: int) -> np.ndarray:
        """The words of ranges, a row for each, up to the longest length or deep."""
        columns = np.arange(min(deep, int(lengths.max()) if len(lengths) else 1))
        at = starts[:, None] + columns
        inside = columns < lengths[:, None]
        return np.where(inside, self.words[np.where(inside, at, 0)], -2).astype(np.int64)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """A word's number in the vocabulary, or -1."""
        out = np.full(len(h), -1, dtype=np.int64)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.seen[(h & U64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
            same = self.vocabulary[at] == h[maybe]
            out[maybe[same]] = at[same]
        return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of text in the order of their first depth entries; -1 parts runs and sorts first."""
    rank = text + 1
    k = 1
    while k < depth:
        after = np.zeros_like(rank)
        after[:-k] = rank[k:]
        # Past a run's end nothing counts, so neighbouring runs don't matter.
        after[rank == 0] = 0
        _, rank = np.unique(rank * (rank.max() + 1 + len(text)) + after, return_inverse=True)
        rank = rank.reshape(-1)
        k *= 2
    return np.argsort(rank, kind="stable")


def _compare(text: np.ndarray, at: np.ndarray, wanted: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """-1, 0 or 1: the suffix at each place against the first lengths entries of wanted."""
    columns = np.arange(wanted.shape[1])
    have = text[np.minimum(at[:, None] + columns, len(text) - 1)]
    # A run's end decides, as -1 is below all that is wanted.
    differs = (have != wanted) & (columns < lengths[:, None])
    first = differs.argmax(axis=1)
    row = np.arange(len(at))
    return np.where(differs[row, first], np.sign(have[row, first] - wanted[row, first]), 0)


def _lower(text: np.ndarray, order: np.ndarray, wanted: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many suffixes of the array are less than each wanted row."""
    lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
    while (open_ := lo < hi).any():
        k = np.flatnonzero(open_)
        mid = (lo[k] + hi[k]) // 2
        right = _compare(text, order[mid], wanted[k], lengths[k]) < 0
        lo[k[right]] = mid[right] + 1
        hi[k[~right]] = mid[~right]
    return lo


def search(text: np.ndarray, order: np.ndarray, wanted: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The interval of the suffix array whose suffixes begin with each wanted row: a binary search for all at once."""
    ends = []
    for upper in (False, True):
        lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
        while (open_ := lo < hi).any():
            k = np.flatnonzero(open_)
            mid = (lo[k] + hi[k]) // 2
            c = _compare(text, order[mid], wanted[k], lengths[k])
            right = c <= 0 if upper else c < 0
            lo[k[right]] = mid[right] + 1
            hi[k[~right]] = mid[~right]
        ends.append(lo)
    return ends[0], ends[1]


#: Benchmark suffixes that are searched at once.
_TOGETHER = 1 << 14


def longest(text: np.ndarray, order: np.ndarray, index: Index, starts: np.ndarray, lengths: np.ndarray, deep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest match of each range of benchmark words (up to deep, to which the array is sorted), and the interval of the array that shares it."""
    best, lo, hi = (np.zeros(len(starts), np.int64) for _ in range(3))
    for i in range(0, len(starts) if len(order) else 0, _TOGETHER):
        n = np.minimum(lengths[i : i + _TOGETHER], deep)
        wanted = index.wanted(starts[i : i + _TOGETHER], n, deep)
        at = _lower(text, order, wanted, n)
        columns = np.arange(wanted.shape[1])
        for near in (at, at - 1):
            place = order[np.clip(near, 0, len(order) - 1)]
            same = text[np.minimum(place[:, None] + columns, len(text) - 1)] == wanted
            got = np.where(same.all(axis=1), wanted.shape[1], (~same).argmax(axis=1))
            best[i : i + len(n)] = np.maximum(best[i : i + len(n)], np.minimum(got, n))
        lo[i : i + len(n)], hi[i : i + len(n)] = search(text, order, wanted, best[i : i + len(n)])
    return best, lo, hi


class _Shard:
    """Runs of benchmark words of some documents, with the place of each word."""

    def __init__(self, shortest: int):
        self.shortest, self.text, self.word, self.size = shortest, [], [], 0

    def add(self, numbers: np.ndarray, first: np.ndarray, base: int) -> None:
        known = np.insert(numbers >= 0, first[1:-1], False)  # documents part runs
        s, e = runs(known)
        long = e - s >= self.shortest
        s, e = s[long], e[long]
        if not len(s):
            return
        # Where the words stand without the entries put between documents.
        shift = np.searchsorted(first[1:-1] + np.arange(len(first) - 2), s, side="left")
        at = ranges(s - shift, e - s)
        text = np.insert(numbers[at], np.cumsum(e - s), -1)
        self.text.append(text)
        self.word.append(np.insert(at + base, np.cumsum(e - s), -1))
        self.size += len(text)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = np.concatenate([*self.text, [-1]]).astype(np.int64), np.concatenate([*self.word, [-1]]).astype(np.int64)
        self.text, self.word, self.size = [], [], 0
        return out


def _add_items(found: np.ndarray, index: Index, doc_of: np.ndarray) -> np.ndarray:
    """Distinct document * items + item of pairs (window, document)."""
    pairs = np.unique(doc_of * len(index.starts) + found)
    doc, w = pairs // len(index.starts), pairs % len(index.starts)
    n = index.owned[w + 1] - index.owned[w]
    return np.unique(np.repeat(doc, n) * len(index.names) + index.owners[ranges(index.owned[w], n)])


def hits(column: pa.Array, index: Index, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Flags of hit words, where each document's words begin, and each document's items."""
    b, off = utf8(column)
    firsts, base = [np.zeros(1, np.int64)], 0
    shard, matched = _Shard(int(index.lengths.min()) if len(index.lengths) else 1), []

    def settle() -> None:
        if not shard.size:
            return
        text, word = shard.take()
        order = suffix_array(text, width)
        order = order[text[order] >= 0]
        best, lo, hi = longest(text, order, index, index.starts, index.lengths, width)
        reached = np.flatnonzero(best == index.lengths)
        n = hi[reached] - lo[reached]
        matched.append((np.repeat(reached, n), word[order[ranges(lo[reached], n)]]))

    for i, j in slices(off):
        h, first = word_hashes(b[off[i] : off[j]], off[i : j + 1] - off[i])
        if len(index.lengths):
            shard.add(index.numbers(h), first, base)
        firsts.append(first[1:] + base)
        base += len(h)
        if shard.size >= SHARD_WORDS:
            settle()
    settle()
    first = np.concatenate(firsts)
    edge = np.zeros(base + 1, dtype=np.int64)
    owned: list[set[str]] = [set() for _ in range(len(first) - 1)]
    for window, at in matched:
        np.add.at(edge, at, 1)
        np.add.at(edge, at + index.lengths[window], -1)
        doc = np.searchsorted(first, at, side="right") - 1
        both = _add_items(window, index, doc)
        for d, k in zip((both // len(index.names)).tolist(), (both % len(index.names)).tolist(), strict=True):
            owned[d].add(index.names[k])
    return np.cumsum(edge)[:-1] > 0, first, owned


def _mark(sent: Broadcast, width: int, text_at: int, kept: int, names: list[str], carried: bool):
    """Adds the hit flags (packed bits) and items of one block to those that are carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, first, owned = hits(batch.column(text_at), sent.value, width)
            bits = [np.packbits(hit[first[k] : first[k + 1]]).tobytes() for k in range(batch.num_rows)]
            if carried:
                bits = [bytes(np.bitwise_or(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8))) for x, y in zip(bits, batch.column(kept + 1).to_pylist(), strict=True)]
                owned = [x.union(y) for x, y in zip(owned, batch.column(kept + 2).to_pylist(), strict=True)]
            arrays = [pa.array(np.diff(first)), pa.array(bits, pa.binary()), pa.array([sorted(x) for x in owned], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(kept)] + arrays, names=[*batch.schema.names[:kept], *names])
        give_back()

    return run


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items, in blocks of about block_bytes."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [tuple(r) for r in part.collect()]


def mark(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[str]]:
    """docs with three more columns, whose names are returned: words, packed hit flags of words, and items."""
    n = len(docs.columns)
    names = [free_name(docs, c) for c in ("n_words", "hit_bits", "items")]
    kinds = [T.LongType(), T.BinaryType(), T.ArrayType(T.StringType())]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, k) for c, k in zip(names, kinds, strict=True)]])
    out, text_at = docs, docs.columns.index("text")
    for k, rows in enumerate(blocks(benchmark, block_bytes)):
        if k:
            out = Table(out).read()
        sent = docs.sparkSession.sparkContext.broadcast(Index.of(rows, width))
        out = out.mapInArrow(_mark(sent, width, text_at, n, names, k > 0), schema)
    return out, names


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """For each benchmark suffix with a match of least words: item_id, item_start, length of its longest verbatim match, and doc_id and doc_start of its first place.

    First is by doc_id, null before all. A suffix gives a row for each shard at most, and those are pre-aggregated.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parts = [_matches(texts, docs.sparkSession.sparkContext.broadcast(Index.of(rows, 1)), [n for n, _ in rows], least, shard_words) for rows in blocks(benchmark, block_bytes)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = F.max_by(F.struct("length", "doc_id", "doc_start"), F.struct("length", -F.col("doc_id").cast("decimal(20,0)"), -F.col("doc_start")))
    return out.groupBy("item_id", "item_start").agg(best.alias("m")).select("item_id", "item_start", "m.length", F.nullif(F.col("m.doc_id"), F.lit(NULL_ID)).alias("doc_id"), "m.doc_start")


def _matches(texts: DataFrame, sent: Broadcast, items: list[str], least: int, shard_words: int) -> DataFrame:
    names = ["item_id", "item_start", "length", "doc_id", "doc_start"]

    def of_shard(shard: _Shard, ids: np.ndarray, first: np.ndarray, index: Index) -> pa.RecordBatch:
        text, word = shard.take()
        starts = np.arange(len(index.words))
        item = np.repeat(np.arange(len(index.first) - 1), np.diff(index.first))
        rest = index.first[item + 1] - starts
        deep = int(rest.max())
        order = suffix_array(text, deep)
        order = order[text[order] >= 0]
        best, lo, hi = longest(text, order, index, starts, rest, least)
        # Only those that reach the least length are looked up in full.
        some = np.flatnonzero(best >= least)
        best, lo, hi = longest(text, order, index, starts[some], rest[some], deep)
        rank = np.unique(ids, return_inverse=True)[1]
        place = np.zeros(len(some), dtype=np.int64)
        for k in range(len(some)):
            at = word[order[lo[k] : hi[k]]]
            doc = np.searchsorted(first, at, side="right") - 1
            place[k] = at[np.lexsort((at - first[doc], rank[doc]))[0]]
        doc = np.searchsorted(first, place, side="right") - 1
        columns = [pa.array([items[i] for i in item[some]], pa.string()), *[pa.array(x.astype(np.int64)) for x in (starts[some] - index.first[item[some]], best, ids[doc], place - first[doc])]]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches if len(index.words) else ():
            b, off = utf8(batch.column(1))
            ids, shard, base, firsts = batch.column(0).to_numpy(), _Shard(min(least, int(np.diff(index.first).max()))), 0, [np.zeros(1, np.int64)]
            for i, j in slices(off):
                h, first = word_hashes(b[off[i] : off[j]], off[i : j + 1] - off[i])
                shard.add(index.numbers(h), first, base)
                firsts.append(first[1:] + base)
                base += len(h)
                if shard.size >= shard_words or j == len(off) - 1:
                    if shard.size:
                        yield of_shard(shard, ids, np.concatenate(firsts), index)

    return texts.mapInArrow(run, "item_id string, item_start long, length long, doc_id long, doc_start long")


def _hit_words(bits: pa.Array) -> list[int]:
    return [int(np.bitwise_count(np.frombuffer(x, np.uint8)).sum()) for x in bits.to_pylist()]


def _contaminated(hit: list[int], words: list[int]) -> list[bool]:
    return [h > 0 and SHARE * h >= n for h, n in zip(hit, words, strict=True)]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for batch in batches:
        hit, items = _hit_words(batch.column(2)), batch.column(3).to_pylist()
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        said = _contaminated(hit, batch.column(1).to_pylist())
        arrays = [batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string()), pa.array(said, pa.bool_())]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def _clean(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = _hit_words(batch.column(n + 1))
            yield batch.select(list(range(n))).filter(pa.array([x == 0 for x in hit], pa.bool_()))

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no window of the benchmark occurs in, with their own columns; however long they are, one occurrence affects them."""
    marked, _ = mark(docs, benchmark)
    return Table(marked.mapInArrow(_clean(len(docs.columns)), docs.schema)).read()


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    marked, (words, bits, items) = mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    made = marked.select("doc_id", words, bits, items).mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    return Table(made).read()
