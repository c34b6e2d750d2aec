"""Harmonic packing of tokenised documents into fixed-capacity sequences.

A length in (C/(k+1), C/k] belongs to class k, and a bin of class k takes k
pieces whatever they are, so no bin needs to know another. A document may be
cut, so a length between two of the first classes is cut at the next class's
size and only its rest goes on: bins of the first classes are full but for
rounding. Each shard of pieces numbers its own pieces of a class from a prefix
sum of the shards' counts, which is all that workers share. The last, unfilled
bin of each class (at most k - 1 pieces each, a bound that the capacity alone
sets) is packed with the others by decreasing size.

Cases: a null text counts as empty and is the end mark alone; a null doc_id is
kept; rows with one doc_id are documents of their own; repeated rows yield
repeated pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ocellus.llm._shared import Table, documents
from ocellus.llm._text import LOWER, PLAIN, give_back, ranges, slices, span_hash, spans, utf8

CAPACITY = 4096
#: Lengths of classes below this are cut to the next class's size.
CUT_CLASSES = 32
END_ID = 2
#: Words whose ids a worker keeps; with one more it begins anew.
CACHED_WORDS = 2_000_000
#: The tokenizer parts these from letters before them.
_TAIL = ".,;:!?%&#$*"
_IS_TAIL = np.zeros(256, dtype=bool)
_IS_TAIL[list(_TAIL.encode())] = True
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_BEYOND_LATIN = "\u0250"
#: What the tokenizer's special strings begin with; it takes them as they stand.
_SPECIAL = b"<|"
#: Bytes of text that are looked up together.
BATCH_BYTES = 1 << 22
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut(n: int, capacity: int = CAPACITY, cut_classes: int = CUT_CLASSES) -> list[int]:
    """Piece lengths of a document of n tokens."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        take = n if k >= cut_classes or n == capacity // k else capacity // (k + 1)
        out.append(take)
        n -= take
    return out


def _without_tails(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with the marks of _TAIL after an ASCII letter or digit as words of their own, as the tokenizer parts them anyway."""
    if not len(starts):
        return starts, ends, first
    last = np.maximum.accumulate(np.where(_IS_TAIL[b], 0, np.arange(len(b), dtype=np.int32)))[ends - 1]
    split = (last >= starts) & (last < ends - 1) & _IS_WORD[b[last]]
    size = 1 + split
    at = np.cumsum(size) - size
    out_s, out_e = np.repeat(starts, size), np.repeat(ends, size)
    own = at[split]
    out_e[own] = out_s[own + 1] = last[split] + 1
    return out_s, out_e, np.append(at, len(out_s))[first]


class WordIds:
    """Ids of texts, looked up word by word.

    The tokenizer never joins what ASCII white space parts, so a text's ids are
    its words' ids in a row. Words are known by 64-bit hashes in sorted arrays:
    among a million words two share one with probability 3e-8.
    """

    def __init__(self, path: str, keep: int = CACHED_WORDS):
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence

        # Tasks use the cores already; threads of the tokenizer's own only add to the work.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.plain, self.keep = Tokenizer.from_file(path), Tokenizer.from_file(path), keep
        # What the normalizers do leaves lower-case ASCII words as they are.
        self.plain.normalizer = Sequence([])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.known, keys)
        inside = np.minimum(at, max(len(self.known) - 1, 0))
        return at, (at < len(self.known)) & (self.known[inside] == keys) if len(self.known) else np.zeros(len(keys), dtype=bool)

    def _joined(self, tokenizer, words: list[str], pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words of known numbers of pieces, encoded as one text, and how many each has; None if the numbers don't hold."""
        ids = np.array(tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype=np.uint32)
        done = np.cumsum(self.last[ids])
        if not len(ids) or done[-1] != pieces.sum():
            return None
        return ids, np.diff(np.searchsorted(done, np.cumsum(pieces)) + 1, prepend=0)

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """keys: sorted, and none of them known."""
        said = [w.decode() for w in words]
        # Letters are one piece, and the marks of _TAIL after them are another; each piece's last id is marked as such.
        pieces = np.zeros(len(words), dtype=np.int64)
        for k, w in enumerate(said):
            stem = w.rstrip(_TAIL)
            if stem.isalpha() and max(stem) < _BEYOND_LATIN:
                pieces[k] = 1 + (len(stem) < len(w))
        easy = np.array([w.isascii() and w == w.lower() for w in words], dtype=bool)
        at, size, parts, total = np.zeros(len(words), np.int64), np.full(len(words), -1), [self.ids], len(self.ids)

        def put(places: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
            nonlocal total
            at[places], size[places] = total + np.cumsum(sizes) - sizes, sizes
            parts.append(ids)
            total += len(ids)

        for tokenizer, own in ((self.plain, easy & (pieces > 0)), (self.tokenizer, ~easy & (pieces > 0))):
            places = np.flatnonzero(own)
            for i in range(0, len(places), 4096):
                part = places[i : i + 4096]
                if (got := self._joined(tokenizer, [said[k] for k in part], pieces[part])) is not None:
                    put(part, *got)
        rest = np.flatnonzero(size < 0)
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([said[k] for k in part], add_special_tokens=False)]
            put(part, np.array(list(chain.from_iterable(found)), dtype=np.uint32), np.array([len(x) for x in found], dtype=np.int64))
        self.ids = np.concatenate(parts)
        place = np.searchsorted(self.known, keys)
        self.known, self.at, self.size = np.insert(self.known, place, keys), np.insert(self.at, place, at), np.insert(self.size, place, size)

    def of(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents of a byte buffer, in a row, and where each document's begin."""
        low = LOWER[b]
        if b.tobytes().find(_SPECIAL) >= 0:  # the tokenizer lower-cases all but its own special strings
            low = b
        starts, ends, first = _without_tails(low, *spans(low, off, PLAIN))
        keys, where, inverse = np.unique(span_hash(low, starts, ends), return_index=True, return_inverse=True)
        _, have = self._places(keys)
        if len(self.known) + np.count_nonzero(~have) > self.keep:
            self.forget()
            have[:] = False
        new = np.flatnonzero(~have)
        if len(new):
            raw = low.tobytes()
            self._learn(keys[new], [raw[s:e] for s, e in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
        at = self._places(keys)[0][inverse]
        size = self.size[at]
        total = np.concatenate(([0], np.cumsum(size)))
        return self.ids[ranges(self.at[at], size)], total[first]


_ids: dict[str, WordIds] = {}


def _pieces(tokenizer: str, capacity: int, cut_classes: int, end_id: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ids:
            _ids[tokenizer] = WordIds(tokenizer)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            b, off = utf8(batch.column(1))
            for i, j in slices(off, BATCH_BYTES):
                found, first = _ids[tokenizer].of(b[off[i] : off[j]], off[i : j + 1] - off[i])
                found = np.insert(found, first[1:], end_id).astype("<u4")
                ends = (first[1:] + np.arange(1, j - i + 1)).tolist()
                raw, begin, rows = found.tobytes(), 0, []
                for doc_id, end in zip(doc_ids[i:j], ends, strict=True):
                    n, at = end - begin, 0
                    for length in cut(n, capacity, cut_classes):
                        own = raw[4 * (begin + at) : 4 * (begin + at + length)]
                        rows.append((doc_id, at, length, zlib.crc32(own), n, own) if with_ids else (doc_id, at, length, zlib.crc32(own), n))
                        at += length
                    begin = end
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        give_back()

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, cut_classes: int = CUT_CLASSES, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of each document; with_ids adds their ids, little-endian 32-bit."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity, cut_classes, end_id, with_ids), PIECES + ", ids binary" * with_ids)


def _fit_rest(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], na_position="first")
        room: list[int] = []
        bins, offsets = [], []
        for n in pdf["length"]:
            b = next((i for i, r in enumerate(room) if r >= n), len(room))
            if b == len(room):
                room.append(capacity)
            bins.append(b)
            offsets.append(capacity - room[b])
            room[b] -= n
        return pdf.assign(sequence_id=[b * (capacity + 1) for b in bins], offset=offsets)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack(made: DataFrame, capacity: int = CAPACITY, shards: int | None = None) -> DataFrame:
    """sequence_id and offset for each piece (the columns of pieces(), no longer than capacity).

    made is read twice, so give a written table.
    """
    shards = shards or int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = made.withColumns({"k": F.floor(F.lit(capacity) / F.col("length")).cast("long"), "shard": F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards))})
    counts = rows.groupBy("k", "shard").agg(F.count("*").alias("n"))
    # A row for each class and shard: the prefix sums stay small whatever the input.
    before = Window.partitionBy("k").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("k", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy("k")).alias("in_class"))
    own = Window.partitionBy("k", "shard").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = rows.withColumn("rank", F.row_number().over(own) - 1).join(offsets, ["k", "shard"]).withColumn("rank", F.col("rank") + F.col("base"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = F.col("rank") < F.floor(F.col("in_class") / F.col("k")) * F.col("k")
    bins = ranked.where(full).select(*columns, (F.floor(F.col("rank") / F.col("k")) * (capacity + 1) + F.col("k")).cast("long").alias("sequence_id"), "rank")
    within = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    filled = bins.select(*columns, "sequence_id", F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long").alias("offset"))
    rest = ranked.where(~full).select(*columns, F.lit(0).alias("one")).groupBy("one").applyInPandas(_fit_rest(capacity), PIECES + ", sequence_id long, offset long")
    return filled.unionByName(rest)


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    return pack(Table(pieces(docs, **options)).read(), options.get("capacity", CAPACITY))


def op4_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
