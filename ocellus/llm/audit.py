"""How filters interact: what each removes at each step of each order.

Each partition keeps a packed bitmap index: one bitset for each filter's
failures, one for each label, and one for each part, whose rows stand together
in 64-bit words of their own. What survives a set of filters is the part's
bits AND NOT each filter's, and a population count a word gives how many of
them there are, and how many with a label. Every figure of every order is a
difference of such counts of prefix subsets, so the partitions' counts are
summed once and the orders are laid out from 32 sums a part.

Cases: a null text counts as empty; a null source is the part of the empty
string; a row without doc_id is identical to no smaller one and makes no other
row fail; rows that share a doc_id are each counted, and neither is smaller;
rows of labels that share a doc_id say what any of them says, null labels say
nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocellus.llm._shared import Table, documents
from ocellus.llm._text import PLAIN, give_back, slices, span_hash, spans, utf8

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 200, 50, 2
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#$%&*|")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
#: Rows of a partition whose bitsets are held at once, and parts whose counts are.
BLOCK_ROWS, HELD_PARTS = 1 << 18, 1 << 12
FLAGS = "doc_id long, part string, bits int, digest binary"


def _counted(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many bytes of each document are set in mask."""
    total = np.concatenate(([0], np.cumsum(mask)))
    return total[off[1:]] - total[off[:-1]]


def failures(b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Filters A to D of each document of a byte buffer, a bit for each that fails."""
    starts, ends, first = spans(b, off, PLAIN)
    words = np.diff(first)
    doc = np.repeat(np.arange(len(words)), words)
    h = span_hash(b, starts, ends)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    distinct = np.bincount(doc[new], minlength=len(words))
    points = _counted((b & 0xC0) != 0x80, off)
    fails = (words < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * words, 100 * _counted(_UPPER[b], off) > MAX_UPPER_PERCENT * points, _counted(_SYMBOL[b], off) > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        b, off = utf8(batch.column(2))
        for i, j in slices(off):
            own, at = b[off[i] : off[j]], off[i : j + 1] - off[i]
            digests = [hashlib.blake2b(own[s:e], digest_size=16).digest() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            arrays = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(failures(own, at)), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "part", "bits", "digest"])
    give_back()


def subset_counts(part: np.ndarray, n_parts: int, bits: np.ndarray, labels: list[np.ndarray]) -> np.ndarray:
    """For each part and subset of filters: rows that fail none of the subset, and how many of those have each label."""
    order = np.argsort(part, kind="stable")
    size = np.bincount(part, minlength=n_parts)
    words = -(-size // 64)
    first = np.cumsum(words) - words
    place = np.repeat(64 * first - (np.cumsum(size) - size), size) + np.arange(len(part))

    def bitset(rows: np.ndarray) -> np.ndarray:
        held = np.zeros(64 * int(words.sum()), dtype=bool)
        held[place] = rows[order]
        return np.packbits(held, bitorder="little").view(np.uint64)

    failing = [bitset((bits >> k) & 1 == 1) for k in range(len(FILTERS))]
    said = [bitset(x) for x in labels]
    alive = {0: bitset(np.ones(len(part), dtype=bool))}
    out = np.zeros((n_parts, SUBSETS, 1 + len(said)), dtype=np.int64)
    for subset in range(SUBSETS):
        if subset:
            low = subset & -subset
            alive[subset] = alive[subset ^ low] & ~failing[low.bit_length() - 1]
        for k, words_of in enumerate([alive[subset], *[alive[subset] & x for x in said]]):
            out[:, subset, k] = np.add.reduceat(np.bitwise_count(words_of).astype(np.int64), first)
    return out


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    rows: list[pa.RecordBatch] = []

    def add() -> None:
        whole = pa.Table.from_batches(rows).combine_chunks()
        rows.clear()
        names = whole.column(0).combine_chunks().dictionary_encode()
        bits, good, toxic = (whole.column(k).to_numpy() for k in (1, 2, 3))
        made = subset_counts(names.indices.to_numpy(), len(names.dictionary), bits, [good == 1, toxic == 1])
        for name, counts in zip(names.dictionary.to_pylist(), made, strict=True):
            held[name] = held[name] + counts if name in held else counts

    def flush() -> pa.RecordBatch:
        counts = np.concatenate(list(held.values())).reshape(-1, 3)
        names = pa.array([name for name in held for _ in range(SUBSETS)])
        subsets = pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), len(held)))
        some = pa.array(counts[:, 0] > 0)
        held.clear()
        return pa.RecordBatch.from_arrays([names, subsets, *[pa.array(counts[:, k]) for k in range(3)]], names=["part", "subset", "kept", "good", "toxic"]).filter(some)

    waiting = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rows.append(batch)
        waiting += batch.num_rows
        if waiting >= BLOCK_ROWS:
            add()
            waiting = 0
            if len(held) > HELD_PARTS:
                yield flush()
    if rows:
        add()
    if held:
        yield flush()
    give_back()


def flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, the failed filters A to D as bits, and a digest of the text."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(_flag, FLAGS)


def with_repeats(flagged: DataFrame) -> DataFrame:
    """flagged (a written table) with filter E's bit: the text stands under a smaller doc_id. Only texts of several doc_ids are joined back."""
    several = flagged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first != last").select("digest", "first")
    again = F.coalesce((F.col("doc_id") > F.col("first")).cast("int"), F.lit(0))
    return flagged.join(several, "digest", "left").select("doc_id", "part", F.col("bits").bitwiseOR(again * (1 << FILTERS.index("E"))).alias("bits"))


def with_labels(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits, and whether the labels say good and toxic."""
    says = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality"), says("toxic"))
    return flagged.join(said, "doc_id", "left").select("part", "bits", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def survivors(rows: DataFrame) -> DataFrame:
    """For each part and subset of filters that anything survives: kept, good and toxic. Each partition sends sums alone."""
    made = rows.mapInArrow(_index, "part string, subset int, kept long, good long, toxic long")
    return made.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("kept", "good", "toxic")])


def _figures(at) -> Column:
    """What a filter's count does not owe to the order: failures, failures of it alone, and the sum over all orders."""
    n, everything = len(FILTERS), SUBSETS - 1
    out = []
    for k in range(n):
        own = 1 << k
        shares = F.lit(0)
        for before in range(SUBSETS):
            if not before & own:
                ahead = before.bit_count()
                shares = shares + F.lit(factorial(ahead) * factorial(n - 1 - ahead)) * (at(before) - at(before | own))
        out.append(F.struct((at(0) - at(own)).alias("fails"), (at(everything ^ own) - at(everything)).alias("alone"), shares.alias("shapley")))
    return F.array(*out)


def orders(counts: DataFrame) -> DataFrame:
    """A row for each part, order and step from survivors(); a part's 32 counts become a map, so no row is joined."""
    held = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("subset", F.struct("kept", "good", "toxic")))).alias("at"))

    def at(subset, name: str = "kept") -> Column:
        return F.coalesce(F.try_element_at("at", subset if isinstance(subset, Column) else F.lit(subset)).getField(name), F.lit(0)).cast("long")

    every = []
    for order in permutations(range(len(FILTERS))):
        masks = [sum(1 << k for k in order[:s]) for s in range(len(order) + 1)]
        every.append(F.struct(F.lit("".join(FILTERS[k] for k in order)).alias("filter_order"), F.array(*map(F.lit, order)).alias("filters"), F.array(*map(F.lit, masks)).alias("masks")))
    laid = held.withColumn("figures", _figures(at)).withColumn("o", F.explode(F.array(*every)))
    laid = laid.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    before, after, own = F.get("o.masks", F.col("step") - 1), F.get("o.masks", F.col("step")), F.get("figures", F.get("o.filters", F.col("step") - 1))
    removed = at(before) - at(after)
    return laid.select(
        "part", F.col("o.filter_order").alias("filter_order"), "step", at(after).alias("kept"), removed.alias("removed"), (own["fails"] - removed).alias("redundant"),
        own["alone"].alias("unique_fails"), (at(before, "good") - at(after, "good")).alias("good_lost"), (at(before, "toxic") - at(after, "toxic")).alias("toxic_lost"), own["shapley"].alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter keeps and removes in each order, for each source."""
    flagged = Table(flags(docs))
    counts = Table(survivors(with_labels(with_repeats(flagged.read()), labels)))
    flagged.drop()
    return orders(counts.read())


def op13_filter_interaction_audit(spark, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
said AS (SELECT doc_id, max(coalesce(CAST(quality = 1 AS INT), 0)) AS good, max(coalesce(CAST(toxic = 1 AS INT), 0)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
    + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * coalesce(CAST(doc_id > min(doc_id) OVER (PARTITION BY t) AS INT), 0) AS bits
  FROM d LEFT JOIN said USING (doc_id)),
grouped AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(x, m)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.m, b.m, c.m, d.m, e.m] AS ms FROM l a, l b, l c, l d, l e WHERE a.m | b.m | c.m | d.m | e.m = 31),
s AS (SELECT filter_order, step, ms[step] AS own, CAST(coalesce(list_sum(ms[1:step - 1]), 0) AS INT) AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)),
made AS (SELECT part, filter_order, step, own, sum(CASE WHEN bits & (before | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN bits & before = 0 AND bits & own != 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN bits & before != 0 AND bits & own != 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN bits = own THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN bits & before = 0 AND bits & own != 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN bits & before = 0 AND bits & own != 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM grouped CROSS JOIN s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM made
"""
