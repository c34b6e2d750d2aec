"""Product codes of vectors by Hamerly's Lloyd iterations, in whole numbers.

A vector's components are floored to integers and cut into equal parts; each
part position has a codebook of its own. With each part of each vector stand
an upper bound of the distance to its entry and a lower bound of the distance
to the second-nearest one. When entries move, the bounds move by as much; while
the upper one is strictly below the lower one (or below half the distance from
the entry to the next entry), the part keeps its entry, as no other can be as
near. Only else are all entries compared, by exact integer distances, and of
equally near entries the lower index wins. Bounds are rounded outwards.

Rows and bounds are written after each round; of a round the driver holds the
sums of each entry alone, whose number the codebook's size fixes.

Cases: rows whose vector is null or has a null, NaN or infinite component are
dropped; so are vectors that do not have the length of the vector with the
smallest vec_id among those of a positive multiple of the parts. A null vec_id
comes after all others; rows that share a vec_id are vectors of their own, the
lesser components first; with fewer vectors than entries there are as many
entries as vectors. Components beyond 2^27 after scaling count as 2^27, so that
every distance fits 64 bits. Null labels count as one label. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.llm._shared import Table
from ocellus.llm._text import give_back

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
MAX_COMPONENT = 1 << 27
#: Whole numbers below this are exact in a double.
_EXACT = 1 << 53
_STATE = "vec_id long, label {label}, x array<int>, code array<int>, upper array<float>, lower array<float>"
_INF32 = np.float32(np.inf)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, dtype=np.float32), _INF32)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.asarray(x, dtype=np.float32), -_INF32), np.float32(0))


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of parts (n, w) to entries (k, w)."""
    largest = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * largest * largest * x.shape[1] < _EXACT:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return sum((x[:, None, k] - book[None, :, k]) ** 2 for k in range(x.shape[1]))


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each part, the lower index of equal ones, and both bounds."""
    d = squared(x, book)
    code = d.argmin(axis=1)
    rows = np.arange(len(x))
    upper = _up(np.sqrt(d[rows, code]))
    if d.shape[1] == 1:
        return code, upper, np.full(len(x), _INF32)
    d[rows, code] = np.iinfo(np.int64).max
    return code, upper, _down(np.sqrt(d.min(axis=1)))


@dataclass
class Moves:
    """How far the entries of one part position moved, and how near they now stand to one another."""

    own: np.ndarray
    others: np.ndarray
    half: np.ndarray

    @classmethod
    def between(cls, old: np.ndarray, new: np.ndarray) -> Moves:
        own = np.sqrt(((new - old) ** 2).sum(axis=1).astype(np.float64))
        apart = squared(new, new).astype(np.float64)
        np.fill_diagonal(apart, np.inf)
        order = np.argsort(own)
        others = np.full(len(own), own[order[-1]])
        others[order[-1]] = own[order[-2]] if len(own) > 1 else 0.0
        return cls(own, others, _down(np.sqrt(apart.min(axis=1)) / 2))


def settle(x: np.ndarray, book: np.ndarray, moves: Moves, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Move the bounds of one part position and scan where they fail, in place; returns how many parts were scanned."""
    upper[:] = _up(upper.astype(np.float64) + moves.own[code])
    lower[:] = _down(lower.astype(np.float64) - moves.others[code])
    bound = np.maximum(lower, moves.half[code])
    open_rows = np.flatnonzero(~(upper < bound))
    if len(open_rows):
        gap = x[open_rows] - book[code[open_rows]]
        upper[open_rows] = _up(np.sqrt((gap * gap).sum(axis=1)))
        open_rows = open_rows[~(upper[open_rows] < bound[open_rows])]
    if len(open_rows):
        code[open_rows], upper[open_rows], lower[open_rows] = scan(x[open_rows], book)
    return len(open_rows)


def _numbers(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(x.reshape(-1), kind))


def _state(batch: pa.RecordBatch, x, code, upper, lower) -> pa.RecordBatch:
    lists = [batch.column(2), _lists(code, pa.int32()), _lists(upper, pa.float32()), _lists(lower, pa.float32())]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["vec_id", "label", "x", "code", "upper", "lower"])


def _first(book: np.ndarray):
    """Scan every part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = book.shape
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _numbers(batch.column(2), n).reshape(n, parts, width).astype(np.int64)
            code, upper, lower = np.zeros((n, parts), np.int32), np.zeros((n, parts), np.float32), np.zeros((n, parts), np.float32)
            for p in range(parts):
                code[:, p], upper[:, p], lower[:, p] = scan(x[:, p], book[p])
            yield _state(batch, x, code, upper, lower)
        give_back()

    return run


def _again(old: np.ndarray, book: np.ndarray):
    """Scan the parts whose bounds fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = book.shape
        moves = [Moves.between(a, b) for a, b in zip(old, book, strict=True)]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _numbers(batch.column(2), n).reshape(n, parts, width).astype(np.int64)
            code, upper, lower = (_numbers(batch.column(k), n).T.copy() for k in (3, 4, 5))
            for p in range(parts):
                settle(x[:, p], book[p], moves[p], code[p], upper[p], lower[p])
            yield _state(batch, x, code.T.copy(), upper.T.copy(), lower.T.copy())
        give_back()

    return run


def _sums(parts: int, entries: int):
    """A partition's sums of the parts of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _numbers(batch.column(0), n).reshape(n, parts, -1)
            code = _numbers(batch.column(1), n)
            if total is None:
                count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, x.shape[2]), np.int64)
            for p in range(parts):
                count[p] += np.bincount(code[:, p], minlength=entries)
                for k in range(x.shape[2]):
                    # Sums of a batch stay far below 2^53.
                    total[p, :, k] += np.bincount(code[:, p], weights=x[:, p, k], minlength=entries).astype(np.int64)
        if total is not None:
            p, e, k = (i.reshape(-1).astype(np.int32) for i in np.indices(total.shape))
            counts = np.repeat(count.reshape(-1), total.shape[2])
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (p, e, k, total.reshape(-1), counts)], names=["part", "entry", "place", "total", "n"])

    return run


def _moved(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The next codebook: each entry becomes the floor of its parts' mean; one without parts stays."""
    made = state.select("x", "code").mapInArrow(_sums(*book.shape[:2]), "part int, entry int, place int, total long, n long")
    new = book.copy()
    # As many rows as the codebook has components.
    for part, entry, place, total, n in made.groupBy("part", "entry", "place").agg(F.sum("total"), F.sum("n")).toLocalIterator():
        if n:
            new[part, entry, place] = total // n
    return new


def _coded(book: np.ndarray):
    """Codes as hexadecimal text, and exact errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = book.shape
        at = np.arange(parts)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _numbers(batch.column(2), n).reshape(n, parts, width).astype(np.int64)
            code = _numbers(batch.column(3), n)
            gap = x - book[at, code]
            hexes = code.astype(np.uint8).tobytes().hex()
            codes = pa.array([hexes[i : i + 2 * parts] for i in range(0, len(hexes), 2 * parts)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, pa.array((gap * gap).sum(axis=(1, 2)))], names=["vec_id", "label", "code", "error"])

    return run


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and x, the floored components, of the rows that are kept."""
    whole = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    scaled = F.transform("embedding", lambda v: F.greatest(F.lit(-MAX_COMPONENT), F.least(F.lit(MAX_COMPONENT), F.floor(v.cast("double") * scale))).cast("int"))
    return vectors.where(F.col("embedding").isNotNull() & whole).select(F.col("vec_id").cast("long"), "label", scaled.alias("x"))


def first_book(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the smallest vec_ids: as many rows as there are entries reach the driver."""
    fit = rows.where((F.size("x") > 0) & (F.size("x") % parts == 0))
    smallest = lambda df: df.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    found = smallest(fit)
    if found and any(len(r.x) != len(found[0].x) for r in found):
        found = smallest(fit.where(F.size("x") == len(found[0].x)))
    if not found:
        return np.zeros((parts, 0, 1), dtype=np.int64)
    return np.array([r.x for r in found], dtype=np.int64).reshape(len(found), parts, -1).transpose(1, 0, 2).copy()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[Table, np.ndarray]:
    """A table of vec_id, label, code and error, and the codebooks (part, entry, place). At most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits: entries must be from 1 to 256")
    rows = integers(vectors, scale)
    label = vectors.schema["label"].dataType.simpleString()
    book = first_book(rows, parts, entries)
    if not book.shape[1]:
        return Table(rows.where("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))), book
    rows = rows.where(F.size("x") == parts * book.shape[2])
    state = Table(rows.mapInArrow(_first(book), _STATE.format(label=label)))
    for _ in range(rounds):
        new = _moved(state.read(), book)
        made = Table(state.read().mapInArrow(_again(book, new), _STATE.format(label=label)))
        state.drop()
        state, book = made, new
    out = Table(state.read().mapInArrow(_coded(book), f"vec_id long, label {label}, code string, error long"))
    state.drop()
    return out, book


def digest(book: np.ndarray) -> str:
    """sha256 of all components as decimal text, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def op11_vector_code_compression(spark, sf_dir: str) -> DataFrame:
    coded, book = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = coded.read()
    by_label = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = rows.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))


def _sql() -> str:
    """DuckDB SQL: two rounds, then the last assignment."""
    distance = " + ".join(f"(x{k} - c{k}) * (x{k} - c{k})" for k in range(4))
    steps = []
    for r in range(3):
        steps.append(f"a{r} AS (SELECT vec_id, p, x0, x1, x2, x3, min(({distance}) * 64 + e) AS best FROM parts JOIN b{r} USING (p) GROUP BY ALL)")
        if r < 2:
            means = ", ".join(f"CAST(floor(sum(x{k})::DOUBLE / count(*)) AS BIGINT) AS m{k}" for k in range(4))
            entry = ", ".join(f"coalesce(m{k}, c{k}) AS c{k}" for k in range(4))
            steps.append(f"m{r} AS (SELECT p, best % 64 AS e, {means} FROM a{r} GROUP BY ALL)")
            steps.append(f"b{r + 1} AS (SELECT p, e, {entry} FROM b{r} LEFT JOIN m{r} USING (p, e))")
    parts = ", ".join(f"v[4 * p + {k + 1}] AS x{k}" for k in range(4))
    cells = ", ".join(f"x{k} AS c{k}" for k in range(4))
    return f"""
WITH kept AS (SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (SELECT vec_id, p, {parts} FROM (SELECT vec_id, v, unnest(range(16)) AS p FROM kept)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, {cells} FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
{", ".join(steps)},
book AS (SELECT sha256(string_agg(c0 || ',' || c1 || ',' || c2 || ',' || c3, ',' ORDER BY p, e)) AS said FROM b2),
coded AS (SELECT vec_id, string_agg(lower(lpad(to_hex(best % 64), 2, '0')), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, said AS codebooks_sha256
FROM coded JOIN kept USING (vec_id) CROSS JOIN book
"""


SQL = _sql()
