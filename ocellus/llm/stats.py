"""Text statistics of whole documents, computed on Arrow buffers.

Words are runs of anything but ASCII white space; lines are what newlines
part. A null text counts as empty; all counts of an empty text are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ocellus.llm._shared import free_name
from ocellus.llm._text import PLAIN, U64, give_back, mix, slices, span_hash, spans, utf8, window_hash

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
REPEAT_WORDS = 5
COUNTS = (
    "n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_distinct_words", "n_upper",
    "n_digits", "n_punct", "n_space", "n_wide", "n_stops", "n_pipes", "n_long_words",
)


def _flag(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_CHAR = np.ones(256, dtype=bool)
_CHAR[0x80:0xC0] = False
_CLASSES = {
    "n_symbols": _flag(SYMBOLS), "n_upper": _flag(bytes(range(65, 91))), "n_digits": _flag(bytes(range(48, 58))),
    "n_punct": _flag(b"!\"'(),-./:;?@[\\]^_`{}~+="), "n_space": ~PLAIN, "n_pipes": _flag(b"|"), "n_stops": _flag(b".!?"),
}
_WIDE = np.zeros(256, dtype=bool)
_WIDE[0xC0:] = True
_CLASSES["n_wide"] = _WIDE


def _twice(keys: np.ndarray) -> np.ndarray:
    """True where a key is there twice or more."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def count(b: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS for each document of a byte buffer."""
    n = len(off) - 1
    total = np.zeros(len(b) + 1, dtype=np.int64)

    def within(flags: np.ndarray) -> np.ndarray:
        np.cumsum(flags, out=total[1:])
        return total[off[1:]] - total[off[:-1]]

    out = {k: within(v[b]) for k, v in _CLASSES.items()}
    out["n_chars"] = within(_CHAR[b])
    at_char = total.copy()
    starts, ends, first = spans(b, off, PLAIN)
    doc = np.repeat(np.arange(n), np.diff(first))
    chars = at_char[ends] - at_char[starts]
    out["n_words"] = np.diff(first)
    out["word_chars"] = np.bincount(doc, weights=chars, minlength=n).astype(np.int64)
    out["n_long_words"] = np.bincount(doc[chars > 20], minlength=n)
    h = span_hash(b, starts, ends)
    salt = mix(np.arange(n, dtype=np.uint64) + U64(0x1234567))
    keys = np.sort(mix(h ^ salt[doc]) & U64((1 << 64) - (1 << 16)) | doc.astype(np.uint64))
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    out["n_distinct_words"] = np.bincount((keys[new] & U64((1 << 16) - 1)).astype(np.int64), minlength=n)
    w = window_hash(h, REPEAT_WORDS)
    whole = doc[: len(w)] == doc[REPEAT_WORDS - 1 :] if len(w) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(whole)
    at = at[_twice(w[at] ^ salt[doc[at]])]
    edge = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + REPEAT_WORDS, -1)
    covered = np.cumsum(edge)[:-1] > 0
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
    # Lines with a word: each begins at a document's start or after a newline.
    breaks = np.flatnonzero(b == 0x0A)
    line_start = np.concatenate((off[:-1], breaks + 1))
    line_end = np.concatenate((breaks, off[1:]))
    line_start.sort()
    line_end.sort()
    has = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[has], line_end[has]
    line_doc = np.searchsorted(off, line_start, side="right") - 1
    lines = span_hash(b, line_start, line_end) ^ salt[line_doc] if len(line_start) else np.zeros(0, np.uint64)
    order = np.argsort(lines, kind="stable")
    again = np.zeros(len(lines), dtype=bool)
    again[order[1:]] = lines[order[1:]] == lines[order[:-1]]
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n)
    return out


def _run(at: int, keep: list[int], name: str):
    kind = pa.struct([(c, pa.int64()) for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, off = utf8(batch.column(at))
            for i, j in slices(off):
                made = count(b[off[i] : off[j]], off[i : j + 1] - off[i])
                stats = pa.StructArray.from_arrays([pa.array(made[c].astype(np.int64)) for c in COUNTS], fields=list(kind))
                names = [batch.schema.names[k] for k in keep] + [name]
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(i, j - i) for k in keep] + [stats], names=names)
        give_back()

    return run


def with_stats(docs: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """The columns in keep (None: all) and a struct column of COUNTS, whose name is returned too."""
    name = free_name(docs, "stats")
    kept = [f for f in docs.schema.fields if keep is None or f.name in keep]
    columns = [docs[f"`{f.name}`"] for f in kept]
    names = [f.name for f in kept]
    if "text" not in names:
        columns.append(docs["text"])
    at = names.index("text") if "text" in names else len(kept)
    schema = T.StructType([*kept, T.StructField(name, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])
    return docs.select(*columns).mapInArrow(_run(at, list(range(len(kept))), name), schema), name
