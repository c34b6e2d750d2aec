"""Secrets in texts: fixed patterns, and random strings told by Markov models.

First-order character models of random strings (one for each alphabet that keys
are written in, trained on seeded labelled samples) are held against one of
ordinary identifiers, trained on every short token of the corpus outside the
patterns' matches and on labelled samples of numbers and compound names. A
token of MIN_TOKEN characters or more is a span when the best random model's
log-likelihood exceeds the ordinary one's by THRESHOLD nats: by that ratio
alone an ordinary token passes with probability e**-THRESHOLD at most for each
random model.

Cases: a null text counts as empty and has no span; a null doc_id is kept;
spans of one start are ordered by kind; a span of the models that overlaps a
pattern's is not added; repeated rows are scanned each; an empty table gives
no rows (and the models then know the labelled samples alone); other columns
pass through redact() and are ignored by scan().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.llm._shared import Table, documents
from ocellus.llm._text import LOWER, give_back, ranges, slices, spans, utf8

#: The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")
MIN_ASSIGN, MIN_ACCESS, MIN_TOKEN = 6, 20, 16
THRESHOLD = 12.0
#: What a text's span becomes in redact().
MARK = "[SECRET]"

ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
N = len(ALPHABET)
_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[list(ALPHABET)] = True
_CODE = np.zeros(256, dtype=np.int64)
_CODE[list(ALPHABET)] = np.arange(N)
#: Alphabets of random strings.
RANDOM = {
    "hex": b"0123456789abcdef", "upper_hex": b"0123456789ABCDEF", "base32": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": ALPHABET[:62], "base64": ALPHABET[:64], "url64": ALPHABET[:62] + b"-_", "lower36": b"abcdefghijklmnopqrstuvwxyz0123456789",
}


#: In lower case, what any match of the first two patterns begins with; and characters of the third.
_HEADS = (b"passw", b"secret", b"token", b"apikey", b"api_key", b"akia")
_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdef")] = True
MIN_HEX = 24


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def pair_counts(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often each character follows each within the spans; N*N."""
    at = ranges(starts, np.maximum(ends - starts - 1, 0))
    return np.bincount(_CODE[b[at]] * N + _CODE[b[at + 1]], minlength=N * N) if len(at) else np.zeros(N * N, np.int64)


def _of_samples(samples: list[bytes]) -> np.ndarray:
    b = np.frombuffer(b"".join(samples), dtype=np.uint8)
    ends = np.cumsum([len(s) for s in samples])
    return pair_counts(b, ends - [len(s) for s in samples], ends)


def labelled_random(seed: int = 11, each: int = 4000) -> dict[str, list[bytes]]:
    """Samples labelled random, for each alphabet."""
    rng = np.random.default_rng(seed)
    return {k: [bytes(rng.choice(list(a), int(rng.integers(16, 65))).tolist()) for _ in range(each)] for k, a in RANDOM.items()}


def labelled_ordinary(seed: int = 12, each: int = 2000) -> list[bytes]:
    """Samples labelled ordinary: numbers, dates, versions, and names put together from parts."""
    rng = np.random.default_rng(seed)
    parts = [b"user", b"name", b"get", b"set", b"file", b"path", b"index", b"value", b"data", b"item", b"test", b"config", b"id", b"list", b"main", b"http"]
    out = []
    for _ in range(each):
        chosen = [parts[k] for k in rng.integers(0, len(parts), int(rng.integers(2, 5)))]
        out += [b"_".join(chosen), b"-".join(chosen), b".".join(chosen), b"/".join(chosen), b"".join(p.capitalize() for p in chosen), b"".join(chosen), b"_".join(chosen).upper()]
        digits = bytes((48 + rng.integers(0, 10, int(rng.integers(2, 21)))).tolist())
        out += [digits, digits, b"%d-%02d-%02d" % tuple(rng.integers((1990, 1, 1), (2030, 13, 29))), b"%d.%d.%d" % tuple(rng.integers(0, 40, 3))]
    return out


def models(corpus: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each pair of characters for each random model; (models, N*N)."""

    def logs(counts: np.ndarray, alphabet: bytes | None) -> np.ndarray:
        inside = np.isin(np.arange(N), _CODE[list(alphabet)]) if alphabet else np.ones(N, dtype=bool)
        c = counts.reshape(N, N) + np.where(inside[None, :], 0.5, 1e-6)
        return np.log(c / c.sum(axis=1, keepdims=True)).reshape(-1)

    own = _of_samples(labelled_ordinary()).astype(float)
    ordinary = logs(corpus + own * max(1.0, 0.02 * corpus.sum() / own.sum()), None)
    return np.stack([logs(_of_samples(s).astype(float), RANDOM[k]) - ordinary for k, s in labelled_random().items()])


def token_ratios(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """The best model's log-likelihood ratio for each span of two characters or more."""
    if not len(starts):
        return np.zeros(0)
    at = ranges(starts, ends - starts - 1)
    pair = _CODE[b[at]] * N + _CODE[b[at + 1]]
    edge = np.concatenate(([0], np.cumsum(ends - starts - 1)))[:-1]
    return np.stack([np.add.reduceat(r[pair], edge) for r in ratios]).max(axis=0)


def _char_starts(b: np.ndarray) -> np.ndarray:
    """How many code points begin before each byte."""
    return np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))


def _maybe(b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Documents in which a pattern can match at all."""
    out, low, last = set(), LOWER[b].tobytes(), len(off) - 2
    for head in _HEADS:
        at = low.find(head)
        while at >= 0:
            d = min(int(np.searchsorted(off, at, side="right")) - 1, last)
            out.add(d)
            at = low.find(head, int(off[d + 1]))
    starts, ends, _ = spans(b, off, _HEX)
    out.update((np.searchsorted(off, starts[ends - starts >= MIN_HEX], side="right") - 1).tolist())
    return np.array(sorted(out), dtype=np.int64)


def found_by_patterns(b: np.ndarray, off: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """The base spans of each document of a byte buffer; code points."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(off) - 1)]
    for d in _maybe(b, off).tolist():
        out[d] = base_spans(b[off[d] : off[d + 1]].tobytes().decode())
    return out


def find(b: np.ndarray, off: np.ndarray, ratios: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """All spans of each document of a byte buffer, in order; code points."""
    out = found_by_patterns(b, off)
    starts, ends, _ = spans(b, off, _TOKEN)
    long = ends - starts >= MIN_TOKEN
    starts, ends = starts[long], ends[long]
    hit = token_ratios(b, starts, ends, ratios) >= THRESHOLD
    starts, ends = starts[hit], ends[hit]
    if len(starts):
        doc = np.searchsorted(off, starts, side="right") - 1
        before = _char_starts(b)
        at, to = before[starts] - before[off[doc]], before[ends] - before[off[doc]]
        cuts = np.searchsorted(doc, np.arange(len(off)))
        for d in np.unique(doc).tolist():
            s, e = at[cuts[d] : cuts[d + 1]], to[cuts[d] : cuts[d + 1]]
            if out[d]:
                # A span overlaps a pattern's when one that starts before its end ends after its start.
                base = sorted((x, y) for _, x, y in out[d])
                reach = np.maximum.accumulate([y for _, y in base])
                k = np.searchsorted([x for x, _ in base], e, side="left") - 1
                free = (k < 0) | (reach[np.maximum(k, 0)] <= s)
                s, e = s[free], e[free]
            out[d] += [("markov", x, y) for x, y in zip(s.tolist(), e.tolist(), strict=True)]
    for found in out:
        found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return out


def _in_patterns(b: np.ndarray, off: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Flags of tokens that begin inside a pattern's match."""
    inside = np.zeros(len(starts), dtype=bool)
    for d, found in enumerate(found_by_patterns(b, off)):
        if found:
            s, e = np.searchsorted(starts, off[d : d + 2])
            at = _char_starts(b[off[d] : off[d + 1]])[starts[s:e] - off[d]]
            for _, x, y in found:
                inside[s + np.searchsorted(at, x) : s + np.searchsorted(at, y)] = True
    return inside


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(N * N, np.int64)
    for batch in batches:
        b, off = utf8(batch.column(0))
        for i, j in slices(off):
            part, at = b[off[i] : off[j]], off[i : j + 1] - off[i]
            starts, ends, _ = spans(part, at, _TOKEN)
            short = (ends - starts < MIN_TOKEN) & (ends - starts > 1) & ~_in_patterns(part, at, starts)
            total += pair_counts(part, starts[short], ends[short])
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])


def train(docs: DataFrame) -> np.ndarray:
    """The models; of the corpus only N*N sums reach the driver.

    Every token is a labelled sample: one outside the patterns' matches and shorter than MIN_TOKEN is labelled ordinary
    (no span of the models is that short); those inside are labelled secret, and train no ordinary model.
    """
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sums = rows.mapInArrow(_count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    corpus = np.zeros(N * N)
    corpus[sums["pair"].to_numpy(dtype=int)] = sums["n"]
    return models(corpus)


def _listed(found: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{s}:{e}" for k, s, e in found])


def _scan(ratios: np.ndarray):
    kinds = [pa.int64()] * 4 + [pa.string()] * 2
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, off = utf8(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, j in slices(off):
                rows = []
                for doc_id, found in zip(ids[i:j], find(b[off[i] : off[j]], off[i : j + 1] - off[i], ratios), strict=True):
                    base = [x for x in found if x[0] != "markov"]
                    n = [sum(x[0] == k for x in base) for k in KINDS[:3]]
                    rows.append((doc_id, *n, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(found)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        give_back()

    return run


def scan(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """Counts, digest and list of spans of each document."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(_scan(ratios), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def replaced(text: str, found: list[tuple[str, int, int]], mark: str = MARK) -> str:
    """text with each run of overlapping spans replaced by mark."""
    out, at, to = [], 0, 0
    for _, s, e in found:
        if s >= to:
            out += [text[at:s], mark]
        at = to = max(to, e)
    return "".join(out) + text[at:]


def _redact(at: int, ratios: np.ndarray, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            b, off = utf8(column)
            texts: list[str | None] = []
            for i, j in slices(off):
                found = find(b[off[i] : off[j]], off[i : j + 1] - off[i], ratios)
                texts += [t.as_py() if not f else replaced(t.as_py(), f, mark) for t, f in zip(column.slice(i, j - i), found, strict=True)]
            yield batch.set_column(at, batch.schema.names[at], pa.array(texts, column.type))
        give_back()

    return run


def redact(docs: DataFrame, ratios: np.ndarray, mark: str = MARK) -> DataFrame:
    """docs with the spans of each text replaced; null texts stay null, and a column n_chars follows the text."""
    out = Table(docs.mapInArrow(_redact(docs.columns.index("text"), ratios, mark), docs.schema)).read()
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def op2_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return Table(scan(docs, train(docs))).read()
