"""Language identification by a blended-spectrum string kernel.

The kernel of two texts counts the character n-grams (1 to 3, presence only,
in BUCKETS hash buckets) that both hold, over the geometric mean of how many
each holds. Landmarks from the training sample give the Nystrom feature map;
kernel ridge regression, one language against the rest, is solved there. As
the presence kernel is an inner product, landmarks and weights fold into one
matrix, and a batch of texts is scored by one matrix product.

Training takes at most sample_rows rows of low hash among those with a language
and crc32 modulo 5 not 0, and their whole texts; every row is scored, on its
whole text.

Cases: a null text, or one with no letter, is `und` with score 0; a null
doc_id's crc32 is an empty text's; with nothing to learn from, all rows are
`und`; ties between languages go to the first in sort order; repeated rows are
scored each; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.llm._shared import Table, bucket, documents, sampled

SAMPLE_ROWS, LANDMARKS, RIDGE = 8_000, 256, 1e-2
GRAMS, BUCKET_BITS = (1, 2, 3), 13
BUCKETS = 1 << BUCKET_BITS
#: Code points of text that are expanded together.
PART_CHARS = 1 << 20
UNKNOWN = "und"


def presence(texts: list[str]) -> np.ndarray:
    """A row for each text: 1 where one of its lower-cased n-grams falls into a bucket."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.uint8)
    flat = out.reshape(-1)
    last = max(GRAMS) - 1
    i = 0
    while i < len(texts):
        parts, docs, size = [], [], 0
        while i < len(texts) and (size < PART_CHARS or not parts):
            low = texts[i].lower()
            # A long text comes in overlapping parts, so no n-gram is lost.
            for at in range(0, max(len(low), 1), PART_CHARS):
                parts.append(low[at : at + PART_CHARS + last])
                docs.append(i)
            size += len(low)
            i += 1
        lens = np.array([len(p) for p in parts], dtype=np.int64)
        c = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        row = np.repeat(np.array(docs, dtype=np.int64) << BUCKET_BITS, lens)
        left = np.repeat(np.cumsum(lens), lens) - np.arange(len(c))
        h = np.zeros(len(c), dtype=np.uint32)
        for n in range(1, last + 2):
            size = len(c) - n + 1
            if size <= 0:
                break
            h = h[:size] * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(n)
            if n in GRAMS:
                whole = left[:size] >= n
                at = ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
                flat[(row[:size] + at)[whole]] = 1
    return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [bool(t) and any(map(str.isalpha, t)) and bool(self.languages) for t in texts]
        said, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        rows = [k for k, x in enumerate(known) if x]
        for at in range(0, len(rows), 128):
            part = rows[at : at + 128]
            p = presence([texts[k] for k in part]).astype(np.float32)
            norm = np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))
            s = (p @ self.weights) / norm
            best = s.argmax(axis=1)
            for k, b, v in zip(part, best, s[np.arange(len(part)), best], strict=True):
                said[k], score[k] = self.languages[b], min(max(float(v), 0.0), 1.0)
        return said, score


def fit(grams: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on Nystrom features, one language against the rest."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), dtype=np.float32))
    x = grams.astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    y = np.array([[1.0 if said == name else 0.0 for name in names] for said in languages])
    # The same share of landmarks for each language, in sample order.
    seen: dict[str, int] = {}
    turn = [seen[a] for a in languages if not seen.update({a: seen.get(a, 0) + 1})]
    order = np.argsort(np.array(turn), kind="stable")
    z = x[order[:landmarks]]
    value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = (x @ z.T).astype(np.float64) @ root
    w = np.linalg.solve(phi.T @ phi + ridge * len(x) / 100 * np.eye(phi.shape[1]), phi.T @ y)
    return Model(names, (z.T.astype(np.float64) @ (root @ w)).astype(np.float32))


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 128):
            part = batch.slice(i, 128)
            packed = np.packbits(presence(part.column(1).to_pylist()), axis=1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in packed], pa.binary()), part.column(2)], names=["h", "grams", "lang"])


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket(F.col("doc_id"), 5) != 0))
    hashed = rows.select(F.xxhash64("doc_id", "text").alias("h"), "text", "lang")
    keys = Table(hashed.select("h"))
    # Repeated rows share a hash, and only one of them is learned from.
    bound = sampled(keys, "h", sample_rows).agg(F.max("h")).first()[0]
    keys.drop()
    if bound is None:
        return fit(np.zeros((0, BUCKETS)), [])
    made = hashed.where(F.col("h") <= bound).mapInArrow(_bits, "h long, grams binary, lang string")
    made = made.groupBy("h").agg(F.min(F.struct("lang", "grams")).alias("x")).select("h", "x.*").orderBy("h").limit(sample_rows).toPandas()
    grams = np.unpackbits(np.frombuffer(b"".join(made["grams"]), dtype=np.uint8).reshape(len(made), -1), axis=1)
    return fit(grams, list(made["lang"]))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                said, score = model.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(said, pa.string()), pa.array(np.round(score, 6))], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document."""
    rows = docs.select(F.col("doc_id").cast("long"), (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, lang_pred string, score double")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return Table(identify(docs, train(docs))).read()
