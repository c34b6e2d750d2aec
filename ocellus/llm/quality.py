"""A sparse rule ensemble that scores documents for quality.

Small boosted trees over text statistics give their paths as conjunctive
rules; a lasso logistic regression over the rules keeps few of them; those are
compiled into one Spark column expression, so a score is a sum over native
comparisons. Fitting takes at most sample_rows labelled documents, of low hash;
scoring takes every row.

Cases: a null or empty text is scored as one whose counts are 0; a null doc_id
has no label, and its crc32 is an empty text's; rows of labels that share a
doc_id count as their lowest quality, null qualities not at all; with labels of
one class, or none, the score is that class's share, or 0.5; repeated rows are
scored each; other columns pass through or are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocellus.llm._shared import Table, bucket, documents, sampled
from ocellus.llm.stats import with_stats

SAMPLE_ROWS = 8_000
TREES, DEPTH, BINS, SHRINK, MIN_LEAF = 30, 3, 24, 0.3, 10
PENALTY, STEPS = 2e-3, 300
#: Shares of one count in another, and plain counts on a logarithmic scale.
SHARES = {
    "symbols": ("n_symbols", "n_chars"), "upper": ("n_upper", "n_chars"), "digits": ("n_digits", "n_chars"), "punct": ("n_punct", "n_chars"),
    "space": ("n_space", "n_chars"), "wide": ("n_wide", "n_chars"), "stops": ("n_stops", "n_words"), "pipes": ("n_pipes", "n_words"),
    "long_words": ("n_long_words", "n_words"), "distinct": ("n_distinct_words", "n_words"), "repeats": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"), "word_length": ("word_chars", "n_words"), "line_words": ("n_words", "n_lines"),
}
LOGS = {"log_words": "n_words", "log_lines": "n_lines"}
FEATURES = (*SHARES, *LOGS)


def feature_columns(stats: str) -> dict[str, Column]:
    """The statistics as columns, for training and scoring alike."""
    out = {k: F.round(F.try_divide(F.col(f"{stats}.{a}").cast("double"), F.greatest(F.col(f"{stats}.{b}"), F.lit(1)).cast("double")), 6) for k, (a, b) in SHARES.items()}
    return out | {k: F.round(F.log1p(F.col(f"{stats}.{c}").cast("double")), 6) for k, c in LOGS.items()}


#: (feature, True for <=, cut)
Test = tuple[int, bool, float]


@dataclass
class Rules:
    bias: float = 0.0
    rules: list[tuple[Test, ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self, features: dict[str, Column]) -> Column:
        """The score as a column expression."""
        total = F.lit(float(self.bias))
        for tests, w in zip(self.rules, self.weights, strict=True):
            said = None
            for f, below, cut in tests:
                c = features[FEATURES[f]] <= cut if below else features[FEATURES[f]] > cut
                said = c if said is None else said & c
            total = total + F.when(said, float(w)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The same for a matrix of features."""
        held = _held(self.rules, x)
        return 1 / (1 + np.exp(-(self.bias + held @ np.array(self.weights)))) if self.rules else np.full(len(x), 1 / (1 + np.exp(-self.bias)))


def _held(rules: list[tuple[Test, ...]], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), dtype=np.float32)
    for j, tests in enumerate(rules):
        for f, below, cut in tests:
            out[:, j] *= (x[:, f] <= cut) if below else (x[:, f] > cut)
    return out


def _grow(binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, rows: np.ndarray, path: tuple[Test, ...], step: np.ndarray, found: list) -> None:
    """One regression tree on the gradient; paths go to found, leaf values into step."""
    if path:
        found.append(path)
    g = grad[rows]
    best = (1e-9, None)
    if len(path) < DEPTH and len(rows) >= 2 * MIN_LEAF:
        for f in range(binned.shape[1]):
            if not len(cuts[f]):
                continue
            n = np.cumsum(np.bincount(binned[rows, f], minlength=len(cuts[f]) + 1))[:-1]
            s = np.cumsum(np.bincount(binned[rows, f], weights=g, minlength=len(cuts[f]) + 1))[:-1]
            ok = (n >= MIN_LEAF) & (len(rows) - n >= MIN_LEAF)
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (g.sum() - s) ** 2 / np.maximum(len(rows) - n, 1) - g.sum() ** 2 / len(rows), 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k))
    if best[1] is None:
        step[rows] = g.mean() if len(g) else 0
        return
    f, k = best[1]
    left = binned[rows, f] <= k
    for side, below in ((rows[left], True), (rows[~left], False)):
        _grow(binned, cuts, grad, side, (*path, (f, below, float(cuts[f][k]))), step, found)


def fit(x: np.ndarray, y: np.ndarray) -> Rules:
    """Trees by gradient boosting, then lasso logistic weights by accelerated proximal steps."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0) or len(y) < 2 * MIN_LEAF:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Rules(float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    # A cut stands halfway to the next value, as rows at a quantile are many.
    for f, c in enumerate(cuts):
        values = np.unique(x[:, f])
        nxt = values[np.minimum(np.searchsorted(values, c, side="right"), len(values) - 1)]
        cuts[f] = np.unique(((c + nxt) / 2)[nxt > c])
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1)
    margin, found = np.full(len(y), np.log(share / (1 - share))), []
    for _ in range(TREES):
        step = np.zeros(len(y))
        _grow(binned, cuts, y - 1 / (1 + np.exp(-margin)), np.arange(len(y)), (), step, found)
        margin += SHRINK * 4 * step
    rules = list(dict.fromkeys(found))
    held = _held(rules, x)
    spread = held.std(axis=0)
    rules, held = [r for r, s in zip(rules, spread, strict=True) if s > 0], held[:, spread > 0]
    w, ahead, t, bias = np.zeros(len(rules)), np.zeros(len(rules)), 1.0, float(np.log(share / (1 - share)))
    rate = 4 * len(y) / max(np.linalg.norm(held, 2) ** 2, 1e-9)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(bias + held @ ahead)))
        bias -= float((p - y).mean())
        new = ahead - rate * (held.T @ (p - y)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * PENALTY, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return Rules(bias, [rules[k] for k in keep], [round(float(w[k]), 6) for k in keep])


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """One row for each doc_id with a label."""
    return labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"))


def train(stats: DataFrame, labels: DataFrame, name: str = "stats", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Rules:
    """Fit on at most sample_rows labelled documents of low hash whose crc32 modulo 3 is not 1; of rows that share a doc_id, on the one of least counts."""
    said = labelled(labels, label).where(bucket(F.col("doc_id"), 3) != 1)
    rows = stats.select("doc_id", F.col(name).alias("counts")).join(said, "doc_id").groupBy("doc_id", "y").agg(F.min("counts").alias("counts"))
    kept = Table(rows.select(F.xxhash64("doc_id").alias("h"), "y", *[c.alias(k) for k, c in feature_columns("counts").items()]))
    picked = sampled(kept, "h", sample_rows).orderBy("h").limit(sample_rows).toPandas()
    kept.drop()
    return fit(picked[list(FEATURES)].to_numpy(dtype=float), (picked["y"].to_numpy() == 1).astype(float))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """The documents whose score reaches cut, with their own columns."""
    made, name = with_stats(docs)
    rows = Table(made).read()
    model = train(rows, labels, name)
    return rows.where(model.column(feature_columns(name)) >= cut).drop(name)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    made, name = with_stats(documents(spark, sf_dir), ["doc_id"])
    stats = Table(made).read()
    model = train(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"), name)
    return (
        stats.select("doc_id", (bucket(F.col("doc_id"), 3) == 1).alias("held_out"), F.round(model.column(feature_columns(name)), 9).alias("score"))
        .withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
    )
