"""Quality rules whose cutoffs bound how many good documents they reject.

A rule rejects a document whose statistic exceeds a cutoff. For each stratum
(language) and rule, the cutoffs of a fixed grid are tried from lenient to
strict on the labelled good documents: a cutoff is taken while the exact
binomial test rejects, at level DELTA over all rules and strata, that it
falsely rejects more than ALPHA / rules of the stratum's good documents. Trying
in a fixed order and stopping at the first failure needs no correction along
the grid; rules and strata are corrected for by Bonferroni. A stratum with too
few labels gets no cutoff, and none of its documents is rejected by a rule.

Cases: a null or empty text has no words and fails the base rules; a null
language is a stratum of its own; a null doc_id has no label; rows of labels
that share a doc_id count as their lowest quality; rows of documents that share
one are judged each, and count once, as one labelled document, for the bounds;
without labels only the base rules reject; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.llm._shared import Table, documents
from ocellus.llm.quality import labelled
from ocellus.llm.stats import with_stats

ALPHA, DELTA = 0.05, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
GRID = 64
#: Rule: numerator, denominator, largest value on the grid.
RULES = {
    "symbols": ("n_symbols", "word_chars", 0.5), "dup_lines": ("n_dup_lines", "n_lines", 1.0), "repeats": ("n_repeat_words", "n_words", 1.0),
    "pipes": ("n_pipes", "n_words", 1.0), "upper": ("n_upper", "word_chars", 1.0),
}


def level(stats: str, rule: str) -> Column:
    """The statistic on the grid, 0 to GRID; a cutoff of c rejects levels above c."""
    a, b, top = RULES[rule]
    x = F.col(f"{stats}.{a}") / F.greatest(F.col(f"{stats}.{b}"), F.lit(1))
    return F.least(F.ceil(x / top * GRID), F.lit(GRID)).cast("int")


def at_most(x: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """P(Binomial(n, p) <= x), exactly."""
    out = np.empty(len(x))
    for i, (k, m) in enumerate(zip(x, n, strict=True)):
        if k >= m:
            out[i] = 1.0
            continue
        if k > m * p + 40 * math.sqrt(m * p + 1):
            out[i] = 1.0
            continue
        j = np.arange(int(k) + 1, dtype=np.float64)
        # log C(m, j) as a running sum, so that no factorial is formed
        steps = np.log(m - j[1:] + 1) - np.log(j[1:])
        logs = np.concatenate(([0.0], np.cumsum(steps))) + j * math.log(p) + (m - j) * math.log1p(-p)
        out[i] = min(1.0, float(np.exp(logs).sum()))
    return out


def cutoffs(good: DataFrame, stats: str, stratum: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """A row for each stratum that good (labelled good documents) holds: stratum and a cutoff for each rule, null for none."""
    rules = list(RULES)
    levels = good.select(stratum, F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), level(stats, r).alias("level")) for r in rules])).alias("x"))
    counts = levels.groupBy(stratum, "x.rule", "x.level").agg(F.count("*").alias("n"))
    # GRID + 1 rows at most for each rule and stratum from here on.
    own = Window.partitionBy(stratum, "rule")
    strata = counts.select(stratum).distinct().agg(F.greatest(F.count("*"), F.lit(1)).alias("strata"))
    share = alpha / len(rules)

    @F.pandas_udf("double")
    def p_value(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(at_most(x.to_numpy(), n.to_numpy(), share))

    above = F.coalesce(F.sum("n").over(own.orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(own)
    held = counts.withColumns({"above": above, "total": total}).withColumn("p", p_value("above", "total")).crossJoin(F.broadcast(strata))
    # A cutoff at a level that no good document has does as well as the next lower level that one has.
    passes = F.col("p") <= F.lit(delta / len(rules)) / F.col("strata")
    failed = F.max(F.when(~passes, 1).otherwise(0)).over(own.orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("failed", failed).where("failed = 0").groupBy(stratum).pivot("rule", rules).agg(F.min("level"))


def judge(rows: DataFrame, chosen: DataFrame, stats: str, stratum: str) -> DataFrame:
    """Adds base_failed and kept. chosen is small: Spark broadcasts it if its size allows, and splits a skewed stratum if not."""
    joined = rows.join(chosen.withColumnRenamed(stratum, "_s"), rows[stratum].eqNullSafe(F.col("_s")), "left")
    n = F.col(f"{stats}.n_words")
    base = (n < MIN_WORDS) | (100 * F.col(f"{stats}.n_repeat_words") > MAX_REPEAT_PERCENT * n)
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(level(stats, r) > F.col(r), F.lit(False))
    return joined.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~rejected)


def strata(lang: Column) -> Column:
    """A stratum for each language, and one for none."""
    return F.when(lang.isNull(), F.lit("none")).otherwise(F.concat(F.lit("lang "), lang.cast("string")))


def labelled_good(rows: DataFrame, labels: DataFrame, stats: str, stratum: str) -> DataFrame:
    """Stratum and counts of each good labelled document, once: of rows that share a doc_id, the first stratum's and least counts."""
    good = labelled(labels, "quality").where("y = 1").select("doc_id")
    one = rows.join(good, "doc_id").groupBy("doc_id").agg(F.min(F.struct(stratum, stats)).alias("x"))
    return one.select("doc_id", "x.*")


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of each document."""
    own = docs.select("doc_id", "text", strata(F.col("lang")).alias("stratum"))
    made, stats = with_stats(own, ["doc_id", "stratum"])
    table = Table(made).read()
    chosen = Table(cutoffs(labelled_good(table, labels, stats, "stratum"), stats, "stratum")).read()
    out = judge(table, chosen, stats, "stratum")
    counts = [F.col(f"{stats}.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select("doc_id", *counts, "base_failed", "kept")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return apply_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
