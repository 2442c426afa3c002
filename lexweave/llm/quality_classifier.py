"""Operator 4, quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Shallow trees over text statistics are grown on a bounded sample of labelled rows; every path from a root is a
conjunctive rule; lasso logistic regression keeps few of them; the kept rules become one native Spark expression that
scores every whole text. Labels, language, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import table
from lexweave.llm.text_stats import with_statistics

#: Bound of the labelled sample that the model is fitted on; the rows with the smallest hashes of doc_id are taken.
MAX_FIT_ROWS = 8000


#: Statistics of the ensemble: name, count, and the count that it is divided by.
RATIOS = (
    ("mean_word", "word_chars", "n_words"), ("symbols", "n_symbols", "n_words"), ("dup_lines", "n_dup_lines", "n_lines"), ("repeats", "n_repeat_words", "n_words"),
    ("upper", "n_upper", "word_chars"), ("digits", "n_digits", "word_chars"), ("marks", "n_marks", "n_words"), ("bangs", "n_bangs", "n_words"), ("stops", "n_stop_words", "n_words"),
    ("distinct", "n_distinct_words", "n_words"), ("pipes", "n_pipes", "n_words"), ("line_words", "n_words", "n_lines"),
)
NAMES = ("log_words", *(r[0] for r in RATIOS))


def features() -> dict[str, Column]:
    """The statistics as expressions over the counts; a zero divisor counts as one."""
    out = {"log_words": F.log1p(F.col("n_words").cast("double"))}
    for name, part, whole in RATIOS:
        out[name] = F.col(part).cast("double") / F.greatest(F.col(whole), F.lit(1)).cast("double")
    return out


#: A condition: (feature index, True for "<=" or False for ">", threshold). A rule: a frozenset of them.
Condition = tuple[int, bool, float]


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[tuple[frozenset, float]] = field(default_factory=list)

    def matrix(self, x: np.ndarray) -> np.ndarray:
        return rule_matrix([r for r, _ in self.rules], x)

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.intercept + self.matrix(x).astype(float) @ np.array([w for _, w in self.rules]) if self.rules else np.full(len(x), self.intercept)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The score as a native expression over the columns named NAMES."""
        z = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            test = None
            for f, below, cut in sorted(rule):
                one = F.col(f"_qc_{NAMES[f]}") <= F.lit(cut) if below else F.col(f"_qc_{NAMES[f]}") > F.lit(cut)
                test = one if test is None else test & one
            z = z + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{NAMES[f]} {'<=' if b else '>'} {c:.4g}" for f, b, c in sorted(r)) for r, w in sorted(self.rules, key=lambda t: -abs(t[1]))]


def rule_matrix(rules: list[frozenset], x: np.ndarray) -> np.ndarray:
    """(rows, rules) of booleans: which rules hold of which rows."""
    out = np.ones((len(x), len(rules)), bool, order="F")
    for j, rule in enumerate(rules):
        for f, below, cut in rule:
            out[:, j] &= (x[:, f] <= cut) if below else (x[:, f] > cut)
    return out


def _grow(x: np.ndarray, target: np.ndarray, depth: int, rng: np.random.Generator, least: int, path: frozenset, found: set) -> None:
    """Least-squares splits on a random half of the features; every node but the root is a rule."""
    if path:
        found.add(path)
    if depth == 0 or len(x) < 2 * least or np.ptp(target) == 0:
        return
    best = (1e-9, -1, 0.0)
    for f in rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(target[order])
        n = np.arange(1, len(v))
        gain = t[:-1] ** 2 / n + (t[-1] - t[:-1]) ** 2 / (len(v) - n) - t[-1] ** 2 / len(v)
        gain[(v[1:] <= v[:-1]) | (n < least) | (len(v) - n < least)] = 0
        if len(gain) and gain.max() > best[0]:
            k = int(gain.argmax())
            best = (gain[k], f, float((v[k] + v[k + 1]) / 2))
    _, f, cut = best
    if f >= 0:
        low, f = x[:, f] <= cut, int(f)
        tighter = lambda below: frozenset(c for c in path if c[:2] != (f, below)) | {(f, below, cut)}
        _grow(x[low], target[low], depth - 1, rng, least, tighter(True), found)
        _grow(x[~low], target[~low], depth - 1, rng, least, tighter(False), found)


def _lasso_logistic(rules: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient on standardised rules; the intercept is free.

    The standardised matrix is never made: centring and scaling go into the vectors on both sides of it.
    """
    a = rules.astype(np.float32)
    mean = rules.mean(0)
    std = np.maximum(np.sqrt(mean * (1 - mean)), 0.05)

    def forward(v: np.ndarray) -> np.ndarray:
        w = v[1:] / std
        return v[0] - mean @ w + (a @ w.astype(np.float32)).astype(float)

    def backward(r: np.ndarray) -> np.ndarray:
        return np.append(r.sum(), ((r.astype(np.float32) @ a).astype(float) - mean * r.sum()) / std)

    v = np.random.default_rng(0).normal(size=a.shape[1] + 1)
    for _ in range(20):
        v = backward(forward(v))
        v /= np.linalg.norm(v)
    step = 4 * len(a) / max(float(np.linalg.norm(backward(forward(v)))), 1e-9)
    w = z = np.zeros(a.shape[1] + 1)
    t = 1.0
    for _ in range(rounds):
        g = backward(1 / (1 + np.exp(-forward(z))) - y) / len(a)
        n = z - step * g
        n[1:] = np.sign(n[1:]) * np.maximum(np.abs(n[1:]) - step * penalty, 0)
        u = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, w, t = n + (t - 1) / u * (n - w), n, u
    weights = w[1:] / std
    return float(w[0] - weights @ mean), weights


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleEnsemble:
    """Grow trees on residuals of bootstrap samples, take their paths as rules, keep those with a lasso weight.

    No row: score 0.5. One class only: a constant score near that class.
    """
    if not len(y):
        return RuleEnsemble(0.0)
    prior = (y.sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return RuleEnsemble(math.log(prior / (1 - prior)))
    rng, found = np.random.default_rng(seed), set()
    for k in range(trees):
        pick = rng.integers(0, len(y), len(y)) if k else np.arange(len(y))
        _grow(x[pick], y[pick] - y.mean(), depth, rng, max(3, len(y) // 400), frozenset(), found)
    rules = sorted(found, key=lambda r: sorted(r))
    m = rule_matrix(rules, x)
    first: dict[bytes, int] = {}  # rules true of the same rows are one rule; those true of all or none are none
    for j in np.flatnonzero(m.any(0) & ~m.all(0)):
        first.setdefault(np.packbits(m[:, j]).tobytes(), int(j))
    unique = sorted(first.values())
    rules, m = [rules[i] for i in unique], m[:, unique]
    if not rules:
        return RuleEnsemble(math.log(prior / (1 - prior)))
    b, w = _lasso_logistic(m, y, penalty)
    return RuleEnsemble(b, [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-3])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> RuleEnsemble:
    """Fit on at most ``max_rows`` labelled documents that are not held out; only their statistics reach the driver.

    Labels without a quality are left out; of repeated labels of a document the smallest counts, and of repeated rows of a
    document the smallest text. Without documents, or without labels of any, the model scores 0.5.
    """
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_qc_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows rows of two numbers
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_qc_y").alias("_qc_y"))
    sample = with_statistics(rows).select("doc_id", F.col("_qc_y").cast("double").alias("y"), *[v.alias(k) for k, v in features().items()])
    got = np.array(sorted(map(tuple, sample.collect())), float).reshape(-1, len(NAMES) + 2)  # at most max_rows rows of numbers
    return fit_rules(got[:, 2:], got[:, 1])


def with_scores(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """``docs`` with ``score`` in [0, 1] and ``predicted``, natively; null and empty texts are scored as empty.

    One row out per row in; clashing input columns named score or predicted are replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    renamed = docs.select(*[F.col(c).alias(f"_in_{i}") for i, c in enumerate(kept)], F.col("text"))
    counted = with_statistics(renamed).withColumns({f"_qc_{k}": v for k, v in features().items()})
    scored = counted.select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(kept)], model.column().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return with_scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.5, with their own columns; repeated rows stay or go together, an empty table gives none."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    # The row number keeps the filter above the score; pushed below, it would hold a copy of every statistic for every rule.
    scored = with_scores(docs, model).withColumn("_qc_row", F.monotonically_increasing_id())
    return scored.where("predicted = 1 AND _qc_row >= 0").select(*docs.columns)
