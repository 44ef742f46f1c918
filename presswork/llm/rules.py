"""Quality as a sparse ensemble of rules over text statistics.

1. Boosted trees of small depth are grown on a bounded sample of labelled rows.
2. Every path from a root is a rule: a conjunction of thresholds on statistics.
3. A logistic regression with an L1 penalty weighs the rules; most get weight 0.
4. The rules that are left become one Spark column expression, so a score is a sum
   of conditions on the statistics' columns.

Statistics come from whole texts, in one pass over the text column. Only the sample,
at most ``sample_rows`` rows of numbers, reaches the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.labelled import labelled_texts

STATISTICS = (
    "n_bytes", "n_words", "mean_word", "longest_word", "upper", "lower", "digit", "mark", "space", "other",
    "marks_per_word", "distinct_marks", "distinct_words", "top_word", "repeated_words", "short_words", "long_words",
    "n_lines", "distinct_lines", "mean_line", "byte_entropy",
)
_CLASS = np.full(256, 5)
for _name, _class in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0), ("abcdefghijklmnopqrstuvwxyz", 1), ("0123456789", 2)):
    _CLASS[[ord(c) for c in _name]] = _class
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4


def statistics(text: str | None) -> list[float]:
    """The numbers named in STATISTICS; shares are 0 where there is nothing to share."""
    data = (text or "").encode("utf-8", "replace")
    words, lines = data.split(), data.split(b"\n")
    n, w = max(len(data), 1), max(len(words), 1)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    classes = np.bincount(_CLASS, weights=counts, minlength=6)
    share = counts[counts > 0] / n
    sizes = list(map(len, words))
    often = Counter(words).most_common(1)
    return [
        float(len(data)), float(len(words)), sum(sizes) / w, float(max(sizes, default=0)), *(classes / n),
        classes[3] / w, float((counts[33:127] > 0)[_CLASS[33:127] == 3].sum()), len(set(words)) / w,
        (often[0][1] if often else 0) / w, sum(map(eq, words, words[1:])) / w,
        sum(s <= 2 for s in sizes) / w, sum(s > 12 for s in sizes) / w,
        float(len(lines)), len(set(lines)) / len(lines), len(data) / len(lines), float(-(share * np.log2(share)).sum()),
    ]


def statistics_column(text: str) -> Column:
    @F.pandas_udf(", ".join(f"{name} double" for name in STATISTICS))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([statistics(t) for t in texts], columns=list(STATISTICS))

    return run(F.col(text))


# ---- trees and their rules ---------------------------------------------------------
#: (statistic, is_above, threshold) of every condition.
Rule = tuple[tuple[int, bool, float], ...]


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Thresholds half way between neighbouring quantiles of each column."""
    edges = []
    for column in x.T:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1), method="nearest"))
        edges.append((values[1:] + values[:-1]) / 2)
    return edges


def grow(filed: np.ndarray, edges, gradient: np.ndarray, hessian: np.ndarray, depth: int, least: int):
    """One regression tree as [(rule, leaf value or None)]: all nodes below the root."""
    nodes = []

    def split(rows: np.ndarray, rule: Rule, level: int):
        g, h = gradient[rows], hessian[rows]
        base = g.sum() ** 2 / (h.sum() + 1.0)
        best = (1e-6, -1, 0)
        for f in range(filed.shape[1]) if level < depth and len(rows) >= 2 * least else ():
            size = len(edges[f]) + 1
            if size < 2:
                continue
            gs = np.bincount(filed[rows, f], g, size).cumsum()[:-1]
            hs = np.bincount(filed[rows, f], h, size).cumsum()[:-1]
            ns = np.bincount(filed[rows, f], minlength=size).cumsum()[:-1]
            gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - base
            gain[(ns < least) | (len(rows) - ns < least)] = -np.inf
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], f, at)
        _, f, at = best
        if f < 0:
            nodes.append((rule, rows, g.sum() / (h.sum() + 1.0)))
            return
        if rule:
            nodes.append((rule, rows, None))
        above = filed[rows, f] > at
        threshold = float(edges[f][at])
        split(rows[~above], (*rule, (f, False, threshold)), level + 1)
        split(rows[above], (*rule, (f, True, threshold)), level + 1)

    split(np.arange(len(filed)), (), 0)
    return nodes


def boosted_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, bins: int = 64, rate: float = 0.3) -> list[Rule]:
    edges = _edges(x, bins)
    filed = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    score, rules = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        for rule, rows, value in grow(filed, edges, y - p, p * (1 - p), depth, max(2, len(y) // 500)):
            if rule:
                rules.setdefault(rule)
            if value is not None:
                score[rows] += rate * value
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, threshold in rule:
        out &= (x[:, f] > threshold) == above
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient; only the weights are penalised."""
    n = max(len(y), 1)
    a = np.hstack([np.ones((len(y), 1)), z])
    step = 4 * n / max(np.linalg.norm(a.T @ a, 2), 1e-9)
    w = v = np.zeros(a.shape[1])
    w[0] = v[0] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a @ v)))
        new = v - step * (a.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (before - 1) / t * (new - w), new
    return float(w[0]), w[1:]


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self, stats: str) -> Column:
        """Chance of label 1 from the struct column ``stats``."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            hit = F.lit(True)
            for f, above, threshold in rule:
                value = F.col(stats)[STATISTICS[f]]
                hit = hit & (value > threshold if above else value <= threshold)
            total = total + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score_rows(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += weight * holds(rule, x)
        return 1 / (1 + np.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 1e-3) -> RuleModel:
    """With rows of one label only, or none, the model is a constant near that label (or 0.5)."""
    if len(np.unique(y)) < 2:
        return RuleModel(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), [])
    rules = boosted_rules(x, y, trees, depth)
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    intercept, weights = lasso_logistic(z, y, penalty)
    return RuleModel(intercept, [(r, float(w)) for r, w in zip(rules, weights) if w])


def fit_quality(
    docs: DataFrame, labels: DataFrame, use: Column, label: str = "quality", key: str = "doc_id", text: str = "text",
    sample_rows: int = 12_000, **options,
) -> RuleModel:
    """A model of ``label`` from at most ``sample_rows`` labelled keys that ``use`` allows."""
    sample = labelled_texts(docs, labels, label, use, sample_rows, key, text)
    rows = sample.select("label", statistics_column("text").alias("s")).select("label", "s.*").toPandas()
    order = np.lexsort(rows.to_numpy().T)  # the same rows give the same model, in any order of arrival
    data = rows.to_numpy(dtype=float)[order]
    return fit_rules(data[:, 1:], data[:, 0], **options)


def score_quality(docs: DataFrame, model: RuleModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (double, 0 to 1); null and empty texts have a score like any other.

    An existing column named score is replaced; an empty table stays empty.
    """
    kept = [c for c in docs.columns if c != "score"]
    return docs.withColumn("_statistics", statistics_column(text)).select(*kept, model.score("_statistics").alias("score"))
