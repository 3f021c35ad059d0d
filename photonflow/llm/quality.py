"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Statistics are Spark column expressions. On a bounded sample of labelled rows, shallow trees are
boosted on the driver; every path of a tree is a rule, a conjunction of threshold tests. A lasso
logistic fit over the rules and the scaled statistics keeps few of them, and what is left is
compiled into one Spark column expression. Scoring runs no Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonflow.llm.common import packed, unpacked

#: Labelled rows to fit on, in expectation; more would move no threshold visibly.
MAX_ROWS = 20_000
TREES, DEPTH, BINS, MIN_LEAF, RATE = 40, 3, 64, 20, 0.3
PENALTY, STEPS = 2e-3, 600


def statistics(text: Column) -> dict[str, Column]:
    """Numeric statistics of a text, all finite for any text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    chars = F.greatest(n, F.lit(1)).cast("double")
    words = F.greatest(count(r"\S+"), F.lit(1.0))
    lines = F.split(t, "\n", -1)
    n_lines = F.size(lines).cast("double")
    return {
        "log_chars": F.log1p(n.cast("double")),
        "word_length": F.least((n - count(r"\s")) / words, F.lit(100.0)),
        "words_per_line": F.log1p(words / n_lines),
        "symbols": count(r"[#$%&*|<>{}\[\]@~^_=+\\/]") / chars,
        "pipes": count(r"\|") / words,
        "exclaims": count(r"!") / words,
        "uppers": count(r"\p{Lu}") / chars,
        "digits": count(r"[0-9]") / chars,
        "stops": count(r"[.?]") / words,
        "commas": count(r",") / words,
        "repeats": count(r"(?<!\S)(\S+)\s\1(?!\S)") / words,
        "unique_words": F.size(F.array_distinct(F.split(t, " ", -1))) / words,
        "unique_lines": F.size(F.array_distinct(lines)) / n_lines,
    }


@dataclass(frozen=True)
class Rule:
    """All tests hold: (statistic, above, threshold); above: > threshold, else <=."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self, stats: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, cut in self.tests:
            out = out & ((stats[name] > cut) if above else (stats[name] <= cut))
        return out

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, cut in self.tests:
            v = x[:, names.index(name)]
            out &= (v > cut) if above else (v <= cut)
        return out


@dataclass
class Model:
    bias: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    #: statistic, weight, low, high, mean, deviation: weight * (clip(x, low, high) - mean) / deviation
    linear: list[tuple[str, float, float, float, float, float]] = field(default_factory=list)

    def score(self, stats: dict[str, Column]) -> Column:
        """Probability of label 1 as a Spark column."""
        z = F.lit(self.bias)
        for rule, w in self.rules:
            z = z + F.when(rule.column(stats), F.lit(w)).otherwise(F.lit(0.0))
        for name, w, lo, hi, mean, dev in self.linear:
            z = z + (F.least(F.greatest(stats[name], F.lit(lo)), F.lit(hi)) - mean) * (w / dev)
        return 1 / (1 + F.exp(-z))


def _grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, path: tuple, names: list[str], rules: dict, step: np.ndarray) -> None:
    """One node of a boosted tree: the best histogram split, down to DEPTH; its paths go to ``rules``."""
    if path:
        rules.setdefault(Rule(tuple(sorted(path))), None)
    value = g[rows].sum() / (h[rows].sum() + 1.0)
    best = (1e-6, None)
    if len(path) < DEPTH and len(rows) >= 2 * MIN_LEAF:
        base = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for f in range(x.shape[1]):
            k = len(cuts[f]) + 1
            if k == 1:
                continue
            b = bins[rows, f]
            gs, hs, ns = (np.cumsum(np.bincount(b, w, k)) for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - base
            gain[(ns[:-1] < MIN_LEAF) | (ns[-1] - ns[:-1] < MIN_LEAF)] = -1
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], (f, i))
    if best[1] is None:
        step[rows] = value
        return
    f, i = best[1]
    left = bins[rows, f] <= i
    for above, part in ((False, rows[left]), (True, rows[~left])):
        _grow(x, bins, cuts, g, h, part, (*path, (names[f], above, float(cuts[f][i]))), names, rules, step)


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> list[Rule]:
    """The distinct paths of boosted shallow trees, in the order in which they were grown."""
    cuts = [np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for v in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    z, rules, rng = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}, np.random.default_rng(7)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        step = np.zeros(len(y))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        _grow(x, bins, cuts, y - p, p * (1 - p), rows, (), names, rules, step)
        z += RATE * step
    return list(rules)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for mean logistic loss + penalty * |w|_1; the bias is free."""
    n, d = x.shape
    full = np.column_stack([x, np.ones(n)])
    v = np.ones(d + 1)
    for _ in range(30):  # largest eigenvalue of the Gram matrix, for the step size
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / max(v @ (full.T @ (full @ v)), 1e-9)
    w, look, t = np.zeros(d + 1), np.zeros(d + 1), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ look, -40, 40)))
        moved = look - rate * (full.T @ (p - y)) / n
        moved[:-1] = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - rate * penalty, 0)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = moved + (t - 1) / later * (moved - w), moved, later
    return float(w[-1]), w[:-1]


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> Model:
    """Too few rows or a single class: a constant, the share of label 1 (one half without labels)."""
    if len(y) < 4 * MIN_LEAF or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(share / (1 - share))))
    order = np.lexsort(np.column_stack([x, y]).T)
    x, y = x[order], y[order]
    rules = [r for r in fit_rules(x, y, names) if 0 < r.holds(x, names).mean() < 1]
    hits = np.column_stack([r.holds(x, names) for r in rules]).astype(float)
    lo, hi = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    clipped = np.clip(x, lo, hi)
    mean, dev = clipped.mean(axis=0), np.where(clipped.std(axis=0) > 1e-9, clipped.std(axis=0), 1.0)
    bias, w = lasso_logistic(np.column_stack([hits, 0.4 * (clipped - mean) / dev]), y)
    model = Model(bias)
    model.rules = [(r, float(v)) for r, v in zip(rules, w) if v]
    model.linear = [(n, 0.4 * float(v), float(a), float(b), float(m), float(s)) for n, v, a, b, m, s in zip(names, w[len(rules) :], lo, hi, mean, dev) if v]
    return model


def held_out(id_col: Column) -> Column:
    """True for ids of the test fold: crc32 of the id as text leaves 1 on division by 3; false for null."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit on labelled rows outside the test fold. ``max_rows`` bounds, in expectation, the rows that reach the driver."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0.0, 1.0)).where(~held_out(F.col("_id")))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))
    names = list(statistics(F.col("text")))
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    rows = chosen.select("_y", *(c.alias(k) for k, c in statistics(F.col("text")).items())).toPandas()
    return fit(rows[names].to_numpy(float), rows["_y"].to_numpy(float), names)


def score(rows: DataFrame, model: Model, text: str) -> DataFrame:
    """``rows`` with ``_score``, 0 to 1, of the column ``text``. Null and empty texts are scored by their statistics, as any other.

    Statistics are computed once per row, as columns of a projection below the score (the optimizer would take a struct apart
    and compute its fields at every use).
    """
    stats = statistics(F.col(text))
    used = {t[0] for r, _ in model.rules for t in r.tests} | {x[0] for x in model.linear}
    inner = rows.withColumns({f"_stat_{k}": c for k, c in stats.items() if k in used})
    return inner.withColumn("_score", model.score({k: F.col(f"_stat_{k}") for k in stats})).drop(*(f"_stat_{k}" for k in stats))


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns: doc_id, held_out, score, predicted. Repeated rows repeat; an empty table gives no rows."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels), "text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score of one half or more, columns unchanged.

    Null and empty texts are scored as any other, null ids have no part in the score, repeated rows share theirs; an empty table gives no rows.
    The random term is zero; a projection with one keeps the optimizer from moving the test below the projection of
    the statistics, where every use of one would compute it anew.
    """
    scored = score(packed(docs), train(docs, labels), "row.text").withColumn("_score", F.col("_score") + 0 * F.rand(0))
    return unpacked(scored.where("_score >= 0.5"), docs.columns)
