"""Quality classifier as a sparse rule ensemble (after Friedman and Popescu, 2008).

Texts are reduced to statistics with built-in functions. Small trees are grown on random parts of a
labelled sample; each path from a root to a node is a conjunctive rule over the statistics. A lasso
logistic regression picks and weighs rules, and those with a weight are compiled into one Spark
column expression, so scoring is a projection without Python.

Only the sample is fitted on the driver: at most ``TRAIN_ROWS`` labelled rows, chosen by the hash of
their id, a few dozen numbers each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from molframe.llm.core import SPACE, UPPER, query, table, words

TRAIN_ROWS = 20_000
TREES, DEPTH, CUTS = 40, 3, 32
STATISTICS = ["n_words", "word_length", "upper", "digits", "symbols", "exclamations", "stops", "commas",
              "distinct_words", "distinct_pairs", "line_words", "dup_lines", "dup_words_top"]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, row (all columns of ``docs``) and the ``STATISTICS`` (double) of whole texts.

    All statistics are 0 for texts without words.
    """
    given = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
                        F.coalesce("text", F.lit("")).alias("text"))
    rows = given.select("row", "doc_id", "text", words(F.col("text")).alias("w"), F.filter(
        F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("lines"))
    hashed = rows.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    paired = hashed.withColumn("pairs", F.expr(
        "CASE WHEN size(h) < 2 THEN CAST(array() AS array<bigint>) ELSE "
        "transform(sequence(0, size(h) - 2), i -> xxhash64(h[i], h[i + 1])) END"))
    n, chars = F.size("w"), F.length("text")
    without = lambda s: chars - F.length(F.translate("text", s, ""))
    per_word = lambda c: F.when(n > 0, c / n).otherwise(0.0)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    lines, apart = F.size("lines"), F.size(F.array_distinct("h"))
    return paired.select(
        "doc_id", "row", n.cast("double").alias("n_words"),
        per_word(F.length(F.translate("text", SPACE, ""))).alias("word_length"),
        per_word(without(UPPER)).alias("upper"), per_word(without("0123456789")).alias("digits"),
        per_word(without("#*$%&|<>{}[]=_~^@\\")).alias("symbols"), per_word(without("!?")).alias("exclamations"),
        per_word(without(".")).alias("stops"), per_word(without(",;:")).alias("commas"),
        share(apart, n).alias("distinct_words"),
        share(F.size(F.array_distinct("pairs")), F.size("pairs")).alias("distinct_pairs"),
        share(n, lines).alias("line_words"), share(lines - F.size(F.array_distinct("lines")), lines).alias("dup_lines"),
        share(n - apart, F.sqrt(n.cast("double"))).alias("dup_words_top"))


@dataclass(frozen=True)
class Rule:
    """Conjunction of (statistic, is above, cut) and its weight."""

    tests: tuple[tuple[str, bool, float], ...]
    weight: float

    def column(self) -> Column:
        met = F.lit(True)
        for name, above, cut in self.tests:
            met = met & ((F.col(name) > cut) if above else (F.col(name) <= cut))
        return F.when(met, F.lit(self.weight)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class RuleModel:
    base: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """Probability of label 1 as an expression over the statistics."""
        total = F.lit(self.base)
        for r in self.rules:
            total = total + r.column()
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x, y, cuts, rows, depth, rng, path, out):
    """Greedy splits by Gini gain over binned statistics; collects the path of every node."""
    if path:
        out.add(path)
    own = y[rows]
    if depth == 0 or len(rows) < 20 or own.min() == own.max():
        return
    best = (1e-9, None)
    for f in sorted(rng.choice(x.shape[1], size=max(2, x.shape[1] // 2), replace=False)):
        bins = x[rows, f]
        n = np.cumsum(np.bincount(bins, minlength=len(cuts[f]) + 1))[:-1]
        p = np.cumsum(np.bincount(bins, weights=own, minlength=len(cuts[f]) + 1))[:-1]
        m, q = len(rows) - n, own.sum() - p
        ok = (n >= 5) & (m >= 5)
        if not ok.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, p * p / n + q * q / m, 0) - own.sum() ** 2 / len(rows)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], (f, k))
    if best[1] is None:
        return
    f, k = best[1]
    low = x[rows, f] <= k
    _grow(x, y, cuts, rows[low], depth - 1, rng, (*path, (int(f), False, k)), out)
    _grow(x, y, cuts, rows[~low], depth - 1, rng, (*path, (int(f), True, k)), out)


def _lasso(z: np.ndarray, y: np.ndarray, strength: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for logistic loss with an L1 penalty; the base is free."""
    n, d = z.shape
    scale = np.maximum(z.std(axis=0), 1e-3)
    a = np.hstack([np.ones((n, 1)), (z - z.mean(axis=0)) / scale])
    v = np.ones(d + 1)
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) or 1
    rate = 4 * n / max(1e-9, float(v @ (a.T @ (a @ v))))
    w = u = np.zeros(d + 1)
    t = 1.0
    for _ in range(steps):
        g = a.T @ (1 / (1 + np.exp(-np.clip(a @ u, -30, 30))) - y) / n
        new = u - rate * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * strength, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / nt * (new - w), new, nt
    weight = w[1:] / scale
    return float(w[0] - (weight * z.mean(axis=0)).sum()), weight


def fit(x: np.ndarray, y: np.ndarray, names: list[str] = STATISTICS, seed: int = 7) -> RuleModel:
    """Rules from trees, weights from the lasso; its strength is chosen on a fifth of the rows."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(share / (1 - share))), ())
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    paths: set = set()
    for _ in range(TREES):
        rows = rng.choice(len(y), size=max(1, len(y) // 2), replace=False)
        _grow(binned, y, cuts, rows, DEPTH, rng, (), paths)

    def simple(path):
        """One test per statistic and direction, the tightest."""
        tight: dict = {}
        for f, above, k in path:
            old = tight.get((f, above))
            tight[f, above] = k if old is None else (max if above else min)(old, k)
        return tuple(sorted((f, above, k) for (f, above), k in tight.items()))

    rules = sorted({simple(p) for p in paths})
    z = np.ones((len(y), len(rules)))
    for i, rule in enumerate(rules):
        for f, above, k in rule:
            z[:, i] *= (binned[:, f] > k) if above else (binned[:, f] <= k)
    # rules with the same rows are one
    _, keep = np.unique(np.packbits(z.astype(bool), axis=0), axis=1, return_index=True)
    rules, z = [rules[i] for i in np.sort(keep)], z[:, np.sort(keep)]
    part = rng.permutation(len(y)) % 5 == 0
    losses = []
    for strength in (0.01, 0.003, 0.001):
        base, w = _lasso(z[~part], y[~part], strength)
        p = 1 / (1 + np.exp(-np.clip(base + z[part] @ w, -30, 30)))
        losses.append((-float(np.mean(np.log(np.where(y[part] == 1, p, 1 - p) + 1e-9))), strength))
    base, w = _lasso(z, y, min(losses)[1])
    return RuleModel(base, tuple(
        Rule(tuple((names[f], above, float(cuts[f][k])) for f, above, k in rule), float(v))
        for rule, v in zip(rules, w) if abs(v) > 1e-4))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> RuleModel:
    """Fit on labelled documents that are not held out, at most ``rows`` labels by the hash of the id.

    Only the documents of the sample are read into statistics.
    """
    known = labels.filter(F.col("quality").isin(0, 1)).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "quality").filter(
        ~held_out(F.col("doc_id"))).dropna().dropDuplicates(["doc_id"])
    total = known.count()
    if total > 2 * rows:
        # the hash that orders the sample also thins it out, so that no task sorts all labels
        share = 1.5 * rows / total
        known = known.filter(F.xxhash64("doc_id") < F.lit(int((share * 2 - 1) * (1 << 63))))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most ``rows`` short rows; rows that repeat a doc_id count once
    wanted = docs.withColumn("doc_id", F.col("doc_id").cast("bigint")).join(
        F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    found = statistics(wanted).select("doc_id", *STATISTICS, F.col("row.quality").alias("quality"))
    sample = found.orderBy("doc_id").collect()
    data = np.array([tuple(r)[1:] for r in sample], float).reshape(len(sample), len(STATISTICS) + 1)
    return fit(data[:, :-1], data[:, -1])


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and row (all columns): one row per row of ``docs``.

    Null and empty texts have statistics of 0 and are scored like any other; without labels of
    both kinds every score is the smoothed share of label 1. One scan, no shuffle.
    """
    score = train(docs.select("doc_id", "text"), labels, rows).score()
    return statistics(docs).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), "row").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(scored: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that are predicted 1, with their own columns.

    A filter would be pushed below the statistics and compute them for every rule; the generator
    keeps it above.
    """
    kept = scored.select(F.explode_outer(F.when(F.col("predicted") == 1, F.array("row"))).alias("row"))
    return kept.filter("row IS NOT NULL").select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


@query("op2_quality_classifier")
def op2_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, table(spark, sf_dir, "labels")).drop("row")
