"""Scores learned from targets and decoys: a linear model refitted on its own best targets, and two-class densities on a grid."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.operators import fdr
from massloom.session import Scratch


def _linear(weights: np.ndarray, x: list[Column]) -> Column:
    """Weights times columns; the last weight is the intercept."""
    total = F.lit(float(weights[-1]))
    for w, c in zip(weights, x, strict=False):
        total = total + c * float(w)
    return total


def fit_margin(df: DataFrame, features: list[str], label: str, cost: float = 1.0, steps: int = 30, tolerance: float = 1e-6) -> np.ndarray:
    """Weights and intercept of the linear support vector machine with squared hinge loss, by Newton's method.

    Minimises half the squared weights plus ``cost`` times the mean squared hinge; ``label`` is 1 or
    -1. Each step is one pass that sums the loss and the normal equations of the rows inside the
    margin: a number of sums that grows with the features' square, not with the rows. A step that
    does not lower the value is halved. The intercept is not shrunk. Null features make a row void.
    """
    k = len(features)
    x = [F.col(c).cast("double") for c in features]
    y = F.col(label).cast("double")
    rows = df.dropna(subset=[*features, label])
    parts = [*x, F.lit(1.0)]
    shrink = np.diag([1.0] * k + [0.0])
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        """The value at ``w`` and where Newton's method goes from there."""
        slack = F.greatest(F.lit(0.0), 1 - y * _linear(w, x))
        inside = (slack > 0).cast("double")
        sums = [F.count("*"), F.sum(slack * slack), *(F.sum(inside * parts[i] * parts[j]) for i, j in pairs), *(F.sum(inside * y * p) for p in parts)]
        n, loss, *found = rows.agg(*(c.alias(f"c{i}") for i, c in enumerate(sums))).first()
        if not n:
            return 0.0, w
        gram = np.zeros((k + 1, k + 1))
        for (i, j), value in zip(pairs, found, strict=False):
            gram[i, j] = gram[j, i] = value
        target = np.array(found[len(pairs) :])
        return w[:k] @ w[:k] / 2 + cost / n * loss, np.linalg.lstsq(shrink + 2 * cost / n * gram, 2 * cost / n * target, rcond=None)[0]

    weights = np.zeros(k + 1)
    value, goal = at(weights)
    for _ in range(steps):
        if np.abs(goal - weights).max() <= tolerance * (1 + np.abs(weights).max()):
            return goal
        step = 1.0
        while True:
            tried = weights + step * (goal - weights)
            new_value, new_goal = at(tried)
            if new_value <= value or step < 1e-3:
                break
            step /= 2
        weights, value, goal = tried, new_value, new_goal
    return weights


def semi_supervised(df: DataFrame, features: list[str], is_decoy: str, start: str, rounds: int = 10, train_fdr: float = 0.01, cost: float = 1.0) -> DataFrame:
    """``df`` with ``svm_score``: the margin of a linear support vector machine of decoys against the targets that pass ``train_fdr``.

    The first targets are those that pass by ``start``; each round takes those that pass by the last
    model's margin, until their number no longer grows. Where fewer than ten pass, the score is
    ``start``. Features are standardised, and both classes weigh as their rows. A model is a handful
    of numbers and its score a column; rows with a null feature have a null score once a model is
    fitted.
    """
    scratch = Scratch(df.sparkSession, "rescoring")
    moments = df.agg(*(f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.mean), ("s", F.stddev_samp)))).first()
    names = [f"__x{i}" for i in range(len(features))]
    scaled = {x: (F.col(c).cast("double") - (moments[f"m{i}"] or 0.0)) / (moments[f"s{i}"] or 1.0) for i, (x, c) in enumerate(zip(names, features, strict=True))}
    rows = scratch.keep(df.withColumns(scaled).withColumn("svm_score", F.col(start).cast("double")), "start")
    decoy, best, passed = F.col(is_decoy), None, 0
    for _ in range(rounds):
        scored = rows if best is None else rows.withColumn("svm_score", _linear(best, [F.col(x) for x in names]))
        rates = fdr.q_values(scored.filter("svm_score IS NOT NULL"), "svm_score", decoy)
        least = rates.filter(F.col("q_value") <= train_fdr).agg(F.min("score")).first()[0]
        if least is None:
            break
        train = scratch.keep(scored.filter(decoy | (F.col("svm_score") >= least)).select(*names, F.when(decoy, -1.0).otherwise(1.0).alias("__y")), "train")
        n = train.filter("__y > 0").count()
        if n < 10 or n <= passed:
            break
        passed, best = n, fit_margin(train, names, "__y", cost)
        scratch.drop(train)
    out = rows if best is None else rows.withColumn("svm_score", _linear(best, [F.col(x) for x in names]))
    return out.drop(*names)


def two_class_density(df: DataFrame, value: str, positive: str, grid: int = 512, rounds: int = 10, bandwidth: float | None = None) -> DataFrame:
    """``df`` with ``posterior``, the probability that a value belongs to the positive class.

    ``positive`` is a first guess between 0 and 1. Both classes' densities are kernel estimates on a
    grid of weighted counts, which is all that reaches the driver; guesses and densities are updated
    until the share of positives changes by less than 0.001. Null values get no posterior.
    """
    x = F.col(value).cast("double")
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None:
        return df.withColumn("posterior", F.lit(None).cast("double"))
    width = (high - low) / grid or 1.0
    slot = F.least(F.floor((x - low) / width), F.lit(grid - 1)).cast("int")
    cells = df.filter(x.isNotNull()).groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.sum(positive).alias("p")).collect()  # ``grid`` rows at most
    n, p = np.zeros(grid), np.zeros(grid)
    for r in cells:
        n[r["slot"]], p[r["slot"]] = r["n"], r["p"]
    at = low + (np.arange(grid) + 0.5) * width
    spread = np.sqrt(np.average((at - np.average(at, weights=n)) ** 2, weights=n))
    h = bandwidth or max(1.06 * spread * n.sum() ** -0.2, width)
    kernel = np.exp(-(((at[:, None] - at) / h) ** 2) / 2)
    share = np.divide(p, n, out=np.zeros(grid), where=n > 0)
    prior = p.sum() / n.sum()
    for _ in range(rounds):
        good, bad = kernel @ (n * share), kernel @ (n * (1 - share))
        good, bad = good / max(good.sum(), 1e-300), bad / max(bad.sum(), 1e-300)
        share = prior * good / np.maximum(prior * good + (1 - prior) * bad, 1e-300)
        new = float((n * share).sum() / n.sum())
        done, prior = abs(new - prior) < 1e-3, new
        if done:
            break
    return df.withColumn("posterior", F.when(x.isNotNull(), F.element_at(F.array(*map(F.lit, share.tolist())), slot + 1)))
