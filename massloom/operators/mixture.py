"""One-dimensional mixtures, fitted on a histogram of bounded size.

Rows are counted into at most ``bins`` bins in parallel; expectation-maximisation then runs over
the bins, so its cost does not depend on the number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: str, bins: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(centres, counts) of equally wide bins between the least and the largest value."""
    low, high = df.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    if low is None:
        return np.zeros(0), np.zeros(0)
    width = (high - low) / bins or 1.0
    slot = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1))
    rows = df.filter(F.col(value).isNotNull()).groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).collect()  # ``bins`` rows at most
    rows.sort(key=lambda r: r["slot"])
    return np.array([low + (r["slot"] + 0.5) * width for r in rows]), np.array([float(r["n"]) for r in rows])


@dataclass
class GaussianMixture:
    weights: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    log_likelihood: float
    bic: float

    def density(self, x: Column) -> Column:
        out = F.lit(0.0)
        for w, m, s in zip(self.weights, self.means, self.deviations, strict=True):
            out = out + F.exp(-F.pow((x - float(m)) / float(s), F.lit(2.0)) / 2) * float(w / (s * math.sqrt(2 * math.pi)))
        return out


def fit_gaussians(x: np.ndarray, n: np.ndarray, components: int, rounds: int = 200) -> GaussianMixture:
    """EM from quantiles as means; the start and so the result are the same at every run."""
    total = n.sum()
    at = np.searchsorted(np.cumsum(n) / total, (np.arange(components) + 0.5) / components)
    means = x[np.minimum(at, len(x) - 1)].astype(float)
    spread = math.sqrt(max(np.average((x - np.average(x, weights=n)) ** 2, weights=n), 1e-12))
    deviations, weights = np.full(components, max(spread / components, 1e-6)), np.full(components, 1 / components)
    before = -math.inf
    for _ in range(rounds):
        parts = weights * np.exp(-0.5 * ((x[:, None] - means) / deviations) ** 2) / (deviations * math.sqrt(2 * math.pi)) + 1e-300
        sums = parts.sum(axis=1)
        after = float((n * np.log(sums)).sum())
        share = parts / sums[:, None] * n[:, None]
        mass = share.sum(axis=0) + 1e-12
        means = (share * x[:, None]).sum(axis=0) / mass
        deviations = np.sqrt(np.maximum((share * (x[:, None] - means) ** 2).sum(axis=0) / mass, (1e-3 * spread + 1e-9) ** 2))
        weights = mass / mass.sum()
        if after - before < 1e-8 * abs(after):
            break
        before = after
    order = np.argsort(means)
    return GaussianMixture(weights[order], means[order], deviations[order], after, -2 * after + (3 * components - 1) * math.log(max(total, 2)))


def best_gaussians(x: np.ndarray, n: np.ndarray, most: int = 5) -> GaussianMixture:
    """The number of components with the least BIC."""
    return min((fit_gaussians(x, n, k) for k in range(1, min(most, len(x)) + 1)), key=lambda m: m.bic)


@dataclass
class GammaMixture:
    weights: np.ndarray
    shapes: np.ndarray
    scales: np.ndarray

    def density(self, x: Column) -> Column:
        out = F.lit(0.0)
        for w, k, s in zip(self.weights, self.shapes, self.scales, strict=True):
            out = out + F.exp((float(k) - 1) * F.log(x) - x / float(s) - float(math.lgamma(k) + k * math.log(s))) * float(w)
        return F.when(x > 0, out).otherwise(F.lit(0.0))


def fit_gammas(x: np.ndarray, n: np.ndarray, components: int, rounds: int = 100) -> GammaMixture:
    """EM with moments in the maximisation step."""
    x, n = x[x > 0], n[x > 0]
    start = fit_gaussians(x, n, components)
    means, deviations, weights = np.maximum(start.means, 1e-6), start.deviations, start.weights
    for _ in range(rounds):
        shapes, scales = np.maximum((means / deviations) ** 2, 1e-3), deviations**2 / means
        logs = (shapes - 1) * np.log(x[:, None]) - x[:, None] / scales - np.array([math.lgamma(k) for k in shapes]) - shapes * np.log(scales)
        parts = weights * np.exp(np.clip(logs, -700, 50)) + 1e-300
        share = parts / parts.sum(axis=1)[:, None] * n[:, None]
        mass = share.sum(axis=0) + 1e-12
        new = np.maximum((share * x[:, None]).sum(axis=0) / mass, 1e-6)
        deviations = np.sqrt(np.maximum((share * (x[:, None] - new) ** 2).sum(axis=0) / mass, 1e-12))
        weights = mass / mass.sum()
        if np.allclose(new, means, rtol=1e-8):
            break
        means = new
    return GammaMixture(weights, shapes, scales)


def posterior_error(targets: DataFrame, decoys: DataFrame, score: str, most: int = 5) -> DataFrame:
    """``targets`` with ``pep``: the decoys' mixture density over the sum of both, the decoys weighted by their number."""
    decoy = best_gaussians(*histogram(decoys, score), most)
    target = best_gaussians(*histogram(targets, score), most)
    ratio = decoys.count() / max(1, targets.count())
    s = F.col(score).cast("double")
    d = decoy.density(s) * min(ratio, 1.0)
    return targets.withColumn("pep", F.least(F.lit(1.0), d / (target.density(s) + 1e-300)))


def k_means(x: np.ndarray, n: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Centres of weighted values on a line, from quantiles."""
    centres = x[np.minimum(np.searchsorted(np.cumsum(n) / n.sum(), (np.arange(k) + 0.5) / k), len(x) - 1)].astype(float)
    for _ in range(rounds):
        near = np.abs(x[:, None] - centres).argmin(axis=1)
        new = np.array([np.average(x[near == i], weights=n[near == i]) if (near == i).any() else centres[i] for i in range(k)])
        if np.array_equal(new, centres):
            break
        centres = new
    return np.sort(centres)


def truncated_density(mixture: GaussianMixture, x: Column) -> Column:
    """A Gaussian mixture cut at zero, each component scaled to what lies above."""
    out = F.lit(0.0)
    for w, m, s in zip(mixture.weights, mixture.means, mixture.deviations, strict=True):
        above = 0.5 * math.erfc(-float(m) / (float(s) * math.sqrt(2)))
        out = out + F.exp(-F.pow((x - float(m)) / float(s), F.lit(2.0)) / 2) * float(w / (s * math.sqrt(2 * math.pi)) / above)
    return F.when(x >= 0, out).otherwise(F.lit(0.0))


def given_gaussians(weights: list[float], means: list[float], deviations: list[float]) -> GaussianMixture:
    """A mixture of known components."""
    return GaussianMixture(np.array(weights), np.array(means), np.array(deviations), 0.0, 0.0)


def fit_with_prior(x: np.ndarray, n: np.ndarray, prior: np.ndarray, components: int, rounds: int = 200) -> tuple[GaussianMixture, float]:
    """Gaussians beside one fixed component, whose density at ``x`` is ``prior``: the Gaussians with their weights, and the weight of the fixed one."""
    start = fit_gaussians(x, n, components)
    weights, means, deviations = np.append(start.weights / 2, 0.5), start.means.copy(), start.deviations.copy()
    for _ in range(rounds):
        parts = np.exp(-(((x[:, None] - means) / deviations) ** 2) / 2) / (deviations * math.sqrt(2 * math.pi))
        parts = weights * np.hstack([parts, prior[:, None]]) + 1e-300
        share = parts / parts.sum(axis=1)[:, None] * n[:, None]
        mass = share.sum(axis=0) + 1e-12
        new = (share[:, :-1] * x[:, None]).sum(axis=0) / mass[:-1]
        deviations = np.sqrt(np.maximum((share[:, :-1] * (x[:, None] - new) ** 2).sum(axis=0) / mass[:-1], 1e-6))
        weights = mass / mass.sum()
        if np.allclose(new, means, rtol=1e-9, atol=1e-12):
            break
        means = new
    return GaussianMixture(weights[:-1], means, deviations, 0.0, 0.0), float(weights[-1])


def responsibilities(mixture: GaussianMixture, x: Column) -> Column:
    """Each component's share of the density, as an array."""
    parts = [F.exp(-F.pow((x - float(m)) / float(s), F.lit(2.0)) / 2) * float(w / (s * math.sqrt(2 * math.pi))) for w, m, s in zip(mixture.weights, mixture.means, mixture.deviations, strict=True)]
    total = sum(parts, F.lit(0.0))
    return F.array(*(p / total for p in parts))
