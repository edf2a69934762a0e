"""Two classes told apart by kernel densities of several scores, with decoys as known members of the false class."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_CELLS = 2_000_000


@dataclass
class ProductKernels:
    """For each score a grid with the densities of either class; ``prior`` is the share of the true class among targets."""

    values: list[str]
    lows: list[float]
    steps: list[float]
    true: list[np.ndarray]
    false: list[np.ndarray]
    prior: float

    def posterior(self) -> Column:
        """The probability that a row's scores come from the true class; null if a score is null; beyond a grid its end counts."""
        odds = F.lit(float(np.log(max(self.prior, 1e-300)) - np.log(max(1 - self.prior, 1e-300))))
        for value, low, step, good, bad in zip(self.values, self.lows, self.steps, self.true, self.false, strict=True):
            ratio = np.log(np.maximum(good, 1e-300)) - np.log(np.maximum(bad, 1e-300))
            slot = F.greatest(F.lit(0), F.least(F.floor((F.col(value) - low) / step), F.lit(len(ratio) - 1))).cast("int")
            odds = odds + F.when(F.col(value).isNotNull(), F.element_at(F.array(*map(F.lit, ratio.tolist())), slot + 1))
        return 1 / (1 + F.exp(-odds))


def fit_kernels(cells: np.ndarray, targets: np.ndarray, decoys: np.ndarray, first: np.ndarray, lows: list[float], steps: list[float], values: list[str], grid: int, rounds: int, tolerance: float) -> ProductKernels:
    """Expectation maximisation over joint cells (a row of slots each) with so many targets and decoys and first guesses for the targets.

    Each score's density of a class is a Gaussian kernel estimate over the class's weights in its
    slots, the classes' scores taken as independent; bandwidths follow Scott's rule of the weights.
    Decoys belong to the false class whatever their scores.
    """
    d = len(values)
    share, prior = first.astype(float), 0.5
    good, bad = [], []
    for _ in range(rounds):
        good, bad = [], []
        for j in range(d):
            at = np.arange(grid)
            for weights, out in ((targets * share, good), (targets * (1 - share) + decoys, bad)):
                mass = np.bincount(cells[:, j], weights, grid)
                total = max(mass.sum(), 1e-300)
                mean = (mass * at).sum() / total
                spread = np.sqrt(max((mass * (at - mean) ** 2).sum() / total, 1e-12))
                h = max(spread * max(total, 1.0) ** (-1 / 5), 0.5)
                density = np.exp(-(((at[:, None] - at) / h) ** 2) / 2) @ mass
                out.append(density / max(density.sum(), 1e-300))
        new = float((targets * share).sum() / max(targets.sum(), 1e-300))
        odds = np.full(len(cells), np.log(max(new, 1e-300)) - np.log(max(1 - new, 1e-300)))
        for j in range(d):
            odds += (np.log(np.maximum(good[j], 1e-300)) - np.log(np.maximum(bad[j], 1e-300)))[cells[:, j]]
        share = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        done, prior = abs(new - prior) < tolerance, new
        if done:
            break
    return ProductKernels(values, lows, steps, good, bad, prior)


def product_kernels(df: DataFrame, values: list[str], is_decoy: Column, first: Column, grid: int = 64, rounds: int = 50, tolerance: float = 1e-4) -> ProductKernels | None:
    """The densities of two classes over several scores; ``first`` is a first guess between 0 and 1 of each target.

    Rows are counted into the cells of a joint grid, ``grid`` slots a score, whose number is checked;
    only counts reach the driver. Rows with a null score do not count. None if there is no row.
    """
    if grid ** len(values) > MOST_CELLS:
        raise ValueError(f"{grid} slots for each of {len(values)} scores are more than {MOST_CELLS} cells")
    rows = df.dropna(subset=values)
    ends = rows.agg(*(f(F.col(v).cast("double")).alias(f"{n}{i}") for i, v in enumerate(values) for n, f in (("low", F.min), ("high", F.max)))).first()
    if ends["low0"] is None:
        return None
    lows = [ends[f"low{i}"] for i in range(len(values))]
    steps = [(ends[f"high{i}"] - low) / grid or 1.0 for i, low in enumerate(lows)]
    slots = [F.least(F.floor((F.col(v) - low) / step), F.lit(grid - 1)).cast("int").alias(f"s{i}") for i, (v, low, step) in enumerate(zip(values, lows, steps, strict=True))]
    decoy = is_decoy.cast("int")
    counts = rows.groupBy(*slots).agg(F.sum(1 - decoy).alias("targets"), F.sum(decoy).alias("decoys"), F.sum(first * (1 - decoy)).alias("first")).orderBy(*(f"s{i}" for i in range(len(values)))).collect()
    cells = np.array([[r[f"s{i}"] for i in range(len(values))] for r in counts])
    targets, decoys = (np.array([r[c] for r in counts], float) for c in ("targets", "decoys"))
    guess = np.divide([r["first"] for r in counts], targets, out=np.zeros(len(counts)), where=targets > 0)
    return fit_kernels(cells, targets, decoys, guess, lows, steps, values, grid, rounds, tolerance)
