"""Error rates from targets and decoys.

Scores are counted before anything is ordered, and the order over distinct scores runs in cells
(see ``ordered``), so no task sees all of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.operators.ordered import running
from massloom.session import Scratch


def score_counts(df: DataFrame, score: str, is_decoy: Column, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Targets and decoys at each distinct score; a row counts ``weight`` times."""
    n = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    return df.groupBy(*(keys or []), F.col(score).alias("score")).agg(
        F.sum((~is_decoy).cast("long") * n).alias("targets_here"), F.sum(is_decoy.cast("long") * n).alias("decoys_here")
    )


def _rate(target_weight: float, correction: float) -> Column:
    return F.when(F.col("targets") == 0, F.lit(1.0)).otherwise((F.col("decoys") + correction) / (F.col("targets") * target_weight))


def q_values(df: DataFrame, score: str, is_decoy: Column, target_weight: float = 1.0, correction: float = 0.0, weight: str | None = None) -> DataFrame:
    """score, targets, decoys (at or above it), fdr and q_value of each distinct score."""
    scratch = Scratch(df.sparkSession, "rates")  # the bounds of cells are looked up first; the search is not run again for them
    counts = scratch.keep(score_counts(df, score, is_decoy, weight=weight), "counts")
    counts = running(counts, "score", {"targets": ("sum", "targets_here"), "decoys": ("sum", "decoys_here")}, descending=True)
    rates = scratch.keep(counts.select("score", "targets", "decoys", _rate(target_weight, correction).alias("fdr")), "rates")
    return running(rates, "score", {"q_value": ("min", "fdr")})


def grouped_q_values(df: DataFrame, score: str, is_decoy: Column, keys: list[str], target_weight: float = 1.0, correction: float = 0.0) -> DataFrame:
    """As ``q_values`` inside each group; groups run in cells too, so one may hold most rows."""
    scratch = Scratch(df.sparkSession, "rates")
    counts = scratch.keep(score_counts(df, score, is_decoy, keys), "counts")
    counts = running(counts, "score", {"targets": ("sum", "targets_here"), "decoys": ("sum", "decoys_here")}, descending=True, within=keys)
    rates = scratch.keep(counts.select(*keys, "score", "targets", "decoys", _rate(target_weight, correction).alias("fdr")), "rates")
    return running(rates, "score", {"q_value": ("min", "fdr")}, within=keys)


def expected_false(targets: Column, decoys: Column, ratio: float = 1.0) -> Column:
    """The expected number of false ones among ``targets`` where ``decoys`` were seen; the target space is ``ratio`` times the decoy space.

    A negative binomial cut at the number of targets. Its terms come from one another; beyond forty
    standard deviations above the mean they add nothing that a double holds, so no more are made.
    """
    p = 1.0 / (1.0 + ratio)
    mean = (decoys + 1) * (p / (1 - p))
    last = F.least(targets.cast("double"), F.ceil(mean + 40 * F.sqrt(mean / (1 - p)) + 100)).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"), F.lit(0.0).alias("weighted"))

    def further(state: Column, m: Column) -> Column:
        term = state["term"] * (p * (m + decoys) / m)
        total, weighted = state["sum"] + term, state["weighted"] + term * m
        scale = F.when(total > 1e200, F.lit(1e-200)).otherwise(F.lit(1.0))
        return F.struct((term * scale).cast("double").alias("term"), (total * scale).cast("double").alias("sum"), (weighted * scale).cast("double").alias("weighted"))

    terms = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(terms, start, further, lambda s: s["weighted"] / s["sum"])


def _share(part: Column, rest: Column) -> Column:
    """``part`` of both; NaN where a score lies so far out that both are 0."""
    return F.when(part + rest == 0, F.lit(math.nan)).otherwise(F.try_divide(part, part + rest))


def separated_pep(decoy: Column, target: Column, prior: float) -> Column:
    """Error probability from separately fitted densities; ``prior`` is the number of decoys over that of targets."""
    return _share(prior * decoy, (1 - prior) * target)


def component_pep(prior_part: Column, own: Column) -> Column:
    """Error probability where decoys are one part of the target mixture: its weighted density over that of all parts."""
    return _share(prior_part, own)


def product_pep(prior: float, decoys: list[Column], targets: list[Column]) -> Column:
    """Error probability from the product of likelihoods of several scores."""
    bad, good = F.lit(prior), F.lit(1 - prior)
    for d, t in zip(decoys, targets, strict=True):
        bad, good = bad * d, good * t
    return _share(bad, good)


def retain_by_q(df: DataFrame, q_value: str, threshold: float) -> DataFrame:
    return df.filter(F.col(q_value) < threshold)


def pep_to_fdr(df: DataFrame, score: str, pep: str) -> DataFrame:
    """Mean error probability of all rows at or above each distinct score, made monotone."""
    sums = df.groupBy(F.col(score).alias("score")).agg(F.sum(pep).alias("pep_here"), F.count("*").alias("n_here"))
    scratch = Scratch(df.sparkSession, "rates")
    down = running(scratch.keep(sums, "sums"), "score", {"pep_sum": ("sum", "pep_here"), "n": ("sum", "n_here")}, descending=True)
    rates = scratch.keep(down.select("score", "n", (F.col("pep_sum") / F.col("n")).alias("mean_pep")), "rates")
    return running(rates, "score", {"fdr": ("min", "mean_pep")})


def joint_fdr(peptide: Column, glycan: Column, both: Column) -> Column:
    """max(peptide, glycan, peptide + glycan - both), within 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(peptide, glycan, peptide + glycan - both))


def threshold_counts(df: DataFrame, score: str, thresholds: list[float]) -> DataFrame:
    """Rows at or above each threshold, in one pass without ordering."""
    sums = [F.sum((F.col(score) >= t).cast("long")).alias(f"t{i}") for i, t in enumerate(thresholds)]
    row = df.agg(*sums)
    pairs = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.coalesce(F.col(f"t{i}"), F.lit(0)).alias("n")) for i, t in enumerate(thresholds)))
    return row.select(F.explode(pairs).alias("p")).select("p.threshold", "p.n")
