"""Which isoform a spectrum speaks for: binomial scores at growing peak depth, and what tells isoforms apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.functions import score
from massloom.operators import select
from massloom.operators.spectrum import times

# Weights of the peak depths 1 to 10.
DEPTH_WEIGHTS = (0.5, 0.75, 1.0, 1.0, 1.0, 1.0, 0.75, 0.5, 0.25, 0.25)
PAIR = ["scan", "structure"]


def window_ranks(peaks: DataFrame, width: float = 100.0, ties: list[str] | None = None) -> DataFrame:
    """Peaks (scan, mass, intensity) with ``depth``, their rank by intensity in their window of mass."""
    window = Window.partitionBy("scan", F.floor(F.col("mass") / width)).orderBy(F.col("intensity").desc(), "mass", *(ties or []))
    return peaks.withColumn("depth", F.row_number().over(window))


def depth_scores(matches: DataFrame, theoretical: DataFrame, width: float = 100.0) -> DataFrame:
    """(scan, structure, depth, score) for depths 1 to 10: -10 log10 of the chance of as many matches among peaks of at most this depth.

    ``matches`` holds scan, structure and the peak's depth, with copies where fragments are folded,
    ``theoretical`` the number of fragments of each structure as n.
    """
    n = times(matches).cast("long")
    sums = matches.groupBy(*PAIR).agg(*(F.sum(F.when(F.col("depth") <= i, n).otherwise(0)).alias(f"k{i}") for i in range(1, 11))).join(theoretical, "structure")
    rows = F.array(*(F.struct(F.lit(i).alias("depth"), F.least(F.col(f"k{i}"), F.col("n")).cast("int").alias("k")) for i in range(1, 11)))
    counts = sums.select(*PAIR, F.col("n").cast("int").alias("n"), F.explode(rows).alias("d")).select(*PAIR, "n", "d.depth", "d.k")
    chance = score.upper_tail(F.col("n"), F.col("k"), F.col("depth") / width)
    own = F.when(F.col("k") == 0, F.lit(0.0)).otherwise(-10 * F.log10(F.greatest(chance, F.lit(1e-300))))
    keys = ["n", "depth", "k"]  # many pairs have equal counts, so each chance is summed once
    chances = counts.select(*keys).distinct().select(*keys, own.alias("score"))
    return counts.join(chances, keys).select(*PAIR, "depth", "score")


def weighted_scores(scores: DataFrame) -> DataFrame:
    """(scan, structure, score): the scores of all depths, weighted, over ten."""
    weights = F.array(*(F.lit(w) for w in DEPTH_WEIGHTS))
    return scores.groupBy(*PAIR).agg((F.sum(F.col("score") * F.element_at(weights, F.col("depth"))) / 10).alias("score"))


def told_apart(scores: DataFrame) -> DataFrame:
    """(scan, best, second, depth, difference): of each scan its two best isoforms, and the depth at which they differ most; null without a second."""
    order = [F.col("score").desc(), F.col("structure").asc()]
    ranked = select.ranked(weighted_scores(scores), ["scan"], order, "nth").filter("nth <= 2")
    pair = ranked.groupBy("scan").agg(F.max(F.when(F.col("nth") == 1, F.col("structure"))).alias("best"), F.max(F.when(F.col("nth") == 2, F.col("structure"))).alias("second"))
    side = lambda name: scores.select("scan", F.col("structure").alias(name), "depth", F.col("score").alias(f"s_{name}"))
    rows = pair.join(side("best"), ["scan", "best"]).join(side("second"), ["scan", "second", "depth"], "left")
    top = F.max(F.struct((F.col("s_best") - F.col("s_second")).alias("difference"), (-F.col("depth")).alias("neg"))).alias("t")
    found = rows.groupBy("scan", "best", "second").agg(top)
    return found.select("scan", "best", "second", F.when(F.col("second").isNotNull(), -F.col("t.neg")).alias("depth"), F.col("t.difference").alias("difference"))


def isotopic_fit(observed: Column, expected: Column) -> Column:
    """How far an envelope of intensities departs from the expected one: twice the sum of o ln(o / e) over shares, 0 where they agree."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v)
    o, e = F.transform(observed, lambda v: v / total(observed)), F.transform(expected, lambda v: v / total(expected))
    return F.aggregate(F.zip_with(o, e, lambda a, b: F.when((a > 0) & (b > 0), 2 * a * F.log(a / b)).otherwise(F.lit(0.0))), F.lit(0.0), lambda t, v: t + v)


def isotopic_scores(envelopes: DataFrame, keys: list[str], observed: str, expected: str, intensity: str, least: float = 1e-6) -> DataFrame:
    """keys and score: 1 less the fits of a feature's envelopes, averaged by intensity, never below ``least``."""
    misfit = isotopic_fit(F.col(observed), F.col(expected))
    sums = envelopes.groupBy(*keys).agg((F.sum(misfit * F.col(intensity)) / F.sum(intensity)).alias("misfit"))
    return sums.select(*keys, F.greatest(1 - F.col("misfit"), F.lit(least)).alias("score"))
