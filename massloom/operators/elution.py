"""Retention times: regressions within groups, robust lines, relative shifts, recalibration and revision of annotations."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.operators import fdr, ordered
from massloom.operators.regress import LinearModel


@dataclass
class WithinModel:
    """Slopes that all groups share, and a table (group columns, intercept) of what each group adds."""

    names: list[str]
    slopes: np.ndarray
    intercepts: DataFrame
    groups: list[str]

    def predict(self, rows: DataFrame, columns: dict[str, Column], name: str = "predicted") -> DataFrame:
        """``rows`` with the predicted time; null for groups the model does not know."""
        value = F.col("intercept")
        for column, slope in zip(self.names, self.slopes, strict=True):
            value = value + columns[column] * float(slope)
        return rows.join(self.intercepts, self.groups, "left").withColumn(name, value).drop("intercept")


def fit_within(df: DataFrame, groups: list[str], columns: dict[str, Column], y: Column, weight: Column | None = None, penalty: float = 0.0) -> WithinModel:
    """Weighted least squares with an intercept for each group (peptide, run, or both) and common slopes.

    Sums are taken for each group, centred there and added up; one row of them reaches the driver,
    however many groups there are.
    """
    names = list(columns)
    w = weight if weight is not None else F.lit(1.0)
    values = {**{f"x{i}": columns[n].cast("double") for i, n in enumerate(names)}, "y": y.cast("double")}
    rows = df.select(*groups, w.cast("double").alias("w"), *(v.alias(k) for k, v in values.items()))
    keys = list(values)
    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[i:]]
    sums = rows.groupBy(*groups).agg(F.sum("w").alias("w"), *(F.sum(F.col("w") * F.col(k)).alias(k) for k in keys), *(F.sum(F.col("w") * F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs))
    centred = [F.sum(F.col(f"{a}_{b}") - F.col(a) * F.col(b) / F.col("w")).alias(f"{a}_{b}") for a, b in pairs]
    row = sums.filter("w > 0").agg(*centred).first()
    at = lambda a, b: float(row[f"{a}_{b}"] or 0.0)
    k = len(names)
    xx = np.array([[at(f"x{min(i, j)}", f"x{max(i, j)}") for j in range(k)] for i in range(k)])
    xy = np.array([at(f"x{i}", "y") for i in range(k)])
    slopes = np.linalg.pinv(xx + penalty * np.eye(k)) @ xy
    intercept = F.col("y") / F.col("w")
    for i, slope in enumerate(slopes):
        intercept = intercept - F.col(f"x{i}") / F.col("w") * float(slope)
    return WithinModel(names, slopes, sums.filter("w > 0").select(*groups, intercept.alias("intercept")), groups)


def fitted_half_width(model: LinearModel, columns: dict[str, Column], quantile: float) -> Column:
    """Half width of the confidence interval of the fitted value, at ``quantile`` standard errors."""
    terms = [F.lit(1.0), *(columns[n] for n in model.names)]
    spread = F.lit(0.0)
    for i, a in enumerate(terms):
        for j, b in enumerate(terms):
            spread = spread + a * b * float(model.inverse[i, j])
    return quantile * F.sqrt(F.lit(model.residual_variance) * spread)


def robust_line(df: DataFrame, ident: str, x: str, y: str, trials: int = 100, sample: int = 1000, seed: int = 1) -> tuple[float, float]:
    """(intercept, slope) of the line that most points lie near, refitted on these.

    Candidate lines go through random pairs of a sample of at most ``sample`` points, those with the
    smallest hashes; one pass over all points counts who lies within the median absolute deviation
    of each. Equal counts are told apart by the smaller error.
    """
    rows = df.select(F.col(ident).alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    points = [(r["x"], r["y"]) for r in rows.orderBy(F.xxhash64("i"), "i").limit(sample).collect()]
    middle = ordered.exact_percentiles(rows, [], "y", [0.5]).first()["p0"]
    apart = rows.withColumn("d", F.abs(F.col("y") - F.lit(middle)))
    threshold = ordered.exact_percentiles(apart, [], "d", [0.5]).first()["p0"]
    draw = random.Random(seed)
    lines = []
    for _ in range(trials):
        (x0, y0), (x1, y1) = draw.sample(points, 2) if len(points) > 1 else (points[0], points[0])
        if x1 != x0:
            slope = (y1 - y0) / (x1 - x0)
            lines.append((y0 - slope * x0, slope))
    table = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in enumerate(lines)))
    near = rows.withColumn("l", F.explode(table)).withColumn("r", F.abs(F.col("y") - F.col("l.a") - F.col("l.b") * F.col("x"))).filter(F.col("r") < threshold)
    best = near.groupBy("l.n").agg(F.count("*").alias("inliers"), F.sum(F.col("r") * F.col("r")).alias("error")).orderBy(F.desc("inliers"), "error", "n").first()
    if best is None:
        return float(middle), 0.0
    a, b = lines[best["n"]]
    fit = rows.filter(F.abs(F.col("y") - a - b * F.col("x")) < threshold).agg(F.regr_intercept("y", "x").alias("a"), F.regr_slope("y", "x").alias("b")).first()
    return fit["a"], fit["b"]


def relative_shifts(df: DataFrame, group: str, counts: list[str], time: str, weight: Column) -> DataFrame:
    """(residue, shift, pairs): how much later a feature of one group is with one residue more, over all such pairs, by weight.

    Partners are found by an equi-join on counts moved by one, so no group's pairs are all made.
    """
    at = lambda move: F.array(*((F.col(c).cast("long") + (1 if c == move else 0)) for c in counts))
    rows = df.withColumn("__w", weight)
    moved = rows.select(F.col(group).alias("g"), F.col(time).alias("t0"), F.col("__w").alias("w0"), F.explode(F.array(*(F.struct(F.lit(c).alias("residue"), at(c).alias("at")) for c in counts))).alias("m"))
    there = rows.select(F.col(group).alias("g"), F.col(time).alias("t1"), F.col("__w").alias("w1"), at(None).alias("at"))
    pairs = moved.select("g", "t0", "w0", "m.residue", "m.at").join(there, ["g", "at"])
    w = F.col("w0") + F.col("w1")
    return pairs.groupBy("residue").agg((F.sum((F.col("t1") - F.col("t0")) * w) / F.sum(w)).alias("shift"), F.count("*").alias("pairs"))


def recalibrated(rows: DataFrame, references: DataFrame, time: str, predicted: str, signal: str, dilation: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """``rows`` with ``delta``: predicted less observed time relative to all reference points, averaged by log signal.

    The difference to a reference is that of the two residuals, so the average needs only the mean
    residual of the references (of equal ``keys``), not all pairs.
    """
    residual = F.col(predicted) * dilation - F.col(time)
    w = F.log10(signal)
    sums = references.groupBy(*(keys or [])).agg((F.sum(residual * w) / F.sum(w)).alias("__mean"))
    joined = rows.join(sums, keys) if keys else rows.crossJoin(F.broadcast(sums))  # one row
    return joined.withColumn("delta", residual - F.col("__mean")).drop("__mean")


def revised(
    df: DataFrame, ident: str, counts: list[str], rules: list[tuple[str, dict[str, int]]], predict: Callable[[dict[str, Column]], Column], score: Callable[[Column], Column],
    known: DataFrame | None = None, threshold: float = 0.2, gain: float = 0.2, apart: float = 0.5, second: str | None = None,
) -> DataFrame:
    """(ident, counts, rule, score): each annotation as it is or as a rule changes it, whichever fits its time better.

    A rule adds counts; it holds where none becomes negative and, if ``known`` lists compositions,
    the result is one of them. It must predict a time more than ``apart`` away, and the best score
    must pass ``threshold`` and gain ``gain``. Among those of more than 0.9 of the best the one with
    the highest ``second`` score stays, the original and then the earlier rule first.
    """
    choices = [("-", {}), *rules]
    made = F.array(*(F.struct(F.lit(n).alias("nth"), F.lit(name).alias("rule"), *((F.col(c) + adds.get(c, 0)).cast("long").alias(c) for c in counts)) for n, (name, adds) in enumerate(choices)))
    original = predict({c: F.col(c).cast("long") for c in counts})
    rows = df.withColumn("__first", original).withColumn("__c", F.explode(made))
    for c in counts:
        rows = rows.filter(F.col(f"__c.{c}") >= 0)
    rows = rows.select(*(c for c in df.columns if c not in counts), "__first", "__c.*")
    if known is not None:
        listed = known.select(*(F.col(c).cast("long").alias(c) for c in counts)).distinct().withColumn("__known", F.lit(True))
        rows = rows.join(listed, counts, "left").filter((F.col("nth") == 0) | F.col("__known"))
    time = predict({c: F.col(c) for c in counts})
    rows = rows.withColumn("score", score(time)).withColumn("__time", time)
    rows = rows.filter((F.col("nth") == 0) | (F.abs(F.col("__time") - F.col("__first")) > apart))
    per = rows.groupBy(ident).agg(F.max("score").alias("__best"), F.max(F.when(F.col("nth") == 0, F.col("score"))).alias("__own"))
    rows = rows.join(per, ident)
    changes = (F.col("__best") > threshold) & (F.col("__best") - F.col("__own") > gain)
    eligible = F.when(changes, F.col("score") > F.col("__best") * 0.9).otherwise(F.col("nth") == 0)
    order = F.struct(F.col(second) if second else F.lit(0.0), (-F.col("nth")).alias("neg"))
    best = F.max_by(F.struct(*counts, "rule", "score"), order).alias("b")
    return rows.filter(eligible).groupBy(ident).agg(best).select(ident, *(f"b.{c}" for c in counts), "b.rule", "b.score")


def shift_can_be_lost(held: Column, lost: str, times: int) -> Column:
    """Whether every shift of a feature (array of map<shift,count>) holds ``times`` of the one a rule takes away."""
    return F.forall(held, lambda m: F.coalesce(F.element_at(m, lost), F.lit(0)) >= times)


def rule_error_rates(targets: DataFrame, decoys: DataFrame, score: str) -> DataFrame:
    """Targets, decoys and q-values by score, where decoys are the same features under an implausible rule; missing scores count as 0."""
    both = targets.select(F.coalesce(score, F.lit(0.0)).alias("score"), F.lit(False).alias("is_decoy")).unionByName(decoys.select(F.coalesce(score, F.lit(0.0)).alias("score"), F.lit(True).alias("is_decoy")))
    return fdr.q_values(both, "score", F.col("is_decoy"))
