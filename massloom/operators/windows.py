"""Retention models of overlapping windows, refitted without what does not follow them, and averaged.

Within a window all groups (peptides) share their slopes and each has its own intercept. Rows are
reduced to sums for each window and group, then to normal equations for each window; only these
reach the driver, and their number is that of the windows, which is checked.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.operators.features import sliding_windows
from massloom.session import Scratch

MOST_WINDOWS = 100_000
EDGE = 1.005  # a window's weight is a little above 0 at its border


@dataclass
class WindowEnsemble:
    names: list[str]
    groups: list[str]
    width: float
    step: float
    slopes: DataFrame  # centre and an array of slopes, one row a window
    intercepts: DataFrame  # centre, group columns and intercept

    def predict(self, rows: DataFrame, ident: list[str], columns: dict[str, Column], at: str) -> DataFrame:
        """(ident..., predicted, models): the mean of all windows that hold a row and know its group, by nearness to their centres; null where none does."""
        x = F.array(*(columns[n].cast("double") for n in self.names))
        placed = sliding_windows(rows.select(*ident, *self.groups, at, x.alias("__x")), at, self.width, self.step)
        known = placed.join(F.broadcast(self.slopes), "centre").join(self.intercepts, ["centre", *self.groups])  # a row a window, checked when fitted
        value = F.aggregate(F.zip_with("__x", "slopes", lambda a, b: a * b), F.col("intercept"), lambda t, v: t + v)
        near = 1 - F.abs(F.col(at) - F.col("centre")) / (self.width / 2 * EDGE)
        sums = known.groupBy(*ident).agg((F.sum(value * near) / F.sum(near)).alias("predicted"), F.count("*").alias("models"))
        return rows.select(*ident).join(sums, ident, "left").withColumn("models", F.coalesce("models", F.lit(0)))


def fit_windows(df: DataFrame, groups: list[str], columns: dict[str, Column], y: Column, at: str, width: float, step: float, weight: Column | None = None, penalty: float = 0.0) -> WindowEnsemble:
    """A model for each window of ``width`` around multiples of ``step``: weighted least squares with an intercept for each group; ``penalty`` shrinks the slopes."""
    names = list(columns)
    k = len(names)
    w = (weight if weight is not None else F.lit(1.0)).cast("double")
    values = {**{f"x{i}": columns[n].cast("double") for i, n in enumerate(names)}, "y": y.cast("double")}
    rows = df.select(*groups, at, w.alias("w"), *(v.alias(c) for c, v in values.items())).dropna().filter("w > 0")
    keys = list(values)
    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[i:]]
    scratch = Scratch(df.sparkSession, "windows")
    placed = sliding_windows(rows, at, width, step)
    sums = placed.groupBy("centre", *groups).agg(F.sum("w").alias("w"), *(F.sum(F.col("w") * F.col(c)).alias(c) for c in keys), *(F.sum(F.col("w") * F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs))
    sums = scratch.keep(sums, "sums")
    centred = sums.groupBy("centre").agg(*(F.sum(F.col(f"{a}_{b}") - F.col(a) * F.col(b) / F.col("w")).alias(f"{a}_{b}") for a, b in pairs))
    found = centred.limit(MOST_WINDOWS + 1).collect()
    if len(found) > MOST_WINDOWS:
        raise ValueError(f"more than {MOST_WINDOWS} windows; choose a larger step")
    models = []
    for r in found:
        xx = np.array([[r[f"x{min(i, j)}_x{max(i, j)}"] for j in range(k)] for i in range(k)])
        xy = np.array([r[f"x{i}_y"] for i in range(k)])
        models.append((float(r["centre"]), (np.linalg.pinv(xx + penalty * np.eye(k)) @ xy).tolist()))
    slopes = df.sparkSession.createDataFrame(models, "centre double, slopes array<double>")
    intercept = F.col("y") / F.col("w")
    for i in range(k):
        intercept = intercept - F.col("slopes")[i] * F.col(f"x{i}") / F.col("w")
    intercepts = sums.join(F.broadcast(slopes), "centre").select("centre", *groups, intercept.alias("intercept"))
    return WindowEnsemble(names, groups, width, step, slopes, scratch.keep(intercepts, "intercepts"))


def refitted(
    df: DataFrame, ident: list[str], groups: list[str], columns: dict[str, Column], y: Column, at: str, width: float, step: float,
    weight: Column | None = None, penalty: float = 0.0, cutoff: float = 3.0, least_weight: float = 0.0, rounds: int = 10,
) -> tuple[WindowEnsemble, DataFrame]:
    """The ensemble after rounds of fit, reweighting and refit, and (ident..., predicted, models, residual, factor, covered) of every row.

    A row is covered if its residual is within ``cutoff`` times the root of the weighted mean square
    of all residuals. Covered rows keep their weight in the next fit, the others get
    ``least_weight`` of it, so that they cost nothing at 0 and still pull a little above it. Rounds
    end when the covered rows stay the same. Rows whose group no window knows are not covered.
    """
    scratch = Scratch(df.sparkSession, "refitted")
    w = (weight if weight is not None else F.lit(1.0)).cast("double")
    rows = scratch.keep(df.withColumn("__y", y.cast("double")).withColumn("__w", w).withColumn("__factor", F.lit(1.0)), "rows")
    before = None
    for n in range(rounds):
        model = fit_windows(rows, groups, columns, F.col("__y"), at, width, step, F.col("__w") * F.col("__factor"), penalty)
        judged = rows.join(model.predict(rows, ident, columns, at), ident).withColumn("__residual", F.col("__y") - F.col("predicted"))
        square = F.col("__w") * F.col("__factor")
        judged = scratch.keep(judged, "judged")
        scale = judged.filter("__residual IS NOT NULL").agg(F.sqrt(F.sum(square * F.col("__residual") * F.col("__residual")) / F.sum(square))).first()[0]
        covered = F.coalesce(F.abs("__residual") <= (scale or 0.0) * cutoff, F.lit(False))
        judged = judged.withColumn("__covered", covered)
        state = tuple(judged.filter("__covered").agg(F.count("*"), F.sum(F.xxhash64(*ident).cast("decimal(38,0)"))).first())
        out = judged.select(*ident, "predicted", "models", F.col("__residual").alias("residual"), F.col("__factor").alias("factor"), F.col("__covered").alias("covered"))
        if state == before or n == rounds - 1:
            break
        before = state
        rows = scratch.keep(judged.withColumn("__factor", F.when(F.col("__covered"), 1.0).otherwise(float(least_weight))).select(*rows.columns), "rows")
    return model, out
