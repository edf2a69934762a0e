"""Scores of discrete states by neighbourhoods of mass, and scores chosen by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-6


def neighbourhood(mass: Column, width: float = 100.0) -> Column:
    """The upper end of a mass's neighbourhood, which is ten widths wide."""
    return (F.floor(mass / width / 10) + 1) * (10 * width)


def fit_states(df: DataFrame, mass: Column, state: str, weight: Column | None = None, width: float = 100.0) -> DataFrame:
    """(neighbourhood, state, frequency): how often, or with how much of the weight, each state is seen there."""
    w = weight if weight is not None else F.lit(1.0)
    cells = df.groupBy(neighbourhood(mass, width).alias("neighbourhood"), F.col(state).alias("state")).agg(F.sum(w).alias("w"))
    total = cells.groupBy("neighbourhood").agg(F.sum("w").alias("total"))
    return cells.join(total, "neighbourhood").select("neighbourhood", "state", (F.col("w") / F.col("total")).alias("frequency"))


def state_scores(df: DataFrame, ident: str, mass: Column, states: str, model: DataFrame, width: float = 100.0) -> DataFrame:
    """(ident, score): the summed frequencies of a feature's states, within 0 and 1.

    A state that its neighbourhood does not know counts as the mean there; a neighbourhood that the
    model does not know scores 0.
    """
    means = model.groupBy("neighbourhood").agg(F.avg("frequency").alias("mean"))
    rows = df.select(F.col(ident), neighbourhood(mass, width).alias("neighbourhood"), F.explode_outer(states).alias("state"))
    rows = rows.join(means, "neighbourhood", "left").join(model, ["neighbourhood", "state"], "left")
    part = F.when(F.col("mean").isNotNull() & F.col("state").isNotNull(), F.coalesce("frequency", "mean")).otherwise(F.lit(0.0))
    sums = rows.groupBy(ident).agg(F.sum(part).alias("total"), F.max(F.col("mean").isNotNull()).alias("is_known"))
    clamped = F.greatest(F.least(F.col("total"), F.lit(1.0)) - EPSILON, F.lit(EPSILON))
    return sums.select(ident, F.when(F.col("is_known"), clamped).otherwise(F.lit(0.0)).alias("score"))


def dispatched(rules: list[tuple[Column, Column]], default: Column) -> Column:
    """The score of the first rule that holds, else the default."""
    out = default
    for rule, value in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), value).otherwise(out)
    return out
