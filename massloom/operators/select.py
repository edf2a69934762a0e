"""Retention, ordering and selection of candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return ranked(df, keys, order, "__rank").filter("__rank = 1").drop("__rank")


def retain_minimum(df: DataFrame, score: str, threshold: float) -> DataFrame:
    return df.filter(F.col(score) > threshold)


def retain_all_minimum(df: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, (F.col(c) >= t for c, t in thresholds.items())))


def retain_top_delta(df: DataFrame, keys: list[str], score: str, delta: float) -> DataFrame:
    best = F.max(score).over(Window.partitionBy(*keys))
    return df.withColumn("__best", best).filter(F.col("__best") - F.col(score) < delta).drop("__best")


def score_groups(df: DataFrame, keys: list[str], score: str, gap: float, ties: list[str], name: str = "score_group") -> DataFrame:
    """Groups of scores from the best down, from 1; a step of more than ``gap`` starts the next."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *ties)
    new = F.coalesce((F.lag(score).over(order) - F.col(score) > gap).cast("int"), F.lit(0))
    return df.withColumn("__new", new).withColumn(name, 1 + F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def retain_top_groups(df: DataFrame, keys: list[str], score: str, groups: int, ties: list[str], gap: float = 1e-2) -> DataFrame:
    return score_groups(df, keys, score, gap, ties, "__group").filter(F.col("__group") <= groups).drop("__group")


def mark_top(df: DataFrame, keys: list[str], score: str, within: float = 1e-3, name: str = "is_best") -> DataFrame:
    return df.withColumn(name, F.col(score) > F.max(score).over(Window.partitionBy(*keys)) - within)


def chain_or_best(df: DataFrame, keys: list[str], steps: list, order: list[Column]) -> DataFrame:
    """Apply the retention ``steps`` in turn; keys that lose all rows keep their best one."""
    kept = reduce(lambda rows, step: step(rows), steps, df)
    lost = df.join(kept.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(best_per_key(lost, keys, order))


def group_share(df: DataFrame, keys: list[str], target: list[str], score: str, above_average: bool = False) -> DataFrame:
    """Per target of each key: summed score, its share of the key's total, and the best score.

    With ``above_average`` only scores of at least mean - standard deviation (population) of the key count.
    """
    rows = df
    if above_average:
        w = Window.partitionBy(*keys)
        rows = df.withColumn("__least", F.avg(score).over(w) - F.stddev_pop(score).over(w)).filter(F.col(score) >= F.col("__least"))
    sums = rows.groupBy(*keys, *target).agg(F.sum(score).alias("score_sum"), F.max(score).alias("best_score"), F.count("*").alias("matches"))
    return sums.withColumn("share", F.col("score_sum") / F.sum("score_sum").over(Window.partitionBy(*keys)))
