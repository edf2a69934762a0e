"""Aggregates and window forms over time series of signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    value, weight = (F.col(c) if isinstance(c, str) else c for c in (value, weight))
    return F.sum(value * weight) / F.sum(weight)


def trapezoid(df: DataFrame, keys: list[str], at: str, value: str, ties: list[str] | None = None) -> DataFrame:
    """Area under ``value`` over ``at`` per key, straight lines between neighbours."""
    order = Window.partitionBy(*keys).orderBy(at, *(ties or []))
    piece = (F.col(value) + F.lag(value).over(order)) / 2 * (F.col(at) - F.lag(at).over(order))
    return df.withColumn("__piece", piece).groupBy(*keys).agg(F.coalesce(F.sum("__piece"), F.lit(0.0)).alias("area"), F.count("*").alias("points"))


def apex(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Time and height of each key's highest point; the earliest of equals."""
    top = F.max(F.struct(F.col(value).alias("height"), (-F.col(at)).alias("neg"))).alias("top")
    return df.groupBy(*keys).agg(top, F.sum(value).alias("total"), F.min(at).alias("start"), F.max(at).alias("end")).select(*keys, (-F.col("top.neg")).alias("apex_time"), F.col("top.height").alias("height"), "total", "start", "end")


def total_and_base_peak(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias("total"), F.max(value).alias("base_peak"), F.count("*").alias("points"))


def supported_values(df: DataFrame, keys: list[str], value: str, support: int) -> DataFrame:
    """Per key the sorted values seen at least min(support, points) times."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("points", total).filter(F.col("n") >= F.least(F.lit(support), F.col("points"))).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("supported"))


def spacing(df: DataFrame, keys: list[str], at: str, value: str, ties: list[str] | None = None) -> DataFrame:
    """Mean step of ``at`` per key, weighted by the change of ``value`` plus 1."""
    order = Window.partitionBy(*keys).orderBy(at, *(ties or []))
    step = F.col(at) - F.lag(at).over(order)
    weight = F.abs(F.col(value) - F.lag(value).over(order)) + 1
    return df.withColumn("__step", step).withColumn("__weight", weight).filter("__step IS NOT NULL").groupBy(*keys).agg(weighted_mean("__step", "__weight").alias("spacing"), F.count("*").alias("steps"))


def local_maxima(df: DataFrame, keys: list[str], at: str, value: str, ties: list[str] | None = None) -> DataFrame:
    """Inner points no lower than both neighbours and higher than one; both edges of a flat top count."""
    order = Window.partitionBy(*keys).orderBy(at, *(ties or []))
    before, after = F.lag(value).over(order), F.lead(value).over(order)
    v = F.col(value)
    top = (v >= before) & (v >= after) & ((v > before) | (v > after))
    return df.withColumn("__top", F.coalesce(top, F.lit(False))).filter("__top").drop("__top")


def rolling_median(df: DataFrame, keys: list[str], at: str, value: str, reach: int, ties: list[str] | None = None, name: str = "smooth") -> DataFrame:
    """Median of a row and its neighbours, fewer at either end."""
    order = Window.partitionBy(*keys).orderBy(at, *(ties or [])).rowsBetween(-reach, reach)
    near = df.withColumn("__near", F.array_sort(F.collect_list(F.col(value)).over(order)))
    n = F.size("__near")
    middle = (F.element_at("__near", F.floor((n + 1) / 2).cast("int")) + F.element_at("__near", F.ceil((n + 1) / 2).cast("int"))) / 2
    return near.withColumn(name, middle).drop("__near")


def monotone_bell(df: DataFrame, keys: list[str], at: str, value: str, ties: list[str] | None = None, name: str = "bell") -> DataFrame:
    """The value raised to its running maximum from either end, whichever is lower: rising to the mode, then falling."""
    order = Window.partitionBy(*keys).orderBy(at, *(ties or []))
    left = F.max(value).over(order.rowsBetween(Window.unboundedPreceding, 0))
    right = F.max(value).over(order.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(name, F.least(left, right))


def sliding_windows(df: DataFrame, at: str, width: float, step: float) -> DataFrame:
    """Each row once for every window of ``width`` centred on a multiple of ``step`` that holds it."""
    first = F.ceil((F.col(at) - width / 2) / step)
    last = F.floor((F.col(at) + width / 2) / step)
    return df.withColumn("centre", F.explode(F.sequence(first, last))).withColumn("centre", F.col("centre") * F.lit(float(step)))
