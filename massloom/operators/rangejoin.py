"""Joins within a tolerance, a window or an interval, as equi-joins on bins.

A range predicate alone plans as a nested loop. Here one side is dealt to the bins its range
touches and the other to the one bin of its value, so the join shuffles by bin (hot bins are left
to adaptive skew handling) and the exact predicate is applied to what meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _finish(matches: DataFrame, queries: DataFrame, key: list[str], how: str, right_columns: list[str]) -> DataFrame:
    if how == "inner":
        return matches
    hit = matches.select(*key).distinct()
    if how == "semi":
        return queries.join(hit, key, "left_semi")
    missing = queries.join(hit, key, "left_anti")
    if how == "anti":
        return missing
    return matches.unionByName(missing, allowMissingColumns=True)


def _binned(queries: DataFrame, refs: DataFrame, low_bin: Column, high_bin: Column, ref_bin: Column, predicate: Column, spread: bool = False) -> DataFrame:
    left = queries.withColumn("__bin", F.explode(F.sequence(low_bin, high_bin)))
    if spread:
        left = left.hint("merge")
    return left.join(refs.withColumn("__bin", ref_bin), "__bin").filter(predicate).drop("__bin")


def ppm_join(queries: DataFrame, refs: DataFrame, mass: str, ref_mass: str, tolerance: float, key: list[str] | None = None, how: str = "inner", strict: bool = False, shift: float = 0.0, spread: bool = False) -> DataFrame:
    """Pairs whose reference mass is within ``tolerance`` times the query mass (plus ``shift``) of it.

    ``spread`` is for queries that were exploded or joined: Spark takes their size for that of the
    compressed files they come from, so both sides are shuffled and none is sent whole to the driver.

    ``strict`` excludes the bound itself. ``how`` is inner, left, semi or anti; the last three need
    ``key``, which identifies a query. Column names of the two sides must differ. Null and
    non-positive masses match nothing.
    """
    width = F.lit(8.0 * tolerance)
    at = F.col(mass) + F.lit(float(shift))
    bin_of = lambda m: F.floor(F.log(m) / width)
    slack = 1e-9  # rounding at a bin's edge
    error = F.abs(F.col(ref_mass) - at)
    inside = error < at * tolerance if strict else error <= at * tolerance
    found = _binned(queries.filter(at > 0), refs.filter(F.col(ref_mass) > 0), bin_of(at * (1 - tolerance - slack)), bin_of(at * (1 + tolerance + slack)), bin_of(F.col(ref_mass)), inside, spread)
    return _finish(found, queries, key or [], how, refs.columns)


def window_join(queries: DataFrame, refs: DataFrame, low: Column, high: Column, ref_value: str, width: float, key: list[str] | None = None, how: str = "inner", spread: bool = False) -> DataFrame:
    """Pairs with ``low`` <= reference value <= ``high``; ``width`` is the bin width, about the usual size of a range. ``spread`` as in ``ppm_join``."""
    size = F.lit(float(width))
    rows = queries.withColumn("__low", low.cast("double")).withColumn("__high", high.cast("double"))
    value = F.col(ref_value).cast("double")
    bin_of = lambda v: F.floor(v / size)
    found = _binned(rows.filter("__low <= __high"), refs.filter(F.col(ref_value).isNotNull()), bin_of(F.col("__low")), bin_of(F.col("__high")), bin_of(value), value.between(F.col("__low"), F.col("__high")), spread)
    return _finish(found.drop("__low", "__high"), queries, key or [], how, refs.columns)


def overlap_join(left: DataFrame, right: DataFrame, start: str, end: str, right_start: str, right_end: str, width: float, on: list[tuple[str, str]] | None = None) -> DataFrame:
    """Pairs of closed intervals that overlap, each once, with equal ``on`` columns.

    Both sides are dealt to the bins they touch; a pair counts in the bin where the later one starts.
    """
    size = F.lit(float(width))
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    l, r = left.withColumn("__bin", bins(start, end)), right.withColumn("__rbin", bins(right_start, right_end))
    condition = F.col("__bin") == F.col("__rbin")
    for a, b in on or []:
        condition = condition & (F.col(a) == F.col(b))
    later = F.floor(F.greatest(F.col(start), F.col(right_start)) / size)
    found = l.join(r, condition).filter((F.col(start) <= F.col(right_end)) & (F.col(right_start) <= F.col(end)) & (F.col("__bin") == later))
    return found.drop("__bin", "__rbin")


def nearest_within(queries: DataFrame, refs: DataFrame, value: str, ref_value: str, key: list[str], limit: float, ties: list[str]) -> DataFrame:
    """For each query the reference nearest by value, at most ``limit`` away; ties go to the lowest ``ties`` columns."""
    at = F.col(value).cast("double")
    found = window_join(queries, refs, at - limit, at + limit, ref_value, 2 * limit)
    distance = F.abs(F.col(ref_value).cast("double") - at)
    best = F.min(F.struct(distance.alias("distance"), *ties, *(c for c in refs.columns if c not in ties))).alias("__best")
    kept = [c for c in queries.columns if c not in key]
    grouped = found.groupBy(*key).agg(*(F.first(c).alias(c) for c in kept), best)
    return grouped.select(*queries.columns, *(F.col(f"__best.{c}").alias(c) for c in refs.columns), F.col("__best.distance").alias("distance"))


def nearest_in_group(queries: DataFrame, refs: DataFrame, group: str, value: str, ref_value: str, ref_columns: list[str]) -> DataFrame:
    """As-of join on both sides: per group the last reference at or before and the first after, by one shuffle and two windows."""
    from pyspark.sql import Window

    mark = F.struct(*(F.col(c) for c in [ref_value, *ref_columns]))
    both = queries.withColumn("__at", F.col(value)).withColumn("__ref", F.lit(None).cast(refs.select(mark.alias("m")).schema[0].dataType)).unionByName(
        refs.select(F.col(group), F.col(ref_value).alias("__at"), mark.alias("__ref")), allowMissingColumns=True
    )
    order = [F.col("__at").asc(), F.col("__ref").isNull().asc(), F.col("__ref").asc()]
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(group).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    out = both.withColumn("previous", F.last("__ref", ignorenulls=True).over(before)).withColumn("following", F.first("__ref", ignorenulls=True).over(after))
    return out.filter(F.col("__ref").isNull()).drop("__at", "__ref")
