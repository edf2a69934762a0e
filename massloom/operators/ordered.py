"""Running values over a global order without bringing all rows to one task.

Rows are dealt to cells of neighbouring keys whose bounds are quantiles of the key. Running values
inside a cell start from the totals of the cells before it; only these totals, one row per cell,
meet in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.session import Scratch, shuffle_width


def quantile_bounds(df: DataFrame, key: str, cells: int) -> list[float]:
    """At most ``cells`` - 1 distinct bounds of about equal shares of rows."""
    marks = [i / cells for i in range(1, cells)]
    found = df.agg(F.percentile_approx(F.col(key).cast("double"), marks, 10 * cells).alias("q")).first()["q"] if marks else None
    return sorted(set(found or []))


def cell_of(key: Column, bounds: list[float]) -> Column:
    """How many of the sorted ``bounds`` are below ``key``; two lookups of about a square root each."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda values: F.size(F.filter(values, lambda b: b < key))
    coarse = below(F.array(*(F.lit(float(g[0])) for g in groups)))
    nested = F.array(*(F.array(*(F.lit(float(b)) for b in g)) for g in groups))
    return F.when(key.isNull() | (coarse == 0), F.lit(0)).otherwise((coarse - 1) * step + below(F.element_at(nested, coarse)))


_COMBINE = {"sum": (F.sum, lambda a, b: a + b, 0), "min": (F.min, F.least, None), "max": (F.max, F.greatest, None)}


def running(df: DataFrame, key: str, values: dict[str, tuple[str, str]], descending: bool = False, ties: list[str] | None = None, cells: int | None = None, within: list[str] | None = None) -> DataFrame:
    """``df`` with running values in the order of ``key`` and then ``ties``, over all rows or those of equal ``within`` columns.

    ``values`` maps a new name to (sum, min or max; column). A row's own value counts.
    """
    groups = within or []
    bounds = quantile_bounds(df, key, cells or 4 * shuffle_width(df.sparkSession))
    rows = df.withColumn("__cell", cell_of(F.col(key).cast("double"), bounds))
    if descending:
        rows = rows.withColumn("__cell", -F.col("__cell"))
    turn = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    in_cell = Window.partitionBy(*groups, "__cell").orderBy(turn(key), *(F.col(t).asc() for t in ties or [])).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*groups, "__cell").agg(*(_COMBINE[kind][0](column).alias(f"__{new}") for new, (kind, column) in values.items()))
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # one row per cell
    totals = totals.select(
        *(F.col(g).alias(f"__of_{g}") for g in groups), F.col("__cell").alias("__its_cell"), *(_COMBINE[kind][0](f"__{new}").over(before).alias(f"__{new}") for new, (kind, _) in values.items())
    )
    same = F.col("__cell") == F.col("__its_cell")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    out = rows.select("*", *(_COMBINE[kind][0](column).over(in_cell).alias(new) for new, (kind, column) in values.items())).join(totals, same)
    for new, (kind, _) in values.items():
        _, combine, zero = _COMBINE[kind]
        start = F.coalesce(F.col(f"__{new}"), F.lit(zero)) if zero is not None else F.col(f"__{new}")
        out = out.withColumn(new, combine(F.col(new), start))
    return out.drop("__cell", "__its_cell", *(f"__of_{g}" for g in groups), *(f"__{new}" for new in values))


def previous(df: DataFrame, key: str, ties: list[str], name: str, cells: int | None = None) -> DataFrame:
    """``df`` with ``name``, the key of the row before in the order of ``key`` and ``ties`` over all rows; null for the first. Rows without a key go."""
    rows = df.filter(F.col(key).isNotNull())
    bounds = quantile_bounds(rows, key, cells or 4 * shuffle_width(df.sparkSession))
    rows = rows.withColumn("__cell", cell_of(F.col(key).cast("double"), bounds))
    edges = rows.groupBy("__cell").agg(F.max(key).alias("__last"))
    edges = edges.select(F.col("__cell").alias("__of"), F.lag("__last").over(Window.orderBy("__cell")).alias("__ahead"))  # one row per cell
    within = Window.partitionBy("__cell").orderBy(key, *ties)
    out = rows.withColumn("__own", F.lag(key).over(within)).join(edges, F.col("__cell") == F.col("__of"))
    return out.withColumn(name, F.coalesce("__own", "__ahead")).drop("__cell", "__of", "__own", "__ahead")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys and p0, p1 ...: the percentiles of each key, between neighbours in proportion.

    Values are counted first, and the counts run in cells, so no task holds a key's values.
    """
    scratch = Scratch(df.sparkSession, "percentiles")
    counts = scratch.keep(df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__value")).agg(F.count("*").alias("__n")), "counts")
    up = running(counts, "__value", {"__upto": ("sum", "__n")}, within=keys)
    total = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    rows = up.join(total, keys) if keys else up.crossJoin(F.broadcast(total))  # one row
    found = []
    for i, share in enumerate(shares):
        at = (F.col("__total") - 1) * share
        for side, place in (("low", F.floor(at)), ("high", F.ceil(at))):
            found.append(F.min(F.when(F.col("__upto") > place, F.col("__value"))).alias(f"__{side}{i}"))
    out = rows.groupBy(*keys).agg(F.first("__total").alias("__total"), *found)
    part = lambda share: (F.col("__total") - 1) * share - F.floor((F.col("__total") - 1) * share)
    return out.select(*keys, *((F.col(f"__low{i}") + (F.col(f"__high{i}") - F.col(f"__low{i}")) * part(share)).alias(f"p{i}") for i, share in enumerate(shares)))


def neighbours(queries: DataFrame, refs: DataFrame, value: str, ref_value: str) -> DataFrame:
    """``queries`` with ``below``, the largest reference value at or below each, and ``above``, the least at or above; null beyond the ends.

    Both sides run in cells of one order, so neither has to fit one task.
    """
    scratch = Scratch(queries.sparkSession, "neighbours")
    asked = queries.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL").distinct().select("v", F.lit(None).cast("double").alias("ref"), F.lit(1).alias("kind"))
    known = refs.select(F.col(ref_value).cast("double").alias("v")).filter("v IS NOT NULL").distinct().select("v", F.col("v").alias("ref"), F.lit(0).alias("kind"))
    both = scratch.keep(asked.unionByName(known), "both")
    down = scratch.keep(running(both, "v", {"below": ("max", "ref")}, ties=["kind"]), "below")
    found = running(down, "v", {"above": ("min", "ref")}, descending=True, ties=["kind"]).filter("kind = 1").select(F.col("v").alias("__v"), "below", "above")
    return queries.join(found, F.col(value).cast("double") == F.col("__v"), "left").drop("__v")


def nearest_clamped(queries: DataFrame, refs: DataFrame, value: str, ref_value: str) -> DataFrame:
    """Each query with the reference row nearest by value, however far; of equally near ones the lower. ``ref_value`` is unique."""
    near = F.when(F.col("above").isNull() | (F.col(value) - F.col("below") <= F.col("above") - F.col(value)), F.col("below")).otherwise(F.col("above"))
    rows = neighbours(queries, refs, value, ref_value).withColumn("__near", near).drop("below", "above")
    return rows.join(refs, F.col("__near") == F.col(ref_value).cast("double"), "left").drop("__near")


def interpolated(queries: DataFrame, refs: DataFrame, value: str, ref_value: str, target: str) -> DataFrame:
    """``queries`` with ``target`` on the straight line between neighbouring references; beyond the ends that of the end. ``ref_value`` is unique."""
    rows = neighbours(queries, refs, value, ref_value)
    side = lambda name: refs.select(F.col(ref_value).cast("double").alias(f"__{name}"), F.col(target).cast("double").alias(f"__{name}_y"))
    rows = rows.join(side("below"), F.col("below") == F.col("__below"), "left").join(side("above"), F.col("above") == F.col("__above"), "left")
    inside = F.col("__below_y") + (F.col("__above_y") - F.col("__below_y")) * F.try_divide(F.col(value) - F.col("below"), F.col("above") - F.col("below"))
    return rows.withColumn(target, F.coalesce(inside, F.col("__below_y"), F.col("__above_y"))).drop("below", "above", "__below", "__above", "__below_y", "__above_y")
