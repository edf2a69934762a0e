"""Features over time: assignment, merging, linking between runs, and what surrounds them.

A feature is a row with an id, a mass, start and end times and a signal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.operators import ordered, rangejoin
from massloom.operators.cluster import gap_split, merge_intervals
from massloom.session import Scratch


def aggregate_by_annotation(df: DataFrame, keys: list[Column], start: str, end: str, signal: str, gap: float) -> DataFrame:
    """Features of one annotation, the first of ``keys`` that is not null, merged where they overlap or lie less than ``gap`` apart.

    Returns annotation, start, end, members and signal; rows without any annotation stay as they are.
    """
    rows = df.withColumn("annotation", F.coalesce(*keys))
    merged = merge_intervals(rows.filter("annotation IS NOT NULL"), ["annotation"], start, end, gap, [F.sum(signal).alias("signal")]).drop("island")
    alone = rows.filter("annotation IS NULL").select("annotation", F.col(start).alias("start"), F.col(end).alias("end"), F.lit(1).cast("long").alias("members"), F.col(signal).alias("signal"))
    return merged.unionByName(alone)


def distribute_orphans(orphans: DataFrame, features: DataFrame, mass: str, time: str, key: list[str], tolerance: float, longest: float) -> DataFrame:
    """Each orphan with the feature (feature, feature_mass, start, end) within ``tolerance`` whose edge is nearest in time.

    ``distance`` is that to the nearer edge; ``feature`` is null where none is at most ``longest`` away.
    Orphans of equal mass and time are looked up once, and of features with equal mass and edges only
    the one that would be chosen.
    """
    asked = orphans.select(mass, time).distinct()
    known = features.groupBy("feature_mass", "start", "end").agg(F.min("feature").alias("feature"))
    found = rangejoin.ppm_join(asked, known, mass, "feature_mass", tolerance)
    distance = F.least(F.abs(F.col("start") - F.col(time)), F.abs(F.col("end") - F.col(time)))
    on = [mass, time]
    best = found.groupBy(*on).agg(F.min(F.struct(distance.alias("distance"), "feature")).alias("best")).filter(F.col("best.distance") <= longest)
    if not set(on) <= set(key):
        best = orphans.select(*{*key, *on}).join(best, on).groupBy(*key).agg(F.min("best").alias("best"))
        on = key
    return orphans.join(best, on, "left").select(*orphans.columns, "best.feature", "best.distance")


def shift_edges(features: DataFrame, shifts: list[tuple[str, float]], tolerance: float, width: float, on: list[str] | None = None) -> DataFrame:
    """(low, high, shift, ppm): pairs of features a known mass apart whose times overlap or lie at most ``width`` apart.

    Of several shifts for one pair the one with the least error stays. ``on`` columns must be equal.
    """
    made = F.explode(F.array(*(F.struct(F.lit(name).alias("shift"), F.lit(float(m)).alias("step")) for name, m in shifts)))
    left = features.select(F.col("id").alias("low"), "mass", F.col("start").alias("s0"), F.col("end").alias("e0"), *(on or []), made.alias("d")).withColumn("at", F.col("mass") + F.col("d.step"))
    right = features.select(F.col("id").alias("high"), F.col("mass").alias("other"), F.col("start").alias("s1"), F.col("end").alias("e1"), *(F.col(c).alias(f"__{c}") for c in on or []))
    found = rangejoin.ppm_join(left, right, "at", "other", tolerance).filter((F.col("low") != F.col("high")) & (F.col("s1") - F.col("e0") <= width) & (F.col("s0") - F.col("e1") <= width))
    for c in on or []:
        found = found.filter(F.col(c) == F.col(f"__{c}"))
    error = (F.col("other") - F.col("at")) / F.col("at")
    best = found.groupBy("low", "high").agg(F.min(F.struct(F.abs(error).alias("size"), F.col("d.shift").alias("shift"), error.alias("error"))).alias("b"))
    return best.select("low", "high", "b.shift", (F.col("b.error") * 1e6).alias("ppm"))


def match_between(identified: DataFrame, features: DataFrame, tolerance: float, window: float) -> DataFrame:
    """Structures (run, structure, mass, time) looked up among the features (feature_run, feature, feature_mass, feature_time, feature_structure) of other runs.

    ``action`` is link where the feature is known as the same structure, create where it has none,
    and conflict where it has another. The best by time and then mass stays for each run.
    """
    found = rangejoin.ppm_join(identified, features, "mass", "feature_mass", tolerance)
    found = found.filter((F.col("run") != F.col("feature_run")) & (F.abs(F.col("time") - F.col("feature_time")) <= window))
    action = F.when(F.col("feature_structure").isNull(), "create").when(F.col("feature_structure") == F.col("structure"), "link").otherwise("conflict")
    order = F.struct(F.abs(F.col("time") - F.col("feature_time")).alias("a"), F.abs(F.col("mass") - F.col("feature_mass")).alias("b"), F.col("feature").alias("feature"), action.alias("action"))
    return found.groupBy("run", "structure", "feature_run").agg(F.min(order).alias("best")).select("run", "structure", "feature_run", "best.feature", "best.action")


def run_table(identified: DataFrame, runs: list[str], values: dict[str, Column]) -> DataFrame:
    """One row per structure with each value in each run, null where the run lacks it."""
    made = [value.alias(name) for name, value in values.items()]
    return identified.groupBy("structure").pivot("run", runs).agg(*made)


def truncated(points: DataFrame, keys: list[str], at: str, value: str, after: float | None = None, before: float | None = None) -> DataFrame:
    """Features cut to times of at least ``after`` and below ``before``; those that keep no point go."""
    rows = points
    if after is not None:
        rows = rows.filter(F.col(at) >= after)
    if before is not None:
        rows = rows.filter(F.col(at) < before)
    return rows.groupBy(*keys).agg(F.min(at).alias("start"), F.max(at).alias("end"), F.sum(value).alias("signal"), F.count("*").alias("points"))


def overlapping(features: DataFrame, start: float, end: float) -> DataFrame:
    """Features that share any time with [start, end]."""
    return features.filter((F.col("start") <= end) & (F.col("end") >= start))


def next_steps(samples: DataFrame, at: str, cells: int | None = None) -> DataFrame:
    """(time, step): distinct sample times with the time to the next; the last has the one before it."""
    known = samples.select(F.col(at).cast("double").alias("time")).filter("time IS NOT NULL").distinct()
    scratch = Scratch(samples.sparkSession, "steps")
    known = scratch.keep(known, "times")
    # The next time is the least above: the running minimum downwards without the row itself.
    bounds = ordered.quantile_bounds(known, "time", cells or 4 * int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = known.withColumn("__cell", ordered.cell_of(F.col("time"), bounds))
    edges = rows.groupBy("__cell").agg(F.min("time").alias("first"), F.max("time").alias("last"))
    whole = Window.orderBy("__cell")  # one row per cell
    edges = edges.select(F.col("__cell").alias("__of"), F.lead("first").over(whole).alias("after"), F.lag("last").over(whole).alias("ahead"))
    own = Window.partitionBy("__cell").orderBy("time")
    near = rows.withColumn("up", F.lead("time").over(own)).withColumn("down", F.lag("time").over(own)).join(edges, F.col("__cell") == F.col("__of"))
    up, down = F.coalesce("up", "after"), F.coalesce("down", "ahead")
    return near.select("time", F.coalesce(up - F.col("time"), F.col("time") - down).alias("step"))


def relative_spacing(points: DataFrame, keys: list[str], at: str, value: str, samples: DataFrame) -> DataFrame:
    """Per key the mean of its steps over the sampling step at their start, weighted by the change of ``value`` plus 1."""
    order = Window.partitionBy(*keys).orderBy(at)
    rows = points.withColumn("__before", F.lag(at).over(order)).withColumn("__change", F.abs(F.col(value) - F.lag(value).over(order)) + 1).filter("__before IS NOT NULL")
    rows = rows.join(next_steps(samples, at), F.col("__before").cast("double") == F.col("time"))
    ratio = F.try_divide(F.col(at) - F.col("__before"), F.col("step"))
    return rows.groupBy(*keys).agg((F.sum(ratio * F.col("__change")) / F.sum(F.when(ratio.isNotNull(), F.col("__change")))).alias("spacing"), F.count("*").alias("steps"))


def best_piece(points: DataFrame, keys: list[str], at: str, value: str, gap: float) -> DataFrame:
    """The points of each key's most abundant piece between gaps; the earliest of equals."""
    pieces = gap_split(points, keys, at, gap)
    totals = pieces.groupBy(*keys, "piece").agg(F.sum(value).alias("__sum"))
    best = totals.groupBy(*keys).agg(F.max(F.struct("__sum", (-F.col("piece")).alias("__neg"))).alias("__b")).select(*keys, (-F.col("__b.__neg")).alias("piece"))
    return pieces.join(best, [*keys, "piece"], "left_semi")


def filled_and_smoothed(series: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """keys, at, filled and smooth: gaps filled in order by the mean of two values before and one behind, then medians of five with the ends repeated.

    One key's series is held in one row, as each filled value goes into the next.
    """
    rows = series.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("t"), F.col(value).cast("double").alias("v")))).alias("s"))
    values = F.transform("s", lambda p: p["v"])

    def fill(done: Column, i: Column) -> Column:
        near = F.array_compact(F.concat(F.slice(done, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))), F.slice("v", i + 2, 1)))
        mean = F.try_divide(F.aggregate(near, F.lit(0.0), lambda t, x: t + x), F.size(near))
        return F.array_append(done, F.coalesce(F.get("v", i), mean))

    rows = rows.withColumn("v", values)
    places = F.sequence(F.lit(0), F.size("v") - 1)
    rows = rows.withColumn("f", F.aggregate(places, F.array().cast("array<double>"), fill))
    near = lambda i: F.transform(F.array(*(F.lit(j) for j in range(-2, 3))), lambda j: F.get("f", F.greatest(F.lit(0), F.least(i + j, F.size("f") - 1))))
    rows = rows.withColumn("m", F.transform(places, lambda i: F.element_at(F.array_sort(near(i)), 3)))
    return rows.select(*keys, F.explode(F.arrays_zip("s", "f", "m")).alias("p")).select(*keys, F.col("p.s.t").alias(at), F.col("p.f").alias("filled"), F.col("p.m").alias("smooth"))


def split_points(points: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Inner points lower than both neighbours that lie between two maxima of their key."""
    order = Window.partitionBy(*keys).orderBy(at)
    before, after, v = F.lag(value).over(order), F.lead(value).over(order), F.col(value)
    rows = points.withColumn("__low", (v < before) & (v < after)).withColumn("__top", (v > before) & (v > after))
    tops = lambda w: F.max(F.col("__top").cast("int")).over(w)
    left, right = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("__left", tops(left)).withColumn("__right", tops(right))
    return rows.filter("__low AND __left = 1 AND __right = 1").drop("__low", "__top", "__left", "__right")


def exclusive_best(matches: DataFrame, scan: str, score: str) -> DataFrame:
    """Of each scan the matches that reach its best score, whatever their type, without repeated rows."""
    best = matches.groupBy(scan).agg(F.max(score).alias("__best"))
    return matches.join(best, scan).filter(F.col(score) == F.col("__best")).drop("__best").dropDuplicates()


def heterogeneity(identified: DataFrame) -> DataFrame:
    """Rows (protein, site, composition, signal) as one row per protein: sites, and a map site -> composition -> signal."""
    cells = identified.groupBy("protein", "site", "composition").agg(F.sum("signal").alias("signal"))
    sites = cells.groupBy("protein", "site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("composition", "signal")))).alias("at_site"))
    by_site = lambda a, b: F.when(a["site"] < b["site"], -1).when(a["site"] > b["site"], 1).otherwise(0)
    return sites.groupBy("protein").agg(F.count("*").alias("sites"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("site", "at_site")), by_site)).alias("site_map"))


def accepted_or_not(matches: DataFrame, features: DataFrame, feature: str, score: str, threshold: float) -> DataFrame:
    """Each feature with its best score and whether that is accepted; features without matches are not."""
    best = matches.groupBy(feature).agg(F.max(score).alias("best_score"), F.count("*").alias("matches"))
    rows = features.select(feature).distinct().join(best, feature, "left")
    return rows.select(feature, "best_score", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce(F.col("best_score") >= threshold, F.lit(False)).alias("accepted"))


def observed_mean(rows: DataFrame, keys: list[str], score: str, signal: str) -> DataFrame:
    """Scores of each key averaged by weight log10(signal) / 6, and the observations behind them."""
    w = F.log10(signal) / 6
    return rows.filter(F.col(signal) > 0).groupBy(*keys).agg((F.sum(F.col(score) * w) / F.sum(w)).alias("score"), F.sum(w).alias("weight"), F.count("*").alias("observations"))


def descendants(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """(id) of the roots and all below them in ``tree`` (id, parent); one join for each level."""
    scratch = Scratch(tree.sparkSession, "descendants")
    level = scratch.keep(roots.select("id").distinct(), "level")
    known = [level]
    while True:
        below = tree.join(level.select(F.col("id").alias("parent")), "parent", "left_semi").select("id")
        level = scratch.keep(below.join(reduce(DataFrame.unionByName, known), "id", "left_anti").distinct(), "level")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, known)
        known.append(level)


def masked(points: DataFrame, masker: DataFrame, on: list[str]) -> DataFrame:
    """Points that the masker does not hold."""
    return points.join(masker.select(*on).distinct(), on, "left_anti")


def with_composed_shift(own: DataFrame, other: DataFrame, shift: str) -> DataFrame:
    """Nodes of both; those of the other carry ``shift`` on top of their own, which Unmodified leaves as it is."""
    composed = F.when(F.col("node_type") == "Unmodified", F.lit(shift)).otherwise(F.concat("node_type", F.lit(f" + {shift}")))
    return own.unionByName(other.withColumn("node_type", composed))
