"""One annotation for each feature where neighbouring features claim several.

Features of a group are joined by mass shifts; each has options (key, solution, shift, score), and an
annotation of one feature speaks for the same key on features that overlap it in time. Assignment
goes in rounds over all groups at once. In a round every open feature takes the option with the most
weight of assigned features beside it; groups where that assigns nothing get a new starting point.
A round is a few joins and groupings, and what it reads grows with the open features only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.operators import rangejoin
from massloom.session import Scratch

OPTION = ["group", "feature", "key", "solution", "shift"]


def supported_options(options: DataFrame, base: str) -> DataFrame:
    """Options whose key is seen without a mass shift (``base``) somewhere in the group; a feature that would have none keeps all of its own."""
    seen = options.filter(F.col("shift") == base).select("group", "key").distinct().withColumn("__seen", F.lit(True))
    marked = options.join(seen, ["group", "key"], "left").withColumn("__seen", F.coalesce("__seen", F.lit(False)))
    any_seen = marked.groupBy("group", "feature").agg(F.max("__seen").alias("__any"))
    return marked.join(any_seen, ["group", "feature"]).filter("__seen OR NOT __any").drop("__seen", "__any")


def _islands(assigned: DataFrame) -> DataFrame:
    """(group, key, shift, start, end): the time that assigned features of a key and shift cover, overlapping ones as one."""
    at = Window.partitionBy("group", "key", "shift").orderBy("start", "end")
    before = F.max("end").over(at.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") > before).cast("int"), F.lit(1))
    numbered = assigned.withColumn("__new", new).withColumn("__n", F.sum("__new").over(at))
    return numbered.groupBy("group", "key", "shift", "__n").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__n")


def _first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__nth = 1").drop("__nth")


def _beside(open_options: DataFrame, assigned: DataFrame, weights: DataFrame, width: float) -> DataFrame:
    """Each open feature's option with the most weight of assigned features that overlap it; none where nothing does."""
    islands = _islands(assigned).select(F.col("group").alias("g"), F.col("key").alias("k"), F.col("shift").alias("solved_shift"), F.col("start").alias("from"), F.col("end").alias("to"))
    met = rangejoin.overlap_join(open_options, islands, "start", "end", "from", "to", width, on=[("group", "g"), ("key", "k")])
    met = met.select(*OPTION, "solved_shift").distinct()
    known = weights.select("group", "key", F.col("shift").alias("solved_shift"), "weight")
    sums = met.join(known, ["group", "key", "solved_shift"]).groupBy(*OPTION).agg(F.sum("weight").alias("weight"))
    return _first(sums, ["group", "feature"], [F.desc("weight"), F.asc("key"), F.asc("solution"), F.asc("shift")])


def _starting_points(open_options: DataFrame) -> DataFrame:
    """For each group the feature with the best score of the key with the greatest total over its shifts, at that key's best shift."""
    best = open_options.groupBy("group", "key", "shift").agg(F.max("score").alias("weight"))
    total = best.groupBy("group", "key").agg(F.sum("weight").alias("total"))
    key = _first(total, ["group"], [F.desc("total"), F.asc("key")]).select("group", "key")
    shift = _first(best.join(key, ["group", "key"]), ["group"], [F.desc("weight"), F.asc("shift")]).select("group", "key", "shift", "weight")
    rows = open_options.join(shift, ["group", "key", "shift"])
    return _first(rows, ["group"], [F.desc("score"), F.asc("feature"), F.asc("solution")]).select(*OPTION, "weight")


def assign_representers(features: DataFrame, options: DataFrame, base: str, width: float, rounds: int = 20) -> DataFrame:
    """(group, feature, key, solution, shift, weight, round) of every feature with an option.

    ``features`` has group, feature, start and end; ``options`` has group, feature, key, solution,
    shift and score, one row each. ``width`` is about the usual length of a feature. Within a round
    all features are decided from what the rounds before assigned, so the result does not depend on
    any order; equal weights go to the smaller key, solution and shift. What is open after
    ``rounds`` takes its own best option, round -1. Null keys and scores are no options.
    """
    scratch = Scratch(features.sparkSession, "representers")
    valid = options.dropna(subset=[*OPTION, "score"]).groupBy(*OPTION).agg(F.max("score").cast("double").alias("score"))
    spans = features.select("group", "feature", "start", "end")
    rows = scratch.keep(supported_options(valid, base).join(spans, ["group", "feature"]), "options")
    weights = scratch.keep(rows.groupBy("group", "key", "shift").agg(F.max("score").alias("weight")), "weights")
    done = scratch.keep(_starting_points(rows).withColumn("round", F.lit(0)), "start")
    left = scratch.keep(rows.join(done.select("group", "feature"), ["group", "feature"], "left_anti"), "open")
    for n in range(1, rounds + 1):
        if left.isEmpty():
            break
        assigned = done.select(*OPTION).join(spans, ["group", "feature"])
        beside = scratch.keep(_beside(left, assigned, weights, width).select(*OPTION, "weight"), "beside")
        stuck = left.join(beside.select("group").distinct(), "group", "left_anti")
        new = beside.unionByName(_starting_points(stuck)).withColumn("round", F.lit(n))
        done, before = scratch.keep(done.unionByName(new), "done"), done
        left, old = scratch.keep(left.join(done.select("group", "feature"), ["group", "feature"], "left_anti"), "open"), left
        scratch.drop(before, old, beside)
    rest = _first(left, ["group", "feature"], [F.desc("score"), F.asc("key"), F.asc("solution"), F.asc("shift")])
    return done.unionByName(rest.select(*OPTION, F.col("score").alias("weight"), F.lit(-1).alias("round")))


def representers(assigned: DataFrame, matches: DataFrame, threshold: float, apart: float = 1e-5) -> DataFrame:
    """(group, feature, key, solution, score, share, place): the solutions that stand for a feature's assigned key, best first.

    ``matches`` has group, feature, key, solution and score, one row for each match; those under
    ``threshold`` do not count. A solution stays if its share of the feature's score under that key
    is less than ``apart`` below the best one's.
    """
    passing = matches.filter(F.col("score") >= threshold).join(assigned.select("group", "feature", "key"), ["group", "feature", "key"])
    sums = passing.groupBy("group", "feature", "key", "solution").agg(F.sum("score").alias("score"))
    feature = Window.partitionBy("group", "feature", "key")
    shares = sums.withColumn("share", F.col("score") / (F.sum("score").over(feature) + 1e-6))
    best = shares.withColumn("__top", F.max("share").over(feature)).filter(F.col("__top") - F.col("share") < apart)
    return best.withColumn("place", F.row_number().over(feature.orderBy(F.desc("share"), F.asc("solution")))).drop("__top")


def merged_features(features: DataFrame, assigned: DataFrame, matches: DataFrame, threshold: float) -> DataFrame:
    """(group, key, solution, start, end, signal, members, merged): assigned features of one key as one, under the representer of the first of them.

    A feature joins only if its own matches support a solution of its key at ``threshold`` or more;
    the others stay by themselves, ``merged`` false, under the solution of their best match of any
    key, null if none passes.
    """
    rows = assigned.select("group", "feature", "key").join(features.select("group", "feature", "start", "end", "signal"), ["group", "feature"])
    first = representers(assigned, matches, threshold).filter("place = 1").select("group", "feature", "solution")
    valid = rows.join(first, ["group", "feature"])
    together = valid.groupBy("group", "key").agg(
        F.min(F.struct("start", "feature", "solution"))["solution"].alias("solution"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("signal").alias("signal"), F.count("*").alias("members"),
        F.lit(True).alias("merged"),
    )
    alone = rows.join(first, ["group", "feature"], "left_anti").drop("key")
    own = matches.filter(F.col("score") >= threshold).join(alone.select("group", "feature"), ["group", "feature"], "left_semi")
    own = _first(own, ["group", "feature"], [F.desc("score"), F.asc("key"), F.asc("solution")]).select("group", "feature", "key", "solution")
    kept = alone.join(own, ["group", "feature"], "left").select("group", "key", "solution", "start", "end", "signal", F.lit(1).cast("long").alias("members"), F.lit(False).alias("merged"))
    return together.unionByName(kept)
