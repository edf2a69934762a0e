"""Paths over the peaks of a scan: two peaks that lie a building block apart are joined by an edge.

Edges go up in mass, so the graph of a scan has no cycles. Paths grow by one edge a round for all
scans at once, and of the paths with the same ends and as many edges only the best goes on: a scan
has at most as many of them as it has pairs of first and last peaks, whatever the number of paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.session import Scratch


def mass_edges(peaks: DataFrame, blocks: list[tuple[str, float]], tolerance: float) -> DataFrame:
    """(scan, start, end, block), start and end being (peak, mass, intensity): pairs of peaks a block apart.

    ``peaks`` holds (scan, peak, mass, intensity). A block fits where the second mass is within
    ``tolerance`` of the first and the block together, relative to that sum. Rows with a null or a
    mass or intensity of 0 or less are left out; of rows that repeat a peak the heaviest counts.
    """
    if not blocks or any(step <= 0 for _, step in blocks):
        raise ValueError("blocks need masses over 0, as edges go up in mass")
    given = peaks.select("scan", "peak", F.col("mass").cast("double").alias("mass"), F.col("intensity").cast("double").alias("intensity"))
    known = given.filter("scan IS NOT NULL AND peak IS NOT NULL AND mass > 0 AND intensity > 0")
    base = known.groupBy("scan", "peak").agg(F.max(F.struct("mass", "intensity")).alias("m"))
    node = base.select("scan", F.struct("peak", "m.mass", "m.intensity").alias("node"))
    slot = lambda m: F.floor(F.log(m) / (8 * tolerance))
    made = F.explode(F.array(*(F.struct(F.lit(name).alias("block"), F.lit(float(step)).alias("step")) for name, step in blocks)))
    ahead = node.select("scan", F.col("node").alias("start"), made.alias("b")).select("scan", "start", "b.block", (F.col("start.mass") + F.col("b.step")).alias("at"))
    ahead = ahead.withColumn("slot", F.explode(F.sequence(slot(F.col("at") * (1 - tolerance) * (1 - 1e-9)), slot(F.col("at") * (1 + tolerance) * (1 + 1e-9)))))
    ends = node.select("scan", F.col("node").alias("end"), slot(F.col("node.mass")).alias("slot"))
    fits = (F.abs(F.col("end.mass") - F.col("at")) <= F.col("at") * tolerance) & (F.col("end.mass") > F.col("start.mass"))
    return ahead.join(ends, ["scan", "slot"]).filter(fits).select("scan", "start", "end", "block")


def path_depths(edges: DataFrame) -> DataFrame:
    """(scan, peak, depth): the number of edges of the longest path that ends at each peak of ``edges``.

    Round k keeps the peaks that some path of k edges reaches, so rounds are those of the longest path.
    """
    scratch = Scratch(edges.sparkSession, "depths")
    links = scratch.keep(edges.select("scan", F.col("start.peak").alias("peak"), F.col("end.peak").alias("next")).distinct(), "links")
    nodes = links.select("scan", "peak").unionByName(links.select("scan", F.col("next").alias("peak"))).distinct()
    reached = scratch.keep(nodes, "round")
    found = reached.withColumn("depth", F.lit(0))
    depth = 0
    while not reached.isEmpty():
        depth += 1
        reached = scratch.keep(links.join(reached, ["scan", "peak"]).select("scan", F.col("next").alias("peak")).distinct(), "round")
        found = found.unionByName(reached.withColumn("depth", F.lit(depth)))
    return found.groupBy("scan", "peak").agg(F.max("depth").alias("depth"))


def longest_paths(edges: DataFrame, least: int = 1) -> DataFrame:
    """(scan, start, end, steps, signal, start_mass, end_mass, labels, nodes): paths that no edge makes longer at either end.

    For each first and last peak one path: that with most edges, then with most signal (the summed
    intensity of its peaks), then the greatest labels and peaks. ``nodes`` are its (peak, mass,
    intensity) and ``labels`` its blocks in the order of mass. Paths of fewer than ``least`` edges go.
    """
    scratch = Scratch(edges.sparkSession, "paths")
    links = edges.select("*", F.col("start.peak").alias("at"), F.col("end.peak").alias("next"))
    onward = links.select("scan", F.col("at").alias("next"), F.lit(True).alias("goes_on")).distinct()
    links = scratch.keep(links.join(onward, ["scan", "next"], "left").fillna(False, "goes_on"), "links")
    first = links.join(links.select("scan", F.col("next").alias("at")).distinct(), ["scan", "at"], "left_anti")
    heads = first.select("scan", F.col("at").alias("first"), F.col("at").alias("last"), F.col("start.intensity").alias("signal"), F.array().cast("array<string>").alias("labels"), F.array("start").alias("nodes")).distinct()
    rows, found, steps = scratch.keep(heads, "round"), None, 0
    while True:
        steps += 1
        longer = rows.withColumnRenamed("last", "at").join(links.select("scan", "at", "next", "goes_on", "end", "block"), ["scan", "at"])
        best = F.max(F.struct((F.col("signal") + F.col("end.intensity")).alias("signal"), F.array_append("labels", F.col("block")).alias("labels"), F.array_append("nodes", F.col("end")).alias("nodes"))).alias("best")
        grown = longer.groupBy("scan", "first", F.col("next").alias("last")).agg(F.first("goes_on").alias("goes_on"), best)
        rows = scratch.keep(grown.select("scan", "first", "last", "goes_on", "best.*"), "round")
        ended = rows.filter("NOT goes_on").withColumn("steps", F.lit(steps))
        found = ended if found is None else found.unionByName(ended)
        rows = rows.filter("goes_on").drop("goes_on")
        if rows.isEmpty():
            break
    pick = F.max(F.struct("steps", "signal", "labels", "nodes")).alias("best")
    out = found.filter(F.col("steps") >= least).groupBy("scan", "first", "last").agg(pick)
    return out.select(
        "scan", F.col("first").alias("start"), F.col("last").alias("end"), "best.steps", "best.signal", F.col("best.nodes")[0]["mass"].alias("start_mass"),
        F.element_at("best.nodes", -1)["mass"].alias("end_mass"), "best.labels", "best.nodes",
    )


def log_signal(nodes: Column) -> Column:
    """The score of a path: the summed decimal logarithms of its peaks' intensities."""
    return F.aggregate(nodes, F.lit(0.0), lambda total, n: total + F.log10(n["intensity"]))


def composition(labels: Column) -> Column:
    """How often a path takes each block, as text by name: ``H:2; N:1``."""
    counted = F.transform(F.array_sort(F.array_distinct(labels)), lambda name: F.concat(name, F.lit(":"), F.size(F.filter(labels, lambda x: x == name)).cast("string")))
    return F.array_join(counted, "; ")


def grouped_paths(paths: DataFrame, tolerance: float) -> DataFrame:
    """(scan, labels, piece, members, signal, start_mass, end_mass): paths of the same blocks and nearly the same start as one.

    Up the start masses a piece takes in what lies less than ``tolerance`` from its first member. At
    each place the distinct peaks of the members stand together: intensities are added, and the mass
    is their mean by intensity.
    """
    of = ["scan", "labels"]
    empty = F.array().cast("array<double>")
    opens = lambda firsts, m: (F.size(firsts) == 0) | ((m - F.element_at(firsts, -1)) / m >= tolerance)
    firsts = F.aggregate(F.array_sort(F.collect_set("start_mass")), empty, lambda a, m: F.when(F.size(a) == 0, F.array(m)).when(opens(a, m), F.array_append(a, m)).otherwise(a))
    rows = paths.join(paths.groupBy(*of).agg(firsts.alias("firsts")), of)
    rows = rows.withColumn("piece", F.size(F.filter("firsts", lambda f: f <= F.col("start_mass"))) - 1)
    members = rows.groupBy(*of, "piece").agg(F.count("*").alias("members"))
    places = rows.select(*of, "piece", F.posexplode("nodes").alias("place", "node")).distinct()
    sums = places.groupBy(*of, "piece", "place").agg(F.sum("node.intensity").alias("intensity"), F.sum(F.col("node.mass") * F.col("node.intensity")).alias("moment"))
    means = sums.withColumn("mass", F.col("moment") / F.col("intensity"))
    whole = means.groupBy(*of, "piece").agg(F.sum("intensity").alias("signal"), F.min_by("mass", "place").alias("start_mass"), F.max_by("mass", "place").alias("end_mass"))
    return members.join(whole, [*of, "piece"])


def disjoint_paths(paths: DataFrame, most: int | None = None) -> DataFrame:
    """The paths of each scan, the strongest first, that share no peak with one taken before; with ``place``, from 1.

    The order is that of signal, then first and last peak; ``most`` keeps the first of that order (a
    report) before paths are compared. In each round a path is taken that comes first at all of its
    peaks, and those that share a peak with it go, which gives what one pass in that order would.
    """
    scratch = Scratch(paths.sparkSession, "disjoint")
    order = Window.partitionBy("scan").orderBy(F.col("signal").desc(), "start", "end")
    ranked = paths.withColumn("place", F.row_number().over(order))
    ranked = scratch.keep(ranked.filter(F.col("place") <= most) if most else ranked, "ranked")
    left = scratch.keep(ranked.select("scan", "place", F.explode("nodes.peak").alias("peak")), "left")
    taken = None
    while True:
        foremost = left.groupBy("scan", "peak").agg(F.min("place").alias("ahead"))
        judged = left.join(foremost, ["scan", "peak"])
        won = scratch.keep(judged.groupBy("scan", "place").agg(F.max((F.col("ahead") < F.col("place")).cast("int")).alias("later")).filter("later = 0").select("scan", "place"), "won")
        taken = won if taken is None else taken.unionByName(won)
        if won.isEmpty():
            break
        used = left.join(won, ["scan", "place"], "left_semi").select("scan", "peak")
        gone = left.join(used, ["scan", "peak"], "left_semi").select("scan", "place").distinct()
        before, left = left, scratch.keep(left.join(gone, ["scan", "place"], "left_anti"), "left")
        scratch.drop(before)
    return ranked.join(taken, ["scan", "place"]).select(*paths.columns, "place")
