"""Core search: the mass of a peptide from its spectrum and a list of glycan compositions.

A ladder peak of a candidate lies at precursor - glycan + shift, so precursor - peak is the glycan's
mass less the shift: one join on that difference finds all compositions that explain a peak, and no
scan is compared with every composition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.operators import rangejoin, select
from massloom.session import Scratch

# Exponents of the matched shares of all fragments and of the core.
FRAGMENT_WEIGHT, CORE_WEIGHT = 0.56, 0.42


def ladder_index(glycans: DataFrame, shifts: DataFrame) -> DataFrame:
    """(glycan, glycan_mass, key, is_core, loss, n_theoretical, core_theoretical): what a peak lies below its precursor.

    ``glycans`` holds (glycan, glycan_mass), ``shifts`` (glycan, key, shift, is_core).
    """
    sizes = shifts.groupBy("glycan").agg(F.count("*").alias("n_theoretical"), F.sum(F.col("is_core").cast("int")).alias("core_theoretical"))
    # Shifts are exploded, so their size is not that of the files they come from; no side goes to the driver.
    rows = shifts.hint("merge").join(glycans, "glycan").join(sizes.hint("merge"), "glycan")
    return rows.withColumn("loss", F.col("glycan_mass") - F.col("shift"))


def ladder_matches(precursors: DataFrame, peaks: DataFrame, index: DataFrame, tolerance: float, width: float) -> DataFrame:
    """Peaks (scan, mass, intensity) that a composition explains, with target and the columns of ``index``; ``width`` is that of the bins.

    Compositions heavier than every precursor explain nothing, so they go before the join.
    """
    most = precursors.agg(F.max("precursor_mass").cast("double")).first()[0] or 0.0
    index = Scratch(peaks.sparkSession, "ladders").keep(index.filter(F.col("loss") <= abs(most) * (1 + 2 * tolerance)), "index")
    rows = peaks.join(precursors.select("scan", "precursor_mass").hint("merge"), "scan").withColumn("below", F.col("precursor_mass") - F.col("mass"))
    slack = F.col("mass") * (tolerance * 1.01)  # the tolerance is relative to the target, which lies within this
    found = rangejoin.window_join(rows, index, F.col("below") - slack, F.col("below") + slack, "loss", width)
    found = found.withColumn("target", F.col("precursor_mass") - F.col("loss"))
    return found.filter(F.abs(F.col("mass") - F.col("target")) <= F.col("target") * tolerance)


def coarse_scores(matches: DataFrame, minimum_mass: float, fragment_weight: float = FRAGMENT_WEIGHT, core_weight: float = CORE_WEIGHT) -> DataFrame:
    """(scan, glycan, peptide_mass, score, n_matched, core_matched) of candidates whose peptide is heavy enough.

    The score is the summed log intensity, less towards the edge of the tolerance, times the matched
    shares of all fragments and of the core, each to its exponent.
    """
    part = F.log("intensity") * (1 - F.pow(F.abs(F.col("mass") - F.col("target")) / F.col("target"), F.lit(4.0)))
    sums = matches.filter(F.col("precursor_mass") - F.col("glycan_mass") >= minimum_mass).groupBy("scan", "glycan").agg(
        F.first(F.col("precursor_mass") - F.col("glycan_mass")).alias("peptide_mass"), F.sum(part).alias("total"),
        F.count_distinct("key").alias("n_matched"), F.count_distinct(F.when(F.col("is_core"), F.col("key"))).alias("core_matched"),
        F.first("n_theoretical").alias("n_theoretical"), F.first("core_theoretical").alias("core_theoretical"),
    )
    share = F.pow(F.col("n_matched") / F.col("n_theoretical"), F.lit(fragment_weight)) * F.pow(F.col("core_matched") / F.col("core_theoretical"), F.lit(core_weight))
    return sums.select("scan", "glycan", "peptide_mass", (F.col("total") * share).alias("score"), "n_matched", "core_matched")


def estimate_peptide_masses(scores: DataFrame, groups: int = 150, threshold: float = -1.0, fragments: int = 0) -> DataFrame:
    """Of each scan the candidates over ``threshold`` with ``fragments`` or more, in the first ``groups`` groups of close scores."""
    kept = scores.filter((F.col("score") > threshold) & (F.col("n_matched") >= fragments))
    return select.retain_top_groups(kept, ["scan"], "score", groups, ["glycan"])


def glycans_for_peptide_mass(pairs: DataFrame, glycans: DataFrame, tolerance: float) -> DataFrame:
    """Compositions at the mass that (scan, precursor_mass, peptide_mass) leave over."""
    rows = pairs.withColumn("rest", F.col("precursor_mass") - F.col("peptide_mass"))
    return rangejoin.ppm_join(rows, glycans, "rest", "glycan_mass", tolerance, strict=True)


def core_ladders(peaks: DataFrame, residues: list[tuple[str, float]], tolerance: float, least: int = 1, optional: tuple[str, float] | None = None) -> DataFrame:
    """(scan, start_mass, steps, signal, label): the longest run up the ``residues`` from each peak.

    Each step is a join inside scans on binned masses; between two residues one ``optional`` residue
    may stand. Of equally long runs from one peak the one with most signal stays. The number of
    steps is that of the residues.
    """
    base = peaks.select("scan", F.col("mass").alias("next_mass"), F.col("intensity").alias("next_intensity"))
    slot = lambda m: F.floor(F.log(m) / (8 * tolerance))
    base = base.withColumn("slot", slot(F.col("next_mass")))

    def step(rows: DataFrame, name: str, mass: float) -> DataFrame:
        at = F.col("last") + mass
        near = rows.withColumn("slot", F.explode(F.sequence(slot(at * (1 - 1.01 * tolerance)), slot(at * (1 + 1.01 * tolerance)))))
        found = near.join(base, ["scan", "slot"]).filter(F.abs(F.col("next_mass") - at) <= at * tolerance)
        found = found.select("scan", "start_mass", F.col("next_mass").alias("last"), (F.col("signal") + F.col("next_intensity")).alias("signal"), F.concat("label", F.lit(name)).alias("label"))
        best = F.max_by(F.struct("signal", "label"), F.struct("signal", "label")).alias("best")  # one run for each pair of ends
        return found.groupBy("scan", "start_mass", "last").agg(best).select("scan", "start_mass", "last", "best.signal", "best.label")

    rows = peaks.groupBy("scan", F.col("mass").alias("start_mass")).agg(F.max("intensity").alias("signal"))
    rows = rows.select("scan", "start_mass", F.col("start_mass").alias("last"), "signal", F.lit("").alias("label"))
    found = None
    for n, (name, mass) in enumerate(residues, 1):
        if optional and n > 1:
            rows = rows.unionByName(step(rows, *optional))
        rows = step(rows, name, mass)
        here = rows.withColumn("steps", F.lit(n))
        found = here if found is None else found.unionByName(here)
    best = F.max(F.struct("steps", "signal", "label")).alias("best")
    return found.filter(F.col("steps") >= least).groupBy("scan", "start_mass").agg(best).select("scan", "start_mass", "best.steps", "best.signal", "best.label")


def distinct_masses(rows: DataFrame, mass: str, keys: list[str], apart: float = 1e-3) -> DataFrame:
    """Masses of each key without those that lie closer than ``apart`` above the one before."""
    from pyspark.sql import Window

    before = F.lag(mass).over(Window.partitionBy(*keys).orderBy(mass))
    return rows.select(*keys, mass).distinct().withColumn("__before", before).filter(F.col("__before").isNull() | (F.col(mass) - F.col("__before") >= apart)).drop("__before")


def within_intervals(rows: DataFrame, value: str, key: list[str], intervals: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """Rows whose value lies in any interval; intervals are merged first, so each value meets few of them."""
    from massloom.operators.cluster import merge_intervals

    merged = merge_intervals(intervals.withColumn("__cell", F.floor(F.col(start) / (64 * width))), ["__cell"], start, end).select(F.col("start").alias("__start"), F.col("end").alias("__end"))
    point = rows.withColumn("__at", F.col(value).cast("double")).withColumn("__same", F.col(value).cast("double"))
    hit = rangejoin.overlap_join(point.select(*key, "__at", "__same"), merged, "__at", "__same", "__start", "__end", width).select(*key).distinct()
    return rows.join(hit, key, "left_semi")


def mass_error(observed: Column, theoretical: Column) -> Column:
    return (observed - theoretical) / theoretical
