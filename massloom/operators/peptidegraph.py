"""A graph of scans through the peptide masses that each suggests.

A node is a peptide mass that a scan suggests, from stored compositions or from a path over its
peaks. Scans are not compared with each other: masses of all scans are put in order, what lies
between two steps over the tolerance is one mass, and a scan is linked to the masses it suggests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.operators import ordered
from massloom.operators.peakpaths import log_signal
from massloom.session import Scratch

# Fixed value: the mean mass of a sugar residue in such compositions.
AVERAGE_RESIDUE = 185.5677185226898


def path_score(nodes: Column, rest: Column) -> Column:
    """The log intensity of a path for each expected residue: ``rest``, the mass beside the peptide, in residues n, counts n ln(n) / 2.

    Null where ``rest`` is not over one residue.
    """
    n = rest / AVERAGE_RESIDUE
    return F.when(n > 1, log_signal(nodes) / (F.log(n) * n / 2.0))


def path_nodes(precursors: DataFrame, paths: DataFrame, least_fragments: int = 2) -> DataFrame:
    """(scan, peptide_mass, rest, score) of paths of more than ``least_fragments`` peaks, which begin at the peptide.

    Paths whose rest is not over one residue have no score and are left out; of paths that begin at one mass the best stays.
    """
    rows = paths.filter(F.size("nodes") > least_fragments).join(precursors.select("scan", "precursor_mass"), "scan")
    rows = rows.withColumn("rest", F.col("precursor_mass") - F.col("start_mass"))
    rows = rows.withColumn("score", path_score(F.col("nodes"), F.col("rest"))).filter("score IS NOT NULL")
    return rows.groupBy("scan", F.col("start_mass").alias("peptide_mass")).agg(F.first("rest").alias("rest"), F.max("score").alias("score"))


def composition_nodes(scores: DataFrame, precursors: DataFrame, threshold: float = 0.1, least_fragments: int = 2) -> DataFrame:
    """(scan, peptide_mass, rest, score) of core-search candidates over the threshold; of one mass the best stays."""
    rows = scores.filter((F.col("score") > threshold) & (F.col("n_matched") >= least_fragments)).join(precursors.select("scan", "precursor_mass"), "scan")
    return rows.groupBy("scan", "peptide_mass").agg(F.first(F.col("precursor_mass") - F.col("peptide_mass")).alias("rest"), F.max("score").alias("score"))


def merged_nodes(stored: DataFrame, novel: DataFrame, tolerance: float = 5e-6) -> DataFrame:
    """All ``stored`` nodes, and the ``novel`` ones of which no stored node of the scan lies within ``tolerance`` (of the novel mass); with is_stored."""
    both = stored.withColumn("is_stored", F.lit(True)).unionByName(novel.withColumn("is_stored", F.lit(False)))
    at = F.when(F.col("is_stored"), F.col("peptide_mass"))
    up, down = (Window.partitionBy("scan").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.col("peptide_mass").asc(), F.col("peptide_mass").desc()))
    near = F.least(F.col("peptide_mass") - F.last(at, ignorenulls=True).over(up), F.last(at, ignorenulls=True).over(down) - F.col("peptide_mass"))
    rows = both.withColumn("__near", near)
    return rows.filter(F.col("is_stored") | F.col("__near").isNull() | (F.col("__near") > F.col("peptide_mass") * tolerance)).drop("__near")


def shared_masses(nodes: DataFrame, tolerance: float = 5e-6, least_scans: int = 2) -> DataFrame:
    """(shared, scan, peptide_mass, score, nodes, scans): the scans of each mass that ``least_scans`` or more suggest.

    ``shared`` is the least of the masses that follow each other in steps of at most ``tolerance``
    (relative to the greater one), so two nodes within tolerance always share it. A scan stands once, with its best
    node (of equal ones the lightest) and the number of its ``nodes`` there; ``scans`` counts the
    scans. Distinct masses are put in order in cells, so a mass that most scans suggest is one row there.
    Nodes without a mass or scan are left out.
    """
    scratch = Scratch(nodes.sparkSession, "shared")
    known = scratch.keep(nodes.filter("scan IS NOT NULL AND peptide_mass > 0").select("scan", "peptide_mass", "score"), "nodes")
    masses = ordered.previous(known.select("peptide_mass").distinct(), "peptide_mass", [], "__before")
    opens = F.col("__before").isNull() | (F.col("peptide_mass") - F.col("__before") > F.col("peptide_mass") * tolerance)
    masses = scratch.keep(masses.select("peptide_mass", F.when(opens, F.col("peptide_mass")).alias("__first")), "masses")
    classes = ordered.running(masses, "peptide_mass", {"shared": ("max", "__first")}).select("peptide_mass", "shared")
    best = F.max(F.struct("score", (-F.col("peptide_mass")).alias("lightness"))).alias("best")
    of = scratch.keep(known.join(classes, "peptide_mass").groupBy("shared", "scan").agg(best, F.count("*").alias("nodes")), "of")
    sizes = of.groupBy("shared").agg(F.count("*").alias("scans")).filter(F.col("scans") >= least_scans)
    return of.join(sizes, "shared").select("shared", "scan", (-F.col("best.lightness")).alias("peptide_mass"), "best.score", "nodes", "scans")


def common_masses(pairs: DataFrame, nodes: DataFrame, tolerance: float = 5e-6) -> DataFrame:
    """(scan, other, peptide_mass, other_mass): for given ``pairs`` of scans the nodes that agree, within ``tolerance`` of the other's mass.

    Both lists meet by scan and bin of mass; the pairs are the caller's.
    """
    slot = lambda m: F.floor(F.log(m) / (8 * tolerance))
    known = nodes.filter("peptide_mass > 0").select("scan", "peptide_mass").distinct()
    low, high = F.col("peptide_mass") / (1 + tolerance) * (1 - 1e-9), F.col("peptide_mass") / (1 - tolerance) * (1 + 1e-9)
    mine = pairs.select("scan", "other").distinct().join(known, "scan").withColumn("slot", F.explode(F.sequence(slot(low), slot(high))))
    theirs = known.select(F.col("scan").alias("other"), F.col("peptide_mass").alias("other_mass"), slot(F.col("peptide_mass")).alias("slot"))
    return mine.join(theirs, ["other", "slot"]).filter(F.abs(F.col("peptide_mass") - F.col("other_mass")) <= F.col("other_mass") * tolerance).select("scan", "other", "peptide_mass", "other_mass")
