"""Tables in the forms that other programs read: their columns, in order, and how rows get them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of each export.
CHROMATOGRAM = ("neutral_mass", "total_signal", "charge_states", "start_time", "apex_time", "end_time")
SCORES = ("score", "line_score", "isotopic_fit", "spacing_fit", "charge_count")
GLYCAN_ANALYSIS = (
    "composition", "neutral_mass", "mass_accuracy", "score", "total_signal", "start_time", "end_time", "apex_time", "charge_states", "mass_shifts",
    "line_score", "isotopic_fit", "spacing_fit", "charge_count", "ambiguous_with", "used_as_mass_shift",
)
GLYCOPEPTIDE = (
    "glycopeptide", "analysis", "neutral_mass", "mass_accuracy", "ms1_score", "ms2_score", "q_value", "total_signal", "start_time", "end_time", "apex_time", "charge_states", "msms_count",
    "peptide_start", "peptide_end", "protein_name", "n_glycosylation_sites", "mass_shifts", "missed_cleavages",
)
RETENTION = ("predicted_apex_interval_start", "predicted_apex_interval_end", "retention_time_score")
SCORE_SET = ("glycopeptide_score", "peptide_score", "glycan_score", "glycan_coverage", "total_q_value", "peptide_q_value", "glycan_q_value", "glycopeptide_q_value", "localizations")
SPECTRUM_MATCH = (
    "glycopeptide", "analysis", "neutral_mass", "mass_accuracy", "mass_shift_name", "scan_id", "scan_time", "charge", "ms2_score", "q_value", "precursor_abundance", "peptide_start", "peptide_end",
    "protein_name", "n_glycosylation_sites", "is_best_match", "is_precursor_fit",
)
AFTER_MATCH = ("precursor_scan_id", "precursor_activation", "missed_cleavages")
HYPOTHESIS_GLYCAN = ("composition", "calculated_mass", "classes")
HYPOTHESIS_GLYCOPEPTIDE = ("glycopeptide", "calculated_mass", "start_position", "end_position", "protein")


def _listed(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), ";")


def accuracy(theoretical: Column, observed: Column) -> Column:
    """Relative mass error against what was observed; 0 where nothing is known to compare."""
    return F.coalesce((theoretical - observed) / observed, F.lit(0.0))


def chromatograms(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points (mass, time, intensity, charge) of each feature as one row with the columns of ``CHROMATOGRAM``."""
    apex = F.max(F.struct(F.col("intensity"), (-F.col("time")).alias("neg")))
    rows = points.groupBy(*keys).agg(
        (F.sum(F.col("mass") * F.col("intensity")) / F.sum("intensity")).alias("neutral_mass"), F.sum("intensity").alias("total_signal"), _listed(F.array_sort(F.collect_set("charge"))).alias("charge_states"),
        F.min("time").alias("start_time"), apex.alias("__apex"), F.max("time").alias("end_time"),
    )
    return rows.withColumn("apex_time", -F.col("__apex.neg")).select(*keys, *CHROMATOGRAM)


def scored_chromatograms(features: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    return features.join(scores, keys).select(*keys, *CHROMATOGRAM, *SCORES)


def glycan_analysis(features: DataFrame) -> DataFrame:
    """Rows with composition, theoretical_mass, the columns of features and scores, and arrays mass_shifts, ambiguous_with and used_as_mass_shift."""
    rows = features.withColumn("mass_accuracy", accuracy(F.col("theoretical_mass"), F.col("neutral_mass")))
    for name in ("mass_shifts", "ambiguous_with", "used_as_mass_shift"):
        rows = rows.withColumn(name, _listed(F.col(name)))
    return rows.select(*GLYCAN_ANALYSIS)


def glycopeptide_analysis(rows: DataFrame, with_group: bool = True, with_retention: bool = False, with_scores: bool = False) -> DataFrame:
    """Identified glycopeptides; times are empty for those without a feature, and intervals a dash."""
    out = rows.withColumn("mass_accuracy", accuracy(F.col("theoretical_mass"), F.col("neutral_mass")))
    for name in ("charge_states", "n_glycosylation_sites", "mass_shifts", *(["localizations"] if with_scores else [])):
        out = out.withColumn(name, _listed(F.col(name)))
    columns = list(GLYCOPEPTIDE)
    if with_group:
        out, columns = out.withColumn("group_id", F.coalesce("group_id", F.lit(-1))), [*columns, "group_id"]
    if with_retention:
        for name in RETENTION:
            out = out.withColumn(name, F.coalesce(F.col(name).cast("string"), F.lit("-")))
        columns += RETENTION
    if with_scores:
        for name in SCORE_SET[:-1]:
            out = out.withColumn(name, F.coalesce(F.col(name).cast("string"), F.lit("?")))
        columns += SCORE_SET
    return out.select(*columns)


def spectrum_matches(rows: DataFrame, with_rank: bool = True, with_group: bool = True, with_scores: bool = False) -> DataFrame:
    """One row per match; a missing mass shift is Unmodified, and its mass counts towards the accuracy."""
    shifted = F.col("theoretical_mass") + F.coalesce("mass_shift_mass", F.lit(0.0))
    out = rows.withColumn("mass_accuracy", accuracy(shifted, F.col("neutral_mass"))).withColumn("mass_shift_name", F.coalesce("mass_shift_name", F.lit("Unmodified")))
    out = out.withColumn("n_glycosylation_sites", _listed(F.col("n_glycosylation_sites")))
    columns = list(SPECTRUM_MATCH)
    for name, wanted in (("rank", with_rank), ("group_id", with_group)):
        if wanted:
            out, columns = out.withColumn(name, F.coalesce(name, F.lit(-1))), [*columns, name]
    columns += AFTER_MATCH
    if with_scores:
        for name in SCORE_SET[:-1]:
            out = out.withColumn(name, F.coalesce(F.col(name).cast("string"), F.lit("?")))
        columns += SCORE_SET[:-1]
    return out.select(*columns)


def hypothesis_glycans(compositions: DataFrame, classes: DataFrame) -> DataFrame:
    """(composition, calculated_mass) with their classes (composition, class), joined by ;."""
    listed = classes.groupBy("composition").agg(_listed(F.array_sort(F.collect_set("class"))).alias("classes"))
    return compositions.join(listed, "composition", "left").select("composition", "calculated_mass", F.coalesce("classes", F.lit("")).alias("classes"))


def hypothesis_glycopeptides(glycopeptides: DataFrame, peptides: DataFrame, proteins: DataFrame) -> DataFrame:
    """(glycopeptide, calculated_mass, peptide_id), (peptide_id, start_position, end_position, protein_id) and (protein_id, protein) as one table."""
    return glycopeptides.join(peptides, "peptide_id").join(proteins, "protein_id").select(*HYPOTHESIS_GLYCOPEPTIDE)


def export_filter(rows: DataFrame, score: str | None = None, threshold: float = 0.0, q_value: str | None = None, most: float = 1.0, between: tuple[str, float, float] | None = None) -> DataFrame:
    """Rows that an export keeps: a score of ``threshold`` or more unless that is 0, a q-value of ``most`` or less unless that is 1, and a range."""
    if score and threshold != 0:
        rows = rows.filter(F.col(score) >= threshold)
    if q_value and most < 1:
        rows = rows.filter(F.col(q_value) <= most)
    if between:
        rows = rows.filter(F.col(between[0]).between(between[1], between[2]))
    return rows


def library_rows(matches: DataFrame, q_value: str, most: float) -> DataFrame:
    """Spectral library: each annotated peak of matches that are good enough; ``fragments`` is array<struct<name, mass, intensity>>."""
    kept = matches.filter(F.col(q_value) <= most)
    return kept.withColumn("f", F.explode("fragments")).select(*(c for c in matches.columns if c != "fragments"), "f.name", "f.mass", "f.intensity")


def report_counts(features: DataFrame, matches: DataFrame, proteins: DataFrame) -> DataFrame:
    """(protein_id, protein, features, matches): what a report says of each protein; 0 where there is none."""
    count = lambda df, name: df.groupBy("protein_id").agg(F.count("*").alias(name))
    rows = proteins.join(count(features, "features"), "protein_id", "left").join(count(matches, "matches"), "protein_id", "left")
    return rows.select("protein_id", "protein", F.coalesce("features", F.lit(0)).alias("features"), F.coalesce("matches", F.lit(0)).alias("matches"))
