"""Exports and readers, each as a round trip through files; scans in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from massloom.operators import spectrum
from massloom.plans.inputs import days, registrar
from massloom.session import Scratch, table
from massloom.sources import exports, markup, scans, spectra, writers

CATALOG: dict = {}
query = registrar(CATALOG)


def _through_csv(spark, df, label):
    path = Scratch(spark, label).path("table")
    writers.write_table(df, path)
    return spark.read.csv(path, header=True, schema=df.schema)


def _points(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("feature"), F.col("l_extendedprice").alias("mass"), days("l_shipdate").alias("time"), F.col("l_quantity").alias("intensity"), F.col("l_linenumber").alias("charge")
    )


_CHROM = """(SELECT l_partkey AS feature, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS neutral_mass, sum(l_quantity) AS total_signal, array_to_string(list_sort(list_distinct(list(l_linenumber))), ';') AS charge_states,
min(t) AS start_time, max(struct_pack(q := l_quantity, n := -t)).n * -1 AS apex_time, max(t) AS end_time FROM (SELECT *, epoch_us(l_shipdate) / 86400000000 AS t FROM lineitem) GROUP BY 1)"""


def _features(spark, d):
    return exports.chromatograms(_points(spark, d), ["feature"]).withColumn("neutral_mass", F.round("neutral_mass", 4))


@query(f"SELECT * FROM {_CHROM}")
def chromatogram_export(spark, d):
    """Features with mass, signal, charges and times, through a file."""
    return _through_csv(spark, _features(spark, d), "chromatograms")


_SCORE = "(SELECT p_partkey AS feature, round(p_retailprice / 1000, 6) AS score, p_size / 50 AS line_score, 0.5::DOUBLE AS isotopic_fit, round(p_size / 100, 6) AS spacing_fit, (p_size % 4)::INT AS charge_count FROM part)"


def _scores(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("feature"), F.round(F.col("p_retailprice") / 1000, 6).alias("score"), (F.col("p_size") / 50).alias("line_score"), F.lit(0.5).alias("isotopic_fit"),
        F.round(F.col("p_size") / 100, 6).alias("spacing_fit"), (F.col("p_size") % 4).cast("int").alias("charge_count"),
    )


@query(f"SELECT c.*, score, line_score, isotopic_fit, spacing_fit, charge_count FROM {_CHROM} c JOIN {_SCORE} USING (feature)")
def scored_chromatogram_export(spark, d):
    """The same with the parts of their score."""
    return _through_csv(spark, exports.scored_chromatograms(_features(spark, d), _scores(spark, d), ["feature"]), "scored")


@query(f"""SELECT p_brand || '/' || p_type AS composition, neutral_mass, round((p_retailprice * 50 - neutral_mass) / neutral_mass, 9) AS mass_accuracy, score, total_signal, start_time, end_time, apex_time, charge_states,
CASE WHEN p_size > 25 THEN 'Unmodified;Formate' ELSE 'Unmodified' END AS mass_shifts, line_score, isotopic_fit, spacing_fit, charge_count, CASE WHEN p_size > 40 THEN 'x:Formate' END AS ambiguous_with, NULL AS used_as_mass_shift
FROM {_CHROM} JOIN {_SCORE} USING (feature) JOIN part ON p_partkey = feature WHERE score > 0.91""")
def glycan_analysis_export(spark, d):
    """Identified compositions with mass errors, scores and lists of shifts, above a score."""
    scored = exports.scored_chromatograms(_features(spark, d), _scores(spark, d), ["feature"])
    part = table(spark, d, "part").select(F.col("p_partkey").alias("feature"), F.concat("p_brand", F.lit("/"), "p_type").alias("composition"), (F.col("p_retailprice") * 50).alias("theoretical_mass"), "p_size")
    none = F.array().cast("array<string>")
    rows = scored.join(part, "feature").filter("score > 0.91").withColumn("mass_shifts", F.when(F.col("p_size") > 25, F.array(F.lit("Unmodified"), F.lit("Formate"))).otherwise(F.array(F.lit("Unmodified"))))
    rows = rows.withColumn("ambiguous_with", F.when(F.col("p_size") > 40, F.array(F.lit("x:Formate"))).otherwise(none)).withColumn("used_as_mass_shift", none)
    return _through_csv(spark, exports.glycan_analysis(rows).withColumn("mass_accuracy", F.round("mass_accuracy", 9)), "glycans")


def _identified(spark, d):
    """Orders as identified glycopeptides, customers as proteins; a third has no feature."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("protein_name"))
    key, seen = F.col("o_orderkey"), F.col("o_orderkey") % 3 != 0
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    day = days("o_orderdate")
    return rows.select(
        F.concat(F.lit("PEP"), key.cast("string")).alias("glycopeptide"), F.lit("run").alias("analysis"), F.col("o_totalprice").alias("neutral_mass"), (F.col("o_totalprice") * 1.00001).alias("theoretical_mass"),
        F.when(seen, key % 10 / 10).alias("ms1_score"), (key % 90).cast("double").alias("ms2_score"), F.round((key % 40) / 1000, 6).alias("q_value"), F.col("o_totalprice").alias("total_signal"),
        F.when(seen, day).alias("start_time"), F.when(seen, day + 2).alias("end_time"), F.when(seen, day + 1).alias("apex_time"), F.array((key % 3 + 2).cast("int"), (key % 3 + 3).cast("int")).alias("charge_states"),
        (key % 5 + 1).alias("msms_count"), (key % 100).alias("peptide_start"), (key % 100 + 12).alias("peptide_end"), "protein_name", F.array((key % 100 + 3).cast("int")).alias("n_glycosylation_sites"),
        F.array(F.lit("Unmodified")).alias("mass_shifts"), (key % 2).alias("missed_cleavages"), F.when(key % 7 == 0, key % 11).alias("group_id"),
        F.when(seen, day - 1).alias("predicted_apex_interval_start"), F.when(seen, day + 3).alias("predicted_apex_interval_end"), F.when(seen, F.lit(0.5)).alias("retention_time_score"),
        *(F.when(key % 4 != 0, (key % (i + 9)).cast("int")).alias(name) for i, name in enumerate(exports.SCORE_SET[:-1])), F.array(F.concat(F.lit("N:"), (key % 5).cast("string"))).alias("localizations"),
    )


_IDENT = """(SELECT o_orderkey AS k, o_orderkey % 3 <> 0 AS seen, epoch_us(o_orderdate) / 86400000000 AS day, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey)"""
_GP = """'PEP' || k AS glycopeptide, 'run' AS analysis, o_totalprice AS neutral_mass, round(0.00001::DOUBLE, 9) AS mass_accuracy, CASE WHEN seen THEN k % 10 / 10 END AS ms1_score, (k % 90)::DOUBLE AS ms2_score, round((k % 40) / 1000, 6) AS q_value, o_totalprice AS total_signal,
CASE WHEN seen THEN day END AS start_time, CASE WHEN seen THEN day + 2 END AS end_time, CASE WHEN seen THEN day + 1 END AS apex_time, (k % 3 + 2) || ';' || (k % 3 + 3) AS charge_states, k % 5 + 1 AS msms_count, k % 100 AS peptide_start, k % 100 + 12 AS peptide_end, c_name AS protein_name,
(k % 100 + 3)::VARCHAR AS n_glycosylation_sites, 'Unmodified' AS mass_shifts, k % 2 AS missed_cleavages, coalesce(CASE WHEN k % 7 = 0 THEN k % 11 END, -1) AS group_id"""


@query(f"SELECT {_GP}, CASE WHEN seen THEN (day - 1)::DOUBLE::VARCHAR ELSE '-' END AS predicted_apex_interval_start, CASE WHEN seen THEN (day + 3)::DOUBLE::VARCHAR ELSE '-' END AS predicted_apex_interval_end, CASE WHEN seen THEN '0.5' ELSE '-' END AS retention_time_score FROM {_IDENT} WHERE k % 90 >= 20 AND (k % 40) / 1000 <= 0.03")
def glycopeptide_export(spark, d):
    """Identified glycopeptides above a score and below an error rate, with predicted times."""
    rows = exports.export_filter(_identified(spark, d), "ms2_score", 20, "q_value", 0.03)
    return _through_csv(spark, exports.glycopeptide_analysis(rows, with_retention=True).withColumn("mass_accuracy", F.round("mass_accuracy", 9)), "glycopeptides")


_MULTI = ", ".join(f"CASE WHEN k % 4 <> 0 THEN (k % {i + 9})::INT::VARCHAR ELSE '?' END AS {name}" for i, name in enumerate(exports.SCORE_SET[:-1]))


@query(f"SELECT {_GP}, {_MULTI}, 'N:' || k % 5 AS localizations FROM {_IDENT}")
def multi_score_export(spark, d):
    """The same with the parts of their scores and error rates."""
    rows = exports.glycopeptide_analysis(_identified(spark, d), with_scores=True)
    return _through_csv(spark, rows.withColumn("mass_accuracy", F.round("mass_accuracy", 9)), "multi")


def _matches(spark, d):
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    shifted = F.col("l_linenumber") % 2 == 0
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("PEP"), F.col("l_partkey").cast("string")).alias("glycopeptide"), F.lit("run").alias("analysis"), F.col("l_extendedprice").alias("neutral_mass"), F.col("l_extendedprice").alias("theoretical_mass"),
        F.when(shifted, "Formate").alias("mass_shift_name"), F.when(shifted, 46.0055).alias("mass_shift_mass"), F.concat(F.lit("scan="), F.col("l_orderkey").cast("string")).alias("scan_id"), days("l_shipdate").alias("scan_time"),
        F.col("l_linenumber").alias("charge"), F.col("l_quantity").alias("ms2_score"), F.col("l_discount").alias("q_value"), F.col("l_tax").alias("precursor_abundance"), (key % 50).alias("peptide_start"), (key % 50 + 9).alias("peptide_end"),
        F.col("l_suppkey").cast("string").alias("protein_name"), F.array((key % 50 + 1).cast("int"), (key % 50 + 4).cast("int")).alias("n_glycosylation_sites"), (F.col("l_returnflag") == "A").alias("is_best_match"),
        (F.col("l_linestatus") == "F").alias("is_precursor_fit"), F.when(key % 5 != 0, F.col("l_linenumber")).alias("rank"), F.when(key % 6 == 0, key % 13).alias("group_id"), F.col("l_orderkey").cast("string").alias("precursor_scan_id"),
        F.lit("HCD").alias("precursor_activation"), (key % 3).alias("missed_cleavages"), *(F.when(key % 4 != 0, (key % (i + 9)).cast("int")).alias(name) for i, name in enumerate(exports.SCORE_SET[:-1])),
    )


_PSM = """'PEP' || l_partkey AS glycopeptide, 'run' AS analysis, l_extendedprice AS neutral_mass, round(CASE WHEN l_linenumber % 2 = 0 THEN 46.0055 ELSE 0 END / l_extendedprice, 9) AS mass_accuracy, CASE WHEN l_linenumber % 2 = 0 THEN 'Formate' ELSE 'Unmodified' END AS mass_shift_name,
'scan=' || l_orderkey AS scan_id, epoch_us(l_shipdate) / 86400000000 AS scan_time, l_linenumber AS charge, l_quantity AS ms2_score, l_discount AS q_value, l_tax AS precursor_abundance, k % 50 AS peptide_start, k % 50 + 9 AS peptide_end, l_suppkey::VARCHAR AS protein_name,
(k % 50 + 1) || ';' || (k % 50 + 4) AS n_glycosylation_sites, l_returnflag = 'A' AS is_best_match, l_linestatus = 'F' AS is_precursor_fit, CASE WHEN k % 5 <> 0 THEN l_linenumber ELSE -1 END AS rank, CASE WHEN k % 6 = 0 THEN k % 13 ELSE -1 END AS group_id,
l_orderkey::VARCHAR AS precursor_scan_id, 'HCD' AS precursor_activation, k % 3 AS missed_cleavages"""
_LINES = "(SELECT *, l_orderkey * 10 + l_linenumber AS k FROM lineitem)"


@query(f"SELECT {_PSM} FROM {_LINES} WHERE l_quantity >= 10 AND l_discount <= 0.05")
def spectrum_match_export(spark, d):
    """Spectrum matches above a score and below an error rate."""
    rows = exports.spectrum_matches(exports.export_filter(_matches(spark, d), "ms2_score", 10, "q_value", 0.05))
    return _through_csv(spark, rows.withColumn("mass_accuracy", F.round("mass_accuracy", 9)), "matches")


@query(f"SELECT {_PSM}, {_MULTI} FROM {_LINES}")
def multi_score_match_export(spark, d):
    rows = exports.spectrum_matches(_matches(spark, d), with_scores=True)
    return _through_csv(spark, rows.withColumn("mass_accuracy", F.round("mass_accuracy", 9)), "multi-matches")


@query("SELECT p_name AS composition, calculated_mass, array_to_string(list_sort(list_distinct(list(p_brand))), ';') AS classes FROM (SELECT p_name, min(p_retailprice) OVER (PARTITION BY p_name) AS calculated_mass, p_brand FROM part) GROUP BY ALL")
def glycan_hypothesis_export(spark, d):
    """Compositions with their masses and classes."""
    part = table(spark, d, "part")
    masses = part.groupBy(F.col("p_name").alias("composition")).agg(F.min("p_retailprice").alias("calculated_mass"))
    return _through_csv(spark, exports.hypothesis_glycans(masses, part.select(F.col("p_name").alias("composition"), F.col("p_brand").alias("class"))), "hypothesis")


@query("SELECT 'G' || l_linenumber || '-' || l_orderkey AS glycopeptide, l_extendedprice AS calculated_mass, p_size AS start_position, p_size + 10 AS end_position, s_name AS protein FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON p_partkey % 10 = s_suppkey")
def glycopeptide_hypothesis_export(spark, d):
    """Candidates with peptide positions and protein names."""
    g = table(spark, d, "lineitem").select(F.concat(F.lit("G"), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_orderkey").cast("string")).alias("glycopeptide"), F.col("l_extendedprice").alias("calculated_mass"), F.col("l_partkey").alias("peptide_id"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("peptide_id"), F.col("p_size").alias("start_position"), (F.col("p_size") + 10).alias("end_position"), (F.col("p_partkey") % 10).alias("protein_id"))
    return _through_csv(spark, exports.hypothesis_glycopeptides(g, p, table(spark, d, "supplier").select(F.col("s_suppkey").alias("protein_id"), F.col("s_name").alias("protein"))), "candidates")


@query("SELECT id, composition, apex, total FROM (SELECT o_orderkey AS id, 'C' || o_custkey AS composition, epoch_us(o_orderdate) / 86400000000 AS apex, o_totalprice AS total FROM orders) WHERE apex BETWEEN 9500 AND 10500")
def chromatogram_records(spark, d):
    """Records of features for retention models, in a range of times, written and read again."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("composition"), days("o_orderdate").alias("apex"), F.col("o_totalprice").alias("total"))
    return _through_csv(spark, exports.export_filter(rows, between=("apex", 9500, 10500)), "records")


@query("""SELECT l_orderkey, l_partkey, 'b' || l_linenumber AS name, l_extendedprice AS mass, l_quantity AS intensity FROM lineitem WHERE l_discount <= 0.03 UNION ALL SELECT l_orderkey, l_partkey, 'y' || l_linenumber, l_extendedprice / 2, l_quantity FROM lineitem WHERE l_discount <= 0.03""")
def spectral_library(spark, d):
    """Annotated peaks of good matches, one row each."""
    made = lambda s, mass: F.struct(F.concat(F.lit(s), F.col("l_linenumber").cast("string")).alias("name"), mass.alias("mass"), F.col("l_quantity").alias("intensity"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_discount", F.array(made("b", F.col("l_extendedprice")), made("y", F.col("l_extendedprice") / 2)).alias("fragments"))
    return exports.library_rows(rows, "l_discount", 0.03).drop("l_discount")


@query("SELECT s_suppkey AS protein_id, s_name AS protein, (SELECT count(*) FROM part WHERE p_partkey % 100 = s_suppkey) AS features, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 30) AS matches FROM supplier")
def report_counts(spark, d):
    """Features and matches of each protein, as a report shows them."""
    f = table(spark, d, "part").select((F.col("p_partkey") % 100).alias("protein_id"))
    m = table(spark, d, "lineitem").filter("l_quantity > 30").select(F.col("l_suppkey").alias("protein_id"))
    return exports.report_counts(f, m, table(spark, d, "supplier").select(F.col("s_suppkey").alias("protein_id"), F.col("s_name").alias("protein")))


@query("SELECT 'scan=' || l_orderkey AS title, count(*) AS peaks, round(sum(i), 2) AS signal FROM (SELECT DISTINCT l_orderkey, l_extendedprice AS mz, l_quantity AS i FROM lineitem WHERE l_orderkey % 100 < 20) GROUP BY 1")
def training_spectra(spark, d):
    """Spectra of good matches as text, read again."""
    peaks = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.struct(F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("intensity"))).alias("peaks"))
    rows = peaks.select(F.concat(F.lit("scan="), F.col("l_orderkey").cast("string")).alias("title"), F.col("l_orderkey").cast("double").alias("mass"), F.lit(2).alias("charge"), "peaks", (F.col("l_orderkey") % 100 / 100).alias("q"))
    path = Scratch(spark, "training").path("spectra")
    writers.write_training_spectra(rows, path, "q", 0.195)
    return spectra.read_mgf(spark, path).select("title", F.size("peaks").cast("long").alias("peaks"), F.round(F.aggregate("peaks", F.lit(0.0), lambda t, p: t + p["intensity"]), 2).alias("signal"))


@query("SELECT 's<' || l_orderkey || '>&\"' AS scan_id, 2 AS ms_level, l_orderkey::DOUBLE / 4 AS scan_time, count(*) AS peaks, round(sum(l_extendedprice), 2) AS mz_sum, round(sum(l_quantity), 2) AS signal FROM lineitem GROUP BY l_orderkey")
def mzml_round_trip(spark, d):
    """Spectra as mzML documents, read again."""
    order = F.array_sort(F.collect_list(F.struct("l_extendedprice", "l_quantity")))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(order.alias("p")).select(
        F.concat(F.lit("s<"), F.col("l_orderkey").cast("string"), F.lit('>&"')).alias("scan_id"), F.col("l_orderkey").alias("index"), F.lit(2).alias("ms_level"), (F.col("l_orderkey") / 4).alias("scan_time"),
        F.lit(500.5).alias("precursor_mz"), F.lit(3).alias("precursor_charge"), F.col("p.l_extendedprice").alias("mz"), F.col("p.l_quantity").alias("intensity"),
    )
    path = Scratch(spark, "mzml").path("spectra")
    markup.write_mzml(rows, path, "gzip")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda t, v: t + v), 2)
    return spectra.read_mzml(spark, f"{path}/part-*").select("scan_id", "ms_level", "scan_time", F.size("mz").cast("long").alias("peaks"), total("mz").alias("mz_sum"), total("intensity").alias("signal"))


@query("""SELECT 'scan=' || l_orderkey AS spectrum, l_linenumber AS rank, l_linenumber AS charge, l_extendedprice AS mz, l_quantity AS score, upper(replace(p_name, ' ', '')) AS peptide, 'ACC' || p_partkey % 20 AS accession, p_size AS "start", p_size + 9 AS "end", p_partkey % 2 = 0 AS is_decoy
FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_extendedprice) JOIN part ON l_partkey = p_partkey""")
def identification_round_trip(spark, d):
    """Identifications as an XML document whose elements refer to one another, resolved on reading."""
    from massloom.operators.select import best_per_key

    text = lambda s, c: F.concat(F.lit(s), c.cast("string"))
    part, key = table(spark, d, "part"), F.col("p_partkey")
    peptides = part.select(text("P", key).alias("_id"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("PeptideSequence"))
    sequences = part.select((key % 20).alias("n")).distinct().select(text("S", F.col("n")).alias("_id"), text("ACC", F.col("n")).alias("_accession"), F.lit("MK").alias("Seq"))
    evidence = part.select(text("E", key).alias("_id"), text("P", key).alias("_peptide_ref"), text("S", key % 20).alias("_dBSequence_ref"), F.col("p_size").alias("_start"), (F.col("p_size") + 9).alias("_end"), (key % 2 == 0).alias("_isDecoy"))
    line = best_per_key(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col("l_extendedprice").asc()])
    item = F.struct(
        text("I", F.col("l_linenumber")).alias("_id"), text("P", F.col("l_partkey")).alias("_peptide_ref"), F.col("l_linenumber").alias("_rank"), F.col("l_linenumber").alias("_chargeState"),
        F.col("l_extendedprice").alias("_experimentalMassToCharge"), F.col("l_quantity").alias("_score"),
    )
    results = line.groupBy("l_orderkey").agg(F.collect_list(item).alias("SpectrumIdentificationItem")).select(text("R", F.col("l_orderkey")).alias("_id"), text("scan=", F.col("l_orderkey")).alias("_spectrumID"), "SpectrumIdentificationItem")
    path = Scratch(spark, "mzid").path("document")
    markup.write_identifications(peptides, sequences, evidence, results, path)
    return markup.read_identified_peptides(spark, path)


@query("SELECT 'ACC' || c_custkey AS accession, c_name AS name, upper(c_mktsegment) AS sequence, 2::BIGINT AS keywords, 'signal peptide:1-' || (c_nationkey + 5) AS feature FROM customer")
def protein_xml_round_trip(spark, d):
    """Protein entries as XML, read again."""
    c = table(spark, d, "customer")
    word = lambda i, v: F.struct(F.lit(i).alias("_id"), v.alias("_VALUE"))
    rows = c.select(
        F.array(F.concat(F.lit("ACC"), F.col("c_custkey").cast("string")), F.lit("OLD")).alias("accession"), F.col("c_name").alias("name"), F.array(word("1", F.lit("Glycoprotein")), word("2", F.col("c_mktsegment"))).alias("keyword"),
        F.array(F.struct(F.lit("signal peptide").alias("_type"), F.lit(1).alias("_begin"), (F.col("c_nationkey") + 5).cast("int").alias("_end"))).alias("feature"), F.upper("c_mktsegment").alias("sequence"),
    )
    path = Scratch(spark, "proteins").path("xml")
    markup.write_elements(rows, path, "entry")
    out, f = markup.read_proteins(spark, path), F.col("features")[0]
    return out.select("accession", "name", "sequence", F.size("keywords").cast("long").alias("keywords"), F.concat(f["type"], F.lit(":"), f["start"].cast("string"), F.lit("-"), f["end"].cast("string")).alias("feature"))


@query("SELECT s_suppkey AS site, s_acctbal AS lam, [s_nationkey, 7]::INT[] AS members, 'J[' || s_nationkey || ',7]' AS text FROM supplier")
def model_round_trip(spark, d):
    """Model parameters as JSON, and number lists as marked text."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_acctbal").alias("lam"), markup.prefixed_json(F.array(F.col("s_nationkey").cast("int"), F.lit(7))).alias("text"))
    path = Scratch(spark, "model").path("json")
    markup.save_model(rows, path)
    return markup.load_model(spark, path, rows.schema).select("site", "lam", markup.read_prefixed_json(F.col("text")).alias("members"), "text")


_SCANS = "(SELECT event_id AS scan_id, CASE WHEN event_type = 'click' THEN 1 ELSE 2 END AS ms_level, epoch_us(ts) / 1e6 AS scan_time, value * 40 AS precursor_mass, user_id % 6 AS charge, event_id - event_id % 10 AS precursor_id FROM events)"


def _scans(spark, d):
    from massloom.plans.inputs import events

    return events(spark, d).select(
        F.col("event_id").alias("scan_id"), F.when(F.col("event_type") == "click", 1).otherwise(2).alias("ms_level"), F.col("t").alias("scan_time"), (F.col("value") * 40).alias("precursor_mass"),
        (F.col("user_id") % 6).alias("charge"), (F.col("event_id") - F.col("event_id") % 10).alias("precursor_id"),
    )


@query(f"SELECT scan_id, ms_level, scan_time, precursor_mass, charge FROM {_SCANS} WHERE ms_level = 1")
def survey_headers(spark, d):
    """Headers of survey scans."""
    return scans.headers(scans.survey_scans(_scans(spark, d)))


@query(f"SELECT scan_id, ms_level, scan_time FROM {_SCANS} ORDER BY abs(scan_time - 1705000000), scan_time, scan_id LIMIT 1")
def scan_at_time(spark, d):
    return scans.at_time(_scans(spark, d), 1705000000.0).select("scan_id", "ms_level", "scan_time")


@query(f"SELECT p_partkey, scan_id, scan_time FROM part JOIN {_SCANS} ON abs(precursor_mass - p_retailprice) <= p_retailprice * 1e-4 WHERE ms_level > 1 AND scan_time BETWEEN 1704500000 AND 1706000000")
def precursor_scans(spark, d):
    """Product scans of a mass in a range of time."""
    masses = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return scans.precursors_near(_scans(spark, d), masses, "p_retailprice", 1e-4, 1704500000.0, 1706000000.0).select("p_partkey", "scan_id", "scan_time")


@query(f"SELECT l_orderkey AS scan_id, l_extendedprice AS mass, scan_time FROM lineitem JOIN {_SCANS} ON scan_id = l_orderkey WHERE ms_level = 1 AND l_extendedprice > 50000")
def survey_peaks_above(spark, d):
    peaks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan_id"), F.col("l_extendedprice").alias("mass"))
    return scans.peaks_above(_scans(spark, d), peaks, 50000.0).select("scan_id", "mass", "scan_time")


@query("SELECT count(*) AS kept, round(any_value(t), 6) AS threshold, count_if(l_quantity >= t) AS above FROM lineitem, (SELECT quantile_cont(l_quantity, 0.05) AS t FROM lineitem WHERE l_extendedprice >= 500) WHERE l_extendedprice >= 500")
def peak_threshold(spark, d):
    """Peaks heavy enough, and the intensity that a twentieth of them lies below."""
    peaks = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("mass"), F.col("l_quantity").alias("intensity"))
    kept, least = scans.loaded_peaks(peaks, 700.0)
    return kept.crossJoin(F.broadcast(least)).agg(F.count("*").alias("kept"), F.round(F.first("threshold"), 6).alias("threshold"), F.count_if(F.col("intensity") >= F.col("threshold")).alias("above"))


@query(f"SELECT ms_level, count(*) AS scans, min(scan_time) AS first_time, max(scan_time) AS last_time, count(DISTINCT charge) AS charges FROM {_SCANS} GROUP BY 1")
def file_summary(spark, d):
    return scans.summary(_scans(spark, d))


@query(f"WITH i AS (SELECT scan_id, 1000 + row_number() OVER (ORDER BY scan_id) - 1 AS n FROM {_SCANS}) SELECT a.n AS precursor_id, b.n AS product_id FROM {_SCANS} s JOIN i a ON a.scan_id = s.precursor_id JOIN i b ON b.scan_id = s.scan_id WHERE ms_level > 1")
def migrated_scans(spark, d):
    """Scans parted into tables and copied under new ids."""
    _, _, links = scans.scan_tables(_scans(spark, d))
    ids = scans.new_ids(_scans(spark, d), "scan_id", 1000)
    return scans.migrated(links, {"precursor_id": ids, "product_id": ids}).select("precursor_id", "product_id")


@query("SELECT o_orderpriority AS analysis_id, count(*) AS n FROM orders WHERE o_orderpriority <> '3-MEDIUM' GROUP BY 1")
def dropped_analysis(spark, d):
    """Analyses as partitions, of which one is removed."""
    path = Scratch(spark, "analyses").path("rows")
    table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("analysis_id")).write.partitionBy("analysis_id").parquet(path)
    writers.drop_analysis(spark, path, "3-MEDIUM")
    return spark.read.parquet(path).groupBy("analysis_id").agg(F.count("*").alias("n"))


@query("SELECT p_name AS name, 'repeated' AS problem FROM part GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT p_name, 'empty' FROM part WHERE p_size = 7 UNION ALL SELECT p_name, 'unknown residue' FROM part WHERE p_size <> 7 AND regexp_matches(upper(replace(p_name, ' ', '')), '[^ACDEFGHIKLMNPQRSTVWYUOBZX]')")
def checked_sequences(spark, d):
    """What is wrong with a sequence file."""
    rows = table(spark, d, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_size") != 7, F.upper(F.replace("p_name", F.lit(" "), F.lit("")))).alias("sequence"))
    return markup.checked_sequences(rows)


@query("SELECT l_orderkey AS scan, count(*) AS peaks FROM lineitem WHERE l_quantity > 20 GROUP BY 1")
def peaks_over_threshold(spark, d):
    """Spectra without their weak peaks."""
    peaks = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("scan")).agg(F.collect_list(F.struct(F.col("l_quantity").alias("intensity"))).alias("peaks"))
    return spectrum.without_weak_peaks(peaks, 20.0).select("scan", F.size("peaks").cast("long").alias("peaks")).filter("peaks > 0")
