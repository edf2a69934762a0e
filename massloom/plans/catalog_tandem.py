"""Spectrum matching and scoring, core search and what follows from it.

Lines of an order are the peaks of a scan, parts are fragments of structures, which brands name.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from massloom.operators import spectrum
from massloom.plans.inputs import registrar
from massloom.session import table

CATALOG: dict = {}
query = registrar(CATALOG)
LENGTH = 20


def _peaks(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("mass"), F.col("l_extendedprice").alias("intensity"))


def _fragments(spark, d):
    series = F.element_at(F.array(F.lit("b"), F.lit("y"), F.lit("Y")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select(
        F.col("p_brand").alias("structure"), F.col("p_partkey").alias("fragment"), F.col("p_retailprice").alias("fragment_mass"), series.alias("series"),
        (F.col("p_size") % 19 + 1).alias("position"), (F.col("p_size") > 25).alias("glycosylated"), (F.col("p_size") <= 20).alias("is_core"), F.col("p_size").cast("double").alias("reference"),
    )


def _structures(spark, d):
    return _fragments(spark, d).groupBy("structure").agg(
        F.lit(LENGTH).alias("length"), F.sum(F.when(F.col("is_core") & (F.col("series") == "Y"), 1).otherwise(0)).alias("core_size"), (F.count("*") % 7 + 2).alias("size"),
        F.avg("fragment_mass").alias("peptide_mass"), (F.max("fragment_mass") * 2).alias("precursor_mass"),
    ).withColumn("structure_mass", 1000.0 + 37.5 * F.regexp_extract("structure", r"(\d+)", 1).cast("int"))


PRECURSOR_TOLERANCE = 0.1  # these tables' masses are sparse
SHIFTS = [("none", 0.0), ("ammonium", 17.02655)]


def _precursors(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("scan"), (1000.0 + F.col("o_totalprice") % 1000).alias("precursor_mass"))


def _candidates(spark, d):
    return spectrum.precursor_candidates(_precursors(spark, d), _structures(spark, d), PRECURSOR_TOLERANCE, spark.createDataFrame(SHIFTS, "shift string, shift_mass double"))


def _signatures(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("signature"), (905.0 + F.col("n_nationkey") * 3.7).alias("signature_mass"))


def _expected(spark, d):
    """Every structure expects the signatures of its number's remainder."""
    number = F.regexp_extract("structure", r"(\d+)", 1).cast("int")
    s = _structures(spark, d).select("structure", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("signature"))
    return s.filter((number + F.col("signature")) % 4 == 0).select("structure", "signature", F.least(0.3 * (F.col("signature") % 4 + 1), F.lit(0.99)).alias("importance"))


def _folded(spark, d, *kept):
    """Fragments that differ in mass or in what ``kept`` names."""
    return spectrum.folded(_fragments(spark, d).select("structure", "fragment", "fragment_mass", *kept))


def _matches(spark, d, *kept):
    shifts = spark.createDataFrame(SHIFTS, "shift string, shift_mass double")
    return spectrum.match_precursors(_peaks(spark, d), _folded(spark, d, *kept), _precursors(spark, d), _structures(spark, d), 2e-5, PRECURSOR_TOLERANCE, shifts)


def _all_matches(spark, d, *kept):
    """Matches of every scan with every structure, whatever the precursor."""
    return spectrum.match_fragments(_peaks(spark, d), _folded(spark, d, *kept), 2e-5)


LADDER = ("series", "position", "glycosylated")  # what coverage looks at


_ROLES_SQL = """WITH peaks AS (SELECT l_orderkey AS scan, l_extendedprice / l_quantity AS mass, l_extendedprice AS intensity FROM lineitem),
frags AS (SELECT p_brand AS structure, p_partkey AS fragment, p_retailprice AS fragment_mass, ['b', 'y', 'Y'][p_partkey % 3 + 1] AS series, p_size % 19 + 1 AS position, p_size > 25 AS glycosylated, p_size <= 20 AS is_core, p_size::DOUBLE AS reference FROM part),
structs AS (SELECT structure, 20 AS len, sum((is_core AND series = 'Y')::INT) AS core_size, count(*) % 7 + 2 AS size, avg(fragment_mass) AS peptide_mass, max(fragment_mass) * 2 AS precursor_mass FROM frags GROUP BY 1),
"""
_CAND_SQL = """cand AS (SELECT scan, structure, arg_min(shift, row(abs(smass - am) / am, shift)) AS shift, arg_min((smass - am) / am, row(abs(smass - am) / am, shift)) AS precursor_error
  FROM (SELECT o_orderkey AS scan, shift, 1000.0::DOUBLE + o_totalprice % 1000 - shift_mass AS am FROM orders, (VALUES ('none', 0.0::DOUBLE), ('ammonium', 17.02655::DOUBLE)) AS s (shift, shift_mass)),
    (SELECT structure, 1000.0::DOUBLE + 37.5 * regexp_extract(structure, '(\\d+)', 1)::INT AS smass FROM structs) WHERE abs(smass - am) <= am * 0.1 GROUP BY ALL),
everything AS (SELECT *, (mass - fragment_mass) / fragment_mass AS error FROM frags JOIN peaks ON abs(mass - fragment_mass) <= fragment_mass * 2e-5),
m AS (SELECT e.* FROM everything e JOIN cand USING (scan, structure)),
"""
_PARTS_SQL = """pairs AS (SELECT DISTINCT scan, structure FROM m),
ladders AS (SELECT structure, count(DISTINCT CASE WHEN series IN ('b', 'y') THEN series || position END) AS n_theoretical, count(DISTINCT CASE WHEN series = 'b' AND glycosylated THEN position END) AS n_gl,
  count(DISTINCT CASE WHEN series = 'y' AND glycosylated THEN position END) AS c_gl FROM frags GROUP BY 1),
ends AS (SELECT scan, structure, CASE WHEN series = 'b' THEN position ELSE 19 - position END AS residue, count(DISTINCT series) AS k FROM m WHERE series IN ('b', 'y') GROUP BY ALL),
back AS (SELECT scan, structure, sum(log2(k + 1) / log2(3)) / 20 AS mean_coverage, sum(k) AS covered FROM ends GROUP BY ALL),
sites AS (SELECT scan, structure, count(DISTINCT CASE WHEN series = 'b' AND glycosylated THEN position END) AS ns, count(DISTINCT CASE WHEN series = 'y' AND glycosylated THEN position END) AS cs, count(DISTINCT CASE WHEN series = 'Y' THEN fragment END) AS stubs FROM m GROUP BY ALL),
cov AS (SELECT s.scan, s.structure, coalesce(mean_coverage, 0) AS mc, CASE WHEN n_gl + c_gl > 0 THEN (ns + cs)::DOUBLE / (n_gl + c_gl) ELSE 0 END AS gc, least(stubs, 3) / 3.0::DOUBLE AS sf, coalesce(covered, 0) AS covered
  FROM sites s JOIN ladders USING (structure) LEFT JOIN back b ON b.scan = s.scan AND b.structure = s.structure),
li AS (SELECT scan, structure, sum(log10(intensity) * (1 - pow(abs(error) / 2e-5, 4))) AS total FROM m WHERE series IN ('b', 'y') GROUP BY ALL),
base AS (SELECT scan, max(intensity) AS base_peak FROM peaks GROUP BY 1),
sig AS (SELECT n_nationkey AS signature, 905.0::DOUBLE + n_nationkey * 3.7::DOUBLE AS smass FROM nation),
hits AS (SELECT scan, signature, max(intensity) / any_value(base_peak) AS ratio FROM peaks JOIN sig ON abs(mass - smass) <= smass * 1e-4 JOIN base USING (scan) GROUP BY ALL),
wanted AS (SELECT structure, signature, least(0.3::DOUBLE * (signature % 4 + 1), 0.99) AS importance FROM structs, (SELECT range AS signature FROM range(25)) WHERE (regexp_extract(structure, '(\\d+)', 1)::INT + signature) % 4 = 0),
strong AS (SELECT * FROM hits WHERE ratio >= 0.025),
costs AS (SELECT p.scan, p.structure, CASE WHEN 1 - ratio <= 0 THEN 20 ELSE -10 * log10(1 - ratio) END AS cost FROM pairs p JOIN strong h ON h.scan = p.scan WHERE NOT EXISTS (SELECT 1 FROM wanted w WHERE w.structure = p.structure AND w.signature = h.signature)
  UNION ALL SELECT p.scan, p.structure, CASE WHEN 1 - importance <= 0 THEN 20 ELSE -10 * log10(1 - importance) END FROM pairs p JOIN wanted w ON w.structure = p.structure WHERE NOT EXISTS (SELECT 1 FROM strong h WHERE h.scan = p.scan AND h.signature = w.signature)),
pen AS (SELECT p.scan, p.structure, coalesce(-sum(cost), 0) AS signature_score FROM pairs p LEFT JOIN costs c ON c.scan = p.scan AND c.structure = p.structure GROUP BY ALL)
"""
_SQL = _ROLES_SQL + _CAND_SQL + _PARTS_SQL  # matches of the precursor's candidates
_WHOLE_SQL = _ROLES_SQL + "m AS (SELECT *, (mass - fragment_mass) / fragment_mass AS error FROM frags JOIN peaks ON abs(mass - fragment_mass) <= fragment_mass * 2e-5),\n" + _PARTS_SQL  # all matches
_MED = "CASE WHEN len({v}) = 0 THEN 0 WHEN len({v}) % 2 = 0 THEN ({v}[(len({v}) - 1) // 2 + 1] + {v}[(len({v}) - 1) // 2 + 2]) / 2 ELSE {v}[(len({v}) - 1) // 2 + 1] END"
_REST = "CASE WHEN len({v}) = 0 THEN {v} ELSE {v}[(len({v}) - 1) // 2 + 2:] END"
_TAIL = "coalesce(list_sum(list_transform(range({k}, {n}), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p})))), 0)"
_BIN = f""", v1 AS (SELECT scan, list_sort(list(intensity)) AS a FROM peaks GROUP BY 1), v2 AS (SELECT *, {_REST.format(v="a")} AS b FROM v1), v3 AS (SELECT *, {_REST.format(v="b")} AS c FROM v2), v4 AS (SELECT *, {_REST.format(v="c")} AS e FROM v3),
tiers AS (SELECT scan, {_MED.format(v="a")} AS m1, {_MED.format(v="b")} AS m2, {_MED.format(v="c")} AS m3, {_MED.format(v="e")} AS m4 FROM v4),
cnt AS (SELECT scan, structure, count(*) AS n0, sum((intensity > m1)::INT)::BIGINT AS n1, sum((intensity > m2)::INT)::BIGINT AS n2, sum((intensity > m3)::INT)::BIGINT AS n3, sum((intensity > m4)::INT)::BIGINT AS n4 FROM m JOIN tiers USING (scan) GROUP BY ALL),
pr AS (SELECT *, exp(ln(peptide_mass / 3 * 2e-5 * 2) + ln(2) + ln(n0) - ln(precursor_mass)) AS p FROM cnt JOIN ladders USING (structure) JOIN structs USING (structure)),
ch AS (SELECT scan, structure, greatest({_TAIL.format(n="n_theoretical", k="n0", p="p")}, 1e-170) AS fp, list_transform([[n_theoretical, n1], [n1, n2], [n2, n3], [n3, n4]], lambda x: CASE WHEN x[1] = 0 THEN 1.0 ELSE
  {_TAIL.format(n="x[1]", k="(CASE WHEN x[1] = x[2] THEN x[2] - 1 ELSE x[2] END)", p="0.5::DOUBLE")} END) AS tails FROM pr),
bin AS (SELECT scan, structure, -log10(greatest(exp(list_sum(list_transform(tails, lambda t: ln(CASE WHEN t = 0 THEN 1e-20 ELSE t END)))), 1e-170)) - log10(fp) AS binomial_score FROM ch)
"""


@query(_SQL + "SELECT structure, series, count(*) AS matches, count(DISTINCT scan) AS scans, round(avg(error) * 1e6, 4) AS mean_ppm FROM everything GROUP BY ALL")
def fragment_matches(spark, d):
    """All peaks of all spectra against all fragments, within tolerance."""
    m = spectrum.match_fragments(_peaks(spark, d), _fragments(spark, d), 2e-5)
    return m.groupBy("structure", "series").agg(F.count("*").alias("matches"), F.count_distinct("scan").alias("scans"), F.round(F.avg("error") * 1e6, 4).alias("mean_ppm"))


@query(_SQL + "SELECT scan, structure, shift, round(precursor_error * 1e6, 3) AS precursor_ppm FROM cand")
def precursor_candidates(spark, d):
    """Structures that each scan's precursor may come from, with or without a mass shift."""
    return _candidates(spark, d).select("scan", "structure", "shift", F.round(F.col("precursor_error") * 1e6, 3).alias("precursor_ppm"))


def _coverage(spark, d, m):
    return spectrum.coverage(m, _structures(spark, d), spectrum.expected_ladders(_fragments(spark, d)))


@query(_WHOLE_SQL + "SELECT scan, structure, round((mc * 0.5 + gc * 0.5) * 0.8 + sf * 0.2, 6) AS score, round(mc, 6) AS mean_coverage FROM cov")
def coverage_scorer(spark, d):
    """Backbone, glycosylated and ladder coverage as one score."""
    return _coverage(spark, d, _all_matches(spark, d, *LADDER)).select("scan", "structure", F.round(spectrum.coverage_score(), 6).alias("score"), F.round("mean_coverage", 6).alias("mean_coverage"))


@query(_WHOLE_SQL + "SELECT scan, structure, round(mc, 6) AS score FROM cov WHERE covered > 0")
def peptide_coverage_scorer(spark, d):
    """The plain backbone coverage, for peptides without a glycan."""
    return _coverage(spark, d, _all_matches(spark, d, *LADDER)).filter("covered > 0").select("scan", "structure", F.round(spectrum.coverage_score(1.0, 0.0, 0.0), 6).alias("score"))


@query(_WHOLE_SQL + "SELECT scan, structure, round((mc * 0.5 + gc * 0.5) * 0.8 + sf * 0.2 + signature_score, 4) AS score FROM cov JOIN pen USING (scan, structure)")
def signature_coverage_scorer(spark, d):
    """Coverage and signature ions together."""
    m = _all_matches(spark, d, *LADDER)
    penalty = spectrum.signature_penalty(m.select("scan", "structure").distinct(), spectrum.signature_hits(_peaks(spark, d), _signatures(spark, d), 1e-4), _expected(spark, d))
    return spectrum.combined([_coverage(spark, d, m), penalty], spectrum.coverage_score() + F.col("signature_score")).select("scan", "structure", F.round("score", 4).alias("score"))


@query(_WHOLE_SQL + "SELECT scan, structure, round(signature_score, 4) AS signature_score FROM pen")
def signature_penalties(spark, d):
    """What unexpected signature ions and missing expected ones cost each candidate."""
    pairs = _all_matches(spark, d).select("scan", "structure").distinct()
    out = spectrum.signature_penalty(pairs, spectrum.signature_hits(_peaks(spark, d), _signatures(spark, d), 1e-4), _expected(spark, d))
    return out.select("scan", "structure", F.round("signature_score", 4).alias("signature_score"))


@query(_SQL + "SELECT scan, structure, round(coalesce(total * covered / 39, 0), 4) AS plain, round(coalesce(total * pow(covered / 39, 0.7), 0), 4) AS reweighted FROM cov LEFT JOIN li USING (scan, structure)")
def log_intensity_scorers(spark, d):
    """Log intensities times coverage, with coverage at power 1 and 0.7."""
    m = _matches(spark, d, *LADDER)
    covered = _coverage(spark, d, m)
    plain, other = (spectrum.log_intensity_scores(m, covered, 2e-5, e) for e in (1.0, 0.7))
    rows = plain.join(other.withColumnRenamed("peptide_score", "reweighted"), ["scan", "structure"])
    return rows.select("scan", "structure", F.round("peptide_score", 4).alias("plain"), F.round("reweighted", 4).alias("reweighted"))


_STUB = """, sp AS (SELECT scan, structure, mass, max(log10(intensity) * (1 - pow(abs(error) / 2e-5, 4))) AS part FROM m WHERE series = 'Y' GROUP BY ALL), st AS (SELECT scan, structure, sum(part) AS total FROM sp GROUP BY ALL),
sc AS (SELECT scan, structure, count(DISTINCT CASE WHEN is_core THEN fragment END) AS core, count(DISTINCT fragment) AS n FROM m WHERE series = 'Y' GROUP BY ALL),
sg AS (SELECT scan, structure, total, pow(core::DOUBLE / core_size, 0.4) * pow(least(n / greatest(size * ln(size) / 2, size), 1), 0.5) AS glycan_coverage FROM st JOIN sc USING (scan, structure) JOIN structs USING (structure))
"""


@query(_WHOLE_SQL + _STUB + "SELECT scan, structure, round(total * glycan_coverage, 4) AS glycan_score, round(total * glycan_coverage + coalesce(signature_score, 0), 4) AS penalised FROM sg LEFT JOIN pen USING (scan, structure)")
def glycan_scorers(spark, d):
    """The intact-peptide ladder's score, plain and with the signature term."""
    m = _all_matches(spark, d, "series", "is_core")
    stubs = spectrum.stub_scores(m, _structures(spark, d))
    penalty = spectrum.signature_penalty(m.select("scan", "structure").distinct(), spectrum.signature_hits(_peaks(spark, d), _signatures(spark, d), 1e-4), _expected(spark, d))
    rows = spectrum.combined([stubs, penalty], F.col("glycan_score") + F.col("signature_score"), "penalised")
    return rows.select("scan", "structure", F.round("glycan_score", 4).alias("glycan_score"), F.round("penalised", 4).alias("penalised"))


def _binomial(spark, d, m):
    masses = _structures(spark, d).select("structure", "peptide_mass", "precursor_mass")
    return spectrum.binomial_scores(m, spectrum.intensity_tiers(_peaks(spark, d)), spectrum.expected_ladders(_fragments(spark, d)), masses)


@query(_SQL + _BIN + "SELECT scan, structure, round(binomial_score, 4) AS score FROM bin")
def binomial_scorer(spark, d):
    """The chance of so many matches, and of so many strong ones."""
    return _binomial(spark, d, _matches(spark, d)).select("scan", "structure", F.round("binomial_score", 4).alias("score"))


@query(_WHOLE_SQL + _BIN + "SELECT scan, structure, round(binomial_score * ((mc * 0.5 + gc * 0.5) * 0.8 + sf * 0.2) + signature_score, 4) AS score FROM bin JOIN cov USING (scan, structure) JOIN pen USING (scan, structure)")
def coverage_weighted_binomial(spark, d):
    """The binomial score times coverage, and the signature term."""
    m = _all_matches(spark, d, *LADDER)
    penalty = spectrum.signature_penalty(m.select("scan", "structure").distinct(), spectrum.signature_hits(_peaks(spark, d), _signatures(spark, d), 1e-4), _expected(spark, d))
    parts = [_binomial(spark, d, m), _coverage(spark, d, m).drop("n_theoretical"), penalty]
    total = F.col("binomial_score") * spectrum.coverage_score() + F.col("signature_score")
    return spectrum.combined(parts, total).select("scan", "structure", F.round("score", 4).alias("score"))


_OX = _SQL + ", ox AS (SELECT b.scan, coalesce(sum(ratio) / 25, 0) AS g_score, count(ratio) AS matched FROM base b LEFT JOIN hits h ON h.scan = b.scan GROUP BY 1)"


@query(_OX + " SELECT scan, round(g_score, 6) AS g_score, matched FROM ox WHERE g_score > 0.01")
def oxonium_filter(spark, d):
    """Scans whose signature ions are strong enough."""
    return spectrum.oxonium_ratios(_peaks(spark, d), _signatures(spark, d), 1e-4).filter("g_score > 0.01").select("scan", F.round("g_score", 6).alias("g_score"), "matched")


@query(_OX + " SELECT count(*) AS scans, count_if(g_score > 0.01) AS retained, count_if(matched = 0) AS silent, round(avg(g_score), 8) AS mean_ratio FROM ox")
def oxonium_report(spark, d):
    """How many scans the signature filter keeps."""
    rows = spectrum.oxonium_ratios(_peaks(spark, d), _signatures(spark, d), 1e-4)
    return rows.agg(F.count("*").alias("scans"), F.count_if(F.col("g_score") > 0.01).alias("retained"), F.count_if(F.col("matched") == 0).alias("silent"), F.round(F.avg("g_score"), 8).alias("mean_ratio"))


@query(_WHOLE_SQL + "SELECT scan, structure FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.scan = p.scan AND h.ratio >= 0.05 AND NOT EXISTS (SELECT 1 FROM wanted w WHERE w.structure = p.structure AND w.signature = h.signature))")
def signature_consistent_candidates(spark, d):
    """Candidates that no strong signature ion speaks against."""
    pairs = _all_matches(spark, d).select("scan", "structure").distinct()
    return spectrum.consistent_candidates(pairs, spectrum.signature_hits(_peaks(spark, d), _signatures(spark, d), 1e-4), _expected(spark, d))


_FREQ = """, tried AS (SELECT structure, count(*) AS scans FROM pairs GROUP BY 1), poss AS (SELECT series, position, sum(scans) AS possible FROM frags JOIN tried USING (structure) GROUP BY ALL),
seen AS (SELECT series, position, count(*) AS seen FROM (SELECT DISTINCT scan, structure, fragment, series, position FROM m) GROUP BY ALL), fq AS (SELECT series, position, coalesce(seen, 0)::DOUBLE / possible AS frequency FROM poss LEFT JOIN seen USING (series, position))
"""


@query(_SQL + _FREQ + "SELECT series, position, round(frequency, 8) AS frequency FROM fq")
def fragment_frequencies(spark, d):
    """How often fragments of each series and place are seen."""
    out = spectrum.fragment_frequencies(_matches(spark, d, "series", "position"), _fragments(spark, d), ["series", "position"])
    return out.select("series", "position", F.round("frequency", 8).alias("frequency"))


@query(_SQL + _FREQ + "SELECT scan, structure, round(sum(frequency), 6) AS score FROM (SELECT DISTINCT scan, structure, fragment, series, position FROM m) JOIN fq USING (series, position) GROUP BY ALL")
def frequency_scorer(spark, d):
    """Matched fragments weighed by how often their kind is seen."""
    m = _matches(spark, d, "series", "position")
    f = spectrum.fragment_frequencies(m, _fragments(spark, d), ["series", "position"])
    return spectrum.frequency_scores(m, f, ["series", "position"]).select("scan", "structure", F.round("frequency_score", 6).alias("score"))


@query(_SQL + "SELECT scan, structure, round(used / total, 6) AS utilisation FROM (SELECT scan, structure, sum(intensity) AS used FROM (SELECT DISTINCT scan, structure, mass, intensity FROM m) GROUP BY ALL) JOIN (SELECT scan, sum(intensity) AS total FROM peaks GROUP BY 1) USING (scan)")
def signal_utilisation(spark, d):
    """The share of a spectrum that a structure explains."""
    return spectrum.signal_utilisation(_matches(spark, d), _peaks(spark, d)).select("scan", "structure", F.round("utilisation", 6).alias("utilisation"))


@query(_WHOLE_SQL + """, fm AS (SELECT scan, structure, fragment, max(intensity) AS i, any_value(reference) AS r FROM m GROUP BY ALL)
SELECT scan, structure, round(sum(i * r) / sqrt(sum(i * i) * any_value(rr)), 6) AS cosine FROM fm JOIN (SELECT structure, sum(reference * reference) AS rr FROM frags GROUP BY 1) USING (structure) GROUP BY ALL""")
def fragment_vectors(spark, d):
    """Observed fragment intensities against reference ones."""
    return spectrum.fragment_vector(_all_matches(spark, d, "reference"), _fragments(spark, d), "reference").select("scan", "structure", F.round("cosine", 6).alias("cosine"))


@query(_SQL + """, r AS (SELECT scan, structure, round(coalesce(total * covered / 39, 0) + signature_score, 4) AS score FROM cov LEFT JOIN li USING (scan, structure) JOIN pen USING (scan, structure)),
best AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY score DESC, structure) AS n FROM r), k AS (SELECT score, sum((regexp_extract(structure, '(\\d+)', 1)::INT % 2 = 1)::INT) AS t, sum((regexp_extract(structure, '(\\d+)', 1)::INT % 2 = 0)::INT) AS dc FROM best WHERE n = 1 GROUP BY 1),
c AS (SELECT score, (sum(t) OVER w)::BIGINT AS targets, (sum(dc) OVER w)::BIGINT AS decoys FROM k WINDOW w AS (ORDER BY score DESC)), f AS (SELECT *, CASE WHEN targets = 0 THEN 1 ELSE decoys::DOUBLE / targets END AS fdr FROM c)
SELECT score, targets, decoys, round(min(fdr) OVER (ORDER BY score), 6) AS q_value FROM f""")
def classic_search(spark, d):
    """Spectra against structures: candidates of the precursor, their fragments matched and scored, the best per scan with targets and decoys competing, error rates."""
    from massloom.plans.search import classic_search as search

    signatures = spectrum.signature_hits(_peaks(spark, d), _signatures(spark, d), 1e-4)
    decoy = F.regexp_extract("structure", r"(\d+)", 1).cast("int") % 2 == 0
    shifts = spark.createDataFrame(SHIFTS, "shift string, shift_mass double")
    rates = search(_precursors(spark, d), _peaks(spark, d), _folded(spark, d, *LADDER), _structures(spark, d), signatures, _expected(spark, d), decoy, PRECURSOR_TOLERANCE, shifts)
    return rates.select("score", "targets", "decoys", F.round("q_value", 6).alias("q_value"))
