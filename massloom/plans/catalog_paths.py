"""Paths over peaks and the graph of scans through peptide masses: parts are scans, their lines peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from massloom.functions import neighbourhoods
from massloom.operators import peakpaths, peptidegraph
from massloom.plans.inputs import registrar
from massloom.session import table

CATALOG: dict = {}
query = registrar(CATALOG)
BLOCKS = [("H", 162.0528), ("N", 203.0794), ("F", 146.0579), ("S", 291.0954), ("G", 307.0903)]
TOLERANCE = 1e-3


def _peaks(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("scan"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("peak"), (300 + F.col("l_extendedprice") / 10).alias("mass"), (F.col("l_quantity") + 1).cast("double").alias("intensity")
    )


def _edges(spark, d):
    return peakpaths.mass_edges(_peaks(spark, d), BLOCKS, TOLERANCE)


def _paths(spark, d):
    return peakpaths.longest_paths(_edges(spark, d))


_GRAPH = f"""WITH RECURSIVE pk AS MATERIALIZED (SELECT l_partkey AS scan, l_orderkey * 10 + l_linenumber AS peak, 300 + l_extendedprice / 10 AS mass, l_quantity::DOUBLE + 1 AS intensity FROM lineitem QUALIFY row_number() OVER (PARTITION BY scan, peak ORDER BY mass DESC, intensity DESC) = 1),
bl AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {m}::DOUBLE)" for n, m in BLOCKS)}) v(block, step)),
ed AS MATERIALIZED (SELECT a.scan, a.peak AS a, b.peak AS b, block, a.mass AS am, b.mass AS bm, a.intensity AS ai, b.intensity AS bi FROM pk a JOIN pk b ON a.scan = b.scan AND b.mass > a.mass JOIN bl ON abs(b.mass - (a.mass + step)) <= (a.mass + step) * {TOLERANCE}),
walk AS (SELECT scan, a AS first, b AS last, 1 AS steps, ai + bi AS signal, [block] AS labels, [a, b] AS peaks, [am, bm] AS masses, [ai, bi] AS ints FROM ed
  UNION ALL SELECT w.scan, w.first, e.b, steps + 1, signal + bi, list_append(labels, block), list_append(peaks, e.b), list_append(masses, bm), list_append(ints, bi) FROM walk w JOIN ed e ON e.scan = w.scan AND e.a = w.last)"""
_LONGEST = """, lp AS MATERIALIZED (SELECT * FROM walk WHERE (scan, first) NOT IN (SELECT (scan, b) FROM ed) AND (scan, last) NOT IN (SELECT (scan, a) FROM ed)
  QUALIFY row_number() OVER (PARTITION BY scan, first, last ORDER BY steps DESC, signal DESC, labels DESC, peaks DESC) = 1)"""


@query(_GRAPH + " SELECT scan, a AS start, b AS \"end\", block FROM ed")
def peak_edges(spark, d):
    """Pairs of peaks of a scan that lie a building block apart."""
    return _edges(spark, d).select("scan", F.col("start.peak").alias("start"), F.col("end.peak").alias("end"), "block")


@query(_GRAPH + " SELECT scan, last AS peak, max(steps) AS depth FROM walk GROUP BY ALL UNION ALL SELECT DISTINCT scan, a, 0 FROM ed WHERE (scan, a) NOT IN (SELECT (scan, b) FROM ed)")
def peak_depths(spark, d):
    """The longest path that ends at each peak."""
    return peakpaths.path_depths(_edges(spark, d))


@query(_GRAPH + _LONGEST + """ SELECT scan, first AS start, last AS "end", steps, signal, round(masses[1], 4) AS start_mass, round(masses[-1], 4) AS end_mass, array_to_string(labels, '') AS labels,
  array_to_string(list_transform(list_sort(list_distinct(labels)), lambda n: n || ':' || len(list_filter(labels, lambda x: x = n))), '; ') AS composition, round(list_sum(list_transform(ints, lambda i: log10(i))), 6) AS score FROM lp""")
def longest_paths(spark, d):
    """For each pair of ends the longest path over a scan's peaks, with its composition and score."""
    rows = _paths(spark, d).withColumn("composition", peakpaths.composition(F.col("labels"))).withColumn("score", F.round(peakpaths.log_signal(F.col("nodes")), 6))
    rows = rows.withColumn("labels", F.array_join("labels", "")).withColumn("start_mass", F.round("start_mass", 4)).withColumn("end_mass", F.round("end_mass", 4))
    return rows.drop("nodes")


@query(_GRAPH + _LONGEST + """, su AS (SELECT scan, labels, list_sort(list(DISTINCT masses[1])) AS ms FROM lp GROUP BY ALL),
fs AS (SELECT scan, labels, list_reduce(list_transform(ms, lambda m: [m]), lambda a, m: CASE WHEN (m[1] - a[-1]) / m[1] >= 0.05 THEN list_append(a, m[1]) ELSE a END) AS firsts FROM su),
gp AS (SELECT lp.*, len(list_filter(firsts, lambda f: f <= masses[1])) - 1 AS piece FROM lp JOIN fs USING (scan, labels)),
un AS (SELECT DISTINCT scan, labels, piece, i, peaks[i] AS peak, masses[i] AS mass, ints[i] AS intensity FROM (SELECT *, unnest(range(1, steps + 2)) AS i FROM gp)),
pl AS (SELECT scan, labels, piece, i, sum(intensity) AS intensity, sum(mass * intensity) / sum(intensity) AS mass FROM un GROUP BY ALL),
wh AS (SELECT scan, labels, piece, sum(intensity) AS signal, arg_min(mass, i) AS a, arg_max(mass, i) AS b FROM pl GROUP BY ALL)
SELECT scan, array_to_string(labels, '') AS labels, piece, members, wh.signal, round(a, 6) AS start_mass, round(b, 6) AS end_mass FROM wh JOIN (SELECT scan, labels, piece, count(*) AS members FROM gp GROUP BY ALL) USING (scan, labels, piece)""")
def merged_paths(spark, d):
    """Paths of the same blocks that begin near each other, as one."""
    rows = peakpaths.grouped_paths(_paths(spark, d), 0.05)
    return rows.select("scan", F.array_join("labels", "").alias("labels"), "piece", "members", "signal", F.round("start_mass", 6).alias("start_mass"), F.round("end_mass", 6).alias("end_mass"))


@query(_GRAPH + _LONGEST + """, rk AS MATERIALIZED (SELECT scan, first, last, peaks, row_number() OVER (PARTITION BY scan ORDER BY signal DESC, first, last) AS place FROM lp),
gr AS (SELECT scan, place, true AS taken, peaks AS used FROM rk WHERE place = 1
  UNION ALL SELECT rk.scan, rk.place, NOT list_has_any(used, peaks), CASE WHEN list_has_any(used, peaks) THEN used ELSE list_concat(used, peaks) END FROM gr JOIN rk ON rk.scan = gr.scan AND rk.place = gr.place + 1)
SELECT scan, first AS start, last AS "end", place FROM rk JOIN gr USING (scan, place) WHERE taken""")
def disjoint_paths(spark, d):
    """The strongest paths of a scan that have no peak in common."""
    return peakpaths.disjoint_paths(_paths(spark, d)).select("scan", "start", "end", "place")


def _precursors(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("scan"), (3000.0 + F.col("p_retailprice")).alias("precursor_mass"))


def _candidates(spark, d):
    """Core-search candidates: suppliers are stored compositions of a scan."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("scan"), F.col("l_suppkey").alias("glycan")).agg(F.count("*").alias("n_matched"), F.avg("l_discount").alias("score"))
    return lines.withColumn("peptide_mass", 400.0 + F.col("glycan") % 97 * 13.7)


def _nodes(spark, d):
    stored = peptidegraph.composition_nodes(_candidates(spark, d), _precursors(spark, d), 0.02, 1)
    return peptidegraph.merged_nodes(stored, peptidegraph.path_nodes(_precursors(spark, d), _paths(spark, d), 2), NODE_TOLERANCE)


NODE_TOLERANCE = 1e-3
_NODES = _GRAPH + _LONGEST + f""", pc AS (SELECT p_partkey AS scan, 3000::DOUBLE + p_retailprice AS pm FROM part),
cn AS (SELECT l_partkey AS scan, 400::DOUBLE + l_suppkey % 97 * 13.7::DOUBLE AS mass, count(*) AS n, avg(l_discount) AS score FROM lineitem GROUP BY l_partkey, l_suppkey),
st AS MATERIALIZED (SELECT scan, mass, max(score) AS score, true AS is_stored FROM cn JOIN pc USING (scan) WHERE score > 0.02 AND n >= 1 GROUP BY scan, mass),
dn AS (SELECT scan, masses[1] AS mass, max(list_sum(list_transform(ints, lambda i: log10(i))) / (ln((pm - masses[1]) / 185.5677185226898) * ((pm - masses[1]) / 185.5677185226898) / 2)) AS score, false AS is_stored
  FROM lp JOIN pc USING (scan) WHERE steps >= 2 AND (pm - masses[1]) / 185.5677185226898 > 1 GROUP BY ALL),
nd AS MATERIALIZED (SELECT * FROM st UNION ALL SELECT * FROM dn WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.scan = dn.scan AND abs(st.mass - dn.mass) <= dn.mass * {NODE_TOLERANCE}))"""


@query(_NODES + " SELECT scan, round(mass, 4) AS peptide_mass, round(score, 6) AS score, is_stored FROM nd")
def peptide_mass_nodes(spark, d):
    """The peptide masses that each scan suggests, from compositions and from paths over its peaks."""
    return _nodes(spark, d).select("scan", F.round("peptide_mass", 4).alias("peptide_mass"), F.round("score", 6).alias("score"), "is_stored")


@query(_NODES + """, ms AS (SELECT mass, CASE WHEN mass - lag(mass) OVER (ORDER BY mass) <= mass * 5e-6 THEN NULL ELSE mass END AS f FROM (SELECT DISTINCT mass FROM nd)),
cl AS (SELECT mass, max(f) OVER (ORDER BY mass) AS shared FROM ms), mb AS (SELECT shared, scan, arg_max(mass, (round(score, 12), -mass)) AS mass, max(score) AS score, count(*) AS nodes FROM nd JOIN cl USING (mass) GROUP BY ALL)
SELECT round(shared, 4) AS shared, scan, round(mass, 4) AS peptide_mass, round(score, 6) AS score, nodes, count(*) OVER (PARTITION BY shared) AS scans FROM mb QUALIFY scans >= 2""")
def shared_peptide_masses(spark, d):
    """Scans linked through the peptide masses that several of them suggest."""
    rows = peptidegraph.shared_masses(_nodes(spark, d))
    return rows.select(F.round("shared", 4).alias("shared"), "scan", F.round("peptide_mass", 4).alias("peptide_mass"), F.round("score", 6).alias("score"), "nodes", "scans")


@query(_NODES + """ SELECT a.scan, b.scan AS other, round(a.mass, 4) AS peptide_mass, round(b.mass, 4) AS other_mass FROM nd a JOIN nd b ON b.scan = a.scan + 1 AND abs(a.mass - b.mass) <= b.mass * 1e-2""")
def common_peptide_masses(spark, d):
    """Peptide masses on which a scan and the next one agree."""
    pairs = table(spark, d, "part").select(F.col("p_partkey").alias("scan"), (F.col("p_partkey") + 1).alias("other"))
    rows = peptidegraph.common_masses(pairs, _nodes(spark, d), 1e-2)
    return rows.select("scan", "other", F.round("peptide_mass", 4).alias("peptide_mass"), F.round("other_mass", 4).alias("other_mass"))


def _counted(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") % 13 + 1).cast("int").alias("Hex"), (F.col("l_partkey") % 9 + 1).cast("int").alias("HexNAc"), (F.col("l_suppkey") % 4).cast("int").alias("NeuAc"), (F.col("l_orderkey") % 3).cast("int").alias("NeuGc")
    )


def _neighbourhoods_sql(mammalian: bool) -> str:
    branched = "SELECT name, i, 2 + i AS lo FROM (VALUES ('bi', 1), ('tri', 2), ('tetra', 3), ('penta', 4), ('hexa', 5), ('hepta', 6)) v(name, i)"
    top, cut = ("2 * i + 6", "2 * i + 5 - s") if mammalian else ("lo + 3", "lo + 3")
    return f"""WITH c AS (SELECT (l_quantity % 13 + 1)::INT AS h, (l_partkey % 9 + 1)::INT AS n, (l_suppkey % 4 + l_orderkey % 3)::INT AS s FROM lineitem), br AS ({branched}),
m AS (SELECT 'high-mannose' AS neighbourhood, h, n, s FROM c WHERE h BETWEEN 3 AND 12 AND n = 2 AND s = 0 UNION ALL SELECT 'hybrid', h, n, s FROM c WHERE h BETWEEN 2 AND 6 AND n BETWEEN 2 AND 4 AND s <= 2
  UNION ALL SELECT name || '-antennary', h, n, s FROM c JOIN br ON n BETWEEN lo AND lo + 2 AND s BETWEEN 1 AND lo AND h BETWEEN lo AND {cut}
  UNION ALL SELECT 'asialo-' || name || '-antennary', h, n, s FROM c JOIN br ON n BETWEEN lo AND lo + 2 AND (s = 0 OR (s = 1 AND i = 1)) AND h BETWEEN lo AND {top})
SELECT neighbourhood, h AS "Hex", n AS "HexNAc", s AS sialic, count(*) AS members FROM m GROUP BY ALL"""


def _neighbourhoods(spark, d, mammalian):
    rows = neighbourhoods.labelled(_counted(spark, d), F.col, neighbourhoods.n_glycan_rules(mammalian))
    return rows.groupBy("neighbourhood", "Hex", "HexNAc", (F.col("NeuAc") + F.col("NeuGc")).alias("sialic")).agg(F.count("*").alias("members"))


@query(_neighbourhoods_sql(False))
def human_neighbourhoods(spark, d):
    """Compositions in the neighbourhoods of human N-glycans."""
    return _neighbourhoods(spark, d, False)


@query(_neighbourhoods_sql(True))
def mammalian_neighbourhoods(spark, d):
    """Compositions in the neighbourhoods of mammalian N-glycans, which allow further hexoses."""
    return _neighbourhoods(spark, d, True)


@query()
def decoy_fragments(spark, d):
    """Fragments beside their decoys, whose shifts follow from the mass of the glycan."""
    from massloom.operators import decoys

    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("structure"), F.col("l_linenumber").alias("position"), (F.col("l_extendedprice") / 10).alias("fragment_mass"), (F.col("l_partkey") % 6).alias("size"))
    glycans = table(spark, d, "orders").select(F.col("o_orderkey").alias("structure"), (600 + F.col("o_totalprice") / 100).alias("glycan_mass"))
    return decoys.shifted_fragments(lines.join(glycans, "structure"))
