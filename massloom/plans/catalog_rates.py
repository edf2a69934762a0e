"""Core search, error rates and look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from massloom.operators import coresearch, fdr, mixture, ordered, select
from massloom.plans.inputs import registrar
from massloom.session import table

CATALOG: dict = {}
query = registrar(CATALOG)
TOLERANCE = 1e-4


def _precursors(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("scan"), F.col("o_totalprice").alias("precursor_mass"))


def _peaks(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan"), F.col("l_extendedprice").alias("mass"), (F.col("l_quantity") + 1).alias("intensity"))


def _glycans(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("glycan"), (F.col("p_partkey") * 187.1 + F.col("p_size")).alias("glycan_mass"))


def _shifts(spark, d):
    made = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(k * 203.08).alias("shift"), F.lit(k < 3).alias("is_core")) for k in range(5)))
    return _glycans(spark, d).select("glycan", F.explode(made).alias("s")).select("glycan", "s.*")


def _scores(spark, d):
    index = coresearch.ladder_index(_glycans(spark, d), _shifts(spark, d))
    return coresearch.coarse_scores(coresearch.ladder_matches(_precursors(spark, d), _peaks(spark, d), index, TOLERANCE, 10.0), 1000.0)


_CORE = """WITH g AS (SELECT p_partkey AS glycan, p_partkey * 187.1::DOUBLE + p_size AS gm FROM part), idx AS (SELECT glycan, gm, k AS key, k < 3 AS is_core, gm - k * 203.08::DOUBLE AS loss FROM g, (SELECT unnest(range(5)) AS k)),
q AS (SELECT l_orderkey AS scan, l_extendedprice AS mass, l_quantity + 1 AS intensity, o_totalprice AS pm, o_totalprice - l_extendedprice AS below FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
h AS (SELECT *, pm - loss AS target FROM q JOIN idx ON loss BETWEEN below - mass * 1.02e-4 AND below + mass * 1.02e-4 WHERE abs(mass - (pm - loss)) <= (pm - loss) * 1e-4 AND pm - gm >= 1000),
s AS (SELECT scan, glycan, any_value(pm - gm) AS peptide_mass, sum(ln(intensity) * (1 - pow(abs(mass - target) / target, 4))) AS total, count(DISTINCT key) AS n, count(DISTINCT CASE WHEN is_core THEN key END) AS c FROM h GROUP BY ALL),
r AS (SELECT scan, glycan, peptide_mass, n, total * pow(n / 5, 0.56) * pow(c / 3, 0.42) AS score FROM s)
"""


@query(_CORE + """, w AS (SELECT *, CASE WHEN lag(score) OVER x - score > 1e-2 THEN 1 ELSE 0 END AS new FROM r WHERE score > -1 AND n >= 1 WINDOW x AS (PARTITION BY scan ORDER BY score DESC, glycan)),
c2 AS (SELECT *, 1 + sum(new) OVER (PARTITION BY scan ORDER BY score DESC, glycan ROWS UNBOUNDED PRECEDING) AS grp FROM w) SELECT scan, glycan, round(peptide_mass, 4) AS peptide_mass, round(score, 5) AS score, n AS n_matched FROM c2 WHERE grp <= 3""")
def core_search(spark, d):
    """Peptide masses that compositions and their ladder peaks suggest, the best three groups of scores for each scan."""
    out = coresearch.estimate_peptide_masses(_scores(spark, d), groups=3, fragments=1)
    return out.select("scan", "glycan", F.round("peptide_mass", 4).alias("peptide_mass"), F.round("score", 5).alias("score"), "n_matched")


@query("""WITH g AS (SELECT p_partkey AS glycan, p_partkey * 187.1::DOUBLE + p_size AS gm FROM part), q AS (SELECT o_orderkey AS scan, o_totalprice - 1500.5 AS rest FROM orders WHERE o_totalprice > 1500.5)
SELECT scan, glycan, round((gm - rest) / rest * 1e6, 3) AS ppm FROM q JOIN g ON gm BETWEEN rest * (1 - 2e-4) AND rest * (1 + 2e-4) WHERE abs(gm - rest) < rest * 1e-4""")
def complement_compositions(spark, d):
    """Compositions at the mass that the precursor leaves over its peptide."""
    pairs = _precursors(spark, d).withColumn("peptide_mass", F.lit(1500.5)).filter("precursor_mass > peptide_mass")
    found = coresearch.glycans_for_peptide_mass(pairs, _glycans(spark, d), 1e-4)
    return found.select("scan", "glycan", F.round(coresearch.mass_error(F.col("glycan_mass"), F.col("rest")) * 1e6, 3).alias("ppm"))


_LADDER = """WITH p AS (SELECT o_custkey AS scan, o_totalprice AS m, max(o_totalprice / 1000) AS i FROM orders GROUP BY ALL),
a1 AS (SELECT p.scan, p.m AS s, q.m AS l, p.i + q.i AS sig, 'N' AS label FROM p JOIN p q ON p.scan = q.scan AND abs(q.m - (p.m + 9000)) <= (p.m + 9000) * 2e-3),
b1 AS (SELECT scan, s, l, max(struct_pack(sig := sig, label := label)) AS b FROM a1 GROUP BY ALL), r1 AS (SELECT scan, s, l, b.sig AS sig, b.label AS label FROM b1),
o1 AS (SELECT r.scan, r.s, q.m AS l, max(struct_pack(sig := r.sig + q.i, label := r.label || 'f')) AS b FROM r1 r JOIN p q ON r.scan = q.scan AND abs(q.m - (r.l + 4000)) <= (r.l + 4000) * 2e-3 GROUP BY ALL),
u1 AS (SELECT * FROM r1 UNION ALL SELECT scan, s, l, b.sig, b.label FROM o1),
a2 AS (SELECT r.scan, r.s, q.m AS l, max(struct_pack(sig := r.sig + q.i, label := r.label || 'H')) AS b FROM u1 r JOIN p q ON r.scan = q.scan AND abs(q.m - (r.l + 16000)) <= (r.l + 16000) * 2e-3 GROUP BY ALL),
allr AS (SELECT scan, s, 1 AS steps, sig, label FROM r1 UNION ALL SELECT scan, s, 2, b.sig, b.label FROM a2)
SELECT scan, round(s, 2) AS start_mass, max(struct_pack(a := steps, b := round(sig, 2), c := label)).a AS steps, max(struct_pack(a := steps, b := round(sig, 2), c := label)).c AS label, max(struct_pack(a := steps, b := round(sig, 2), c := label)).b AS signal FROM allr GROUP BY scan, s"""


@query(_LADDER)
def core_ladders(spark, d):
    """Runs of peaks one residue apart, from each peak the longest."""
    peaks = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("scan"), F.col("o_totalprice").alias("mass")).agg((F.first("o_totalprice") / 1000).alias("intensity"))
    out = coresearch.core_ladders(peaks, [("N", 9000.0), ("H", 16000.0)], 2e-3, optional=("f", 4000.0))
    return out.select("scan", F.round("start_mass", 2).alias("start_mass"), "steps", "label", F.round("signal", 2).alias("signal"))


@query("SELECT event_id, value FROM events WHERE value BETWEEN 10 AND 14 OR value BETWEEN 13 AND 20 OR value BETWEEN 100 AND 101 OR value BETWEEN 55.5 AND 55.7")
def interval_filter(spark, d):
    """Membership in a list of intervals that may overlap."""
    spans = spark.createDataFrame([(10.0, 14.0), (13.0, 20.0), (100.0, 101.0), (55.5, 55.7)], "low double, high double")
    return coresearch.within_intervals(table(spark, d, "events").select("event_id", "value"), "value", ["event_id"], spans, "low", "high", 1.0)


@query("""WITH r AS (SELECT event_id, event_id % 300 AS t, user_id % 12 AS dc FROM events), w AS (SELECT t, dc, list_transform(range(0, t + 1), lambda m: exp(m * ln(1 / (1 + 1.5::DOUBLE)) + lgamma(m + dc + 1) - lgamma(m + 1) - lgamma(dc + 1))) AS p FROM (SELECT DISTINCT t, dc FROM r))
SELECT event_id, round(list_sum(list_transform(range(0, t + 1), lambda m: m * p[m + 1])) / list_sum(p), 6) AS expected FROM r JOIN w USING (t, dc)""")
def expectation_correction(spark, d):
    """How many false targets to expect where few decoys were seen."""
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") % 300).alias("targets"), (F.col("user_id") % 12).alias("decoys"))
    return rows.select("event_id", F.round(fdr.expected_false(F.col("targets"), F.col("decoys"), 1.5), 6).alias("expected"))


_G = lambda x, w, m, s: f"({w} * exp(-pow(({x} - {m}) / {s}, 2) / 2) / ({s} * sqrt(2 * pi())))"
_GAMMA = lambda x, k, s: f"(exp(({k} - 1) * ln({x}) - {x} / {s} - lgamma({k}) - {k} * ln({s})))"
_CUT = lambda x, s: f"(2 * exp(-pow({x} / {s}, 2) / 2) / ({s} * sqrt(2 * pi())))"
_TARGET = f"({_G('value', 0.6, 60.0, 40.0)} + {_G('value', 0.4, 150.0, 70.0)})"
_PEPS = f"""SELECT event_id, round(0.4::DOUBLE * {_GAMMA('value', 2.5, 9.0)} / (0.4 * {_GAMMA('value', 2.5, 9.0)} + 0.6 * {_TARGET}), 6) AS separated_gamma,
round(0.4::DOUBLE * {_G('value', 1.0, 15.0, 12.0)} / (0.4 * {_G('value', 1.0, 15.0, 12.0)} + 0.6 * {_TARGET}), 6) AS separated_gaussian,
round(0.3::DOUBLE * {_CUT('value', 20.0)} / (0.3 * {_CUT('value', 20.0)} + 0.7 * {_TARGET}), 6) AS half_gaussian,
round(0.5::DOUBLE * {_G('value', 1.0, 15.0, 12.0)} * {_GAMMA('(user_id + 1)', 2.0, 30.0)} / (0.5 * {_G('value', 1.0, 15.0, 12.0)} * {_GAMMA('(user_id + 1)', 2.0, 30.0)} + 0.5 * {_TARGET} * {_G('(user_id + 1)', 1.0, 80.0, 30.0)}), 6) AS joint
FROM events"""


@query(_PEPS)
def mixture_error_probabilities(spark, d):
    """Error probabilities from gamma, Gaussian and half-Gaussian decoys, and from two scores together, for known mixtures."""
    x, other = F.col("value"), (F.col("user_id") + 1).cast("double")
    target = mixture.given_gaussians([0.6, 0.4], [60.0, 150.0], [40.0, 70.0]).density(x)
    gamma = lambda k, s, at: mixture.GammaMixture([1.0], [k], [s]).density(at)
    gauss = mixture.given_gaussians([1.0], [15.0], [12.0]).density(x)
    half = mixture.truncated_density(mixture.given_gaussians([1.0], [0.0], [20.0]), x)
    side = mixture.given_gaussians([1.0], [80.0], [30.0]).density(other)
    return table(spark, d, "events").select(
        "event_id",
        F.round(fdr.separated_pep(gamma(2.5, 9.0, x), target, 0.4), 6).alias("separated_gamma"),
        F.round(fdr.separated_pep(gauss, target, 0.4), 6).alias("separated_gaussian"),
        F.round(fdr.component_pep(half * 0.3, target * 0.7), 6).alias("half_gaussian"),
        F.round(fdr.product_pep(0.5, [gauss, gamma(2.0, 30.0, other)], [target, side]), 6).alias("joint"),
    )


@query(f"SELECT event_id, round(a / (a + b), 6) AS first, round(b / (a + b), 6) AS second FROM (SELECT event_id, {_G('value', 0.6, 60.0, 40.0)} AS a, {_G('value', 0.4, 150.0, 70.0)} AS b FROM events)")
def mixture_responsibilities(spark, d):
    """How far each component accounts for a score."""
    parts = mixture.responsibilities(mixture.given_gaussians([0.6, 0.4], [60.0, 150.0], [40.0, 70.0]), F.col("value"))
    return table(spark, d, "events").select("event_id", parts.alias("r")).select("event_id", F.round(F.col("r")[0], 6).alias("first"), F.round(F.col("r")[1], 6).alias("second"))


_REFS = "(SELECT v, min(k) AS k FROM (SELECT round(p_retailprice / 3, 3) AS v, p_partkey AS k FROM part WHERE p_size < 20) GROUP BY v)"


@query(f"""WITH n AS (SELECT event_id, value, v, k, row_number() OVER (PARTITION BY event_id ORDER BY abs(v - value), v) AS n FROM events, {_REFS} r WHERE event_id % 5 = 0) SELECT event_id, v AS nearest, k FROM n WHERE n = 1""")
def nearest_clamped(spark, d):
    """The nearest of all known scores, also beyond both ends."""
    refs = table(spark, d, "part").filter("p_size < 20").select(F.round(F.col("p_retailprice") / 3, 3).alias("nearest"), "p_partkey").groupBy("nearest").agg(F.min("p_partkey").alias("k"))
    asked = table(spark, d, "events").filter("event_id % 5 = 0").select("event_id", "value")
    return ordered.nearest_clamped(asked, refs, "value", "nearest").select("event_id", "nearest", "k")


@query(f"""WITH r AS (SELECT v, k::DOUBLE AS y FROM {_REFS}), e AS (SELECT event_id, value * 3 AS x FROM events), lo AS (SELECT event_id, x, v AS v0, y AS y0 FROM e ASOF LEFT JOIN r ON e.x >= r.v), hi AS (SELECT event_id, v AS v1, y AS y1 FROM e ASOF LEFT JOIN r ON e.x <= r.v)
SELECT event_id, round(CASE WHEN v0 IS NULL THEN y1 WHEN v1 IS NULL OR v1 = v0 THEN y0 ELSE y0 + (y1 - y0) * (x - v0) / (v1 - v0) END, 4) AS y FROM lo JOIN hi USING (event_id)""")
def interpolated_curve(spark, d):
    """A curve given by points, read between them."""
    refs = table(spark, d, "part").filter("p_size < 20").select(F.round(F.col("p_retailprice") / 3, 3).alias("v"), "p_partkey").groupBy("v").agg(F.min("p_partkey").cast("double").alias("y"))
    asked = table(spark, d, "events").select("event_id", (F.col("value") * 3).alias("x"))
    return ordered.interpolated(asked, refs, "x", "v", "y").select("event_id", F.round("y", 4).alias("y"))


_Q = """WITH k AS (SELECT value AS score, sum((user_id % 2 = 1)::INT) AS t, sum((user_id % 2 = 0)::INT) AS dc FROM events GROUP BY 1), r AS (SELECT score, sum(t) OVER w AS targets, sum(dc) OVER w AS decoys FROM k WINDOW w AS (ORDER BY score DESC)),
f AS (SELECT score, CASE WHEN targets = 0 THEN 1 ELSE decoys::DOUBLE / targets END AS fdr FROM r), q AS (SELECT score, min(fdr) OVER (ORDER BY score) AS q_value FROM f)"""


def _rated(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("value").alias("score"))
    return ev.join(fdr.q_values(ev, "score", F.col("user_id") % 2 == 0).select("score", "q_value"), "score")


@query(_Q + " SELECT event_id, round(q_value, 6) AS q_value FROM events JOIN q ON value = score WHERE q_value < 0.9")
def q_value_retention(spark, d):
    return fdr.retain_by_q(_rated(spark, d), "q_value", 0.9).select("event_id", F.round("q_value", 6).alias("q_value"))


@query(_Q + " SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY round(q_value, 6), value, event_id) AS rank FROM events JOIN q ON value = score")
def q_value_order(spark, d):
    """Matches of a scan in the order of q-value, score and id."""
    rows = _rated(spark, d).withColumn("q", F.round("q_value", 6))
    return select.ranked(rows, ["user_id"], [F.col("q").asc(), F.col("score").asc(), F.col("event_id").asc()]).select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query(_Q + """, j AS (SELECT event_type, round(q_value, 6) AS q_value FROM events JOIN q ON value = score) SELECT event_type, count(*) AS n, count_if(q_value < 0.8) AS below_080, count_if(q_value < 0.95) AS below_095, count_if(q_value < 1) AS below_100 FROM j GROUP BY 1""")
def analysis_summary(spark, d):
    """How many identifications of each kind pass each error rate."""
    rows = _rated(spark, d).withColumn("q", F.round("q_value", 6))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), *(F.count_if(F.col("q") < t).alias(name) for t, name in ((0.8, "below_080"), (0.95, "below_095"), (1.0, "below_100"))))
