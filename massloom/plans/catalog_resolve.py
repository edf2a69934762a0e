"""Annotations resolved among features: orders of a customer are features of one group, their lines the options."""

from __future__ import annotations

from pyspark.sql import functions as F

from massloom.operators import representers
from massloom.plans.inputs import days, registrar
from massloom.session import table

CATALOG: dict = {}
query = registrar(CATALOG)
ROUNDS = 5
THRESHOLD = 10.0


def _features(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("feature"), days("o_orderdate"), F.col("o_totalprice").alias("signal"))
    return o.select("group", "feature", F.col("day").alias("start"), (F.col("day") + 20 + F.col("feature") % 7 * 40).alias("end"), "signal")


def _options(spark, d):
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("feature"), (F.col("l_partkey") % 5).alias("key"), (F.col("l_suppkey") % 3).alias("solution"), F.col("l_returnflag").alias("shift"), F.col("l_quantity").cast("double").alias("score")
    )
    return lines.join(_features(spark, d).select("group", "feature"), "feature")


def _assigned(spark, d):
    return representers.assign_representers(_features(spark, d), _options(spark, d), "N", 150.0, ROUNDS)


_BEGIN = """WITH feat AS (SELECT o_custkey AS grp, o_orderkey AS feature, epoch_us(o_orderdate) / 86400000000 AS a, epoch_us(o_orderdate) / 86400000000 + 20 + o_orderkey % 7 * 40 AS b, o_totalprice AS signal FROM orders),
raw AS (SELECT grp, feature, l_partkey % 5 AS key, l_suppkey % 3 AS solution, l_returnflag AS shift, l_quantity::DOUBLE AS score FROM lineitem JOIN feat ON feature = l_orderkey),
opts AS (SELECT grp, feature, key, solution, shift, max(score) AS score FROM raw GROUP BY ALL),
mk AS (SELECT *, bool_or(shift = 'N') OVER (PARTITION BY grp, key) AS seen FROM opts), ma AS (SELECT *, bool_or(seen) OVER (PARTITION BY grp, feature) AS any_seen FROM mk),
o AS MATERIALIZED (SELECT ma.grp, feature, key, solution, shift, score, a, b FROM ma JOIN feat USING (feature) WHERE seen OR NOT any_seen), wt AS MATERIALIZED (SELECT grp, key, shift, max(score) AS weight FROM o GROUP BY ALL)"""
_START = """, {p}b AS (SELECT grp, key, shift, max(score) AS weight FROM {src} GROUP BY ALL), {p}k AS (SELECT grp, key FROM {p}b GROUP BY grp, key QUALIFY row_number() OVER (PARTITION BY grp ORDER BY sum(weight) DESC, key) = 1),
{p}s AS (SELECT * FROM {p}b JOIN {p}k USING (grp, key) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY weight DESC, shift) = 1),
{p}n AS (SELECT grp, feature, key, solution, shift, weight, a, b FROM {src} JOIN {p}s USING (grp, key, shift) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY score DESC, feature, solution) = 1)"""


def _rounds() -> str:
    sql = _BEGIN + _START.format(p="r0", src="o") + ", d0 AS MATERIALIZED (SELECT *, 0 AS round FROM r0n)"
    for n in range(1, ROUNDS + 1):
        sql += f""", l{n} AS MATERIALIZED (SELECT * FROM o WHERE feature NOT IN (SELECT feature FROM d{n - 1})),
h{n} AS (SELECT DISTINCT l.*, x.shift AS other FROM l{n} l JOIN d{n - 1} x ON l.grp = x.grp AND l.key = x.key AND l.a <= x.b AND x.a <= l.b),
e{n} AS (SELECT h.grp, feature, h.key, solution, h.shift, sum(weight) AS weight, a, b FROM h{n} h JOIN wt ON wt.grp = h.grp AND wt.key = h.key AND wt.shift = h.other GROUP BY ALL),
f{n} AS (SELECT * FROM e{n} QUALIFY row_number() OVER (PARTITION BY feature ORDER BY weight DESC, key, solution, shift) = 1), g{n} AS (SELECT * FROM l{n} WHERE grp NOT IN (SELECT grp FROM f{n}))"""
        sql += _START.format(p=f"r{n}", src=f"g{n}")
        sql += f", d{n} AS MATERIALIZED (SELECT * FROM d{n - 1} UNION ALL SELECT *, {n} FROM f{n} UNION ALL SELECT *, {n} FROM r{n}n)"
    left = f"SELECT grp, feature, key, solution, shift, score AS weight, a, b, -1 AS round FROM o WHERE feature NOT IN (SELECT feature FROM d{ROUNDS}) QUALIFY row_number() OVER (PARTITION BY feature ORDER BY score DESC, key, solution, shift) = 1"
    return sql + f", assigned AS MATERIALIZED (SELECT * FROM d{ROUNDS} UNION ALL {left})"


_ROUNDS = _rounds()
_PASSING = f""", pm AS (SELECT r.grp, r.feature, r.key, r.solution, sum(r.score) AS score FROM raw r JOIN assigned x ON r.feature = x.feature AND r.key = x.key WHERE r.score >= {THRESHOLD} GROUP BY ALL),
sh AS (SELECT *, score / (sum(score) OVER (PARTITION BY feature) + 1e-6) AS share FROM pm), rp AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY share DESC, solution) AS place FROM (SELECT *, max(share) OVER (PARTITION BY feature) AS top FROM sh) WHERE top - share < 1e-5)"""


@query(_ROUNDS + " SELECT grp AS \"group\", feature, key, solution, shift, round(weight, 4) AS weight, round FROM assigned")
def resolved_annotations(spark, d):
    """One annotation for each feature, from those of the features beside it, in rounds."""
    return _assigned(spark, d).withColumn("weight", F.round("weight", 4))


@query(_ROUNDS + _PASSING + " SELECT grp AS \"group\", feature, key, solution, round(share, 6) AS share, place FROM rp")
def representative_solutions(spark, d):
    """Solutions that stand for the assigned key of a feature, by their share of its score."""
    out = representers.representers(_assigned(spark, d), _options(spark, d), THRESHOLD)
    return out.select("group", "feature", "key", "solution", F.round("share", 6).alias("share"), "place")


@query(_ROUNDS + _PASSING + f""", v AS (SELECT f.grp, f.feature, x.key, rp.solution, f.a, f.b, f.signal FROM assigned x JOIN feat f USING (feature) JOIN rp ON rp.feature = f.feature AND place = 1),
own AS (SELECT * FROM raw WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY feature ORDER BY score DESC, key, solution) = 1)
SELECT grp AS "group", key, arg_min(solution, row(a, feature, solution)) AS solution, min(a) AS start, max(b) AS "end", round(sum(signal), 2) AS signal, count(*) AS members, true AS merged FROM v GROUP BY grp, key
UNION ALL SELECT f.grp, own.key, own.solution, f.a, f.b, round(f.signal, 2), 1, false FROM assigned x JOIN feat f USING (feature) LEFT JOIN own ON own.feature = f.feature WHERE f.feature NOT IN (SELECT feature FROM v)""")
def merged_annotations(spark, d):
    """Features of one assigned key as one, where their own matches support it."""
    return representers.merged_features(_features(spark, d), _assigned(spark, d), _options(spark, d), THRESHOLD).withColumn("signal", F.round("signal", 2))


def _times(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").cast("double").alias("x1"), F.sum("l_quantity").cast("double").alias("x2"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("peptide"), days("o_orderdate"), F.col("o_totalprice").alias("y"))
    return o.join(lines, "id")


_PIPELINE_ROUNDS = 3


def _ensemble_sql() -> str:
    sql = """WITH base AS MATERIALIZED (SELECT o_orderkey AS id, o_custkey % 20 AS p, epoch_us(o_orderdate) / 86400000000 AS t, o_totalprice AS y, x1, x2, 1.0::DOUBLE AS f FROM orders
  JOIN (SELECT l_orderkey, count(*)::DOUBLE AS x1, sum(l_quantity)::DOUBLE AS x2 FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
win AS MATERIALIZED (SELECT *, unnest(range(ceil((t - 300) / 200)::BIGINT, floor((t + 300) / 200)::BIGINT + 1)) * 200.0::DOUBLE AS c FROM base), f0 AS (SELECT id, f FROM base)"""
    for n in range(_PIPELINE_ROUNDS):
        sql += f""", s{n} AS MATERIALIZED (SELECT c, p, sum(g.f) AS w, sum(g.f * x1) AS a, sum(g.f * x2) AS b, sum(g.f * y) AS y, sum(g.f * x1 * x1) AS aa, sum(g.f * x1 * x2) AS ab, sum(g.f * x2 * x2) AS bb, sum(g.f * x1 * y) AS ay, sum(g.f * x2 * y) AS bz FROM win JOIN f{n} g USING (id) WHERE g.f > 0 GROUP BY ALL),
z{n} AS (SELECT c, sum(aa - a * a / w) + 1 AS aa, sum(ab - a * b / w) AS ab, sum(bb - b * b / w) + 1 AS bb, sum(ay - a * y / w) AS ay, sum(bz - b * y / w) AS bz FROM s{n} GROUP BY c),
k{n} AS MATERIALIZED (SELECT c, (bb * ay - ab * bz) / (aa * bb - ab * ab) AS u, (aa * bz - ab * ay) / (aa * bb - ab * ab) AS v FROM z{n}),
p{n} AS (SELECT id, sum((s.y / s.w - u * s.a / s.w - v * s.b / s.w + u * x1 + v * x2) * (1 - abs(t - c) / 301.5)) / sum(1 - abs(t - c) / 301.5) AS predicted, count(*) AS models FROM win JOIN k{n} USING (c) JOIN (SELECT c, p, w, a, b, y FROM s{n}) s USING (c, p) GROUP BY id),
j{n} AS MATERIALIZED (SELECT id, base.y - predicted AS residual, predicted, models, g.f FROM base JOIN f{n} g USING (id) LEFT JOIN p{n} USING (id)), t{n} AS (SELECT sqrt(sum(f * residual * residual) / sum(f)) AS scale FROM j{n} WHERE residual IS NOT NULL),
r{n} AS MATERIALIZED (SELECT *, coalesce(abs(residual) <= scale * 1.8, false) AS covered FROM j{n}, t{n}), f{n + 1} AS (SELECT id, CASE WHEN covered THEN 1.0 ELSE 0.1 END::DOUBLE AS f FROM r{n})"""
    return sql + f" SELECT id, round(predicted, 3) AS predicted, coalesce(models, 0) AS models, round(residual, 3) AS residual, f AS factor, covered FROM r{_PIPELINE_ROUNDS - 1}"


@query(_ensemble_sql())
def elution_ensemble(spark, d):
    """Retention models of overlapping windows, refitted with less weight on what does not follow them."""
    from massloom.operators import windows

    columns = {"x1": F.col("x1"), "x2": F.col("x2")}
    _, out = windows.refitted(_times(spark, d), ["id"], ["peptide"], columns, F.col("y"), "day", 600.0, 200.0, penalty=1.0, cutoff=1.8, least_weight=0.1, rounds=_PIPELINE_ROUNDS)
    return out.withColumn("predicted", F.round("predicted", 3)).withColumn("residual", F.round("residual", 3))


@query()
def multivariate_posteriors(spark, d):
    """The probability of the true class from two scores together, decoys known to be false."""
    from massloom.operators import densities

    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.log("l_extendedprice") + F.when(F.col("l_suppkey") % 3 == 0, 1.0).otherwise(0.0)).alias("a"), (F.col("l_quantity") + F.when(F.col("l_suppkey") % 3 == 0, 15.0).otherwise(0.0)).alias("b"), (F.col("l_suppkey") % 3 == 1).alias("is_decoy")
    )
    model = densities.product_kernels(rows, ["a", "b"], F.col("is_decoy"), F.when(F.col("b") > 40, 0.8).otherwise(0.2))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(model.posterior(), 6).alias("posterior"))


def _peptides(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("peptide"), (1000.0 + F.col("c_custkey") * 60.3).alias("peptide_mass"))


def _peptide_fragments(spark, d):
    made = F.array(*(F.struct(F.lit(k).alias("fragment"), (F.col("peptide_mass") * k / 9 + 1).alias("fragment_mass"), F.lit("by"[k % 2]).alias("series")) for k in range(1, 9)))
    return _peptides(spark, d).select("peptide", F.explode(made).alias("f")).select("peptide", "f.*")


def _predicted(spark, d):
    from massloom.plans import catalog_rates as core
    from massloom.plans import predictive

    return predictive.predicted_candidates(core._precursors(spark, d), core._peaks(spark, d), core._glycans(spark, d), core._shifts(spark, d), _peptides(spark, d), core.TOLERANCE, 1e-3, 10.0, 3, 1000.0)


def _scored(spark, d):
    from massloom.plans import catalog_rates as core
    from massloom.plans import predictive

    return predictive.score_predicted(core._peaks(spark, d), _predicted(spark, d), _peptide_fragments(spark, d), 1e-2)


def _predictive_sql() -> str:
    from massloom.plans.catalog_rates import _CORE

    return _CORE + """, wg AS (SELECT *, CASE WHEN lag(score) OVER x - score > 1e-2 THEN 1 ELSE 0 END AS new FROM r WHERE score > -1 AND n >= 1 WINDOW x AS (PARTITION BY scan ORDER BY score DESC, glycan)),
est AS (SELECT * FROM (SELECT *, 1 + sum(new) OVER (PARTITION BY scan ORDER BY score DESC, glycan ROWS UNBOUNDED PRECEDING) AS grp FROM wg) WHERE grp <= 3),
pep AS (SELECT c_custkey AS peptide, 1000.0::DOUBLE + c_custkey * 60.3::DOUBLE AS mass FROM customer),
cd AS MATERIALIZED (SELECT scan, glycan, peptide, pep.mass, est.score AS glycan_score FROM est JOIN pep ON abs(pep.mass - est.peptide_mass) <= est.peptide_mass * 1e-3),
pf AS (SELECT scan, glycan, peptide, k, mass * k / 9 + 1 AS fm FROM cd, (SELECT unnest(range(1, 9)) AS k)),
pm AS (SELECT f.scan, glycan, peptide, k, fm, q.mass AS found, q.intensity FROM pf f JOIN q ON q.scan = f.scan AND abs(q.mass - fm) <= fm * 1e-2),
ps AS (SELECT scan, glycan, peptide, sum(log10(intensity) * (1 - pow(abs((found - fm) / fm) / 1e-2, 4))) * count(DISTINCT k) / 8 AS peptide_score FROM pm GROUP BY ALL),
sc AS (SELECT scan, glycan, peptide, peptide_score, glycan_score, peptide_score + glycan_score AS score FROM cd JOIN ps USING (scan, glycan, peptide))"""


@query(_predictive_sql() + " SELECT scan, glycan, peptide, round(mass, 3) AS peptide_mass, round(glycan_score, 5) AS glycan_score FROM cd")
def predicted_candidates(spark, d):
    """Peptides at the masses that each scan's ladder peaks suggest."""
    out = _predicted(spark, d)
    return out.withColumn("peptide_mass", F.round("peptide_mass", 3)).withColumn("glycan_score", F.round("glycan_score", 5))


@query(_predictive_sql() + " SELECT scan, glycan, peptide, round(peptide_score, 4) AS peptide_score, round(glycan_score, 4) AS glycan_score, round(score, 4) AS score FROM sc")
def predictive_scores(spark, d):
    """Candidates made for each scan, scored in that scan only."""
    out = _scored(spark, d)
    return out.select("scan", "glycan", "peptide", *(F.round(c, 4).alias(c) for c in ("peptide_score", "glycan_score", "score")))


@query(_predictive_sql() + """, bs AS (SELECT scan, glycan, peptide, round(score, 4) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY scan ORDER BY round(score, 4) DESC, peptide, glycan) = 1),
kc AS (SELECT score, sum((peptide % 3 > 0)::INT) AS t, sum((peptide % 3 = 0)::INT) AS dc FROM bs GROUP BY 1), rc AS (SELECT score, sum(t) OVER z AS t, sum(dc) OVER z AS dc FROM kc WINDOW z AS (ORDER BY score DESC)),
qv AS (SELECT score, min(CASE WHEN t = 0 THEN 1 ELSE dc::DOUBLE / t END) OVER (ORDER BY score) AS q FROM rc) SELECT scan, glycan, peptide, score, round(q, 6) AS q_value FROM bs JOIN qv USING (score) WHERE peptide % 3 > 0 AND q <= 0.5""")
def glycopeptide_analysis(spark, d):
    """From peaks and precursors to identified glycopeptides with error rates, by predictive search."""
    from massloom.plans import predictive

    return predictive.identified_glycopeptides(_scored(spark, d), F.col("peptide") % 3 == 0, 4, 0.5).withColumn("q_value", F.round("q_value", 6))
