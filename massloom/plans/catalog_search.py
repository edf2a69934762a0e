"""Localisation, isotopic fits, rescoring, whole profile analyses and multipart rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from massloom.operators import localise, rescoring, spectrum
from massloom.plans import profile, search
from massloom.plans.catalog_tandem import _SQL, _WHOLE_SQL, PRECURSOR_TOLERANCE, _all_matches, _folded, _fragments, _matches, _peaks, _precursors, _structures
from massloom.plans.inputs import days, registrar
from massloom.session import Scratch, table

CATALOG: dict = {}
query = registrar(CATALOG)

_DEPTH_SQL = """, rk AS (SELECT scan, mass, intensity, row_number() OVER (PARTITION BY scan, floor(mass / 100) ORDER BY intensity DESC, mass) AS depth FROM (SELECT DISTINCT scan, mass, intensity FROM peaks)),
md AS (SELECT m.scan, m.structure, depth FROM m JOIN rk ON m.scan = rk.scan AND m.mass = rk.mass AND m.intensity = rk.intensity), th AS (SELECT structure, count(*) AS n FROM frags GROUP BY 1),
kk AS (SELECT scan, structure, d, any_value(n) AS n, least(sum((depth <= d)::INT)::BIGINT, any_value(n)) AS k FROM md JOIN th USING (structure), range(1, 11) g(d) GROUP BY ALL),
ds AS (SELECT scan, structure, d AS depth, CASE WHEN k = 0 THEN 0 ELSE -10 * log10(greatest(list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(d / 100) + (n - i) * ln(1 - d / 100)))), 1e-300)) END AS score FROM kk),
ws AS (SELECT scan, structure, sum(score * [0.5, 0.75, 1, 1, 1, 1, 0.75, 0.5, 0.25, 0.25][depth]) / 10 AS score FROM ds GROUP BY ALL)
"""


def _depths(spark, d, m):
    """Depth scores of the matches ``m``, each with the depth of its peak."""
    m = Scratch(spark, "depths").keep(m.select("scan", "structure", "mass", "intensity", "copies"), "matches")
    ranked = localise.window_ranks(_peaks(spark, d).join(m.select("scan").distinct(), "scan", "left_semi").distinct())
    rows = m.join(ranked, ["scan", "mass", "intensity"])
    return localise.depth_scores(rows, _fragments(spark, d).groupBy("structure").agg(F.count("*").alias("n")))


@query(_WHOLE_SQL + _DEPTH_SQL + "SELECT scan, structure, round(score, 4) AS score FROM ws")
def localisation_scores(spark, d):
    """Binomial scores of isoforms over all peak depths."""
    return localise.weighted_scores(_depths(spark, d, _all_matches(spark, d))).withColumn("score", F.round("score", 4))


@query(_SQL + _DEPTH_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY round(score, 9) DESC, structure) AS z FROM ws), p AS (SELECT scan, max(CASE WHEN z = 1 THEN structure END) AS best, max(CASE WHEN z = 2 THEN structure END) AS second FROM r GROUP BY 1)
SELECT p.scan, best, second, round(max(a.score - b.score), 4) AS difference FROM p JOIN ds a ON a.scan = p.scan AND a.structure = best LEFT JOIN ds b ON b.scan = p.scan AND b.structure = second AND b.depth = a.depth GROUP BY ALL""")
def told_apart(spark, d):
    """What tells the two best isoforms of a spectrum apart."""
    scores = Scratch(spark, "depths").keep(_depths(spark, d, _matches(spark, d)).withColumn("score", F.round("score", 10)), "scores")
    return localise.told_apart(scores).select("scan", "best", "second", F.round("difference", 4).alias("difference"))


@query("""WITH r AS (SELECT l_partkey AS k, l_quantity AS w, [l_quantity, l_linenumber::DOUBLE, l_discount * 100] AS o, [30.0::DOUBLE, 4.0, 5.0] AS e FROM lineitem), n AS (SELECT k, w, list_transform(o, lambda v: v / list_sum(o)) AS o, list_transform(e, lambda v: v / list_sum(e)) AS e FROM r),
g AS (SELECT k, w, list_sum(list_transform([1, 2, 3], lambda i: CASE WHEN o[i] > 0 THEN 2 * o[i] * ln(o[i] / e[i]) ELSE 0 END)) AS g FROM n) SELECT k, round(greatest(1 - sum(g * w) / sum(w), 1e-6), 6) AS score FROM g GROUP BY 1""")
def isotopic_scores(spark, d):
    """How well isotope envelopes agree with what they should be."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("k"), F.col("l_quantity").alias("w"), F.array("l_quantity", F.col("l_linenumber").cast("double"), F.col("l_discount") * 100).alias("o"), F.array(F.lit(30.0), F.lit(4.0), F.lit(5.0)).alias("e")
    )
    return localise.isotopic_scores(rows, ["k"], "o", "e", "w").withColumn("score", F.round("score", 6))


_SUM = """WITH t AS (SELECT quantile_cont(l_quantity, 0.3) AS t FROM lineitem), p AS (SELECT row_number() OVER () AS id, l_extendedprice AS m, epoch_us(l_shipdate) / 86400000000 AS x, l_quantity AS i, l_orderkey * 10 + l_linenumber AS peak FROM lineitem, t WHERE l_quantity >= t),
a AS (SELECT *, CASE WHEN m - lag(m) OVER w <= m * 2e-6 THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (ORDER BY m, x, peak)), b AS (SELECT *, sum(new) OVER (ORDER BY m, x, peak ROWS UNBOUNDED PRECEDING) AS trace FROM a),
c AS (SELECT *, CASE WHEN x - lag(x) OVER w > 400 THEN 1 ELSE 0 END AS cut FROM b WINDOW w AS (PARTITION BY trace ORDER BY x, peak)), e AS (SELECT *, sum(cut) OVER (PARTITION BY trace ORDER BY x, peak ROWS UNBOUNDED PRECEDING) AS piece FROM c)
SELECT round(sum(m * i) / sum(i), 7) AS mass, min(x) AS "start", max(x) AS "end", sum(i) AS signal, count(*) AS points FROM e GROUP BY trace, piece HAVING count(*) >= 2"""


@query(_SUM)
def feature_summary(spark, d):
    """From peaks to features: threshold, traces of near masses, pieces between gaps."""
    peaks = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("peak"), F.col("l_extendedprice").alias("mass"), days("l_shipdate").alias("time"), F.col("l_quantity").alias("intensity"))
    return profile.summarise(peaks, 0.3, 2e-6, 400.0, 2).withColumn("mass", F.round("mass", 7))


_FEAT = "(SELECT o_orderkey AS id, o_totalprice / 100 AS mass, o_totalprice AS signal FROM orders)"
_ACC = f"""WITH m AS (SELECT f.*, s.name AS shift, p_partkey AS composition, (p_retailprice - (mass - s.m)) / (mass - s.m) AS error FROM {_FEAT} f, (VALUES ('Unmodified', 0.0::DOUBLE), ('Ammonium', 17.0265::DOUBLE)) s(name, m) JOIN part ON p_retailprice BETWEEN (mass - s.m) * (1 - 4e-5) AND (mass - s.m) * (1 + 4e-5) WHERE abs(p_retailprice - (mass - s.m)) <= (mass - s.m) * 2e-5),
r AS (SELECT f.id, f.mass, f.signal, m.shift, m.composition, m.error, round(log10(f.signal) / 6 - coalesce(abs(m.error) * 1e4, 1), 9) AS score FROM {_FEAT} f LEFT JOIN m ON m.id = f.id),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, abs(error) NULLS LAST, composition NULLS LAST, shift NULLS LAST) AS n FROM r), acc AS (SELECT * FROM b WHERE n = 1 AND score >= -0.5)"""


def _accepted(spark, d):
    features = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100).alias("mass"), F.col("o_totalprice").alias("signal"))
    compositions = table(spark, d, "part").select(F.col("p_partkey").alias("composition"), F.col("p_retailprice").alias("composition_mass"))
    score = F.round(F.log10("signal") / 6 - F.coalesce(F.abs("error") * 1e4, F.lit(1.0)), 9)
    return profile.profile_search(features, compositions, [("Unmodified", 0.0), ("Ammonium", 17.0265)], 2e-5, score, -0.5)


@query(_ACC + " SELECT id, shift, composition, round(score, 4) AS score FROM acc")
def profile_search(spark, d):
    """Features matched to compositions under mass shifts, scored and accepted."""
    return _accepted(spark, d).select("id", "shift", "composition", F.round("score", 4).alias("score"))


@query(_ACC + """, o AS (SELECT composition, max(score) AS s FROM acc WHERE composition IS NOT NULL GROUP BY 1), n AS (SELECT p_partkey AS id, s AS observed, coalesce(s, 0) AS v FROM part LEFT JOIN o ON composition = p_partkey),
e AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part) UNION ALL SELECT p_partkey + 1, p_partkey FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)),
x AS (SELECT n.id, ((observed IS NOT NULL)::INT * coalesce(observed, 0) + 0.5 * sum(m.v)) / ((observed IS NOT NULL)::INT + 0.5 * count(*)) AS smooth FROM n JOIN e ON e.a = n.id JOIN (SELECT id, v FROM n) m ON m.id = e.b GROUP BY n.id, observed)
SELECT acc.id, composition, round(score + 0.5 * coalesce(smooth, 0), 4) AS smoothed FROM acc LEFT JOIN x ON x.id = composition""")
def smoothed_profile_search(spark, d):
    """The same with scores smoothed over a network of compositions."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    edges = part.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1.0).alias("weight")).join(part.select(F.col("id").alias("b")), "b", "left_semi")
    out = profile.smoothed_search(_accepted(spark, d), part.withColumn("composition", F.col("id")), edges, 0.5, 1, 0.5)
    return out.select("id", "composition", F.round("smoothed", 4).alias("smoothed"))


_DEC = _SQL + """, near AS (SELECT o_orderkey AS scan, structure FROM orders, structs WHERE abs(1000.0::DOUBLE + 37.5 * regexp_extract(structure, '(\\d+)', 1)::INT - (1000.0::DOUBLE + o_totalprice % 1000)) <= (1000.0::DOUBLE + o_totalprice % 1000) * 0.1),
tm AS (SELECT e.* FROM everything e JOIN near USING (scan, structure)),
dm AS (SELECT f.structure, p.scan, p.mass, p.intensity FROM (SELECT structure, fragment_mass + 0.037 AS fm FROM frags) f JOIN peaks p ON abs(p.mass - fm) <= fm * 2e-5 JOIN near ON near.scan = p.scan AND near.structure = f.structure),
s AS (SELECT scan, structure, round(sum(log10(intensity)), 4) AS score, false AS dc FROM tm GROUP BY ALL UNION ALL SELECT scan, structure, round(sum(log10(intensity)), 4), true FROM dm GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY scan, dc ORDER BY score DESC, structure) AS n FROM s), k AS (SELECT score, sum((NOT dc)::INT) AS a, sum(dc::INT) AS b FROM best WHERE n = 1 GROUP BY 1),
r AS (SELECT score, (sum(a) OVER w)::BIGINT AS targets, (sum(b) OVER w)::BIGINT AS decoys FROM k WINDOW w AS (ORDER BY score DESC)), q AS (SELECT *, CASE WHEN targets = 0 THEN 1 ELSE decoys::DOUBLE / targets END AS fdr FROM r)
SELECT score, targets, decoys, round(min(fdr) OVER (ORDER BY score), 6) AS q_value FROM q"""


@query(_DEC)
def compared_search(spark, d):
    """Target and decoy fragments searched apart, each with its own best match for a scan."""
    targets = _folded(spark, d)
    decoys = targets.withColumn("fragment_mass", F.col("fragment_mass") + 0.037)
    score = lambda m: m.groupBy("scan", "structure").agg(F.round(F.sum(F.log10("intensity") * F.col("copies")), 4).alias("score"))
    structures = _structures(spark, d)
    _, rates = search.compared_search(_precursors(spark, d), _peaks(spark, d), (structures, targets), (structures, decoys), score, PRECURSOR_TOLERANCE)
    return rates.select("score", "targets", "decoys", F.round("q_value", 6).alias("q_value"))


def _rate_sql(name, score, where, decoy):
    return f"""{name}k AS (SELECT {score} AS score, sum((NOT {decoy})::INT) AS a, sum(({decoy})::INT) AS b FROM base WHERE {where} GROUP BY 1), {name}r AS (SELECT score, sum(a) OVER w AS t, sum(b) OVER w AS dc FROM {name}k WINDOW w AS (ORDER BY score DESC)),
{name} AS (SELECT score, min(CASE WHEN t = 0 THEN 1 ELSE dc::DOUBLE / t END) OVER (ORDER BY score) AS q FROM {name}r)"""


_MULTI = f"""WITH base AS (SELECT event_id, round(value, 1) AS peptide, round(user_id + value / 10, 1) AS glycan, round(value * 1.1 + user_id, 1) AS total, event_id % 4 AS kind FROM events),
{_rate_sql("p", "peptide", "kind IN (0, 1, 3)", "kind IN (1, 3)")}, {_rate_sql("g", "glycan", "kind IN (0, 2, 3)", "kind IN (2, 3)")}, {_rate_sql("a", "total", "kind IN (0, 3)", "kind = 3")}
SELECT event_id, round(coalesce(p.q, 1), 6) AS peptide_q, round(coalesce(g.q, 1), 6) AS glycan_q, round(least(1, greatest(coalesce(p.q, 1), coalesce(g.q, 1), coalesce(p.q, 1) + coalesce(g.q, 1) - coalesce(a.q, 1))), 6) AS total_q_value
FROM base LEFT JOIN p ON p.score = peptide LEFT JOIN g ON g.score = glycan LEFT JOIN a ON a.score = total"""


@query(_MULTI)
def multipart_rates(spark, d):
    """Error rates of peptide, glycan and both, from decoys that are false in one part or in both."""
    kind = F.col("event_id") % 4
    parts = F.array_compact(F.array(F.when(kind.isin(1, 3), "peptide"), F.when(kind.isin(2, 3), "glycan")))
    ev = table(spark, d, "events")
    rows = ev.select("event_id", F.round("value", 1).alias("peptide"), F.round(F.col("user_id") + F.col("value") / 10, 1).alias("glycan"), F.round(F.col("value") * 1.1 + F.col("user_id"), 1).alias("total"), parts.alias("kind"))
    out = search.multipart_rates(rows, ["peptide", "glycan"], "kind")
    return out.select("event_id", F.round("peptide_q", 6).alias("peptide_q"), F.round("glycan_q", 6).alias("glycan_q"), F.round("total_q_value", 6).alias("total_q_value"))


@query(_WHOLE_SQL + """, u AS (SELECT scan, structure, used / total AS u FROM (SELECT scan, structure, sum(intensity) AS used FROM (SELECT DISTINCT scan, structure, mass, intensity FROM m) GROUP BY ALL) JOIN (SELECT scan, sum(intensity) AS total FROM peaks GROUP BY 1) USING (scan)), b AS (SELECT scan, max(u) AS best FROM u GROUP BY 1)
SELECT scan, structure FROM u JOIN b USING (scan) WHERE u >= 0.85 * best""")
def utilisation_preserved(spark, d):
    """Annotations that explain nearly as much of a spectrum as its best one."""
    u = spectrum.signal_utilisation(_all_matches(spark, d), _peaks(spark, d))
    best = u.groupBy("scan").agg(F.max("utilisation").alias("best"))
    return u.join(best, "scan").filter("utilisation >= 0.85 * best").select("scan", "structure")


@query(_SQL + """, sc AS (SELECT scan, structure, sum(log10(intensity)) AS score FROM m GROUP BY ALL), chosen AS (SELECT scan, max(struct_pack(a := score, s := structure)).s AS structure FROM sc GROUP BY 1), near_by AS (SELECT DISTINCT c.scan // 1000 AS run, structure FROM chosen c)
SELECT sc.scan, structure, round(score, 4) AS score FROM sc JOIN near_by w USING (structure) WHERE w.run = sc.scan // 1000 AND NOT EXISTS (SELECT 1 FROM chosen x WHERE x.scan = sc.scan AND x.structure = sc.structure)""")
def back_filled_matches(spark, d):
    """Structures chosen somewhere in a group of scans, scored in those where another was chosen."""
    scored = _matches(spark, d).groupBy("scan", "structure").agg(F.sum(F.log10("intensity") * F.col("copies")).alias("score"))
    chosen = scored.groupBy("scan").agg(F.max(F.struct("score", "structure")).alias("b")).select("scan", "b.structure")
    run = F.floor(F.col("scan") / 1000).alias("run")
    wanted = chosen.select(run, "structure").distinct()
    missing = scored.join(chosen, ["scan", "structure"], "left_anti").select("*", run)
    return missing.join(wanted, ["run", "structure"], "left_semi").select("scan", "structure", F.round("score", 4).alias("score"))


@query(_SQL + "SELECT structure, count(DISTINCT fragment) AS seen, (SELECT count(*) FROM frags f WHERE f.structure = m.structure AND f.series = 'Y') AS possible, round(count(DISTINCT fragment)::DOUBLE / (SELECT count(*) FROM frags f WHERE f.structure = m.structure AND f.series = 'Y'), 6) AS coverage FROM m WHERE series = 'Y' GROUP BY structure")
def glycan_fragment_coverage(spark, d):
    """How many of a composition's own fragments are seen."""
    f = _fragments(spark, d).filter("series = 'Y'")
    seen = _matches(spark, d, "series").filter("series = 'Y'").select("structure", "fragment", "names").distinct().groupBy("structure").agg(F.sum("names").alias("seen"))
    rows = seen.join(f.groupBy("structure").agg(F.count("*").alias("possible")), "structure")
    return rows.withColumn("coverage", F.round(F.col("seen") / F.col("possible"), 6))


@query()
def rescored_matches(spark, d):
    """Scores learned by a support vector machine from the best targets and all decoys."""
    line = table(spark, d, "lineitem")
    rows = line.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", (F.col("l_suppkey") % 2 == 0).alias("is_decoy"), (F.col("l_quantity") + F.when(F.col("l_suppkey") % 2 == 1, 20.0).otherwise(0.0)).alias("start"))
    out = rescoring.semi_supervised(rows, ["l_quantity", "l_discount", "start"], "is_decoy", "start", rounds=2, train_fdr=0.05)
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice", F.round("svm_score", 6).alias("svm_score"))


@query()
def class_posteriors(spark, d):
    """Two classes told apart by kernel densities on a grid."""
    rows = table(spark, d, "events").select("event_id", F.log1p("value").alias("x"), F.when(F.col("user_id") % 2 == 0, 0.8).otherwise(0.2).alias("p"))
    return rescoring.two_class_density(rows, "x", "p").select("event_id", F.round("posterior", 6).alias("posterior"))


@query("SELECT c_custkey, o_orderkey, c_name FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_name IN ('Customer#000000001', 'Customer#000000007', 'Customer#000000011')")
def named_lookup(spark, d):
    """Rows of the records that names ask for."""
    names = spark.createDataFrame([(f"Customer#{n:09d}",) for n in (1, 7, 11)], "c_name string")
    wanted = table(spark, d, "customer").select("c_custkey", "c_name").join(names, "c_name", "left_semi")
    return wanted.join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey", "o_orderkey", "c_name")


@query("SELECT l_orderkey, bit_or(CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 2 ELSE 4 END)::INT AS flags, list(l_linenumber ORDER BY l_shipdate, l_linenumber, l_partkey)[1] AS first_line, count(*) FILTER (l_quantity > 25) > 0 AS strong FROM lineitem GROUP BY 1")
def match_flags(spark, d):
    """What is true of any match of a scan, as bits, and its matches in the order of time."""
    flag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(4)
    bundle = F.array_sort(F.collect_list(F.struct("l_shipdate", "l_linenumber", "l_partkey")))[0]["l_linenumber"]
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bit_or(flag).alias("flags"), bundle.alias("first_line"), (F.count_if(F.col("l_quantity") > 25) > 0).alias("strong"))
