"""Retention-time models, state models, site models and peak shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from massloom.functions import states
from massloom.operators import elution, fits, priors, regress, sites
from massloom.plans.inputs import EVENTS_SQL, days, events, registrar
from massloom.session import table

CATALOG: dict = {}
query = registrar(CATALOG)


@query("""WITH g AS (SELECT l_suppkey AS k, count(*) AS n, avg(l_quantity) AS x, avg(l_linenumber) AS z, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1),
s AS (SELECT sum((l_quantity - x) * (l_quantity - x)) AS xx, sum((l_quantity - x) * (l_linenumber - z)) AS xz, sum((l_linenumber - z) * (l_linenumber - z)) AS zz, sum((l_quantity - x) * (l_extendedprice - y)) AS xy, sum((l_linenumber - z) * (l_extendedprice - y)) AS zy FROM lineitem JOIN g ON l_suppkey = k),
b AS (SELECT (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b2 FROM s)
SELECT k AS peptide, round(y - b1 * x - b2 * z, 3) AS intercept, round(b1, 5) AS per_quantity, round(b2, 5) AS per_line FROM g, b""")
def elution_by_peptide(spark, d):
    """Times by peptide and residue counts: an intercept for each peptide, common slopes."""
    rows = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "peptide")
    model = elution.fit_within(rows, ["peptide"], {"q": F.col("l_quantity"), "n": F.col("l_linenumber")}, F.col("l_extendedprice"))
    b1, b2 = map(float, model.slopes)
    return model.intercepts.select("peptide", F.round("intercept", 3).alias("intercept"), F.round(F.lit(b1), 5).alias("per_quantity"), F.round(F.lit(b2), 5).alias("per_line"))


@query("""WITH r AS (SELECT l_suppkey AS p, l_returnflag AS run, log10(l_extendedprice) AS w, l_quantity AS x, l_extendedprice AS y FROM lineitem), g AS (SELECT p, run, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM r GROUP BY ALL),
b AS (SELECT sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS b FROM r JOIN g USING (p, run)) SELECT p AS peptide, run, round(my - b * mx + b * 10, 2) AS at_ten FROM g, b""")
def elution_by_run(spark, d):
    """The same over several runs, weighted by log signal, read at a count of ten."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("peptide"), F.col("l_returnflag").alias("run"), "l_quantity", "l_extendedprice")
    model = elution.fit_within(rows, ["peptide", "run"], {"q": F.col("l_quantity")}, F.col("l_extendedprice"), F.log10("l_extendedprice"))
    asked = rows.select("peptide", "run").distinct()
    return model.predict(asked, {"q": F.lit(10.0)}).select("peptide", "run", F.round("predicted", 2).alias("at_ten"))


@query("""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) * count(*) AS sxx FROM lineitem), v AS (SELECT sum(pow(l_extendedprice - a - b * l_quantity, 2)) / (any_value(n) - 2) AS s2 FROM lineitem, f)
SELECT q AS quantity, round(2 * sqrt(s2 * (1 / n + pow(q - m, 2) / sxx)), 3) AS half_width FROM f, v, (SELECT DISTINCT l_quantity AS q FROM lineitem)""")
def fitted_intervals(spark, d):
    """How well a fitted line is known at each place."""
    rows = table(spark, d, "lineitem")
    model = regress.fit_linear(rows, {"q": F.col("l_quantity")}, F.col("l_extendedprice"))
    return rows.select(F.col("l_quantity").alias("quantity")).distinct().select("quantity", F.round(elution.fitted_half_width(model, {"q": F.col("quantity")}, 2.0), 3).alias("half_width"))


@query()
def robust_line(spark, d):
    """The line that most points lie near."""
    rows = table(spark, d, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber", "l_extendedprice").alias("i"), "l_quantity", "l_extendedprice")
    a, b = elution.robust_line(rows, "i", "l_quantity", "l_extendedprice", trials=50)
    return spark.createDataFrame([(round(a, 2), round(b, 4))], "intercept double, slope double")


_ORD = "(SELECT o_custkey AS g, o_orderkey AS id, o_orderkey % 3 AS h, o_orderkey % 5 AS f, epoch_us(o_orderdate) / 86400000000 AS t, log10(o_totalprice) AS w, o_totalprice FROM orders)"


def _orders(spark, d):
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("g"), key.alias("id"), (key % 3).alias("h"), (key % 5).alias("f"), days("o_orderdate").alias("t"), F.log10("o_totalprice").alias("w"), "o_totalprice")


@query(f"""SELECT residue, round(sum(dt * w) / sum(w), 4) AS shift, count(*) AS pairs FROM (SELECT 'h' AS residue, b.t - a.t AS dt, a.w + b.w AS w FROM {_ORD} a JOIN {_ORD} b ON a.g = b.g AND b.h = a.h + 1 AND b.f = a.f
UNION ALL SELECT 'f', b.t - a.t, a.w + b.w FROM {_ORD} a JOIN {_ORD} b ON a.g = b.g AND b.f = a.f + 1 AND b.h = a.h) GROUP BY 1""")
def relative_shifts(spark, d):
    """How one residue more moves a feature of the same peptide."""
    return elution.relative_shifts(_orders(spark, d), "g", ["h", "f"], "t", F.col("w")).select("residue", F.round("shift", 4).alias("shift"), "pairs")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 50 - epoch_us(l_shipdate) / 86400000000 AS res, log10(l_quantity + 1) AS w, l_returnflag FROM lineitem), m AS (SELECT l_linenumber, sum(res * w) / sum(w) AS mean FROM r WHERE l_returnflag = 'A' GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, round(res - mean, 4) AS delta FROM r JOIN m USING (l_linenumber)""")
def recalibrated_times(spark, d):
    """Predicted less observed times relative to reference points."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", (F.col("l_extendedprice") / 50).alias("predicted"), days("l_shipdate").alias("t"), (F.col("l_quantity") + 1).alias("signal"))
    out = elution.recalibrated(rows, rows.filter("l_returnflag = 'A'"), "t", "predicted", "signal", keys=["l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("delta", 4).alias("delta"))


_RULES = [("more h", {"h": 1, "f": -1}), ("more f", {"h": -1, "f": 1}), ("two f", {"f": 2})]
_REV = f"""WITH o AS (SELECT id, h, f, t % 30 AS t FROM {_ORD}), c AS (SELECT id, t, 0 AS nth, '-' AS rule, h, f, 3 * h + 5 * f AS p0 FROM o UNION ALL SELECT id, t, 1, 'more h', h + 1, f - 1, 3 * h + 5 * f FROM o UNION ALL SELECT id, t, 2, 'more f', h - 1, f + 1, 3 * h + 5 * f FROM o UNION ALL SELECT id, t, 3, 'two f', h, f + 2, 3 * h + 5 * f FROM o),
v AS (SELECT *, exp(-abs(3 * h + 5 * f - t) / 10) AS score FROM c WHERE h >= 0 AND f >= 0 AND (nth = 0 OR (abs(3 * h + 5 * f - p0) > 0.5 AND h + f < 6))), b AS (SELECT *, max(score) OVER (PARTITION BY id) AS best, max(CASE WHEN nth = 0 THEN score END) OVER (PARTITION BY id) AS own FROM v),
e AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY nth) AS n FROM b WHERE CASE WHEN best > 0.2 AND best - own > 0.2 THEN score > best * 0.9 ELSE nth = 0 END)"""


def _revised(spark, d):
    rows = _orders(spark, d).select("id", "h", "f", (F.col("t") % 30).alias("t"))
    grid = spark.range(6).select(F.col("id").alias("h")).crossJoin(spark.range(7).select(F.col("id").alias("f"))).filter("h + f < 6")  # a fixed list of compositions
    predict = lambda c: 3.0 * c["h"] + 5.0 * c["f"]
    return elution.revised(rows, "id", ["h", "f"], _RULES, predict, lambda time: F.exp(-F.abs(time - F.col("t")) / 10), known=grid)


@query(_REV + " SELECT id, h, f, rule, round(score, 6) AS score FROM e WHERE n = 1")
def revised_annotations(spark, d):
    """Annotations that fit their time better under a rule are changed by it."""
    return _revised(spark, d).select("id", "h", "f", "rule", F.round("score", 6).alias("score"))


@query(f"""WITH o AS (SELECT h, f, t % 30 AS t FROM {_ORD}), s AS (SELECT round(exp(-abs(3 * h + 5 * f - t) / 10), 4) AS score, false AS dc FROM o UNION ALL SELECT CASE WHEN f > 0 THEN round(exp(-abs(3 * (h + 2) + 5 * (f - 1) - t) / 10), 4) ELSE 0 END, true FROM o),
k AS (SELECT score, sum((NOT dc)::INT) AS a, sum(dc::INT) AS b FROM s GROUP BY 1), r AS (SELECT score, (sum(a) OVER w)::BIGINT AS targets, (sum(b) OVER w)::BIGINT AS decoys FROM k WINDOW w AS (ORDER BY score DESC)), q AS (SELECT *, CASE WHEN targets = 0 THEN 1 ELSE decoys::DOUBLE / targets END AS fdr FROM r)
SELECT score, targets, decoys, round(min(fdr) OVER (ORDER BY score), 6) AS q_value FROM q""")
def rule_error_rates(spark, d):
    """Error rates of retention scores from features under an implausible rule."""
    rows = _orders(spark, d).select("h", "f", (F.col("t") % 30).alias("t"))
    score = lambda h, f: F.round(F.exp(-F.abs(3.0 * h + 5.0 * f - F.col("t")) / 10), 4)
    targets = rows.select(score(F.col("h"), F.col("f")).alias("score"))
    decoys = rows.select(F.when(F.col("f") > 0, score(F.col("h") + 2, F.col("f") - 1)).alias("score"))
    return elution.rule_error_rates(targets, decoys, "score").select("score", "targets", "decoys", F.round("q_value", 6).alias("q_value"))


_HOOD = "(floor(o_totalprice / 100 / 100 / 10) + 1) * 1000"


@query(f"WITH c AS (SELECT {_HOOD} AS neighbourhood, o_orderkey % 4 + 1 AS state, sum(o_totalprice) AS w FROM orders GROUP BY ALL) SELECT neighbourhood, state, round(w / sum(w) OVER (PARTITION BY neighbourhood), 6) AS frequency FROM c")
def state_model(spark, d):
    """How much of the signal each charge state has, by neighbourhood of mass."""
    rows = table(spark, d, "orders").select((F.col("o_totalprice") / 100).alias("mass"), (F.col("o_orderkey") % 4 + 1).alias("state"), "o_totalprice")
    return states.fit_states(rows, F.col("mass"), "state", F.col("o_totalprice")).select("neighbourhood", "state", F.round("frequency", 6).alias("frequency"))


@query(f"""WITH m AS (SELECT {_HOOD} AS n, o_orderkey % 4 + 1 AS s, count(*)::DOUBLE AS c FROM orders WHERE o_orderkey % 3 > 0 AND NOT (o_orderkey % 4 = 0 AND o_totalprice > 250000) GROUP BY ALL), f AS (SELECT n, s, c / sum(c) OVER (PARTITION BY n) AS f FROM m), a AS (SELECT n, avg(f) AS mean FROM f GROUP BY 1),
k AS (SELECT c_custkey AS id, (floor(max(o_totalprice) / 100 / 100 / 10) + 1) * 1000 AS n, list_distinct(list(o_orderkey % 4 + 1)) AS ss FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1), u AS (SELECT id, n, unnest(ss) AS s FROM k)
SELECT id, round(CASE WHEN max(mean) IS NULL THEN 0 ELSE greatest(least(sum(coalesce(f, mean)), 1) - 1e-6, 1e-6) END, 6) AS score FROM u LEFT JOIN a ON a.n = u.n LEFT JOIN f ON f.n = u.n AND f.s = u.s GROUP BY 1""")
def state_scores(spark, d):
    """Features scored by the states that they are seen in."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 100).alias("mass"), (F.col("o_orderkey") % 4 + 1).alias("state"))
    model = states.fit_states(o.filter("o_orderkey % 3 > 0 AND NOT (o_orderkey % 4 = 0 AND mass > 2500)"), F.col("mass"), "state")
    features = o.groupBy(F.col("o_custkey").alias("id")).agg(F.max("mass").alias("mass"), F.collect_set("state").alias("states"))
    return states.state_scores(features, "id", F.col("mass"), "states", model).select("id", F.round("score", 6).alias("score"))


@query("SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN p_size / 50 WHEN p_size > 30 THEN 0.5 ELSE p_retailprice / 1000 END AS score FROM part")
def dispatched_scores(spark, d):
    """A model chosen by what a composition is."""
    value = states.dispatched([(F.col("p_type") == "ECONOMY", F.col("p_size") / 50), (F.col("p_size") > 30, F.lit(0.5))], F.col("p_retailprice") / 1000)
    return table(spark, d, "part").select("p_partkey", value.alias("score"))


_NET = "(SELECT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, max(l_discount) + 0.01 AS w FROM lineitem WHERE l_suppkey <> l_partkey AND l_quantity > 45 GROUP BY ALL)"


def _network(spark, d):
    line = table(spark, d, "lineitem").filter("l_suppkey <> l_partkey AND l_quantity > 45")
    return line.groupBy(F.least("l_suppkey", "l_partkey").alias("a"), F.greatest("l_suppkey", "l_partkey").alias("b")).agg((F.max("l_discount") + 0.01).alias("weight"))


@query(f'WITH e AS (SELECT a, b, w FROM {_NET} UNION ALL SELECT b, a, w FROM {_NET}) SELECT a AS "row", b AS "column", round(-sum(w), 6) AS value FROM e GROUP BY ALL UNION ALL SELECT a, a, round(sum(w), 6) FROM e GROUP BY a')
def weighted_laplacian(spark, d):
    return sites.weighted_laplacian(_network(spark, d)).withColumn("value", F.round("value", 6))


def _site_inputs(spark, d):
    c = table(spark, d, "customer")
    nodes = c.select(F.col("c_nationkey").alias("site"), F.floor(F.col("c_custkey") / 25).alias("id"), F.when(F.col("c_acctbal") > 4000, F.col("c_acctbal") / 1000).alias("observed"))
    edges = nodes.select("site", F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1.0).alias("weight")).distinct()
    return nodes, edges


@query()
def smoothed_sites(spark, d):
    """A network of each site smoothed at several strengths and thresholds, the best of them kept."""
    nodes, edges = _site_inputs(spark, d)
    return sites.best_models(sites.smooth_sites(nodes, edges, "site", [0.1, 1.0], [0.0, 6.0]), "site")


@query()
def averaged_site_models(spark, d):
    """Near-best solutions averaged."""
    nodes, edges = _site_inputs(spark, d)
    return sites.averaged_models(sites.smooth_sites(nodes, edges, "site", [0.1, 0.5, 1.0], [0.0, 5.0, 6.0]), "site")


@query()
def neighbourhood_sites(spark, d):
    """Networks of sites smoothed towards the means of four neighbourhoods of compositions, two of which overlap."""
    nodes, edges = _site_inputs(spark, d)
    ids = nodes.select("id").distinct()
    members = ids.select("id", (F.col("id") % 3).alias("neighbourhood"), F.lit(1.0).alias("weight")).unionByName(ids.filter("id % 2 = 0").select("id", F.lit(3).cast("long").alias("neighbourhood"), F.lit(0.5).alias("weight")))
    nodes = priors.with_membership(nodes, priors.normalised_membership(members, "colrow"), [0, 1, 2, 3])
    return sites.best_models(sites.smooth_sites(nodes, edges, "site", [0.1, 1.0], [0.0, 6.0]), "site")


@query("""WITH m AS (SELECT l_partkey AS id, l_suppkey % 7 AS neighbourhood, sum(l_discount)::DOUBLE AS weight FROM lineitem GROUP BY ALL), c AS (SELECT id, neighbourhood, CASE WHEN sum(weight) OVER (PARTITION BY neighbourhood) = 0 THEN 0 ELSE weight / sum(weight) OVER (PARTITION BY neighbourhood) END AS weight FROM m)
SELECT id, neighbourhood, round(weight / CASE WHEN sum(weight) OVER (PARTITION BY id) = 0 THEN 1e-6 ELSE sum(weight) OVER (PARTITION BY id) END, 8) AS weight FROM c""")
def neighbourhood_membership(spark, d):
    """How far compositions belong to neighbourhoods, neighbourhoods made even first, then compositions."""
    members = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id"), (F.col("l_suppkey") % 7).alias("neighbourhood")).agg(F.sum("l_discount").cast("double").alias("weight"))
    return priors.normalised_membership(members, "colrow").withColumn("weight", F.round("weight", 8))


@query("""WITH RECURSIVE r AS (SELECT l_suppkey AS site, l_partkey AS id, sum(l_quantity)::DOUBLE AS observed FROM lineitem GROUP BY ALL), p AS (SELECT site, observed AS o, count(*) * observed * 0.01::DOUBLE AS oa FROM r WHERE observed > 0 GROUP BY site, observed),
roots AS (SELECT site, 0 AS n, max(o) + arg_max(oa, o) AS x FROM p GROUP BY site UNION ALL SELECT site, n + 1, x + (h * h - h) / s FROM (SELECT site, n, x, sum(oa / (x - o)) AS h, sum(oa / ((x - o) * (x - o))) AS s FROM roots JOIN p USING (site) WHERE n < 12 GROUP BY ALL) AS q)
SELECT site, id, observed, round(0.01 / (1 + 0.01 * count(*) OVER (PARTITION BY site)) * x / (x - observed), 8) AS share FROM r JOIN roots USING (site) WHERE n = 12""")
def composition_shares(spark, d):
    """Shares of compositions at each site, from what was observed and a small prior."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").cast("double").alias("observed"))
    return priors.composition_shares(rows, ["site"]).withColumn("share", F.round("share", 8))


@query("""WITH m AS (SELECT l_suppkey AS s, l_linenumber AS c, avg(l_quantity) AS q FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL), dm AS (SELECT l_suppkey AS s, l_linenumber AS c, avg(l_discount) AS q FROM lineitem WHERE l_linenumber < 6 GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(CASE WHEN l_orderkey % 2 = 0 THEN dm.q ELSE m.q END, 0), 6) AS prior FROM lineitem LEFT JOIN m ON m.s = l_suppkey AND m.c = l_linenumber LEFT JOIN dm ON dm.s = l_suppkey AND dm.c = l_linenumber""")
def site_priors(spark, d):
    """Each match's prior from the model of its site, targets and decoys by their own."""
    line = table(spark, d, "lineitem")
    fit = lambda rows, value: rows.groupBy("l_suppkey", "l_linenumber").agg(F.avg(value).alias("score"))
    rows = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_orderkey") % 2 == 0).alias("is_decoy"))
    out = sites.target_or_decoy_priors(rows, fit(line.filter("l_returnflag <> 'R'"), "l_quantity"), fit(line.filter("l_linenumber < 6"), "l_discount"), ["l_suppkey", "l_linenumber"], "is_decoy")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("prior", 6).alias("prior"))


@query("""WITH p AS (SELECT DISTINCT substr(p_name, 1, 8) AS peptide, p_size % 5 AS composition FROM part WHERE length(p_name) >= 8), q AS (SELECT p_partkey AS protein, p_name AS sequence FROM part), m AS (SELECT p_partkey AS protein, p_size % 5 AS composition, p_retailprice AS score FROM part)
SELECT peptide, composition::INT AS composition, max(score) AS prior FROM p JOIN q ON contains(sequence, peptide) JOIN m USING (protein, composition) GROUP BY ALL""")
def substring_priors(spark, d):
    """Priors of the proteins that a peptide stands in."""
    part = table(spark, d, "part")
    peptides = part.filter("length(p_name) >= 8").select(F.substring("p_name", 1, 8).alias("peptide"), (F.col("p_size") % 5).alias("composition")).distinct()
    models = part.select(F.col("p_partkey").alias("protein"), (F.col("p_size") % 5).alias("composition"), F.col("p_retailprice").alias("score"))
    return sites.priors_by_substring(peptides, part.select(F.col("p_partkey").alias("protein"), F.col("p_name").alias("sequence")), models)


@query(f"""WITH g AS (SELECT user_id, sum(t * value) / sum(value) AS c FROM {EVENTS_SQL} GROUP BY 1) SELECT user_id, round(sum(exp(-pow((t - c) / 50000, 2) / 2) / (50000 * sqrt(2 * pi())) * value) / sum(pow(exp(-pow((t - c) / 50000, 2) / 2) / (50000 * sqrt(2 * pi())), 2)), 0) AS amplitude
FROM {EVENTS_SQL} JOIN g USING (user_id) GROUP BY 1""")
def fixed_gaussians(spark, d):
    """The height of a peak whose place and width are given."""
    ev = events(spark, d)
    centre = ev.groupBy("user_id").agg((F.sum(F.col("t") * F.col("value")) / F.sum("value")).alias("c")).withColumn("s", F.lit(50000.0))
    return fits.fixed_gaussian(ev.join(centre, "user_id"), ["user_id"], "t", "value", "c", "s").withColumn("amplitude", F.round("amplitude", 0))


def _shapes(kind, doc):
    def run(spark, d):
        rows = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 30).alias("x"), "l_quantity")
        return fits.fitted_shapes(rows, ["l_suppkey"], "x", "l_quantity", kind).select("l_suppkey", F.round("line_score", 3).alias("line_score"), "peaks")

    run.__doc__ = doc
    run.__name__ = f"shapes_{kind}"
    return query()(run)


for _kind, _doc in (
    ("gaussian", "A Gaussian."), ("skewed", "A skewed Gaussian."), ("penalised", "A skewed Gaussian that may not run away."), ("two_sided", "A Gaussian with two widths."),
    ("peeled", "Peaks fitted and taken away, one after the other."), ("split", "Each part between minima fitted by itself."), ("best", "Whichever of these fits best."),
):
    _shapes(_kind, _doc)
