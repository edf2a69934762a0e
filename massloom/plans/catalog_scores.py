"""Scores, models and regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from massloom.functions import score
from massloom.operators import regress
from massloom.plans.inputs import days, registrar
from massloom.session import table

CATALOG: dict = {}
query = registrar(CATALOG)


def _r(column, digits=6):
    return F.round(column, digits)


@query("SELECT event_id, round(ln(x) - ln(1 - x) + ln(y) - ln(1 - y), 6) AS score, round(x * y, 6) AS product FROM (SELECT event_id, 1 / (1.5 + value) AS x, (event_id % 97 + 1) / 100.0::DOUBLE AS y FROM events)")
def logit_sum(spark, d):
    rows = table(spark, d, "events").select("event_id", (1 / (1.5 + F.col("value"))).alias("x"), ((F.col("event_id") % 97 + 1) / 100.0).alias("y"))
    return rows.select("event_id", _r(score.logit_sum([F.col("x"), F.col("y")])).alias("score"), _r(score.product([F.col("x"), F.col("y")])).alias("product"))


@query("""SELECT l_orderkey, round(sum(log10(l_extendedprice) * (1 - pow(abs(l_discount - 0.05) / 0.06, 4))), 4) AS score FROM lineitem WHERE abs(l_discount - 0.05) < 0.06 GROUP BY 1""")
def log_intensity_score(spark, d):
    rows = table(spark, d, "lineitem").filter("abs(l_discount - 0.05) < 0.06")
    return rows.groupBy("l_orderkey").agg(_r(F.sum(score.log_intensity(F.col("l_extendedprice"), F.col("l_discount") - 0.05, 0.06)), 4).alias("score"))


@query("""SELECT l_orderkey, round(lgamma(f + 1) + lgamma(b + 1) + ln(greatest(fs, 1)) + ln(greatest(bs, 1)), 4) AS score FROM
(SELECT l_orderkey, sum((l_linestatus = 'O')::INT) AS f, sum((l_linestatus = 'F')::INT) AS b, sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END) AS fs, sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0 END) AS bs FROM lineitem GROUP BY 1)""")
def hyperscore(spark, d):
    is_f = F.col("l_linestatus") == "O"
    sums = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum(is_f.cast("int")).alias("f"), F.sum((F.col("l_linestatus") == "F").cast("int")).alias("b"),
        F.sum(F.when(is_f, F.col("l_extendedprice")).otherwise(0.0)).alias("fs"), F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice")).otherwise(0.0)).alias("bs"),
    )
    return sums.select("l_orderkey", _r(score.hyperscore(F.col("f"), F.col("b"), F.col("fs"), F.col("bs")), 4).alias("score"))


@query("""WITH c AS (SELECT l_orderkey, count(*) AS n, sum((l_returnflag = 'N')::INT) AS k FROM lineitem GROUP BY 1), u AS (SELECT l_orderkey, n, k, unnest(range(k::BIGINT, n)) AS i FROM c)
SELECT c.l_orderkey, round(coalesce(sum(exp(lgamma(u.n + 1) - lgamma(i + 1) - lgamma(u.n - i + 1) + i * ln(0.3) + (u.n - i) * ln(0.7))), 0), 6) AS tail FROM c LEFT JOIN u USING (l_orderkey) GROUP BY 1""")
def binomial_tail(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum((F.col("l_returnflag") == "N").cast("int")).alias("k"))
    return c.select("l_orderkey", _r(score.binomial_tail(F.col("n"), F.col("k"), F.lit(0.3))).alias("tail"))


@query("""WITH o AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, event_type, n::DOUBLE / sum(n) OVER (PARTITION BY user_id) AS p FROM o),
m AS (SELECT event_type, count(*)::DOUBLE / (SELECT count(*) FROM events) AS q FROM events GROUP BY 1) SELECT user_id, round(1 - exp(-sum(p * ln(p / q))), 6) AS score FROM p JOIN m USING (event_type) GROUP BY 1""")
def kl_feature(spark, d):
    from pyspark.sql import Window

    ev = table(spark, d, "events")
    o = ev.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    p = o.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    kinds = ev.groupBy("event_type").agg(F.count("*").alias("n_kind"))
    m = kinds.select("event_type", (F.col("n_kind") / F.sum("n_kind").over(Window.partitionBy(F.lit(1)))).alias("q"))
    return p.join(m, "event_type").groupBy("user_id").agg(_r(1 - F.exp(-F.sum(score.kl_terms(F.col("p"), F.col("q"))))).alias("score"))


@query("""SELECT l_orderkey, n, round(least(n * 0.4, 1) - 1e-6, 6) AS uniform, round(least(ln(n + 1) / ln(4), 1), 6) AS logarithmic, round((SELECT sum(0.5 / (i + 1)) FROM generate_series(0, n - 1) g(i)), 6) AS decaying FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)""")
def count_models(spark, d):
    n = F.col("n")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return rows.select("l_orderkey", "n", _r(score.uniform_count(n)).alias("uniform"), _r(score.logarithmic_count(n, 4.0)).alias("logarithmic"), _r(score.decaying_count(n, 0.5, 1.0)).alias("decaying"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_extendedprice, o_orderkey, (o_totalprice - l_extendedprice) / l_extendedprice * 1e6 AS error FROM lineitem JOIN orders ON abs(o_totalprice - l_extendedprice) <= l_extendedprice * 1e-5),
m AS (SELECT avg(error) AS mu, stddev_pop(error) AS sd FROM e) SELECT l_orderkey, l_linenumber, o_orderkey, round(error, 4) AS error, round(-10 * log10(1 - exp(-pow(error - mu, 2) / (2 * sd * sd)) * (1 - 1e-9)), 3) AS score FROM e, m""")
def mass_accuracy(spark, d):
    from massloom.operators.rangejoin import ppm_join

    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    e = ppm_join(lines, table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "l_extendedprice", "o_totalprice", 1e-5)
    e = e.withColumn("error", (F.col("o_totalprice") - F.col("l_extendedprice")) / F.col("l_extendedprice") * 1e6)
    m = e.agg(F.avg("error").alias("mu"), F.stddev_pop("error").alias("sd"))
    return e.crossJoin(F.broadcast(m)).select("l_orderkey", "l_linenumber", "o_orderkey", _r("error", 4).alias("error"), _r(score.mass_accuracy(F.col("error"), F.col("mu"), F.col("sd")), 3).alias("score"))  # m is one row


@query("""SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_correlation(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", _r(score.cosine(F.col("embedding"), F.col("other")), 5).alias("similarity"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem GROUP BY 1")
def line_fit(spark, d):
    out = regress.line_fit(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", _r("slope", 4).alias("slope"), _r("intercept", 2).alias("intercept"), _r("r2").alias("r2"), "n")


@query("""WITH s AS (SELECT l_linestatus, sum(w) AS w, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy, count(*) AS n FROM (SELECT l_linestatus, 1 + l_discount AS w, l_quantity AS x, l_extendedprice AS y FROM lineitem) GROUP BY 1)
SELECT l_linestatus, round((w * xy - x * y) / (w * xx - x * x), 4) AS slope, round((xx * y - x * xy) / (w * xx - x * x), 2) AS intercept, n FROM s""")
def weighted_line_fit(spark, d):
    out = regress.weighted_line_fit(table(spark, d, "lineitem"), ["l_linestatus"], F.col("l_quantity"), F.col("l_extendedprice"), 1 + F.col("l_discount"))
    return out.select("l_linestatus", _r("slope", 4).alias("slope"), _r("intercept", 2).alias("intercept"), "n")


@query("""WITH s AS (SELECT l_linestatus, sum(1.0) + 5 AS w, sum(x) AS x, sum(y) AS y, sum(x * x) + 5 AS xx, sum(x * y) AS xy, count(*) AS n FROM (SELECT l_linestatus, l_quantity AS x, l_extendedprice AS y FROM lineitem) GROUP BY 1)
SELECT l_linestatus, round((w * xy - x * y) / (w * xx - x * x), 4) AS slope, round((xx * y - x * xy) / (w * xx - x * x), 2) AS intercept, n FROM s""")
def ridge_line_fit(spark, d):
    out = regress.weighted_line_fit(table(spark, d, "lineitem"), ["l_linestatus"], F.col("l_quantity"), F.col("l_extendedprice"), F.lit(1.0), penalty=5.0)
    return out.select("l_linestatus", _r("slope", 4).alias("slope"), _r("intercept", 2).alias("intercept"), "n")


@query("""WITH r AS (SELECT year(o_orderdate) AS run, o_custkey, min(o_totalprice) AS v FROM orders GROUP BY ALL), ref AS (SELECT o_custkey, v AS ref FROM r WHERE run = 1995)
SELECT run, round(regr_slope(ref, v), 6) AS slope, round(regr_intercept(ref, v), 2) AS intercept, count(*) AS n FROM r JOIN ref USING (o_custkey) WHERE run <> 1995 GROUP BY 1""")
def run_alignment(spark, d):
    """A line per run onto the reference run."""
    r = table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("run"), "o_custkey").agg(F.min("o_totalprice").alias("v"))
    ref = r.filter("run = 1995").select("o_custkey", F.col("v").alias("ref"))
    out = regress.line_fit(r.filter("run <> 1995").join(ref, "o_custkey"), ["run"], "v", "ref")
    return out.select("run", _r("slope").alias("slope"), _r("intercept", 2).alias("intercept"), "n")


@query("SELECT 'l_quantity' AS name, round(regr_slope(l_extendedprice, l_quantity), 4) AS value FROM lineitem UNION ALL SELECT 'intercept', round(regr_intercept(l_extendedprice, l_quantity), 2) FROM lineitem")
def factor_regression(spark, d):
    """The general solver on one factor; ``fit_linear`` takes any number."""
    model = regress.fit_linear(table(spark, d, "lineitem"), {"l_quantity": F.col("l_quantity")}, F.col("l_extendedprice"))
    rows = [("l_quantity", round(float(model.parameters[1]), 4)), ("intercept", round(float(model.parameters[0]), 2))]
    return spark.createDataFrame(rows, "name string, value double")


@query("""WITH o AS (SELECT o_orderkey, o_totalprice AS y, epoch_us(o_orderdate) / 86400000000 AS t FROM orders), w AS (SELECT *, unnest(range(ceil((t - 200) / 100)::BIGINT, floor((t + 200) / 100)::BIGINT + 1)) * 100.0::DOUBLE AS c FROM o),
m AS (SELECT c, avg(y) AS mean, count(*) AS n FROM w GROUP BY 1) SELECT o_orderkey, round(sum(mean * (1 - abs(t - c) / 201)) / sum(1 - abs(t - c) / 201), 4) AS prediction FROM w JOIN m USING (c) GROUP BY 1""")
def window_ensemble(spark, d):
    """Models of overlapping windows, averaged with weights that fall towards the edge."""
    from massloom.operators.features import sliding_windows

    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"), days("o_orderdate"))
    w = sliding_windows(rows, "day", 400.0, 100.0)
    m = w.groupBy("centre").agg(F.avg("y").alias("mean"))
    near = 1 - F.abs(F.col("day") - F.col("centre")) / 201
    return w.join(m, "centre").groupBy("o_orderkey").agg(_r(F.sum(F.col("mean") * near) / F.sum(near), 4).alias("prediction"))


@query("""WITH f AS (SELECT l_suppkey % 5 AS k, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) SELECT k, l_returnflag, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY k), 6) AS frequency FROM f""")
def charge_frequency_model(spark, d):
    """Learned state frequencies per neighbourhood."""
    from pyspark.sql import Window

    f = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("k"), "l_returnflag").agg(F.count("*").alias("n"))
    return f.withColumn("frequency", _r(F.col("n") / F.sum("n").over(Window.partitionBy("k"))))
