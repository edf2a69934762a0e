"""Retention, error rates and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from massloom.operators import fdr, select
from massloom.plans.inputs import EVENTS_SQL, events, registrar
from massloom.session import table

CATALOG: dict = {}
query = registrar(CATALOG)
_LINES = "(SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem)"


def _lines(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").distinct()


def _order():
    return [F.col("l_extendedprice").desc(), F.col("l_partkey").asc(), F.col("l_suppkey").asc(), F.col("l_quantity").asc()]


_BY = "PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_quantity"


@query("SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE l_extendedprice > 50000")
def retain_minimum(spark, d):
    return select.retain_minimum(table(spark, d, "lineitem"), "l_extendedprice", 50000).select("l_orderkey", "l_partkey", "l_extendedprice")


@query("SELECT l_orderkey, l_partkey, l_extendedprice, l_quantity FROM lineitem WHERE l_extendedprice >= 40000 AND l_quantity >= 45 AND l_discount >= 0.05")
def retain_multi_minimum(spark, d):
    return select.retain_all_minimum(table(spark, d, "lineitem"), {"l_extendedprice": 40000, "l_quantity": 45, "l_discount": 0.05}).select("l_orderkey", "l_partkey", "l_extendedprice", "l_quantity")


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS best FROM {_LINES}) WHERE best - l_extendedprice < 5000")
def retain_top_delta(spark, d):
    return select.retain_top_delta(_lines(spark, d), ["l_orderkey"], "l_extendedprice", 5000).select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")


@query(f"""WITH m AS (SELECT *, CASE WHEN lag(l_extendedprice) OVER w - l_extendedprice > 2000 THEN 1 ELSE 0 END AS new FROM {_LINES} WINDOW w AS ({_BY})),
g AS (SELECT *, 1 + sum(new) OVER ({_BY} ROWS UNBOUNDED PRECEDING) AS score_group FROM m) SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM g WHERE score_group <= 2""")
def retain_top_groups(spark, d):
    return select.retain_top_groups(_lines(spark, d), ["l_orderkey"], "l_extendedprice", 2, ["l_partkey", "l_suppkey", "l_quantity"], 2000.0).select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")


@query(f"""WITH r AS (SELECT *, row_number() OVER ({_BY}) AS n, count(*) FILTER (l_extendedprice > 60000 AND l_quantity > 40) OVER (PARTITION BY l_orderkey) AS kept FROM {_LINES})
SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM r WHERE (kept > 0 AND l_extendedprice > 60000 AND l_quantity > 40) OR (kept = 0 AND n = 1)""")
def retain_chain(spark, d):
    """Filters in turn; a key that loses everything keeps its best row."""
    steps = [lambda df: select.retain_minimum(df, "l_extendedprice", 60000), lambda df: select.retain_minimum(df, "l_quantity", 40)]
    return select.chain_or_best(_lines(spark, d), ["l_orderkey"], steps, _order())


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_extendedprice > max(l_extendedprice) OVER (PARTITION BY l_orderkey) - 0.001 AS is_best FROM {_LINES}")
def mark_top(spark, d):
    return select.mark_top(_lines(spark, d), ["l_orderkey"], "l_extendedprice").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "is_best")


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, n AS rank FROM (SELECT *, row_number() OVER ({_BY}) AS n FROM {_LINES}) WHERE n <= 3")
def top_n_peaks(spark, d):
    return select.ranked(_lines(spark, d), ["l_orderkey"], _order()).filter("rank <= 3").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT l_partkey, l_suppkey, l_orderkey, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_quantity) AS n FROM {_LINES}) WHERE n = 1")
def dedup_best(spark, d):
    return select.best_per_key(_lines(spark, d), ["l_partkey", "l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey").asc(), F.col("l_quantity").asc()])


@query(f"""WITH t AS (SELECT *, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS top FROM {_LINES}) SELECT DISTINCT l_orderkey, l_suppkey % 3 AS kind, round(l_extendedprice, 2) AS score FROM t WHERE l_extendedprice = top""")
def exclusive_best(spark, d):
    """Per query only the best score counts, with ties across kinds of match."""
    rows = _lines(spark, d).withColumn("top", F.max("l_extendedprice").over(Window.partitionBy("l_orderkey"))).filter("l_extendedprice = top")
    return rows.select("l_orderkey", (F.col("l_suppkey") % 3).alias("kind"), F.round("l_extendedprice", 2).alias("score")).distinct()


@query(f"""WITH s AS (SELECT l_orderkey, l_partkey, sum(l_extendedprice) AS s, max(l_extendedprice) AS b, count(*) AS matches FROM {_LINES} GROUP BY ALL)
SELECT l_orderkey, l_partkey, round(s, 2) AS score_sum, b AS best_score, matches, round(s / sum(s) OVER (PARTITION BY l_orderkey), 6) AS share FROM s""")
def representer_share(spark, d):
    out = select.group_share(_lines(spark, d), ["l_orderkey"], ["l_partkey"], "l_extendedprice")
    return out.withColumn("share", F.round("share", 6)).withColumn("score_sum", F.round("score_sum", 2))


@query(f"""WITH k AS (SELECT *, avg(l_extendedprice) OVER w - stddev_pop(l_extendedprice) OVER w AS least FROM {_LINES} WINDOW w AS (PARTITION BY l_orderkey)),
s AS (SELECT l_orderkey, l_partkey, sum(l_extendedprice) AS s, max(l_extendedprice) AS b, count(*) AS matches FROM k WHERE l_extendedprice >= least - 1e-9 GROUP BY ALL)
SELECT l_orderkey, l_partkey, round(s, 2) AS score_sum, b AS best_score, matches, round(s / sum(s) OVER (PARTITION BY l_orderkey), 6) AS share FROM s""")
def representer_above_average(spark, d):
    rows = _lines(spark, d)
    w = Window.partitionBy("l_orderkey")
    rows = rows.withColumn("least", F.avg("l_extendedprice").over(w) - F.stddev_pop("l_extendedprice").over(w)).filter(F.col("l_extendedprice") >= F.col("least") - 1e-9)
    out = select.group_share(rows, ["l_orderkey"], ["l_partkey"], "l_extendedprice")
    return out.withColumn("share", F.round("share", 6)).withColumn("score_sum", F.round("score_sum", 2))


_COUNTS = "SELECT {keys} value AS score, sum((user_id % 2 <> 0)::INT) AS t, sum((user_id % 2 = 0)::INT) AS d FROM events GROUP BY ALL"


@query(f"""WITH k AS ({_COUNTS.format(keys="")}), r AS (SELECT score, (sum(t) OVER w)::BIGINT AS targets, (sum(d) OVER w)::BIGINT AS decoys FROM k WINDOW w AS (ORDER BY score DESC)),
f AS (SELECT *, CASE WHEN targets = 0 THEN 1.0 ELSE decoys::DOUBLE / targets END AS fdr FROM r) SELECT score, targets, decoys, round(fdr, 6) AS fdr, round(min(fdr) OVER (ORDER BY score), 6) AS q_value FROM f""")
def q_values(spark, d):
    out = fdr.q_values(table(spark, d, "events"), "value", F.col("user_id") % 2 == 0)
    return out.select("score", "targets", "decoys", F.round("fdr", 6).alias("fdr"), F.round("q_value", 6).alias("q_value"))


@query(f"""WITH k AS ({_COUNTS.format(keys="event_type,")}), r AS (SELECT event_type, score, (sum(t) OVER w)::BIGINT AS targets, (sum(d) OVER w)::BIGINT AS decoys FROM k WINDOW w AS (PARTITION BY event_type ORDER BY score DESC)),
f AS (SELECT *, CASE WHEN targets = 0 THEN 1.0 ELSE (decoys::DOUBLE + 1) / targets END AS fdr FROM r)
SELECT event_type, score, targets, decoys, round(fdr, 6) AS fdr, round(min(fdr) OVER (PARTITION BY event_type ORDER BY score), 6) AS q_value FROM f""")
def q_values_grouped(spark, d):
    out = fdr.grouped_q_values(table(spark, d, "events"), "value", F.col("user_id") % 2 == 0, ["event_type"], correction=1.0)
    return out.withColumn("fdr", F.round("fdr", 6)).withColumn("q_value", F.round("q_value", 6))


@query("""WITH p AS (SELECT round(value, 2) AS score, sum(1 / (1 + value)) AS p, count(*) AS c FROM events GROUP BY 1), r AS (SELECT score, (sum(c) OVER w)::BIGINT AS n, sum(p) OVER w / sum(c) OVER w AS m FROM p WINDOW w AS (ORDER BY score DESC))
SELECT score, n, round(m, 6) AS mean_pep, round(min(m) OVER (ORDER BY score), 6) AS fdr FROM r""")
def pep_cumulative_fdr(spark, d):
    rows = table(spark, d, "events").select(F.round("value", 2).alias("s"), (1 / (1 + F.col("value"))).alias("pep"))
    return fdr.pep_to_fdr(rows, "s", "pep").select("score", "n", F.round("mean_pep", 6).alias("mean_pep"), F.round("fdr", 6).alias("fdr"))


@query("SELECT threshold, (SELECT count(*) FROM events WHERE value >= threshold) AS n FROM (VALUES (1.0::DOUBLE), (5.0::DOUBLE), (10.0::DOUBLE), (50.0::DOUBLE), (100.0::DOUBLE)) t(threshold)")
def threshold_counts(spark, d):
    return fdr.threshold_counts(table(spark, d, "events"), "value", [1.0, 5.0, 10.0, 50.0, 100.0])


@query("SELECT event_id, round(least(1.0, greatest(a, b, a + b - c)), 6) AS fdr FROM (SELECT event_id, 1 / (1 + value) AS a, (user_id % 10) / 20.0::DOUBLE AS b, 1 / (2 + value) AS c FROM events)")
def joint_fdr(spark, d):
    rows = table(spark, d, "events").select("event_id", (1 / (1 + F.col("value"))).alias("a"), ((F.col("user_id") % 10) / 20.0).alias("b"), (1 / (2 + F.col("value"))).alias("c"))
    return rows.select("event_id", F.round(fdr.joint_fdr(F.col("a"), F.col("b"), F.col("c")), 6).alias("fdr"))


@query(f"SELECT event_id, t, 'root' AS node FROM {EVENTS_SQL} WHERE event_type = 'view' UNION ALL SELECT event_id, t, 'branch' AS node FROM {EVENTS_SQL} WHERE event_type = 'click'")
def union_all_tree(spark, d):
    ev = events(spark, d)
    part = lambda kind, node: ev.filter(F.col("event_type") == kind).select("event_id", "t", F.lit(node).alias("node"))
    return part("view", "root").unionByName(part("click", "branch"))


@query("""SELECT user_id, event_id, value FROM events WHERE event_type = 'view' UNION ALL
SELECT user_id, event_id, value FROM events c WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'view')""")
def merge_missing_only(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_id", "value", "event_type")
    have, more = ev.filter("event_type = 'view'").drop("event_type"), ev.filter("event_type = 'click'").drop("event_type")
    return have.unionByName(more.join(have.select("user_id").distinct(), "user_id", "left_anti").select(have.columns))


@query("SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def common_nodes(spark, d):
    ev = table(spark, d, "events")
    return ev.filter("event_type = 'view'").select("user_id").intersect(ev.filter("event_type = 'purchase'").select("user_id"))


@query("SELECT event_id, event_type = 'purchase' AS has_shift, user_id FROM events")
def bisect_by_state(spark, d):
    """Both halves of a partition, labelled, in one pass."""
    return table(spark, d, "events").select("event_id", (F.col("event_type") == "purchase").alias("has_shift"), "user_id")


@query("""WITH p AS (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey)) AS parts FROM lineitem GROUP BY 1)
SELECT a.l_orderkey AS ref, len(list_intersect(a.parts, b.parts)) AS shared, len(a.parts) - len(list_intersect(a.parts, b.parts)) AS only_ref, len(b.parts) - len(list_intersect(a.parts, b.parts)) AS only_alt FROM p a JOIN p b ON b.l_orderkey = a.l_orderkey + 1""")
def count_peaks_shared(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    b = p.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("parts").alias("other"))
    both = F.array_intersect("parts", "other")
    return p.join(b, "l_orderkey").select(F.col("l_orderkey").alias("ref"), F.size(both).cast("long").alias("shared"), F.size(F.array_except("parts", "other")).cast("long").alias("only_ref"), F.size(F.array_except("other", "parts")).cast("long").alias("only_alt"))


@query("SELECT l_orderkey, count(*) AS points, bool_or(l_returnflag = 'R') AS has_msms FROM lineitem GROUP BY 1 HAVING count(*) >= 3 OR bool_or(l_returnflag = 'R')")
def minimum_points(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("points"), F.bool_or(F.col("l_returnflag") == "R").alias("has_msms")).filter("points >= 3 OR has_msms")


@query("""SELECT event_id, ntile FROM (SELECT event_id, ntile(4) OVER (PARTITION BY user_id ORDER BY value, event_id) AS ntile FROM events)""")
def intensity_ranks(spark, d):
    return table(spark, d, "events").select("event_id", F.ntile(4).over(Window.partitionBy("user_id").orderBy("value", "event_id")).cast("long").alias("ntile"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey, l_partkey, l_quantity FROM lineitem), m AS (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total FROM s)
SELECT l_orderkey, l_partkey, l_quantity, round(least(1.0, 2 * l_quantity / total), 6) AS probability FROM m""")
def site_probabilities(spark, d):
    """Scores scaled so that they sum to the number of modifications, capped at 1."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").distinct()
    total = F.sum("l_quantity").over(Window.partitionBy("l_orderkey"))
    return rows.select("l_orderkey", "l_partkey", "l_quantity", F.round(F.least(F.lit(1.0), 2 * F.col("l_quantity") / total), 6).alias("probability"))


@query("SELECT p_type, p_size, round(v / greatest(sum(v) OVER (PARTITION BY p_type), 1e-6), 6) AS share FROM (SELECT p_type, p_size, sum(p_retailprice) AS v FROM part GROUP BY ALL)")
def row_normalised(spark, d):
    sums = table(spark, d, "part").groupBy("p_type", "p_size").agg(F.sum("p_retailprice").alias("v"))
    return sums.select("p_type", "p_size", F.round(F.col("v") / F.greatest(F.sum("v").over(Window.partitionBy("p_type")), F.lit(1e-6)), 6).alias("share"))
