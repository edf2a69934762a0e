"""Splits, merges and aggregates over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from massloom.operators import cluster, features, ordered
from massloom.plans.inputs import EVENTS_SQL, days, events, registrar
from massloom.session import table

CATALOG: dict = {}
query = registrar(CATALOG)
_LAG = "lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id)"


@query(f"""WITH m AS (SELECT *, CASE WHEN t - {_LAG} > 3600 THEN 1 ELSE 0 END AS new FROM {EVENTS_SQL})
SELECT event_id, user_id, (sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id))::BIGINT AS piece FROM m""")
def gap_split(spark, d):
    return cluster.gap_split(events(spark, d), ["user_id"], "t", 3600.0, ["event_id"]).select("event_id", "user_id", "piece")


@query(f"""WITH m AS (SELECT *, CASE WHEN t - {_LAG} > 3600 THEN 1 ELSE 0 END AS new FROM {EVENTS_SQL}), p AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS piece FROM m)
SELECT user_id, piece::BIGINT AS piece, count(*) AS points, round(sum(value), 4) AS signal, min(t) AS start, max(t) AS stop FROM p GROUP BY ALL""")
def sparse_pieces(spark, d):
    pieces = cluster.gap_split(events(spark, d), ["user_id"], "t", 3600.0, ["event_id"])
    return pieces.groupBy("user_id", "piece").agg(F.count("*").alias("points"), F.round(F.sum("value"), 4).alias("signal"), F.min("t").alias("start"), F.max("t").alias("stop"))


@query("""WITH o AS (SELECT o_custkey, epoch_us(o_orderdate) / 86400000000 AS s, epoch_us(o_orderdate) / 86400000000 + 30 AS e FROM orders),
m AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 1 ELSE 0 END AS new FROM o),
i AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT o_custkey, island::BIGINT AS island, min(s) AS start, max(e) AS "end", count(*) AS members FROM i GROUP BY ALL""")
def islands_merge(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", days("o_orderdate")).withColumn("stop", F.col("day") + 30)
    return cluster.merge_intervals(rows, ["o_custkey"], "day", "stop")


@query("""WITH m AS (SELECT *, CASE WHEN (lag(o_totalprice) OVER w - o_totalprice) / lag(o_totalprice) OVER w > 0.05 THEN 1 ELSE 0 END AS new FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))
SELECT o_custkey, o_orderkey, (sum(new) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))::BIGINT AS "group" FROM m""")
def precursor_groups(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return cluster.relative_gap_groups(rows, ["o_custkey"], "o_totalprice", 0.05, ["o_orderkey"]).drop("o_totalprice")


@query(f"""WITH p AS (SELECT user_id, (value + lag(value) OVER w) / 2 * (t - lag(t) OVER w) AS piece FROM {EVENTS_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, round(coalesce(sum(piece), 0), 2) AS area, count(*) AS points FROM p GROUP BY 1""")
def trapezoid(spark, d):
    return features.trapezoid(events(spark, d), ["user_id"], "t", "value", ["event_id"]).withColumn("area", F.round("area", 2))


@query("SELECT l_orderkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity) + 1e-7, 4) AS mass, round(sum(l_quantity), 4) AS signal FROM lineitem GROUP BY 1")
def weighted_mass(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(features.weighted_mean("l_extendedprice", "l_quantity") + 1e-7, 4).alias("mass"), F.round(F.sum("l_quantity"), 4).alias("signal"))


@query("SELECT l_orderkey, l_returnflag, l_linestatus, round(sum(l_extendedprice * l_quantity) / sum(l_quantity) + 1e-7, 4) AS mean_mz FROM lineitem GROUP BY ALL")
def mean_mz_by_state(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.round(features.weighted_mean("l_extendedprice", "l_quantity") + 1e-7, 4).alias("mean_mz"))


@query(f"SELECT user_id, -max(struct_pack(height := value, neg := -t)).neg AS apex_time, max(value) AS height, round(sum(value), 4) AS total, min(t) AS start, max(t) AS \"end\" FROM {EVENTS_SQL} GROUP BY 1")
def apex(spark, d):
    return features.apex(events(spark, d), ["user_id"], "t", "value").withColumn("total", F.round("total", 4))


@query("SELECT (epoch_us(ts) // 86400000000)::BIGINT AS scan, round(sum(value), 4) AS total, max(value) AS base_peak, count(*) AS points FROM events GROUP BY 1")
def total_and_base_peak(spark, d):
    rows = events(spark, d).withColumn("scan", F.floor(F.col("t") / 86400))
    return features.total_and_base_peak(rows, ["scan"], "value").withColumn("total", F.round("total", 4))


@query("""WITH k AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey) AS points FROM k)
SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY l_returnflag) AS states FROM c WHERE n >= least(2, points) GROUP BY 1""")
def charge_states(spark, d):
    return features.supported_values(table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", 2).select("l_orderkey", F.array_join("supported", ",").alias("states"))


@query(f"""WITH s AS (SELECT user_id, t - lag(t) OVER w AS step, abs(value - lag(value) OVER w) + 1 AS weight FROM {EVENTS_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, round(sum(step * weight) / sum(weight), 3) AS spacing, count(*) AS steps FROM s WHERE step IS NOT NULL GROUP BY 1""")
def spacing(spark, d):
    return features.spacing(events(spark, d), ["user_id"], "t", "value", ["event_id"]).withColumn("spacing", F.round("spacing", 3))


@query(f"""WITH s AS (SELECT event_id, user_id, value, lag(value) OVER w AS b, lead(value) OVER w AS a FROM {EVENTS_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, user_id, value FROM s WHERE value >= b AND value >= a AND (value > b OR value > a)""")
def local_maxima(spark, d):
    return features.local_maxima(events(spark, d), ["user_id"], "t", "value", ["event_id"]).select("event_id", "user_id", "value")


@query(f"SELECT event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM {EVENTS_SQL}")
def rolling_median(spark, d):
    return features.rolling_median(events(spark, d), ["user_id"], "t", "value", 2, ["event_id"]).select("event_id", F.round("smooth", 6).alias("smooth"))


@query(f"""SELECT event_id, least(max(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), max(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS bell FROM {EVENTS_SQL}""")
def monotone_bell(spark, d):
    return features.monotone_bell(events(spark, d), ["user_id"], "t", "value", ["event_id"]).select("event_id", "bell")


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, epoch_us(o_orderdate) / 86400000000 AS t FROM orders), w AS (SELECT *, unnest(range(ceil((t - 30) / 15)::BIGINT, floor((t + 30) / 15)::BIGINT + 1)) * 15.0 AS centre FROM o)
SELECT centre::DOUBLE AS centre, count(*) AS points, round(avg(o_totalprice), 4) AS mean_value FROM w GROUP BY 1""")
def sliding_windows(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", days("o_orderdate"))
    return features.sliding_windows(rows, "day", 60.0, 15.0).groupBy("centre").agg(F.count("*").alias("points"), F.round(F.avg("o_totalprice"), 4).alias("mean_value"))


@query(f"SELECT event_id, round(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) - t, 6) AS next_step FROM {EVENTS_SQL}")
def next_sample_step(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    return events(spark, d).select("event_id", F.round(F.lead("t").over(w) - F.col("t"), 6).alias("next_step"))


@query(f"""WITH c AS (SELECT user_id, event_type, round(sum(value), 4) AS signal FROM {EVENTS_SQL} GROUP BY ALL)
SELECT user_id, event_type, signal, round(signal / sum(signal) OVER (PARTITION BY user_id), 6) AS fraction FROM c""")
def signal_fractions(spark, d):
    from pyspark.sql import Window

    sums = events(spark, d).groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("signal"))
    return sums.withColumn("fraction", F.round(F.col("signal") / F.sum("signal").over(Window.partitionBy("user_id")), 6))


@query("""SELECT p_brand, max(CASE WHEN y = 1995 THEN q END) AS y1995, max(CASE WHEN y = 1996 THEN q END) AS y1996, max(CASE WHEN y = 1997 THEN q END) AS y1997
FROM (SELECT p_brand, year(l_shipdate) AS y, round(max(l_extendedprice), 2) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) GROUP BY 1""")
def cross_run_pivot(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_extendedprice", F.year("l_shipdate").alias("y")).groupBy("l_partkey", "y").agg(F.max("l_extendedprice").alias("q"))
    rows = rows.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    out = rows.groupBy("p_brand").pivot("y", [1995, 1996, 1997]).agg(F.round(F.max("q"), 2))
    return out.select("p_brand", *(F.col(str(y)).alias(f"y{y}") for y in (1995, 1996, 1997)))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, round(sum(l_extendedprice), 2) AS abundance FROM lineitem GROUP BY ALL""")
def site_abundance(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("abundance"))


@query("SELECT p_type, string_agg(DISTINCT p_brand, ';' ORDER BY p_brand) AS classes, count(*) AS members FROM part GROUP BY 1")
def union_of_classes(spark, d):
    """Entities of one composition merged, their class labels united."""
    return table(spark, d, "part").groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ";").alias("classes"), F.count("*").alias("members"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(min(l_extendedprice), 2) AS lowest, round(max(l_extendedprice), 2) AS highest FROM lineitem GROUP BY ALL")
def mass_bounds(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.min("l_extendedprice"), 2).alias("lowest"), F.round(F.max("l_extendedprice"), 2).alias("highest"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05 FROM lineitem GROUP BY 1")
def percentile_threshold(spark, d):
    """Exact percentiles: values are counted per group before they meet."""
    found = ordered.exact_percentiles(table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", [0.9, 0.05])
    return found.select("l_returnflag", F.round("p0", 4).alias("p90"), F.round("p1", 4).alias("p05"))


@query("""SELECT k, e.event_id % 7 AS ion, round(sum(value), 4) AS trace FROM (SELECT *, (epoch_us(ts) // 86400000000)::BIGINT AS k FROM events) e JOIN (VALUES (10.0), (20.0), (50.0)) v(mz) ON abs(value - mz) <= 0.5 GROUP BY ALL""")
def signature_ion_traces(spark, d):
    """Signal inside fixed narrow windows, per scan."""
    rows = events(spark, d).withColumn("k", F.floor(F.col("t") / 86400)).withColumn("ion", F.col("event_id") % 7)
    inside = F.filter(F.array(*map(F.lit, (10.0, 20.0, 50.0))), lambda mz: F.abs(F.col("value") - mz) <= 0.5)
    hits = rows.withColumn("mz", F.explode(inside))
    return hits.groupBy("k", "ion").agg(F.round(F.sum("value"), 4).alias("trace"))
