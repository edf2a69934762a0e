"""Sources and sinks as round trips, streams, mixtures and smoothing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from massloom.functions import compositions as comp
from massloom.operators import cluster, graph, mixture, smooth
from massloom.plans.inputs import events, micros, registrar
from massloom.session import Scratch, table
from massloom.sources import spectra, text, writers
from massloom.streaming import stateful

CATALOG: dict = {}
query = registrar(CATALOG)


@query("SELECT 'sp|ACC' || item_id || '|ITEM' AS name, 'ACC' || item_id AS accession, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM benchmark")
def fasta_round_trip(spark, d):
    rows = table(spark, d, "benchmark").select(F.concat(F.lit("sp|ACC"), F.col("item_id").cast("string"), F.lit("|ITEM")).alias("name"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence"))
    path = Scratch(spark, "fasta").path("sequences")
    writers.write_fasta(rows, path)
    return text.read_fasta(spark, path)


@query("""SELECT '{size:' || p_size || '; type:' || length(p_type) || '}' AS text, p_brand AS class, count(*) AS n FROM part GROUP BY ALL""")
def composition_list_round_trip(spark, d):
    made = F.create_map(F.lit("size"), F.col("p_size").cast("int"), F.lit("type"), F.length("p_type"))
    rows = table(spark, d, "part").select(made.alias("composition"), F.array("p_brand").alias("classes"))
    path = Scratch(spark, "compositions").path("list")
    writers.write_compositions(rows, path)
    back = text.read_compositions(spark, path)
    return back.groupBy(comp.to_text(F.col("composition")).alias("text"), F.col("classes")[0].alias("class")).agg(F.count("*").alias("n"))


@query("SELECT 's' || l_orderkey AS scan_id, l_partkey AS peptide_id, round(l_extendedprice, 2) AS total_score, count(*) AS n FROM lineitem GROUP BY ALL")
def journal_round_trip(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_orderkey").cast("string")).alias("scan_id"), F.col("l_partkey").alias("peptide_id"), F.round("l_extendedprice", 2).alias("total_score"))
    for name, kind in text.JOURNAL_FIELDS:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    path = Scratch(spark, "journal").path("shards")
    writers.write_journal(rows, path)
    return text.read_journal(spark, path).groupBy("scan_id", "peptide_id", "total_score").agg(F.count("*").alias("n"))


@query("""SELECT 'scan=' || l_orderkey AS title, count(*) AS peaks, round(sum(i), 2) AS signal, round(max(mz), 2) AS highest FROM (SELECT DISTINCT l_orderkey, l_extendedprice AS mz, l_quantity AS i FROM lineitem) GROUP BY 1""")
def spectra_round_trip(spark, d):
    peaks = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.struct(F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("intensity"))).alias("peaks"))
    rows = peaks.select(F.concat(F.lit("scan="), F.col("l_orderkey").cast("string")).alias("title"), F.col("l_orderkey").cast("double").alias("mass"), F.lit(2).alias("charge"), "peaks")
    path = Scratch(spark, "spectra").path("text")
    writers.write_spectra(rows, path)
    total = F.aggregate("peaks", F.lit(0.0), lambda t, p: t + p["intensity"])
    return spectra.read_mgf(spark, path).select("title", F.size("peaks").cast("long").alias("peaks"), F.round(total, 2).alias("signal"), F.round(F.array_max(F.transform("peaks", lambda p: p["mz"])), 2).alias("highest"))


@query("SELECT n_nationkey::BIGINT AS a, (100 + n_regionkey)::BIGINT AS b, (1.0 / (1 + n_regionkey))::DOUBLE AS weight FROM nation")
def network_round_trip(spark, d):
    n = table(spark, d, "nation")
    nodes = n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("label"))
    edges = n.select(F.col("n_nationkey").cast("long").alias("a"), (F.col("n_regionkey") + 100).cast("long").alias("b"), (1.0 / (1 + F.col("n_regionkey"))).alias("weight"))
    path = Scratch(spark, "network").path("lines")
    writers.write_network(nodes, edges, path)
    return text.read_network(spark, path)[1]


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey::VARCHAR, r_name FROM region")
def concatenated_tables(spark, d):
    scratch = Scratch(spark, "tables")
    a, b = scratch.path("a"), scratch.path("b")
    writers.write_table(table(spark, d, "nation").select("n_nationkey", "n_name"), a)
    writers.write_table(table(spark, d, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name")), b)
    return text.concatenate_tables(spark, [a, b])


@query("SELECT o_orderpriority AS analysis_id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def analysis_partition(spark, d):
    """Analyses written twice under their names; the second replaces the first."""
    path = Scratch(spark, "analysis").path("store")
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    for name in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"):
        for _ in range(2):
            writers.write_analysis(rows.filter(F.col("o_orderpriority") == name).drop("o_orderpriority"), path, name)
    return spark.read.parquet(path).groupBy(F.col("analysis_id").cast("string").alias("analysis_id")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH m AS (SELECT user_id, ts, value, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 3600000000 THEN 1 ELSE 0 END AS new FROM events),
p AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS piece FROM m) SELECT user_id, min(epoch_us(ts))::BIGINT AS start_us, count(*) AS points, round(sum(value), 4) AS signal FROM p GROUP BY user_id, piece""")
def streamed_sessions(spark, d):
    """Sessions as the stream itself emits them; two late rows of nobody move the watermark past all others."""
    rows = stateful.with_closing_rows(stateful.event_stream(spark, d).select("user_id", "value", F.col("ts").cast("timestamp").alias("at")), "2100-01-01", "2100-03-01")
    out = stateful.run_to_end(stateful.gap_sessions(rows, "at", ["user_id"], "1 hour", "0 seconds").select("user_id", F.unix_micros("session_window.start").alias("start_us"), "points", "signal"), "sessions", "append")
    return out.filter("user_id IS NOT NULL").withColumn("signal", F.round("signal", 4))


@query("""WITH e AS (SELECT DISTINCT value AS mass, event_id, user_id FROM events) SELECT user_id, event_id, p_partkey FROM e JOIN part ON abs(p_retailprice / 10 - mass) <= mass * 1e-4""")
def streamed_candidates(spark, d):
    """A stream of queries against a static reference by mass bins; the equi-join part is stateless."""
    width = 8e-4
    bin_of = lambda m: F.floor(F.log(m) / width)
    refs = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / 10).alias("ref")).withColumn("bin", bin_of(F.col("ref")))
    stream = stateful.event_stream(spark, d).select("user_id", "event_id", F.col("value").alias("mass")).filter("mass > 0")
    stream = stream.withColumn("bin", F.explode(F.sequence(bin_of(F.col("mass") * (1 - 1.0001e-4)), bin_of(F.col("mass") * (1 + 1.0001e-4)))))
    found = stream.join(refs, "bin").filter(F.abs(F.col("ref") - F.col("mass")) <= F.col("mass") * 1e-4).select("user_id", "event_id", "p_partkey")
    return stateful.run_to_end(found, "candidates")


@query()
def mixture_error_rates(spark, d):
    """Error probabilities from Gaussian mixtures of targets and decoys (no SQL form; tested on known mixtures)."""
    ev = table(spark, d, "events").select("event_id", "user_id", F.log1p("value").alias("score"))
    return mixture.posterior_error(ev.filter("user_id % 2 = 1"), ev.filter("user_id % 2 = 0"), "score").select("event_id", F.round("pep", 6).alias("pep"))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey + 1) % 25 AS b FROM nation UNION ALL SELECT (n_nationkey + 1) % 25, n_nationkey FROM nation),
n AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::DOUBLE END AS observed FROM nation),
r1 AS (SELECT n.id, observed, ((observed IS NOT NULL)::INT * coalesce(observed, 0) + 0.5 * s) / ((observed IS NOT NULL)::INT + 1.0) AS smooth FROM n JOIN (SELECT e.a, sum(coalesce(m.observed, 0)) AS s FROM e JOIN n m ON m.id = e.b GROUP BY 1) p ON p.a = n.id),
r2 AS (SELECT n.id, n.observed, ((n.observed IS NOT NULL)::INT * coalesce(n.observed, 0) + 0.5 * s) / ((n.observed IS NOT NULL)::INT + 1.0) AS smooth FROM r1 n JOIN (SELECT e.a, sum(m.smooth) AS s FROM e JOIN r1 m ON m.id = e.b GROUP BY 1) p ON p.a = n.id)
SELECT id::BIGINT AS id, round(smooth, 6) AS smooth FROM r2""")
def network_smoothing(spark, d):
    n = table(spark, d, "nation")
    nodes = n.select(F.col("n_nationkey").cast("long").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey").cast("double")).alias("observed"))
    edges = n.select(F.col("n_nationkey").cast("long").alias("a"), ((F.col("n_nationkey") + 1) % 25).cast("long").alias("b"), F.lit(1.0).alias("weight"))
    return smooth.laplacian_smooth(nodes, edges, 0.5, 2).select("id", F.round("smooth", 6).alias("smooth"))


@query()
def greedy_clusters(spark, d):
    """Order-dependent clustering of peaks by mass (no SQL form; tested against a replay)."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("c"), F.crc32(F.col("o_orderkey").cast("string")).cast("double").alias("intensity"))
    return cluster.greedy_mass_clusters(rows, ["c"], "o_totalprice", "intensity", "o_orderkey", 0.05).select("c", "o_orderkey", "piece", "cluster", F.round("centre", 4).alias("centre"))


@query("""WITH m AS (SELECT l_orderkey, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, epoch_us(a)::BIGINT AS start_us, epoch_us(b)::BIGINT AS end_us FROM m WHERE epoch_us(a) <= 800000000000000 AND epoch_us(b) >= 800000000000000""")
def spanning_time(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", micros("l_shipdate").alias("t")).groupBy("l_orderkey").agg(F.min("t").alias("start_us"), F.max("t").alias("end_us"))
    return rows.filter(F.lit(800000000000000).between(F.col("start_us"), F.col("end_us")))


@query("""WITH s AS (SELECT user_id, event_type, count(*) AS n, sum(value) AS v FROM events GROUP BY ALL), f AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS kinds FROM s)
SELECT user_id, event_type, CASE WHEN kinds = 1 THEN 0.0 ELSE round(v, 4) END AS entry FROM f""")
def lone_member_patch(spark, d):
    """Entries of neighbourhoods with a single observed member become 0."""
    s = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("v"))
    kinds = F.count("*").over(Window.partitionBy("user_id"))
    return s.withColumn("kinds", kinds).select("user_id", "event_type", F.when(F.col("kinds") == 1, 0.0).otherwise(F.col("v")).alias("entry"))


@query("""WITH d AS (SELECT user_id, t, value, lag(t) OVER w AS pt, lag(value) OVER w AS pv FROM (SELECT user_id, event_id, value, epoch_us(ts) / 1e6 AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, round(avg(t - pt), 3) AS mean_step, round(stddev_pop(t - pt), 3) AS spread FROM d WHERE pt IS NOT NULL GROUP BY 1""")
def sampling_intervals(spark, d):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    rows = events(spark, d).withColumn("step", F.col("t") - F.lag("t").over(w)).filter("step IS NOT NULL")
    return rows.groupBy("user_id").agg(F.round(F.avg("step"), 3).alias("mean_step"), F.round(F.stddev_pop("step"), 3).alias("spread"))


@query("""WITH l AS (SELECT n_nationkey AS id, n_regionkey AS c FROM nation) SELECT x.id::BIGINT AS a, y.id::BIGINT AS b FROM l x JOIN l y ON x.c = y.c AND x.id < y.id""")
def adjacency_neighbourhoods(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_regionkey")
    labelled = graph.neighbourhood_labels(n, {str(r): F.col("n_regionkey") == r for r in range(5)})
    return labelled.select(F.col("id").alias("a"), "neighbourhood").join(labelled.select(F.col("id").alias("b"), "neighbourhood"), "neighbourhood").filter("a < b").select("a", "b")
