"""Shapes, ladders, modified forms, containment, shift statistics and the shell."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from massloom.functions import compositions as comp
from massloom.functions import sequences as seq
from massloom.operators import cluster, rangejoin, select, shapes, space, strings
from massloom.plans.inputs import EVENTS_SQL, events, registrar
from massloom.plans.shell import Shell
from massloom.session import table

CATALOG: dict = {}
query = registrar(CATALOG)
_SEQ = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


def _sequences(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("q"))


@query("""WITH r AS (SELECT l_orderkey AS k, l_extendedprice / 10000 AS x, l_quantity AS v FROM lineitem), m AS (SELECT k, sum(x * v) / sum(v) AS mid FROM r GROUP BY 1),
c AS (SELECT r.k, r.x - m.mid AS x, ln(v) AS y, v * v AS w, mid FROM r JOIN m ON r.k = m.k),
s AS (SELECT k, any_value(mid) AS mid, count(*) AS points, sum(w) s0, sum(w * x) s1, sum(w * x * x) s2, sum(w * pow(x, 3)) s3, sum(w * pow(x, 4)) s4, sum(w * y) t0, sum(w * y * x) t1, sum(w * y * x * x) t2 FROM c GROUP BY 1),
f AS (SELECT k, mid, points, s0 * s2 * s4 AS size, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS det, s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2) AS b,
  s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2) AS c FROM s)
SELECT k, points, CASE WHEN points >= 3 AND det > 1e-3 * size AND c < -1e-3 * det THEN round(mid - b / (2 * c), 2) END AS centre FROM f""")
def gaussian_shapes(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_extendedprice") / 10000).alias("x"), F.col("l_quantity").alias("v"))
    return shapes.gaussian_shape(rows, ["k"], "x", "v").select("k", "points", F.round("centre", 2).alias("centre"))


@query("""WITH p AS (SELECT DISTINCT o_custkey AS scan, o_totalprice AS m FROM orders), e AS (SELECT a.scan, a.m AS lo, b.m AS hi, s.name FROM p a JOIN p b ON a.scan = b.scan, (VALUES ('x', 5000.0), ('y', 12000.0)) s(name, step) WHERE abs(b.m - (a.m + step)) <= 150)
SELECT e.scan, round(e.lo, 2) AS start, round(f.hi, 2) AS stop, e.name || f.name AS path FROM e JOIN e f ON e.scan = f.scan AND f.lo = e.hi""")
def mass_ladders(spark, d):
    """Paths of two steps between peaks of a scan, each step a known mass difference."""
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("scan"), F.col("o_totalprice").alias("m")).distinct()
    steps = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).alias("step")) for n, v in (("x", 5000.0), ("y", 12000.0)))))
    a = p.select("scan", F.col("m").alias("lo"), steps.alias("s")).select("scan", "lo", "s.name", (F.col("lo") + F.col("s.step")).alias("at"))
    b = p.select(F.col("scan").alias("scan_b"), F.col("m").alias("hi"))
    e = a.join(b, F.col("scan") == F.col("scan_b")).filter(F.abs(F.col("hi") - F.col("at")) <= 150).select("scan", "lo", "hi", "name")
    f = e.select(F.col("scan").alias("scan_f"), F.col("lo").alias("lo_f"), F.col("hi").alias("stop"), F.col("name").alias("next"))
    return e.join(f, (F.col("scan") == F.col("scan_f")) & (F.col("hi") == F.col("lo_f"))).select("scan", F.round("lo", 2).alias("start"), F.round("stop", 2).alias("stop"), F.concat("name", "next").alias("path"))


@query(f"""WITH s AS (SELECT item_id, {_SEQ} AS q FROM benchmark), p AS (SELECT item_id, list_filter(range(0, len(q)), lambda i: q[i + 1] IN ('S', 'T')) AS sites FROM s)
SELECT item_id, 1 + len(sites) + len(sites) * (len(sites) - 1) // 2 AS forms FROM p WHERE len(sites) >= 2""")
def peptidoforms(spark, d):
    """Forms with up to two variable modifications, enumerated."""
    rows = _sequences(spark, d).select("item_id", seq.sites(F.col("q"), seq.O_SITE).alias("sites")).filter("size(sites) >= 2")
    one, two = space.limited_combinations(F.col("sites"), 1, 10**6), space.limited_combinations(F.col("sites"), 2, 10**6)
    forms = rows.withColumn("form", F.explode(F.concat(F.array(F.array().cast("array<int>")), one, two)))
    return forms.groupBy("item_id").agg(F.count("*").alias("forms"))


@query("""WITH p AS (SELECT p_partkey AS peptide, p_retailprice AS m, p_size % 3 + 1 AS sites FROM part), g AS (SELECT n_nationkey AS glycan, 100.0::DOUBLE + n_nationkey * 7 AS gm, n_regionkey % 3 + 1 AS size FROM nation)
SELECT peptide, glycan::BIGINT AS glycan, round(m + gm - size * 18.0106, 4) AS mass FROM p JOIN g ON size <= sites""")
def glycosylated_peptides(spark, d):
    """Every peptide with every combination that its sites can hold; each bond loses one water."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("peptide"), F.col("p_retailprice").alias("m"), (F.col("p_size") % 3 + 1).alias("sites"))
    g = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("glycan"), (100.0 + F.col("n_nationkey") * 7).alias("gm"), (F.col("n_regionkey") % 3 + 1).alias("size"))
    held = p.withColumn("size", F.explode(F.sequence(F.lit(1), F.col("sites"))))
    return held.join(g, "size").select("peptide", "glycan", F.round(F.col("m") + F.col("gm") - F.col("size") * 18.0106, 4).alias("mass"))


@query(f"""WITH s AS (SELECT item_id, {_SEQ} AS q FROM benchmark), n AS (SELECT DISTINCT item_id AS source, peptide FROM (SELECT item_id, unnest(string_split(regexp_replace(regexp_replace(q, '([KR])', '\\1|', 'g'), '([KR])\\|P', '\\1P', 'g'), '|')) AS peptide FROM s) WHERE len(peptide) BETWEEN 8 AND 30 AND NOT contains(peptide, 'X')) SELECT source, item_id, peptide FROM n JOIN s ON contains(q, peptide)""")
def shared_peptides(spark, d):
    """In which sequences a peptide stands."""
    s = _sequences(spark, d)
    n = s.select(F.col("item_id").alias("source"), F.explode(seq.digest(F.col("q"), seq.PROTEASES["trypsin"], 0, 8, 30)).alias("p")).select("source", "p.peptide").distinct()
    return strings.contained_in(n, s, "peptide", "q", 8).select("source", "item_id", "peptide")


@query("SELECT p_partkey, n_nationkey::BIGINT AS n_nationkey FROM (SELECT p_partkey, upper(p_name) AS w FROM part) JOIN (SELECT n_nationkey, upper(substr(n_name, 1, 1)) AS pre FROM nation) ON starts_with(w, pre)")
def prefix_containment(spark, d):
    w = table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("w"))
    p = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.upper(F.substring("n_name", 1, 1)).alias("pre"))
    return strings.with_prefix(w, p, "w", "pre").select("p_partkey", "n_nationkey")


@query("""WITH a AS (SELECT l_suppkey AS k, l_partkey AS g, avg(l_extendedprice) AS y, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), p AS (SELECT x.g - z.g AS delta, x.y - z.y AS shift, log10(1 + x.w) + log10(1 + z.w) AS w FROM a x JOIN a z ON x.k = z.k AND x.g > z.g AND x.g - z.g <= 3),
f AS (SELECT delta, sum(w * shift) / sum(w) AS mean, sqrt(sum(w * shift * shift) / sum(w) - pow(sum(w * shift) / sum(w), 2)) AS sd FROM p GROUP BY 1)
SELECT delta, count(*) AS pairs, round(sum(w * shift) / sum(w), 3) AS mean FROM p JOIN f USING (delta) WHERE abs(shift - f.mean) <= 2.5 * sd GROUP BY 1""")
def local_shifts(spark, d):
    """Differences between near compositions, weighted by log signal, trimmed at 2.5 deviations and refitted."""
    a = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("g")).agg(F.avg("l_extendedprice").alias("y"), F.sum("l_quantity").alias("w"))
    # Near compositions by an equi-join: every row looks up the three values below its own.
    x = a.withColumn("delta", F.explode(F.array(*(F.lit(i) for i in (1, 2, 3))))).withColumn("other", F.col("g") - F.col("delta"))
    z = a.select("k", F.col("g").alias("other"), F.col("y").alias("y2"), F.col("w").alias("w2"))
    p = x.join(z, ["k", "other"]).select(F.col("delta").cast("long").alias("delta"), (F.col("y") - F.col("y2")).alias("shift"), (F.log10(1 + F.col("w")) + F.log10(1 + F.col("w2"))).alias("w"))
    mean = F.sum(F.col("w") * F.col("shift")) / F.sum("w")
    f = p.groupBy("delta").agg(mean.alias("mean"), F.sqrt(F.sum(F.col("w") * F.col("shift") * F.col("shift")) / F.sum("w") - mean * mean).alias("sd"))
    kept = p.join(f, "delta").filter(F.abs(F.col("shift") - F.col("mean")) <= 2.5 * F.col("sd"))
    return kept.groupBy("delta").agg(F.count("*").alias("pairs"), F.round(mean, 3).alias("mean"))


@query("""SELECT p_partkey AS id, p_retailprice AS mass, 'database' AS origin FROM part UNION ALL
SELECT o_orderkey, o_totalprice / 100, 'de novo' FROM orders WHERE NOT EXISTS (SELECT 1 FROM part WHERE abs(p_retailprice - o_totalprice / 100) <= o_totalprice / 100 * 5e-6)""")
def merged_nodes(spark, d):
    """Database nodes, and de novo nodes that lie near none of them."""
    db = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("mass"))
    novo = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100).alias("mass"))
    new = rangejoin.ppm_join(novo, db.select(F.col("mass").alias("ref")), "mass", "ref", 5e-6, key=["id"], how="anti")
    return db.withColumn("origin", F.lit("database")).unionByName(new.withColumn("origin", F.lit("de novo")))


@query("""SELECT p_partkey, p_size::INT AS Hex, 0 AS decoy FROM part UNION ALL SELECT p_partkey, p_size::INT, 2 FROM part""")
def decoy_augmentation(spark, d):
    """Each composition and its decoy copy."""
    made = F.create_map(F.lit("Hex"), F.col("p_size").cast("int"))
    rows = table(spark, d, "part").select("p_partkey", made.alias("m"))
    both = rows.unionByName(rows.withColumn("m", comp.as_decoy(F.col("m"))))
    return both.select("p_partkey", comp.count(F.col("m"), "Hex").alias("Hex"), comp.count(F.col("m"), comp.DECOY).alias("decoy"))


@query(f"""WITH b AS (SELECT user_id, floor(t / 86400)::BIGINT AS w, event_id, value FROM {EVENTS_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, w ORDER BY value DESC, event_id) AS n FROM b) SELECT user_id, w AS "window", event_id, n AS rank FROM r WHERE n <= 2""")
def window_ranks(spark, d):
    """The two highest peaks of each window."""
    b = events(spark, d).withColumn("window", F.floor(F.col("t") / 86400))
    out = select.ranked(b, ["user_id", "window"], [F.col("value").desc(), F.col("event_id").asc()]).filter("rank <= 2")
    return out.select("user_id", "window", "event_id", F.col("rank").cast("long").alias("rank"))


@query("""WITH m AS (SELECT user_id, event_id, value, median(value) OVER (PARTITION BY user_id) AS half FROM events) SELECT event_id, (CASE WHEN value >= half THEN 1 ELSE 0 END)::INT AS tier FROM m""")
def intensity_tiers(spark, d):
    """Above or below the median of its group; medians are one row per group."""
    ev = table(spark, d, "events").select("user_id", "event_id", "value")
    half = ev.groupBy("user_id").agg(F.median("value").alias("half"))
    return ev.join(half, "user_id").select("event_id", (F.col("value") >= F.col("half")).cast("int").alias("tier"))


@query("""WITH s AS (SELECT o_custkey AS k, o_orderkey AS id, o_totalprice AS signal, o_totalprice + 18.0 AS shifted FROM orders), j AS (SELECT a.id AS owner, b.id AS other, a.signal AS s1, b.signal AS s2 FROM s a JOIN s b ON a.k = b.k AND a.id <> b.id AND abs(b.signal - a.shifted) <= a.shifted * 1e-2)
SELECT owner, other, CASE WHEN s1 >= 1.005 * s2 THEN 'owner' WHEN s2 >= 1.005 * s1 THEN 'shifted' ELSE 'both' END AS keeper FROM j""")
def shift_pruning(spark, d):
    """Which of two features a mass shift apart keeps the signal."""
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("owner"), F.col("o_totalprice").alias("s1"), (F.col("o_totalprice") + 18.0).alias("at"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("other"), F.col("o_totalprice").alias("s2"))
    j = s.join(o, "k").filter((F.col("owner") != F.col("other")) & (F.abs(F.col("s2") - F.col("at")) <= F.col("at") * 1e-2))
    keeper = F.when(F.col("s1") >= 1.005 * F.col("s2"), "owner").when(F.col("s2") >= 1.005 * F.col("s1"), "shifted").otherwise("both")
    return j.select("owner", "other", keeper.alias("keeper"))


@query("""WITH t AS (SELECT DISTINCT p_partkey, unnest(string_split(p_type || ' ' || p_brand, ' ')) AS fragment FROM part), i AS (SELECT fragment, count(*) AS n FROM t GROUP BY 1) SELECT p_partkey, fragment, n AS structures FROM t JOIN i USING (fragment)""")
def inverted_index(spark, d):
    """Fragment to structures, and back to each structure's fragments with their frequency."""
    t = table(spark, d, "part").select("p_partkey", F.explode(F.split(F.concat_ws(" ", "p_type", "p_brand"), " ")).alias("fragment")).distinct()
    return t.join(t.groupBy("fragment").agg(F.count("*").alias("structures")), "fragment").select("p_partkey", "fragment", "structures")


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) >= 5")
def shell_query(spark, d):
    """A statement as the shell takes it."""
    return Shell(spark, d, ["lineitem"]).select("l_suppkey, count(DISTINCT l_partkey) AS parts, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) >= 5")


@query("""WITH RECURSIVE r AS (SELECT o_orderkey AS id, o_totalprice / 100 AS m, epoch_us(o_orderdate) / 86400000000 AS s, epoch_us(o_orderdate) / 86400000000 + 60 AS e FROM orders),
w AS (SELECT *, CASE WHEN m - lag(m) OVER (ORDER BY m, s, id) <= 1e-4 * m THEN 0 ELSE 1 END AS new FROM r), p AS (SELECT *, sum(new) OVER (ORDER BY m, s, id ROWS UNBOUNDED PRECEDING) AS piece FROM w),
q AS (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY m, s, id) AS n FROM p),
f AS (SELECT piece, n, 1 AS chain, m, s, e, 1 AS c FROM q WHERE n = 1 UNION ALL
  SELECT q.piece, q.n, CASE WHEN x THEN chain ELSE chain + 1 END, CASE WHEN x THEN (f.m * c + q.m) / (c + 1) ELSE q.m END, CASE WHEN x THEN least(f.s, q.s) ELSE q.s END, CASE WHEN x THEN greatest(f.e, q.e) ELSE q.e END, CASE WHEN x THEN c + 1 ELSE 1 END
  FROM (SELECT f.*, abs(f.m - q.m) / q.m <= 1e-4 AND f.s <= q.e AND q.s <= f.e AS x FROM f JOIN q ON q.piece = f.piece AND q.n = f.n + 1) f JOIN q ON q.piece = f.piece AND q.n = f.n + 1)
SELECT round(m, 6) AS mass, s AS start, e AS "end", c::BIGINT AS members FROM (SELECT *, row_number() OVER (PARTITION BY piece, chain ORDER BY n DESC) AS z FROM f) WHERE z = 1""")
def smoothed_overlaps(spark, d):
    """Neighbours by mass that overlap in time become one feature."""
    from massloom.plans.inputs import days

    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("m"), days("o_orderdate")).withColumn("e", F.col("day") + 60)
    return cluster.smooth_overlaps(rows, "m", "day", "e", 1e-4, "o_orderkey").withColumn("mass", F.round("mass", 6))


@query("""WITH m AS (SELECT user_id, event_type, max(value) AS v, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT *, first_value(event_type) OVER (PARTITION BY user_id ORDER BY v DESC, event_type) AS best, first_value(n) OVER (PARTITION BY user_id ORDER BY v DESC, event_type) AS best_n FROM m)
SELECT user_id, event_type, abs(v - max(v) OVER (PARTITION BY user_id)) <= 5 AND n >= best_n AS agrees FROM t""")
def multi_score_top(spark, d):
    """Rows that are as good as the best one in every score."""
    m = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"), F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.col("v").desc(), "event_type")
    t = m.withColumn("best_n", F.first("n").over(w)).withColumn("top", F.max("v").over(Window.partitionBy("user_id")))
    return t.select("user_id", "event_type", ((F.abs(F.col("v") - F.col("top")) <= 5) & (F.col("n") >= F.col("best_n"))).alias("agrees"))
