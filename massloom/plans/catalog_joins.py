"""Searches by mass, window, interval and neighbourhood."""

from __future__ import annotations

from pyspark.sql import functions as F

from massloom.operators import rangejoin, select
from massloom.plans.inputs import EVENTS_SQL, days, events, registrar
from massloom.session import shuffle_width, table

CATALOG: dict = {}
query = registrar(CATALOG)
PPM = 1e-5


def _lines(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").filter("l_extendedprice > 0")


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")


def _parts(spark, d):
    """Parts with a hundred times their price, which is where order totals lie."""
    return table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * 100).alias("p_retailprice"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, o_orderkey, o_totalprice FROM lineitem JOIN orders ON abs(o_totalprice - l_extendedprice) <= l_extendedprice * 1e-5")
def ppm_join(spark, d):
    return rangejoin.ppm_join(_lines(spark, d), _orders(spark, d).drop("o_orderpriority"), "l_extendedprice", "o_totalprice", PPM)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, o_orderkey, o_totalprice FROM lineitem JOIN orders ON abs(o_totalprice - l_extendedprice) < l_extendedprice * 5e-6")
def ppm_join_strict(spark, d):
    return rangejoin.ppm_join(_lines(spark, d), _orders(spark, d).drop("o_orderpriority"), "l_extendedprice", "o_totalprice", 5e-6, strict=True)


@query("SELECT p_partkey, p_retailprice, o_orderkey, o_totalprice FROM (SELECT p_partkey, p_retailprice * 100 AS p_retailprice FROM part) LEFT JOIN orders ON abs(o_totalprice - p_retailprice) <= p_retailprice * 1e-5")
def ppm_left(spark, d):
    return rangejoin.ppm_join(_parts(spark, d), _orders(spark, d).drop("o_orderpriority"), "p_retailprice", "o_totalprice", 1e-5, key=["p_partkey"], how="left")


@query("SELECT p_partkey, p_retailprice FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE abs(l_extendedprice - p_retailprice) <= p_retailprice * 1e-5)")
def ppm_semi(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return rangejoin.ppm_join(parts, _lines(spark, d).select("l_extendedprice"), "p_retailprice", "l_extendedprice", PPM, key=["p_partkey"], how="semi")


@query("SELECT p_partkey, p_retailprice FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE abs(l_extendedprice - p_retailprice) <= p_retailprice * 1e-5)")
def ppm_unmatched(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return rangejoin.ppm_join(parts, _lines(spark, d).select("l_extendedprice"), "p_retailprice", "l_extendedprice", PPM, key=["p_partkey"], how="anti")


@query("SELECT o_orderkey, o_totalprice, p_partkey, p_retailprice FROM orders JOIN part ON p_retailprice BETWEEN o_totalprice / 100 - 0.005 AND o_totalprice / 100 + 0.005")
def absolute_window_join(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return rangejoin.window_join(_orders(spark, d).drop("o_orderpriority"), parts, F.col("o_totalprice") / 100 - 0.005, F.col("o_totalprice") / 100 + 0.005, "p_retailprice", 0.01)


@query("SELECT p_partkey, p_retailprice, p_size FROM part WHERE p_retailprice BETWEEN 950 AND 960")
def mass_between(spark, d):
    return table(spark, d, "part").filter(F.col("p_retailprice").between(950, 960)).select("p_partkey", "p_retailprice", "p_size")


@query("SELECT a.p_partkey AS light_key, b.p_partkey AS heavy_key, a.p_retailprice AS light, b.p_retailprice AS heavy FROM part a JOIN part b ON abs(b.p_retailprice - (a.p_retailprice + 17.5)) <= (a.p_retailprice + 17.5) * 1e-6")
def shift_self_join(spark, d):
    part = table(spark, d, "part")
    a, b = part.select(F.col("p_partkey").alias("light_key"), F.col("p_retailprice").alias("light")), part.select(F.col("p_partkey").alias("heavy_key"), F.col("p_retailprice").alias("heavy"))
    return rangejoin.ppm_join(a, b, "light", "heavy", 1e-6, shift=17.5)


@query("""SELECT s.p_partkey, s.i, s.shift, o.o_orderkey FROM (SELECT p_partkey, p_retailprice * 100 AS p_retailprice, i, shift FROM part, generate_series(0, 2) g(i), (VALUES (0.0::DOUBLE), (18.01::DOUBLE)) v(shift)) s
JOIN orders o ON abs(o.o_totalprice - (s.p_retailprice - s.i * 1.003 - s.shift)) <= (s.p_retailprice - s.i * 1.003 - s.shift) * 1e-5""")
def precursor_probing(spark, d):
    """Isotopes probed downwards, and mass shifts: a small bounded fan-out per query, then one mass join."""
    fan = _parts(spark, d).withColumn("i", F.explode(F.array(*map(F.lit, range(3))))).withColumn("shift", F.explode(F.array(F.lit(0.0), F.lit(18.01))))
    fan = fan.withColumn("i", F.col("i").cast("long")).withColumn("mass", F.col("p_retailprice") - F.col("i") * 1.003 - F.col("shift"))
    return rangejoin.ppm_join(fan, _orders(spark, d).drop("o_orderpriority"), "mass", "o_totalprice", PPM, spread=True).select("p_partkey", "i", "shift", "o_orderkey")


_SPANS = f"(SELECT user_id AS owner, event_type AS kind, min(t) AS t0, max(t) AS t1 FROM {EVENTS_SQL} GROUP BY ALL HAVING count(*) > 1)"


def _spans(spark, d):
    return events(spark, d).groupBy(F.col("user_id").alias("owner"), F.col("event_type").alias("kind")).agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n")).filter("n > 1").drop("n")


@query(f"SELECT s.owner, s.kind, count(*) AS hits, round(sum(e.value), 4) AS signal FROM {_SPANS} s JOIN {EVENTS_SQL} e ON e.t BETWEEN s.t0 AND s.t1 AND e.user_id = s.owner GROUP BY ALL")
def interval_join(spark, d):
    spans, ev = _spans(spark, d), events(spark, d)
    found = ev.join(spans, (F.col("user_id") == F.col("owner")) & F.col("t").between(F.col("t0"), F.col("t1")))
    return found.groupBy("owner", "kind").agg(F.count("*").alias("hits"), F.round(F.sum("value"), 4).alias("signal"))


@query("""WITH c AS (SELECT o_custkey AS cust, min(epoch_us(o_orderdate)) / 86400000000 AS d0, min(epoch_us(o_orderdate)) / 86400000000 + 30 AS d1 FROM orders GROUP BY 1),
w AS (SELECT l_suppkey AS supp, min(epoch_us(l_shipdate)) / 86400000000 AS s0, min(epoch_us(l_shipdate)) / 86400000000 + 30 AS s1 FROM lineitem GROUP BY 1)
SELECT cust, count(*) AS overlaps, min(supp) AS first_supplier FROM c JOIN w ON d0 <= s1 AND s0 <= d1 GROUP BY cust""")
def overlap_join(spark, d):
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("cust"), days("o_orderdate")).groupBy("cust").agg(F.min("day").alias("d0")).withColumn("d1", F.col("d0") + 30)
    w = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supp"), days("l_shipdate")).groupBy("supp").agg(F.min("day").alias("s0")).withColumn("s1", F.col("s0") + 30)
    return rangejoin.overlap_join(c, w, "d0", "d1", "s0", "s1", 30.0).groupBy("cust").agg(F.count("*").alias("overlaps"), F.min("supp").alias("first_supplier"))


@query("""SELECT p_partkey, p_retailprice, o_totalprice, o_orderkey, round(distance, 6) AS distance FROM (SELECT p_partkey, p_retailprice, o_totalprice, o_orderkey, abs(o_totalprice - p_retailprice) AS distance,
row_number() OVER (PARTITION BY p_partkey ORDER BY abs(o_totalprice - p_retailprice), o_orderkey) AS n FROM (SELECT p_partkey, p_retailprice * 100 AS p_retailprice FROM part) JOIN orders ON abs(o_totalprice - p_retailprice) <= 2.0) WHERE n = 1""")
def nearest_lookup(spark, d):
    found = rangejoin.nearest_within(_parts(spark, d), _orders(spark, d).select("o_orderkey", "o_totalprice"), "p_retailprice", "o_totalprice", ["p_partkey"], 2.0, ["o_orderkey"])
    return found.withColumn("distance", F.round("distance", 6))


@query(f"""SELECT a.event_id, a.user_id, b.event_id AS view_id, round(a.t - b.t, 6) AS lag FROM (SELECT * FROM {EVENTS_SQL} WHERE event_type = 'purchase') a
ASOF LEFT JOIN (SELECT user_id, t, max(event_id) AS event_id FROM {EVENTS_SQL} WHERE event_type = 'view' GROUP BY ALL) b ON a.user_id = b.user_id AND a.t >= b.t""")
def asof_previous(spark, d):
    ev = events(spark, d)
    views = ev.filter("event_type = 'view'").groupBy("user_id", F.col("t").alias("view_t")).agg(F.max("event_id").alias("view_id"))
    found = rangejoin.nearest_in_group(ev.filter("event_type = 'purchase'").select("event_id", "user_id", "t"), views, "user_id", "t", "view_t", ["view_id"])
    return found.select("event_id", "user_id", F.col("previous.view_id").alias("view_id"), F.round(F.col("t") - F.col("previous.view_t"), 6).alias("lag"))


@query("SELECT DISTINCT p_partkey, p_brand FROM part JOIN lineitem ON l_partkey = p_partkey AND l_quantity BETWEEN p_size AND p_size + 1")
def spanning_sites(spark, d):
    """Equal key plus a range condition, one row per left key."""
    found = table(spark, d, "lineitem").select("l_partkey", "l_quantity").join(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return found.filter(F.col("l_quantity").between(F.col("p_size"), F.col("p_size") + 1)).select("p_partkey", "p_brand").distinct()


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT p_partkey AS k, p_retailprice AS v FROM part WHERE p_size <= 30) a
FULL JOIN (SELECT p_partkey AS k, p_retailprice * 2 AS v FROM part WHERE p_size >= 20) b ON a.k = b.k""")
def keyed_merge(spark, d):
    """Two keyed collections; the right side wins."""
    part = table(spark, d, "part")
    a = part.filter("p_size <= 30").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("a"))
    b = part.filter("p_size >= 20").select(F.col("p_partkey").alias("k"), (F.col("p_retailprice") * 2).alias("b"))
    return a.join(b, "k", "full").select("k", F.coalesce("b", "a").alias("v"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_extendedprice, o_orderkey, abs(o_totalprice - l_extendedprice) / l_extendedprice AS error FROM lineitem JOIN orders ON abs(o_totalprice - l_extendedprice) <= l_extendedprice * 1e-5),
s AS (SELECT *, -log10(error * 1e6 + 1e-3) AS score, o_orderkey % 2 = 0 AS is_decoy FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_extendedprice ORDER BY score DESC, o_orderkey) AS n FROM s),
k AS (SELECT round(score, 3) AS score, sum((NOT is_decoy)::INT) AS t, sum(is_decoy::INT) AS d FROM b WHERE n = 1 GROUP BY 1),
r AS (SELECT score, (sum(t) OVER w)::BIGINT AS targets, (sum(d) OVER w)::BIGINT AS decoys FROM k WINDOW w AS (ORDER BY score DESC)),
f AS (SELECT *, CASE WHEN targets = 0 THEN 1.0 ELSE decoys::DOUBLE / targets END AS fdr FROM r)
SELECT score, targets, decoys, round(fdr, 6) AS fdr, round(min(fdr) OVER (ORDER BY score), 6) AS q_value FROM f""")
def candidate_search(spark, d):
    """The whole search in small: candidates within tolerance, scores, best per query, error rates."""
    from massloom.plans.search import search_and_rate

    rates = search_and_rate(_lines(spark, d), _orders(spark, d), PPM)
    return rates.select("score", "targets", "decoys", F.round("fdr", 6).alias("fdr"), F.round("q_value", 6).alias("q_value"))


@query("SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def lookup_roll_up(spark, d):
    """Facts joined to two reference tables of fixed size; partial sums pass the shuffle."""
    c, n, r = (table(spark, d, name) for name in ("customer", "nation", "region"))
    return c.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", "customers", F.round("balance", 2).alias("balance"))


@query("SELECT least(a.l_orderkey, b.l_orderkey) AS low_order, greatest(a.l_orderkey, b.l_orderkey) AS high_order, count(*) AS shared FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_orderkey < b.l_orderkey GROUP BY ALL")
def shared_peak_pairs(spark, d):
    """Pairs of features that share a peak."""
    peaks = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    a, b = peaks.withColumnRenamed("l_orderkey", "low_order"), peaks.withColumnRenamed("l_orderkey", "high_order")
    return a.join(b, ["l_partkey", "l_suppkey"]).filter("low_order < high_order").groupBy("low_order", "high_order").agg(F.count("*").alias("shared"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def id_list_load(spark, d):
    """Rows whose id is in another selection, as a semi-join."""
    chosen = table(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey", "p_name").join(chosen, "p_partkey", "left_semi")


@query("""WITH f AS (SELECT p_partkey, floor(p_retailprice * 100)::BIGINT // 10 AS bin, p_retailprice AS mass FROM part), o AS (SELECT o_orderkey, floor(o_totalprice / 100 * 100)::BIGINT // 10 AS bin, o_totalprice / 100 AS o_totalprice FROM orders)
SELECT o_orderkey, count(*) AS fragments, min(p_partkey) AS first_part FROM o JOIN f ON f.bin BETWEEN o.bin - 1 AND o.bin + 1 AND abs(mass - o_totalprice) <= o_totalprice * 1e-4 GROUP BY 1""")
def fragment_index(spark, d):
    """Inverted index on mass bins: the query side looks into its own and the neighbouring bins."""
    bin_of = lambda c: F.floor(F.floor(F.col(c) * 100) / 10)
    f = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("mass"), bin_of("p_retailprice").alias("bin"))
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("o_totalprice"))
    o = o.select("o_orderkey", "o_totalprice", F.explode(F.sequence(bin_of("o_totalprice") - 1, bin_of("o_totalprice") + 1)).alias("bin"))
    found = o.join(f, "bin").filter(F.abs(F.col("mass") - F.col("o_totalprice")) <= F.col("o_totalprice") * 1e-4)
    return found.groupBy("o_orderkey").agg(F.count("*").alias("fragments"), F.min("p_partkey").alias("first_part"))


@query("""SELECT o_orderkey, a.p_partkey AS peptide, b.p_partkey AS glycan FROM (SELECT * FROM orders WHERE o_totalprice BETWEEN 1790 AND 2010) o JOIN (SELECT * FROM part WHERE p_size <= 25) a ON TRUE
JOIN (SELECT * FROM part WHERE p_size > 25) b ON abs(a.p_retailprice + b.p_retailprice - o_totalprice) <= o_totalprice * 1e-4""")
def bounded_cross_product(spark, d):
    """Two parts whose masses add up to an observed one: the second is looked up at the complement mass."""
    part, orders = table(spark, d, "part"), table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    light = part.filter("p_size <= 25").select(F.col("p_partkey").alias("peptide"), F.col("p_retailprice").alias("m1"))
    heavy = part.filter("p_size > 25").select(F.col("p_partkey").alias("glycan"), F.col("p_retailprice").alias("m2"))
    low, high = F.col("o_totalprice") * (1 - 1e-4) - F.col("m1"), F.col("o_totalprice") * (1 + 1e-4) - F.col("m1")
    # Which peptides can go with an order follows from the range of the glycans' masses.
    bounds = heavy.agg(F.min("m2").alias("least"), F.max("m2").alias("most")).first()
    # Masses are compared once each, however many rows share them; what fits is then looked up.
    totals, m1, m2 = orders.select("o_totalprice").distinct(), light.select("m1").distinct(), heavy.select("m2").distinct()
    paired = rangejoin.window_join(totals, m1, F.col("o_totalprice") * (1 - 1e-4) - bounds["most"], F.col("o_totalprice") * (1 + 1e-4) - bounds["least"], "m1", 50.0)
    found = rangejoin.window_join(paired, m2, low, high, "m2", 0.5)
    found = found.filter(F.abs(F.col("m1") + F.col("m2") - F.col("o_totalprice")) <= F.col("o_totalprice") * 1e-4)
    # Few masses stand for many rows, so what is to be multiplied last is dealt out first.
    rows = found.join(orders, "o_totalprice").join(light, "m1").repartition(4 * shuffle_width(spark), "o_orderkey", "peptide")
    return rows.join(heavy, "m2").select("o_orderkey", "peptide", "glycan")


@query("""WITH h AS (SELECT p_partkey, o_orderkey, o_totalprice FROM part JOIN orders ON abs(o_totalprice - p_retailprice * 100) <= p_retailprice * 100 * 1e-4)
SELECT p_partkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM h) WHERE n = 1""")
def most_intense_in_window(spark, d):
    """Of all features within tolerance the most intense."""
    found = rangejoin.ppm_join(_parts(spark, d), _orders(spark, d), "p_retailprice", "o_totalprice", 1e-4)
    return select.best_per_key(found, ["p_partkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]).select("p_partkey", "o_orderkey", "o_totalprice")
