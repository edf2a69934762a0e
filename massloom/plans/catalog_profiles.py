"""Features over time: assignment, merging, links between runs.

Orders are features: their total is the mass, their date the start, customers the samples.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from massloom.operators import features as feat
from massloom.operators import profiles, rangejoin
from massloom.plans.inputs import EVENTS_SQL, days, events, registrar
from massloom.session import table

CATALOG: dict = {}
query = registrar(CATALOG)

_F = """(SELECT o_orderkey AS id, o_totalprice / 100 AS mass, epoch_us(o_orderdate) / 86400000000 AS "start", epoch_us(o_orderdate) / 86400000000 + 10 + o_orderkey % 30 AS "end", o_totalprice AS signal, o_custkey,
CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'P' || o_custkey % 200 END AS entity, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'C' || o_custkey % 50 END AS composition, o_orderpriority AS run FROM orders)"""


def _features(spark, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        key.alias("id"), (F.col("o_totalprice") / 100).alias("mass"), days("o_orderdate").alias("start"), (days("o_orderdate") + 10 + key % 30).alias("end"), F.col("o_totalprice").alias("signal"), "o_custkey",
        F.when(key % 3 != 0, F.concat(F.lit("P"), (cust % 200).cast("string"))).alias("entity"), F.when(key % 7 != 0, F.concat(F.lit("C"), (cust % 50).cast("string"))).alias("composition"), F.col("o_orderpriority").alias("run"),
    )


@query(f"""WITH f AS (SELECT *, coalesce(entity, composition) AS a FROM {_F}), w AS (SELECT *, max("end") OVER (PARTITION BY a ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f WHERE a IS NOT NULL),
g AS (SELECT *, sum(CASE WHEN "start" - reach > 0.25 THEN 1 ELSE 0 END) OVER (PARTITION BY a ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS isl FROM w)
SELECT a AS annotation, min("start") AS "start", max("end") AS "end", count(*) AS members, round(sum(signal), 2) AS signal FROM g GROUP BY a, isl UNION ALL SELECT NULL, "start", "end", 1, round(signal, 2) FROM f WHERE a IS NULL""")
def annotated_features(spark, d):
    """Features of one annotation become one where they overlap; those without stay."""
    out = profiles.aggregate_by_annotation(_features(spark, d), [F.col("entity"), F.col("composition")], "start", "end", "signal", 0.25)
    return out.withColumn("signal", F.round("signal", 2))


_ORPH = """(SELECT l_orderkey AS o, l_linenumber AS n, l_extendedprice / 50 AS m, epoch_us(l_shipdate) / 86400000000 AS t, l_partkey % 40 AS target, l_quantity AS score FROM lineitem)"""


def _orphans(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), (F.col("l_extendedprice") / 50).alias("m"), days("l_shipdate").alias("t"), (F.col("l_partkey") % 40).alias("target"), F.col("l_quantity").alias("score")
    )


@query(f"""WITH o AS (SELECT DISTINCT o, n, m, t FROM {_ORPH}), c AS (SELECT o, n, m, t, f.id, least(abs(f."start" - t), abs(f."end" - t)) AS dist FROM o JOIN {_F} f ON f.mass BETWEEN m * (1 - 2e-5) AND m * (1 + 2e-5) WHERE abs(f.mass - m) <= m * 1e-5),
b AS (SELECT o, n, m, t, min(struct_pack(dist := dist, id := id)) AS best FROM c GROUP BY ALL HAVING min(dist) <= 200) SELECT o.o, o.n, round(o.m, 4) AS m, o.t, best.id AS feature, best.dist AS distance FROM o LEFT JOIN b ON o.o = b.o AND o.n = b.n AND o.m = b.m AND o.t = b.t""")
def distributed_orphans(spark, d):
    """Matches without a feature go to the one whose edge is nearest in time."""
    f = _features(spark, d).select(F.col("id").alias("feature"), F.col("mass").alias("feature_mass"), "start", "end")
    o = _orphans(spark, d).select("o", "n", "m", "t").distinct()
    return profiles.distribute_orphans(o, f, "m", "t", ["o", "n", "m", "t"], 1e-5, 200.0).withColumn("m", F.round("m", 4))


@query(f"SELECT target, count(*) AS matches, max(score) AS best_score, min(t) AS first_time, max(t) AS last_time FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY score DESC, target, n, m) AS r FROM {_ORPH}) WHERE r = 1 GROUP BY 1")
def grouped_orphans(spark, d):
    """Orphans by the best target of their scan."""
    from massloom.operators.select import best_per_key

    best = best_per_key(_orphans(spark, d), ["o"], [F.col("score").desc(), F.col("target").asc(), F.col("n").asc(), F.col("m").asc()])
    return best.groupBy("target").agg(F.count("*").alias("matches"), F.max("score").alias("best_score"), F.min("t").alias("first_time"), F.max("t").alias("last_time"))


@query(f"SELECT id, p_partkey FROM {_F} LEFT JOIN part ON abs(p_retailprice - mass) <= mass * 1e-5")
def assigned_features(spark, d):
    """One row for each composition that a feature's mass fits, or one without."""
    f = _features(spark, d).select("id", "mass")
    return rangejoin.ppm_join(f, table(spark, d, "part").select("p_partkey", "p_retailprice"), "mass", "p_retailprice", 1e-5, key=["id"], how="left").select("id", "p_partkey")


_SHIFT = """WITH f AS (SELECT * FROM {f}), p AS (SELECT a.id AS low, b.id AS high, s.name, abs(b.mass - (a.mass + s.step)) / (a.mass + s.step) AS size, (b.mass - (a.mass + s.step)) / (a.mass + s.step) AS err FROM f a, (VALUES ('ammonium', 17.0265::DOUBLE), ('sodium', 21.9819::DOUBLE), ('none', 0.0::DOUBLE)) s(name, step)
JOIN f b ON b.mass BETWEEN (a.mass + s.step) * (1 - 2e-5) AND (a.mass + s.step) * (1 + 2e-5) AND a.id <> b.id {on} AND b."start" - a."end" <= {w} AND a."start" - b."end" <= {w} WHERE abs(b.mass - (a.mass + s.step)) <= (a.mass + s.step) * 1e-5)
SELECT low, high, min(struct_pack(size := size, name := name, err := err)).name AS shift, round(min(struct_pack(size := size, name := name, err := err)).err * 1e6, 3) AS ppm FROM p GROUP BY low, high"""
_SHIFTS = [("ammonium", 17.0265), ("sodium", 21.9819), ("none", 0.0)]


@query(_SHIFT.format(f=_F, on="", w=2.0))
def shift_graph(spark, d):
    """Edges between features a mass shift apart that are near in time."""
    return profiles.shift_edges(_features(spark, d), _SHIFTS, 1e-5, 2.0).withColumn("ppm", F.round("ppm", 3))


@query(_SHIFT.format(f=_F, on="AND a.o_custkey % 8 = b.o_custkey % 8", w=0.0).replace("1e-5", "1e-4").replace("2e-5", "2e-4"))
def related_profiles(spark, d):
    """The same inside components, where only overlapping features count."""
    f = _features(spark, d).withColumn("component", F.col("o_custkey") % 8)
    return profiles.shift_edges(f, _SHIFTS, 1e-4, 0.0, on=["component"]).withColumn("ppm", F.round("ppm", 3))


@query(f"""WITH f AS (SELECT * FROM {_F}), i AS (SELECT run, entity AS structure, mass, "start" AS t FROM f WHERE entity IS NOT NULL), c AS (SELECT i.run, i.structure, f.run AS feature_run, struct_pack(a := abs(i.t - f."start"), b := abs(i.mass - f.mass), feature := f.id,
  act := CASE WHEN f.entity IS NULL THEN 'create' WHEN f.entity = i.structure THEN 'link' ELSE 'conflict' END) AS o FROM i JOIN f ON f.mass BETWEEN i.mass * (1 - 4e-5) AND i.mass * (1 + 4e-5) AND i.run <> f.run AND abs(i.t - f."start") <= 300 WHERE abs(f.mass - i.mass) <= i.mass * 2e-5)
SELECT run, structure, feature_run, min(o).feature AS feature, min(o).act AS action FROM c GROUP BY ALL""")
def match_between_runs(spark, d):
    """Structures of one run looked up among the features of the others."""
    f = _features(spark, d)
    known = f.filter("entity IS NOT NULL").select("run", F.col("entity").alias("structure"), "mass", F.col("start").alias("time"))
    other = f.select(F.col("run").alias("feature_run"), F.col("id").alias("feature"), F.col("mass").alias("feature_mass"), F.col("start").alias("feature_time"), F.col("entity").alias("feature_structure"))
    return profiles.match_between(known, other, 2e-5, 300.0)


@query(f"""PIVOT (SELECT entity AS structure, run, round(signal, 2) AS signal, id FROM {_F} WHERE entity IS NOT NULL) ON run IN ('1-URGENT', '5-LOW') USING max(signal) AS signal, count(id) AS n GROUP BY structure""")
def run_pivot(spark, d):
    """Abundance and features of each structure in each run, side by side."""
    f = _features(spark, d).filter("entity IS NOT NULL").select(F.col("entity").alias("structure"), "run", F.round("signal", 2).alias("signal"), "id")
    out = profiles.run_table(f, ["1-URGENT", "5-LOW"], {"signal": F.max("signal"), "n": F.count("id")})
    return out.na.fill(0, [c for c in out.columns if c.endswith("_n")])


@query(f"SELECT user_id, event_type, min(t) AS \"start\", max(t) AS \"end\", round(sum(value), 4) AS signal, count(*) AS points FROM {EVENTS_SQL} WHERE t >= 1704931200 AND t < 1705536000 GROUP BY ALL")
def truncated_features(spark, d):
    """Features cut at both ends."""
    out = profiles.truncated(events(spark, d), ["user_id", "event_type"], "t", "value", after=1704931200.0, before=1705536000.0)
    return out.withColumn("signal", F.round("signal", 4))


@query(f'SELECT id, "start", "end" FROM {_F} WHERE "start" <= 9800 AND "end" >= 9700')
def overlapping_features(spark, d):
    return profiles.overlapping(_features(spark, d), 9700.0, 9800.0).select("id", "start", "end")


_STEPS = f"(SELECT t, coalesce(lead(t) OVER (ORDER BY t) - t, t - lag(t) OVER (ORDER BY t)) AS step FROM (SELECT DISTINCT t FROM {EVENTS_SQL}))"


@query(f"SELECT t AS time, round(step, 5) AS step FROM {_STEPS}")
def sampling_steps(spark, d):
    """The time from each sample to the next."""
    return profiles.next_steps(events(spark, d), "t").select("time", F.round("step", 5).alias("step"))


_REL = """WITH st AS (SELECT * FROM {steps}), e AS (SELECT user_id, t, value, lag(t) OVER w AS b, abs(value - lag(value) OVER w) + 1 AS c FROM {rows} WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, round(sum((e.t - b) / step * c) / sum(c), 3) AS spacing, count(*) AS steps FROM e JOIN st ON st.t = b GROUP BY 1"""


@query(_REL.format(steps=_STEPS, rows=EVENTS_SQL))
def relative_spacing(spark, d):
    """Steps of a feature over the sampling step at that time."""
    out = profiles.relative_spacing(events(spark, d), ["user_id"], "t", "value", events(spark, d))
    return out.withColumn("spacing", F.round("spacing", 3))


_BEST = f"""(SELECT user_id, t, value FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS piece FROM (SELECT user_id, t, value, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 60000 THEN 1 ELSE 0 END AS new FROM {EVENTS_SQL}))
QUALIFY piece = first_value(piece) OVER (PARTITION BY user_id ORDER BY sum(value) OVER (PARTITION BY user_id, piece) DESC, piece))"""


@query(f"""WITH p AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS piece FROM (SELECT user_id, event_id, t, value, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 60000 THEN 1 ELSE 0 END AS new FROM {EVENTS_SQL})),
s AS (SELECT user_id, piece, sum(value) AS total FROM p GROUP BY ALL), b AS (SELECT user_id, max(struct_pack(a := total, b := -piece)).b AS neg FROM s GROUP BY 1),
k AS (SELECT p.user_id, t, value FROM p JOIN b ON p.user_id = b.user_id AND piece = -neg), st AS (SELECT * FROM {_STEPS}), e AS (SELECT user_id, t, value, lag(t) OVER w AS b, abs(value - lag(value) OVER w) + 1 AS c FROM k WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, round(sum((e.t - e.b) / step * c) / sum(c), 3) AS spacing, count(*) AS steps FROM e JOIN st ON st.t = e.b GROUP BY 1""")
def best_piece_spacing(spark, d):
    """The same for the most abundant piece of each feature."""
    kept = profiles.best_piece(events(spark, d), ["user_id"], "t", "value", 60000.0)
    return profiles.relative_spacing(kept, ["user_id"], "t", "value", events(spark, d)).withColumn("spacing", F.round("spacing", 3))


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN n % 4 = 2 THEN NULL ELSE value END AS v, n, c FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events)),
f AS (SELECT a.user_id, a.event_id, a.n, a.c, coalesce(a.v, list_avg(list_filter([b.v, p.v, x.v], lambda q: q IS NOT NULL))) AS f FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.n = a.n - 2 LEFT JOIN e p ON p.user_id = a.user_id AND p.n = a.n - 1 LEFT JOIN e x ON x.user_id = a.user_id AND x.n = a.n + 1),
g AS (SELECT user_id, list(f ORDER BY n) AS l FROM f GROUP BY 1) SELECT event_id, round(f, 4) AS filled, round(list_sort([l[greatest(1, least(n + 1 + j, c))] FOR j IN [-2, -1, 0, 1, 2]])[3], 4) AS smooth FROM f JOIN g USING (user_id)""")
def filled_series(spark, d):
    """Missing values filled from their neighbours, then medians of five."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = table(spark, d, "events").select("user_id", "event_id", F.when(nth % 4 != 2, F.col("value")).alias("value"))
    out = profiles.filled_and_smoothed(rows, ["user_id"], "event_id", "value")
    return out.select("event_id", F.round("filled", 4).alias("filled"), F.round("smooth", 4).alias("smooth"))


@query(f"""WITH e AS (SELECT user_id, event_id, t, value, value < lag(value) OVER w AND value < lead(value) OVER w AS low, value > lag(value) OVER w AND value > lead(value) OVER w AS top FROM {EVENTS_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY t)),
b AS (SELECT *, max(top::INT) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, max(top::INT) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM e) SELECT event_id, value FROM b WHERE low AND l = 1 AND r = 1""")
def split_points(spark, d):
    """Minima between maxima, where a profile is parted."""
    return profiles.split_points(events(spark, d), ["user_id"], "t", "value").select("event_id", "value")


@query("SELECT DISTINCT l_orderkey, l_returnflag, l_quantity FROM lineitem l JOIN (SELECT l_orderkey AS k, max(l_quantity) AS best FROM lineitem GROUP BY 1) ON k = l_orderkey AND best = l_quantity")
def exclusive_solutions(spark, d):
    """The best matches of each scan over all types of match; ties stay."""
    return profiles.exclusive_best(table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity"), "l_orderkey", "l_quantity")


@query("""WITH c AS (SELECT l_suppkey AS protein, l_linenumber AS site, l_returnflag AS composition, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY ALL)
SELECT protein, count(DISTINCT site) AS sites, string_agg(site || ':' || composition || '=' || s::BIGINT, ';' ORDER BY site, composition) AS cells FROM c GROUP BY 1""")
def protein_heterogeneity(spark, d):
    """What stands at each site of a protein, as nested maps."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("protein"), F.col("l_linenumber").alias("site"), F.col("l_returnflag").alias("composition"), F.col("l_quantity").alias("signal"))
    out = profiles.heterogeneity(rows)
    at_site = lambda e: F.transform(F.map_entries(e["value"]), lambda c: F.concat(e["key"].cast("string"), F.lit(":"), c["key"], F.lit("="), c["value"].cast("long").cast("string")))
    return out.select("protein", "sites", F.array_join(F.flatten(F.transform(F.map_entries("site_map"), at_site)), ";").alias("cells"))


@query("SELECT o_orderkey AS feature, max(l_quantity) AS best_score, count(l_quantity) AS matches, coalesce(max(l_quantity) >= 40, false) AS accepted FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def accepted_features(spark, d):
    """Features whose best match is good enough, and the rest."""
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("feature"), F.col("l_quantity").alias("score"))
    return profiles.accepted_or_not(m, table(spark, d, "orders").select(F.col("o_orderkey").alias("feature")), "feature", "score", 40.0)


@query("SELECT l_partkey, round(sum(l_quantity * log10(l_extendedprice) / 6) / sum(log10(l_extendedprice) / 6), 5) AS score, round(sum(log10(l_extendedprice) / 6), 5) AS weight, count(*) AS observations FROM lineitem GROUP BY 1")
def weighted_observations(spark, d):
    """Observations of a composition averaged by their log signal."""
    out = profiles.observed_mean(table(spark, d, "lineitem"), ["l_partkey"], "l_quantity", "l_extendedprice")
    return out.select("l_partkey", F.round("score", 5).alias("score"), F.round("weight", 5).alias("weight"), "observations")


@query("""WITH RECURSIVE t AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 3 END AS parent FROM part), c AS (SELECT id FROM t WHERE id IN (2, 5, 9) UNION SELECT t.id FROM t JOIN c ON t.parent = c.id) SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT id FROM c)""")
def taxonomy_exclusion(spark, d):
    """Rows outside the chosen taxa and all below them."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    tree = parts.withColumn("parent", F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 3)))
    inside = profiles.descendants(tree, parts.filter("id IN (2, 5, 9)"))
    return parts.join(inside, "id", "left_anti").select(F.col("id").alias("p_partkey"))


@query("SELECT event_id, user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events m WHERE m.event_type = 'error' AND m.user_id = e.user_id AND floor(m.value) = floor(e.value))")
def masked_points(spark, d):
    """Points without those that a masker holds as well."""
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", F.floor("value").alias("bin"))
    return profiles.masked(rows, rows.filter("event_type = 'error'"), ["user_id", "bin"]).select("event_id", "user_id")


@query("""SELECT l_orderkey, l_linenumber, l_returnflag AS node_type FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'Formate' ELSE CASE WHEN l_returnflag = 'Unmodified' THEN 'Formate' ELSE l_returnflag || ' + Formate' END END
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'Unmodified' ELSE l_returnflag END AS l_returnflag FROM lineitem WHERE l_linestatus = 'O')""")
def composed_shifts(spark, d):
    """Nodes of another feature taken over under a mass shift."""
    own = table(spark, d, "lineitem").filter("l_linestatus = 'F'").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("node_type"))
    plain = F.when(F.col("l_returnflag") == "N", "Unmodified").otherwise(F.col("l_returnflag"))
    other = table(spark, d, "lineitem").filter("l_linestatus = 'O'").select("l_orderkey", "l_linenumber", plain.alias("node_type"))
    return profiles.with_composed_shift(own, other, "Formate")


@query("SELECT l_partkey, l_quantity FROM lineitem WHERE l_linestatus = 'F' INTERSECT SELECT l_partkey, l_quantity FROM lineitem WHERE l_linestatus = 'O'")
def common_peaks(spark, d):
    """Peaks that two features share."""
    rows = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_linestatus")
    return rows.filter("l_linestatus = 'F'").drop("l_linestatus").intersect(rows.filter("l_linestatus = 'O'").drop("l_linestatus"))


@query("SELECT l_suppkey, l_partkey FROM lineitem WHERE l_quantity > 40 UNION SELECT l_suppkey, l_partkey FROM lineitem WHERE l_discount > 0.08")
def merged_workloads(spark, d):
    """The candidate pairs of two workloads, each once."""
    rows = table(spark, d, "lineitem")
    return rows.filter("l_quantity > 40").select("l_suppkey", "l_partkey").union(rows.filter("l_discount > 0.08").select("l_suppkey", "l_partkey")).distinct()


@query(f"SELECT user_id, round(sum(value), 4) AS total, min(t) AS \"start\", max(t) AS \"end\", arg_max(t, value) AS apex FROM (SELECT DISTINCT ON (user_id, value) * FROM {EVENTS_SQL} ORDER BY user_id, value, t) GROUP BY 1")
def feature_spans(spark, d):
    """Groups of features with their common span of time."""
    rows = events(spark, d).groupBy("user_id", "value").agg(F.min("t").alias("t"))
    out = feat.apex(rows, ["user_id"], "t", "value")
    return out.select("user_id", F.round("total", 4).alias("total"), "start", "end", F.col("apex_time").alias("apex"))
