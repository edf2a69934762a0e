"""Generators, compositions, sequences and networks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from massloom.functions import compositions as comp
from massloom.functions import sequences as seq
from massloom.operators import expressions, graph, space
from massloom.plans.inputs import registrar
from massloom.session import table

CATALOG: dict = {}
query = registrar(CATALOG)
# Monoisotopic masses of residues and of water.
MASSES = {"Hex": 162.0528, "HexNAc": 203.0794, "Fuc": 146.0579, "Neu5Ac": 291.0954}
WATER = 18.0106


@query("""SELECT h::INT AS Hex, n::INT AS HexNAc, f::INT AS Fuc, s::INT AS Neu5Ac, round(18.0106::DOUBLE + h * 162.0528::DOUBLE + n * 203.0794::DOUBLE + f * 146.0579::DOUBLE + s * 291.0954::DOUBLE, 4) AS mass
FROM generate_series(3, 10) a(h), generate_series(2, 9) b(n), generate_series(0, 5) c(f), generate_series(0, 4) e(s) WHERE n > f AND n - 1 > s""")
def bounded_product(spark, d):
    """Compositions within bounds under the constraints HexNAc > Fuc and HexNAc > NeuAc + 1."""
    keep = expressions.compile_rule("HexNAc > Fuc & HexNAc > (Neu5Ac + 1)", lambda name: F.col(name))
    rows = space.bounded_product(spark, {"Hex": (3, 10), "HexNAc": (2, 9), "Fuc": (0, 5), "Neu5Ac": (0, 4)}, keep)
    total = F.lit(WATER)
    for name in ("Hex", "HexNAc", "Fuc", "Neu5Ac"):
        total = total + F.col(name) * MASSES[name]
    return rows.withColumn("mass", F.round(total, 4))


@query("""WITH r AS (SELECT n_nationkey AS i, (n_nationkey + 1) * 10.0::DOUBLE AS m FROM nation)
SELECT i::VARCHAR AS members, 1 AS size, m AS total FROM r UNION ALL SELECT a.i || ',' || b.i, 2, a.m + b.m FROM r a JOIN r b ON b.i >= a.i UNION ALL SELECT a.i || ',' || b.i || ',' || c.i, 3, a.m + b.m + c.m FROM r a JOIN r b ON b.i >= a.i JOIN r c ON c.i >= b.i""")
def combinations(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("i"), ((F.col("n_nationkey") + 1) * 10.0).alias("m"))
    return space.combinations_with_replacement(rows, "i", "m", 3).select(F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "size", "total")


@query("""WITH s AS (SELECT n_nationkey, n_regionkey FROM nation), a AS (SELECT n_regionkey, list_sort(list(n_nationkey)) AS xs FROM s GROUP BY 1)
SELECT n_regionkey, count(*) AS pairs, min(x) AS first_low FROM (SELECT n_regionkey, x, y FROM a, unnest(xs) u(x), unnest(xs) v(y) WHERE x < y) GROUP BY 1""")
def site_combinations(spark, d):
    """k-subsets of sites, up to a limit."""
    a = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("xs"))
    return a.withColumn("c", F.explode(space.limited_combinations(F.col("xs"), 2, 100))).groupBy("n_regionkey").agg(F.count("*").alias("pairs"), F.min(F.col("c")[0]).alias("first_low"))


@query("SELECT a::INT AS Na, n::INT AS NH4, f::INT AS Formate, round(a * 21.9819::DOUBLE + n * 17.0265::DOUBLE + f * 46.0055::DOUBLE, 4) AS mass FROM generate_series(0, 2) x(a), generate_series(0, 3) y(n), generate_series(0, 1) z(f) WHERE a + n + f > 0")
def shift_combinations(spark, d):
    return space.shift_combinations(spark, {"Na": (21.9819, 2), "NH4": (17.0265, 3), "Formate": (46.0055, 1)}).withColumn("mass", F.round("mass", 4))


@query("""WITH p AS (SELECT p_partkey, p_size % 4 AS a, p_partkey % 5 AS b, length(p_type) % 6 AS c FROM part), n AS (SELECT min(p_partkey) AS i, a, b, c FROM p GROUP BY a, b, c)
SELECT x.i AS a, y.i AS b, abs(x.a - y.a) + abs(x.b - y.b) + abs(x.c - y.c) AS distance, 1.0::DOUBLE AS weight FROM n x JOIN n y ON x.i < y.i AND abs(x.a - y.a) + abs(x.b - y.b) + abs(x.c - y.c) <= 1""")
def composition_network(spark, d):
    edges = graph.unit_edges(_nodes(spark, d), "i", ["a", "b", "c"])
    return edges.select("a", "b", F.col("distance").cast("long").alias("distance"), "weight")


def _nodes(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 4).alias("a"), (F.col("p_partkey") % 5).alias("b"), (F.length("p_type") % 6).alias("c"))
    return p.groupBy("a", "b", "c").agg(F.min("p_partkey").alias("i"))


@query("""WITH p AS (SELECT p_partkey, p_size % 4 AS a, p_partkey % 5 AS b, length(p_type) % 6 AS c FROM part), n AS (SELECT min(p_partkey) AS i, a, b, c FROM p GROUP BY a, b, c),
e AS (SELECT x.i AS node, y.i AS m FROM n x JOIN n y ON abs(x.a - y.a) + abs(x.b - y.b) + abs(x.c - y.c) <= 1), s AS (SELECT a, count(*) AS size FROM n GROUP BY 1)
SELECT e.node, n.a::BIGINT AS neighbourhood, round(count(*)::DOUBLE / any_value(s.size), 6) AS belongingness FROM e JOIN n ON n.i = e.m JOIN s ON s.a = n.a GROUP BY e.node, n.a""")
def belongingness(spark, d):
    nodes = _nodes(spark, d)
    edges = graph.unit_edges(nodes, "i", ["a", "b", "c"])
    members = nodes.select(F.col("i").alias("node"), F.col("a").cast("long").alias("neighbourhood"))
    return graph.belongingness(edges, members).withColumn("belongingness", F.round("belongingness", 6))


_LINKS = "SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events QUALIFY b IS NOT NULL"


def _links(spark, d):
    """Each event with the next of the same user: paths, the hardest shape for component search."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("event_id").alias("a"), F.lead("event_id").over(w).alias("b")).filter("b IS NOT NULL")


@query(f"""WITH RECURSIVE e AS (SELECT a, b FROM ({_LINKS}) UNION SELECT b, a FROM ({_LINKS})), r AS (SELECT a AS id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT id, min(c) AS component FROM r GROUP BY 1""")
def components(spark, d):
    return graph.components(_links(spark, d))


@query(f"SELECT component, count(*) AS members FROM (WITH RECURSIVE e AS (SELECT a, b FROM ({_LINKS}) UNION SELECT b, a FROM ({_LINKS})), r AS (SELECT a AS id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id) SELECT id, min(c) AS component FROM r GROUP BY 1) GROUP BY 1")
def component_workloads(spark, d):
    return graph.components(_links(spark, d)).groupBy("component").agg(F.count("*").alias("members"))


@query("""WITH p AS (SELECT p_partkey, p_size % 4 AS a, p_partkey % 5 AS b, length(p_type) % 6 AS c FROM part), n AS (SELECT min(p_partkey) AS i, a, b, c FROM p GROUP BY a, b, c),
e AS (SELECT x.i AS u, y.i AS v FROM n x JOIN n y ON abs(x.a - y.a) + abs(x.b - y.b) + abs(x.c - y.c) = 1), d1 AS (SELECT v AS id, 1 AS s FROM e WHERE u = (SELECT min(i) FROM n)),
d2 AS (SELECT DISTINCT e.v AS id, 2 AS s FROM d1 JOIN e ON e.u = d1.id), d3 AS (SELECT DISTINCT e.v AS id, 3 AS s FROM d2 JOIN e ON e.u = d2.id)
SELECT id, min(s)::DOUBLE AS distance FROM (SELECT min(i) AS id, 0 AS s FROM n UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3) GROUP BY 1""")
def shortest_paths(spark, d):
    nodes = _nodes(spark, d)
    edges = graph.unit_edges(nodes, "i", ["a", "b", "c"])
    return graph.distances_from(edges, nodes.agg(F.min("i").alias("id")), 3)


@query("""SELECT p_partkey, label FROM part, LATERAL (SELECT unnest(list_filter([CASE WHEN p_size BETWEEN 1 AND 12 THEN 'small' END, CASE WHEN p_size >= 10 THEN 'large' END, CASE WHEN p_retailprice / p_size >= 100 THEN 'dense' END], lambda x: x IS NOT NULL)) AS label)""")
def rule_neighbourhoods(spark, d):
    part = table(spark, d, "part")
    rules = {"small": F.col("p_size").between(1, 12), "large": F.col("p_size") >= 10, "dense": F.try_divide(F.col("p_retailprice"), F.col("p_size")) >= 100}
    return graph.neighbourhood_labels(part, rules).select("p_partkey", F.col("neighbourhood").alias("label"))


@query("SELECT p_partkey, (p_size * 2 + 3 > p_partkey % 50 AND p_size >= 5) OR p_retailprice < 950 AS accepted FROM part")
def expression_filter(spark, d):
    """A rule given as text."""
    part = table(spark, d, "part").withColumn("r", F.col("p_partkey") % 50)
    rule = expressions.compile_rule("((2p_size + 3 > r) & (p_size >= 5)) | (p_retailprice < 950)", lambda name: F.col(name))
    return part.select("p_partkey", rule.alias("accepted"))


@query("""WITH s AS (SELECT p_partkey, p_type FROM part) SELECT p_partkey, '{' || string_agg(ch || ':' || n, '; ' ORDER BY ch) || '}' AS composition, sum(n)::BIGINT AS residues FROM
(SELECT p_partkey, ch, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS ch FROM s) GROUP BY ALL) GROUP BY 1""")
def composition_text(spark, d):
    """Token counts as compositions, their text form, and back."""
    words = table(spark, d, "part").select("p_partkey", F.explode(F.split("p_type", " ")).alias("w")).groupBy("p_partkey", "w").agg(F.count("*").cast("int").alias("n"))
    made = words.groupBy("p_partkey").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("m"))
    text = made.select("p_partkey", comp.to_text(F.col("m")).alias("composition"))
    back = comp.parse_any(F.col("composition"))
    return text.withColumn("residues", F.size(comp.linearised(back)).cast("long"))


@query("""SELECT a.p_partkey, abs(a.s - b.s) + abs(a.k - b.k) + abs(a.l - b.l) AS distance FROM (SELECT p_partkey, p_size AS s, p_partkey % 7 AS k, length(p_name) AS l FROM part) a JOIN (SELECT p_partkey, p_size AS s, p_partkey % 7 AS k, length(p_name) AS l FROM part) b ON b.p_partkey = a.p_partkey + 1""")
def composition_distance(spark, d):
    m = F.create_map(F.lit("s"), F.col("p_size").cast("int"), F.lit("k"), (F.col("p_partkey") % 7).cast("int"), F.lit("l"), F.length("p_name"))
    a = table(spark, d, "part").select("p_partkey", m.alias("m"))
    b = a.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("m").alias("o"))
    return a.join(b, "p_partkey").select("p_partkey", comp.distance(F.col("m"), F.col("o")).cast("long").alias("distance"))


_SEQ = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


@query(f"""WITH s AS (SELECT item_id, {_SEQ} AS q FROM benchmark), c AS (SELECT item_id, list_filter(string_split(regexp_replace(regexp_replace(q, '([KR])', '\\1|', 'g'), '([KR])\\|P', '\\1P', 'g'), '|'), lambda x: len(x) > 0) AS p FROM s),
u AS (SELECT item_id, p, unnest(range(1, len(p) + 1)) AS i FROM c), m AS (SELECT item_id, i, k, list_aggregate(p[i:i + k], 'string_agg', '') AS peptide, coalesce(list_sum(list_transform(p[1:i - 1], lambda x: len(x))), 0)::INT AS start FROM u, generate_series(0, 1) g(k) WHERE i + k <= len(p))
SELECT item_id, peptide, start, (start + len(peptide))::INT AS "end", k::INT AS missed FROM m WHERE len(peptide) BETWEEN 6 AND 30 AND NOT contains(peptide, 'X')""")
def digest(spark, d):
    """Tryptic peptides with up to one missed cleavage."""
    q = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    rows = table(spark, d, "benchmark").select("item_id", F.explode(seq.digest(q, seq.PROTEASES["trypsin"], 1, 6, 30)).alias("p"))
    return rows.select("item_id", "p.peptide", "p.start", "p.end", "p.missed")


@query(f"""WITH s AS (SELECT item_id, {_SEQ} AS q FROM benchmark), p AS (SELECT item_id, q, unnest(range(0, len(q))) AS i FROM s) SELECT item_id, i::INT AS site, CASE WHEN q[i + 1] = 'N' THEN 'N' ELSE 'O' END AS kind
FROM p WHERE (q[i + 1] = 'N' AND q[i + 2] <> 'P' AND q[i + 2] <> '' AND q[i + 3] IN ('S', 'T')) OR q[i + 1] IN ('S', 'T')""")
def sites(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("q"))
    part = lambda pattern, kind: rows.select("item_id", F.explode(seq.sites(F.col("q"), pattern)).alias("site"), F.lit(kind).alias("kind"))
    return part(seq.N_SEQUON, "N").union(part(seq.O_SITE, "O"))


@query(f"SELECT item_id, reverse({_SEQ}) AS decoy, len({_SEQ}) AS residues FROM benchmark")
def reversed_decoys(spark, d):
    q = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, d, "benchmark").select("item_id", F.reverse(q).alias("decoy"), F.length(q).cast("long").alias("residues"))


@query("""SELECT p_partkey, concat('sp|', upper(replace(p_brand, '#', '')), '|X') AS name, upper(replace(p_brand, '#', '')) AS accession, regexp_replace(p_name, '[^A-Za-z0-9_.-]+', '_', 'g') AS file FROM part""")
def names_and_accessions(spark, d):
    name = F.concat(F.lit("sp|"), F.upper(F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))), F.lit("|X"))
    return table(spark, d, "part").select("p_partkey", name.alias("name"), seq.accession(name).alias("accession"), seq.safe_filename(F.col("p_name")).alias("file"))
