"""Search spaces: combinations, modifications, glycoforms, networks, selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from massloom.functions import compositions as comp
from massloom.functions import sequences as seq
from massloom.operators import build, rangejoin, space, strings
from massloom.plans.inputs import registrar
from massloom.session import table

CATALOG: dict = {}
query = registrar(CATALOG)

_SETS = """(SELECT s_suppkey::VARCHAR AS combination, 1 AS size, s_acctbal AS total, [s_suppkey] AS members FROM supplier UNION ALL SELECT a.s_suppkey || '+' || b.s_suppkey, 2, a.s_acctbal + b.s_acctbal, [a.s_suppkey, b.s_suppkey] FROM supplier a JOIN supplier b ON b.s_suppkey >= a.s_suppkey)"""


def _sets(spark, d):
    return space.combinations_with_replacement(table(spark, d, "supplier"), "s_suppkey", "s_acctbal", 2)


@query(f"SELECT combination, size, round(total, 2) AS total FROM {_SETS}")
def stored_combinations(spark, d):
    """Combinations of up to two compositions as a table."""
    return build.combination_tables(_sets(spark, d))[0].withColumn("total", F.round("total", 2))


@query(f"SELECT combination, m AS member, count(*) AS count FROM (SELECT combination, unnest(members) AS m FROM {_SETS}) GROUP BY ALL")
def combination_members(spark, d):
    """How often each composition stands in each combination."""
    return build.combination_tables(_sets(spark, d))[1]


@query(f"""WITH m AS (SELECT combination, CASE WHEN s_nationkey < 12 THEN 'N' ELSE 'O' END AS c, count(*) AS n FROM (SELECT combination, unnest(members) AS m FROM {_SETS}) JOIN supplier ON m = s_suppkey GROUP BY ALL)
SELECT combination, sum(n)::BIGINT AS size, string_agg(c || ':' || n, ';' ORDER BY c) AS class_counts FROM m GROUP BY 1""")
def combination_partitions(spark, d):
    """Combinations by size and the classes of their members."""
    classes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("member"), F.when(F.col("s_nationkey") < 12, "N").otherwise("O").alias("class"))
    return build.partitioned_combinations(build.combination_tables(_sets(spark, d))[1], classes)


def _compositions(spark, d):
    made = F.create_map(F.lit("Hex"), F.col("p_size").cast("int"), F.lit("HexNAc"), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, d, "part").select("p_partkey", made.alias("c"))


@query("""SELECT p_partkey, a::INT AS sulfate, p::INT AS phosphate, '{Hex:' || p_size || CASE WHEN p_partkey % 5 > 0 THEN '; HexNAc:' || p_partkey % 5 ELSE '' END || '; Reduced:' || p_size || CASE WHEN p > 0 THEN '; phosphate:' || p ELSE '' END || CASE WHEN a > 0 THEN '; sulfate:' || a ELSE '' END || '}' AS text
FROM part, generate_series(0, 2) x(a), generate_series(0, 1) y(p)""")
def modified_compositions(spark, d):
    """Compositions with one constant and two variable modifications."""
    rows = build.modified_compositions(_compositions(spark, d), "c", {"Reduced": "Hex"}, {"sulfate": 2, "phosphate": 1})
    n = lambda name: comp.count(F.col("modified"), name).alias(name)
    return rows.select("p_partkey", n("sulfate"), n("phosphate"), comp.to_text(F.col("modified")).alias("text"))


@query("SELECT p_partkey, p_size + p_partkey % 5 AS Hex, 2 AS HexNAc FROM part")
def underivatised(spark, d):
    """Derivatives counted with their base residues."""
    made = F.create_map(F.lit("Hex^Me"), F.col("p_size").cast("int"), F.lit("Hex^Ac"), (F.col("p_partkey") % 5).cast("int"), F.lit("HexNAc"), F.lit(2))
    base = build.underivatised(made)
    return table(spark, d, "part").select("p_partkey", comp.count(base, "Hex").cast("long").alias("Hex"), comp.count(base, "HexNAc").alias("HexNAc"))


@query("SELECT p_partkey, '{Fuc:' || p_size || '; Neu5Ac:1}' AS text, (p_size + 1)::INT AS residues, p_size - CASE WHEN p_size > 1 THEN 1 ELSE 0 END AS internal FROM part")
def canonical_names(spark, d):
    """Formulas read, residues under canonical names, and the size without terminal residues."""
    text = F.concat(F.lit("dHex"), F.col("p_size").cast("string"), F.lit("NeuAc1"))
    rows = table(spark, d, "part").withColumn("c", build.canonical_names(comp.parse_formula(F.replace(text, F.lit("dHex"), F.lit("DHex"))), {"DHex": "Fuc", "NeuAc": "Neu5Ac"}))
    total = F.aggregate(F.map_values("c"), F.lit(0), lambda t, v: t + v)
    return rows.select("p_partkey", comp.to_text(F.col("c")).alias("text"), total.alias("residues"), comp.internal_size(F.col("c")).cast("long").alias("internal"))


_SEQ = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


def _proteins(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("protein"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence"))


@query(f"""WITH p AS (SELECT item_id AS protein, {_SEQ} AS q FROM benchmark), e AS (SELECT protein, q, list_sort(list_distinct([0, 5, 20, len(q) // 2, len(q)])) AS b FROM p WHERE len(q) > 40), u AS (SELECT protein, q, b[i] AS s, b[i + 1] AS t FROM e, generate_series(1, 4) g(i))
SELECT protein, q[s + 1:t] AS piece, s::INT AS "start", t::INT AS "end" FROM u WHERE t - s >= 6""")
def protein_pieces(spark, d):
    """Proteins cut where annotations say."""
    p = _proteins(spark, d).filter("length(sequence) > 40")
    p = p.withColumn("cuts", F.array(F.lit(5), F.lit(20), F.floor(F.length("sequence") / 2).cast("int")))
    return build.split_protein(p, "sequence", "cuts", 6).select("protein", "piece", "start", "end")


@query(f"""WITH s AS (SELECT item_id, {_SEQ} AS q FROM benchmark), c AS (SELECT item_id, q, list_filter(string_split(regexp_replace(regexp_replace(q, '([KR])', '\\1|', 'g'), '([KR])\\|P', '\\1P', 'g'), '|'), lambda x: len(x) > 0) AS p FROM s),
u AS (SELECT item_id, q, p, unnest(range(1, len(p) + 1)) AS i FROM c), m AS (SELECT item_id, q, list_aggregate(p[i:i + k], 'string_agg', '') AS peptide, coalesce(list_sum(list_transform(p[1:i - 1], lambda x: len(x))), 0)::INT AS s FROM u, generate_series(0, 1) g(k) WHERE i + k <= len(p)),
f AS (SELECT DISTINCT item_id, peptide, s, unnest(range(s, s + len(peptide))) AS site, q FROM m WHERE len(peptide) BETWEEN 5 AND 60 AND NOT contains(peptide, 'X'))
SELECT item_id AS protein, peptide, s AS "start", (s + len(peptide))::INT AS "end", site::INT AS site, n_nationkey::BIGINT AS glycan FROM f, nation WHERE q[site + 1] = 'N' AND q[site + 2] <> 'P' AND q[site + 2] <> '' AND q[site + 3] IN ('S', 'T')""")
def fasta_candidates(spark, d):
    """Sequences to candidates: digestion, sequons, compositions."""
    glycans = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("glycan"))
    return build.fasta_candidates(_proteins(spark, d), glycans).select("protein", "peptide", "start", "end", "site", "glycan")


@query("""WITH p AS (SELECT p_partkey, p_retailprice AS m, list_filter([1, 2, 3, 4], lambda i: (p_size >> i) & 1 = 1) AS n, list_filter([5, 6], lambda i: (p_size >> (i - 4)) & 1 = 0) AS o FROM part),
u AS (SELECT p_partkey, m, 'N' AS class, unnest(n) AS site FROM p UNION ALL SELECT p_partkey, m, 'O', unnest(o) FROM p) SELECT p_partkey, class, site::INT AS site, n_nationkey::BIGINT AS glycan, round(m + 200 + n_nationkey * 10, 4) AS mass FROM u JOIN nation ON class = CASE WHEN n_regionkey < 2 THEN 'N' ELSE 'O' END""")
def glycoforms(spark, d):
    """Each composition on each site of its class."""
    bit = lambda i, by, set_: F.shiftright("p_size", by).bitwiseAND(1) == set_
    n = F.array_compact(F.array(*(F.when(bit(i, i, 1), F.lit(i)) for i in (1, 2, 3, 4))))
    o = F.array_compact(F.array(*(F.when(bit(i, i - 4, 0), F.lit(i)) for i in (5, 6))))
    rows = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("peptide_mass"), n.alias("n"), o.alias("o"))
    g = table(spark, d, "nation").select(F.when(F.col("n_regionkey") < 2, "N").otherwise("O").alias("class"), F.col("n_nationkey").cast("long").alias("glycan"), (200.0 + F.col("n_nationkey") * 10).alias("glycan_mass"))
    return build.glycoforms(rows, g, {"N": "n", "O": "o"}).select("p_partkey", "class", "site", "glycan", F.round("mass", 4).alias("mass"))


@query("""SELECT l_partkey, l_suppkey, l_orderkey AS best, l_extendedprice AS score, evidence FROM (SELECT *, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS evidence, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey) AS n FROM lineitem) WHERE n = 1""")
def best_evidence(spark, d):
    """Of each peptide of a protein the evidence that scores best."""
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_extendedprice")
    out = build.best_evidence(rows, ["l_partkey", "l_suppkey"], "l_extendedprice", ["l_orderkey"])
    return out.select("l_partkey", "l_suppkey", F.col("l_orderkey").alias("best"), F.col("l_extendedprice").alias("score"), "evidence")


_NODES = "(SELECT min(p_partkey) AS i, p_size AS a, p_partkey % 9 AS b, length(p_type) AS c FROM part GROUP BY ALL)"


def _nodes(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("a"), (F.col("p_partkey") % 9).alias("b"), F.length("p_type").alias("c"))
    return rows.groupBy("a", "b", "c").agg(F.min("p_partkey").alias("i"))


@query(f"SELECT x.i AS a, y.i AS b, (abs(x.a - y.a) + abs(x.b - y.b) + abs(x.c - y.c))::INT AS distance FROM {_NODES} x JOIN {_NODES} y ON x.i <> y.i AND abs(x.a - y.a) + abs(x.b - y.b) + abs(x.c - y.c) <= 2")
def related_compositions(spark, d):
    """Compositions within two steps of each other."""
    return build.within_distance(_nodes(spark, d), "i", ["a", "b", "c"], 2)


@query(f"SELECT x.i AS a, count(*) AS neighbours FROM {_NODES} x JOIN {_NODES} y ON x.i <> y.i AND abs(x.a - y.a) + abs(x.b - y.b) + abs(x.c - y.c) <= 1 GROUP BY 1")
def narrow_neighbours(spark, d):
    """How many compositions lie one step away."""
    return build.within_distance(_nodes(spark, d), "i", ["a", "b", "c"], 1).groupBy("a").agg(F.count("*").alias("neighbours"))


_EDGES = "(SELECT least(l_partkey, l_suppkey + 10000) AS a, greatest(l_partkey, l_suppkey + 10000) AS b, min(l_linenumber) AS o FROM lineitem WHERE l_quantity > 45 GROUP BY ALL)"


@query(f"""WITH e AS (SELECT * FROM {_EDGES}), g AS (SELECT s_suppkey + 10000 AS id FROM supplier WHERE s_suppkey % 4 = 0), s AS (SELECT a, b, o FROM e UNION ALL SELECT b, a, o FROM e), r AS (SELECT a, b, o FROM s WHERE a IN (SELECT id FROM g) AND b NOT IN (SELECT id FROM g)),
k AS (SELECT a, b, o FROM e WHERE a NOT IN (SELECT id FROM g) AND b NOT IN (SELECT id FROM g)), n AS (SELECT x.b AS a, y.b AS b, min(x.o + y.o) AS o FROM r x JOIN r y ON x.a = y.a AND x.b < y.b WHERE x.o + y.o < 4 GROUP BY ALL)
SELECT a, b, o AS "order" FROM k UNION ALL SELECT a, b, o FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.a = n.a AND k.b = n.b)""")
def removed_nodes(spark, d):
    """A network without some nodes, their neighbours bridged where that is short."""
    line = table(spark, d, "lineitem").filter("l_quantity > 45")
    far = F.col("l_suppkey") + 10000
    edges = line.groupBy(F.least("l_partkey", far).alias("a"), F.greatest("l_partkey", far).alias("b")).agg(F.min("l_linenumber").alias("order"))
    gone = table(spark, d, "supplier").filter("s_suppkey % 4 = 0").select((F.col("s_suppkey") + 10000).alias("id"))
    return build.remove_nodes(edges, gone, 4)


@query("""SELECT least(a, b) AS a, greatest(a, b) AS b, max(w) AS weight FROM (SELECT l_partkey AS a, l_suppkey + 10000 AS b, l_discount AS w FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_suppkey + 10000, l_partkey, l_tax FROM lineitem WHERE l_returnflag = 'R') GROUP BY ALL""")
def merged_networks(spark, d):
    """Two networks as one."""
    line = table(spark, d, "lineitem")
    far = F.col("l_suppkey") + 10000
    one = line.filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("a"), far.alias("b"), F.col("l_discount").alias("weight"))
    two = line.filter("l_returnflag = 'R'").select(far.alias("a"), F.col("l_partkey").alias("b"), F.col("l_tax").alias("weight"))
    nodes = [e.select(F.col("a").alias("label")).union(e.select("b")) for e in (one, two)]
    return build.merge_networks(nodes, [one, two])[1]


@query("""WITH RECURSIVE s AS (SELECT 3 AS h, 2 AS n, 0 AS f, 0 AS k UNION SELECT CASE e WHEN 0 THEN h + 1 ELSE h END, CASE e WHEN 1 THEN n + 1 ELSE n END, CASE e WHEN 2 THEN f + 1 ELSE f END, k + 1
FROM s, (SELECT unnest([0, 1, 2]) AS e) WHERE k < 20 AND CASE e WHEN 0 THEN n > 2 AND h < 5 WHEN 1 THEN h >= 3 AND n < 5 ELSE n > 3 AND f < 1 END)
SELECT h AS Hex, n AS HexNAc, f AS Fuc, min(k) AS steps FROM s GROUP BY ALL""")
def synthesised_compositions(spark, d):
    """All that three enzymes make from a core within limits."""
    seed = spark.createDataFrame([(3, 2, 0)], "Hex int, HexNAc int, Fuc int")
    enzymes = [(F.col("HexNAc") > 2, {"Hex": 1}), (F.col("Hex") >= 3, {"HexNAc": 1}), (F.col("HexNAc") > 3, {"Fuc": 1})]
    return build.synthesised(seed, ["Hex", "HexNAc", "Fuc"], enzymes, {"Hex": 5, "HexNAc": 5, "Fuc": 1})


@query("""WITH r AS (SELECT l_suppkey AS label, l_extendedprice AS m, l_orderkey * 10 + l_linenumber AS id, l_quantity AS s FROM lineitem), w AS (SELECT *, CASE WHEN (lag(m) OVER x - m) / lag(m) OVER x > 1e-3 THEN 1 ELSE 0 END AS new FROM r WINDOW x AS (PARTITION BY label ORDER BY m DESC, id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY label ORDER BY m DESC, id ROWS UNBOUNDED PRECEDING) AS grp FROM w) SELECT label, count(*) AS members, max(struct_pack(s := s, neg := -id)).neg * -1 AS best, round(avg(m), 6) AS mass FROM g GROUP BY label, grp""")
def grouped_paths(spark, d):
    """Paths of one label and nearly one mass."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("label"), F.col("l_extendedprice").alias("m"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("s"))
    return build.grouped_paths(rows, "label", "m", 1e-3, "id", "s").withColumn("mass", F.round("mass", 6))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' WHEN p_partkey % 2 = 0 AND p_size > 10 THEN 'even' END AS class FROM part")
def classified_compositions(spark, d):
    return build.classified(table(spark, d, "part"), {"large": F.col("p_size") > 40, "even": (F.col("p_partkey") % 2 == 0) & (F.col("p_size") > 10)}).select("p_partkey", "class")


def _query(spark, d):
    return build.CompositionQuery(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 20 AND p_retailprice BETWEEN 910 AND 990 UNION ALL SELECT p_partkey FROM part WHERE p_size BETWEEN 15 AND 30")
def composition_union(spark, d):
    """Ranges of counts, two selections one after the other."""
    q = _query(spark, d)
    return build.CompositionQuery.union([q.where("p_size", 5, 20).where("p_retailprice", 910, 990).where("unknown", 1, 2), q.where("p_size", 15, 30)]).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 20 AND p_size BETWEEN 15 AND 30 AND p_retailprice BETWEEN 910 AND 990")
def composition_intersection(spark, d):
    q = _query(spark, d)
    return build.CompositionQuery.intersect([q.where("p_size", 5, 20), q.where("p_size", 15, 30), q.where("p_retailprice", 910, 990)]).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9)")
def composition_inclusion(spark, d):
    """Rows whose composition is in a selection."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return _query(spark, d).where("p_size", 5, 9).includes(rows, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT p_partkey, suf FROM part JOIN (SELECT DISTINCT right(p_name, 4) AS suf FROM part WHERE p_size < 3) ON ends_with(p_name, suf)")
def suffix_containment(spark, d):
    parts = table(spark, d, "part")
    suffixes = parts.filter("p_size < 3").select(F.right("p_name", F.lit(4)).alias("suf")).distinct()
    return strings.with_suffix(parts.select("p_partkey", "p_name"), suffixes, "p_name", "suf").select("p_partkey", "suf")


@query("""SELECT l_orderkey, l_linenumber, source, id FROM lineitem JOIN (SELECT 'orders' AS source, o_orderkey AS id, o_totalprice AS m FROM orders UNION ALL SELECT 'customer', c_custkey, c_acctbal * 10 FROM customer) ON m BETWEEN l_extendedprice * (1 - 2e-6) AND l_extendedprice * (1 + 2e-6) WHERE abs(m - l_extendedprice) <= l_extendedprice * 1e-6""")
def concatenated_search(spark, d):
    """One mass search over several collections, each hit with its origin."""
    one = table(spark, d, "orders").select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("m"))
    two = table(spark, d, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), (F.col("c_acctbal") * 10).alias("m"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rangejoin.ppm_join(rows, one.unionByName(two), "l_extendedprice", "m", 1e-6).select("l_orderkey", "l_linenumber", "source", "id")


@query("SELECT DISTINCT p_type AS composition, p_brand AS class FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 45")
def identified_compositions(spark, d):
    """Compositions of what an analysis has found, as a search space."""
    found = table(spark, d, "lineitem").filter("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(found, "p_partkey", "left_semi").select(F.col("p_type").alias("composition"), F.col("p_brand").alias("class")).distinct()


@query("""SELECT event_id, CASE WHEN value >= 3600 THEN printf('%d h %02d m %05.2f s', floor(value / 3600)::INT, floor((value % 3600) / 60)::INT, value % 60) WHEN value >= 60 THEN printf('%d m %05.2f s', floor(value / 60)::INT, value % 60) ELSE printf('%.2f s', value) END AS text, event_type IN ('click', 'view') AS known
FROM (SELECT event_id, event_type, round(value) * 40 + 0.25::DOUBLE AS value FROM events)""")
def elapsed_times(spark, d):
    """Seconds as text, and whether keywords name a record."""
    rows = table(spark, d, "events").select("event_id", "event_type", (F.round("value") * 40 + 0.25).alias("value"))
    words = F.when(F.col("event_type").isin("click", "view"), F.array(F.lit("x"), F.lit("Glycoprotein"))).when(F.col("event_type") == "error", F.lit(None)).otherwise(F.array(F.lit("x")))
    return rows.select("event_id", seq.elapsed(F.col("value")).alias("text"), seq.has_keyword(words).alias("known"))
