"""Building search spaces: stored combinations, modified compositions, glycoforms, pieces of proteins, and selections among them.

Compositions are columns of counts or map<string,int>; each step widens rows by a bounded number of
choices, so all of it is explode, join and group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.functions import sequences
from massloom.session import Scratch


def combination_tables(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Multisets as two tables: (combination, size, total), and (combination, member, count) with repeated members counted."""
    named = sets.withColumn("combination", F.array_join(F.col("members").cast("array<string>"), "+"))
    bridge = named.select("combination", F.explode("members").alias("member")).groupBy("combination", "member").agg(F.count("*").alias("count"))
    return named.select("combination", "size", "total"), bridge


def partitioned_combinations(bridge: DataFrame, classes: DataFrame) -> DataFrame:
    """(combination, size, class_counts): how many members of each class (member, class) a combination has, as sorted text."""
    rows = bridge.join(classes, "member").groupBy("combination", "class").agg(F.sum("count").alias("n"))
    listed = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "class", F.col("n").cast("string")))), ";")
    return rows.groupBy("combination").agg(F.sum("n").alias("size"), listed.alias("class_counts"))


def modified_compositions(df: DataFrame, composition: str, constant: dict[str, str], variable: dict[str, int]) -> DataFrame:
    """Each composition with its constant modifications, one for each residue named, and every choice of variable ones up to their most.

    Returns all columns and ``modified``, the composition as a map with the modifications counted.
    """
    base = F.col(composition)
    for modification, residue in constant.items():
        base = F.map_concat(base, F.create_map(F.lit(modification), F.coalesce(F.element_at(F.col(composition), residue), F.lit(0))))
    rows = df.withColumn("modified", base)
    for modification, most in variable.items():
        rows = rows.withColumn("__n", F.explode(F.sequence(F.lit(0), F.lit(most))))
        rows = rows.withColumn("modified", F.when(F.col("__n") > 0, F.map_concat("modified", F.create_map(F.lit(modification), F.col("__n")))).otherwise(F.col("modified"))).drop("__n")
    return rows.withColumn("modified", F.map_filter("modified", lambda k, v: v > 0))


def underivatised(composition: Column, suffix: str = r"\^.*$") -> Column:
    """A composition with derivatives named as their base residues, whose counts add up."""
    pairs = F.transform(F.map_entries(composition), lambda e: F.struct(F.regexp_replace(e["key"], suffix, "").alias("k"), e["value"].alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.aggregate(F.filter(pairs, lambda p: p["k"] == n), F.lit(0), lambda t, p: t + p["v"])))


def canonical_names(composition: Column, names: dict[str, str]) -> Column:
    """Residues under their canonical names; names that are not listed stay."""
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.transform_keys(composition, lambda k, v: F.coalesce(known[k], k))


def split_protein(df: DataFrame, sequence: str, cuts: str, shortest: int) -> DataFrame:
    """The pieces of a protein between annotated cuts (positions from 0), of ``shortest`` residues or more: piece, start, end."""
    inner = F.array_sort(F.array_distinct(F.filter(F.col(cuts), lambda c: (c > 0) & (c < F.length(sequence)))))
    edges = F.concat(F.array(F.lit(0)), inner, F.array(F.length(sequence)))
    made = F.transform(F.sequence(F.lit(0), F.size(edges) - 2), lambda i: F.struct(F.get(edges, i).alias("start"), F.get(edges, i + 1).alias("end")))
    rows = df.withColumn("__p", F.explode(F.filter(made, lambda p: p["end"] - p["start"] >= shortest)))
    return rows.select(*df.columns, F.substring(F.col(sequence), F.col("__p.start") + 1, F.col("__p.end") - F.col("__p.start")).alias("piece"), F.col("__p.start").alias("start"), F.col("__p.end").alias("end"))


def glycoforms(peptides: DataFrame, glycans: DataFrame, site_columns: dict[str, str]) -> DataFrame:
    """Each peptide with each composition for each of its sites of the composition's class: class, site, glycan, mass.

    ``site_columns`` names for each class the array of its sites; ``glycans`` holds (class, glycan, glycan_mass).
    """
    of_class = lambda kind: lambda s: F.struct(F.lit(kind).alias("class"), s.alias("site"))
    made = F.flatten(F.array(*(F.transform(F.col(column), of_class(kind)) for kind, column in site_columns.items())))
    rows = peptides.withColumn("__s", F.explode(made)).withColumn("class", F.col("__s.class")).withColumn("site", F.col("__s.site")).drop("__s")
    return rows.join(glycans, "class").withColumn("mass", F.col("peptide_mass") + F.col("glycan_mass"))


def fasta_candidates(proteins: DataFrame, glycans: DataFrame, protease: str = "trypsin", missed: int = 1, shortest: int = 5, longest: int = 60) -> DataFrame:
    """From sequences (protein, sequence) to candidates: digestion, N-sequons inside each peptide, one composition (glycan, glycan_mass) on one of them.

    Returns protein, peptide, start, end, site and glycan, each once.
    """
    pieces = proteins.withColumn("p", F.explode(sequences.digest(F.col("sequence"), sequences.PROTEASES[protease], missed, shortest, longest)))
    # A sequon may run over the peptide's end, so sites are those of the whole sequence.
    pieces = pieces.withColumn("sites", sequences.sites(F.col("sequence"), sequences.N_SEQUON))
    pieces = pieces.withColumn("site", F.explode(sequences.in_span(F.col("sites"), F.col("p.start"), F.col("p.end"))))
    rows = pieces.select("protein", F.col("p.peptide").alias("peptide"), F.col("p.start").alias("start"), F.col("p.end").alias("end"), "site").distinct()
    return rows.withColumn("one", F.lit(1)).join(glycans.withColumn("one", F.lit(1)), "one").drop("one")


def best_evidence(evidence: DataFrame, peptide: list[str], score: str, ties: list[str]) -> DataFrame:
    """Of each peptide of each protein the evidence with the best score, and how much there was."""
    n = F.count("*").over(Window.partitionBy(*peptide))
    order = Window.partitionBy(*peptide).orderBy(F.col(score).desc(), *ties)
    return evidence.withColumn("evidence", n).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def within_distance(nodes: DataFrame, ident: str, counts: list[str], window: int) -> DataFrame:
    """(a, b, distance): pairs whose counts differ by at most ``window`` in total, from either side, by an equi-join on moved counts."""
    moves = [[0] * len(counts)]
    for i in range(len(counts)):
        moves = [m[:i] + [step] + m[i + 1 :] for m in moves for step in range(-window, window + 1) if sum(map(abs, m)) + abs(step) <= window]
    at = lambda move: F.array(*((F.col(c).cast("long") + s) for c, s in zip(counts, move, strict=True)))
    asked = nodes.select(F.col(ident).alias("a"), F.explode(F.array(*(F.struct(at(m).alias("at"), F.lit(sum(map(abs, m))).alias("distance")) for m in moves))).alias("m"))
    there = nodes.select(F.col(ident).alias("b"), at([0] * len(counts)).alias("at"))
    return asked.select("a", "m.at", "m.distance").join(there, "at").filter("a <> b").select("a", "b", "distance")


def remove_nodes(edges: DataFrame, gone: DataFrame, limit: float) -> DataFrame:
    """Edges (a, b, order) without the nodes of ``gone`` (id); neighbours of one such node are bridged where both steps together stay below ``limit``.

    An edge that is there already, or a shorter bridge, is kept in place of a longer one.
    """
    both = edges.select("a", "b", "order").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "order"))
    around = both.join(gone.select(F.col("id").alias("a")), "a", "left_semi").join(gone.select(F.col("id").alias("b")), "b", "left_anti")
    one, other = around.select("a", F.col("b").alias("x"), F.col("order").alias("o1")), around.select("a", F.col("b").alias("y"), F.col("order").alias("o2"))
    bridges = one.join(other, "a").filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), (F.col("o1") + F.col("o2")).alias("order")).filter(F.col("order") < limit)
    kept = edges.join(gone.select(F.col("id").alias("a")), "a", "left_anti").join(gone.select(F.col("id").alias("b")), "b", "left_anti")
    new = bridges.join(kept.select("a", "b"), ["a", "b"], "left_anti")
    return kept.select("a", "b", "order").unionByName(new).groupBy("a", "b").agg(F.min("order").alias("order"))


def merge_networks(nodes: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes (label) and edges (a, b, weight) of several networks, by label, each once; of repeated edges the heaviest."""
    all_nodes = reduce(DataFrame.unionByName, nodes).distinct()
    all_edges = reduce(DataFrame.unionByName, edges).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")
    return all_nodes, all_edges.groupBy("a", "b").agg(F.max("weight").alias("weight"))


def synthesised(seeds: DataFrame, counts: list[str], enzymes: list[tuple[Column, dict[str, int]]], limits: dict[str, int]) -> DataFrame:
    """All compositions that enzymes make from the seeds: counts and ``steps``, the fewest that lead there.

    An enzyme is a condition on the counts and what it adds. Each round is one table; rounds end when
    nothing new is made, which the ``limits`` on counts see to.
    """
    scratch = Scratch(seeds.sparkSession, "synthesis")
    front = scratch.keep(seeds.select(*counts).distinct().withColumn("steps", F.lit(0)), "seeds")
    known = front
    inside = reduce(lambda a, b: a & b, (F.col(c) <= n for c, n in limits.items()))
    step = 0
    while True:
        step += 1
        made = [front.filter(when).select(*((F.col(c) + adds.get(c, 0)).alias(c) for c in counts)) for when, adds in enzymes]
        new = reduce(DataFrame.unionByName, made).filter(inside).distinct().join(known, counts, "left_anti").withColumn("steps", F.lit(step))
        front = scratch.keep(new, "front")
        if front.isEmpty():
            return known
        known = scratch.keep(known.unionByName(front), "known")


def grouped_paths(paths: DataFrame, label: str, mass: str, tolerance: float, ident: str, signal: str) -> DataFrame:
    """Paths of equal label whose masses follow within ``tolerance``: label, members, the best path and the mean mass."""
    from massloom.operators.cluster import relative_gap_groups

    rows = relative_gap_groups(paths, [label], mass, tolerance, [ident])
    return rows.groupBy(label, "group").agg(F.count("*").alias("members"), F.max_by(ident, F.struct(F.col(signal), (-F.col(ident)).alias("neg"))).alias("best"), F.avg(mass).alias("mass")).drop("group")


def classified(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with ``class``, the name of the first rule that holds."""
    choice = F.lit(None).cast("string")
    for name, rule in reversed(list(rules.items())):
        choice = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(choice)
    return df.withColumn("class", choice)


class CompositionQuery:
    """Ranges of counts, chained; a name that is no column asks for nothing."""

    def __init__(self, members: DataFrame, ident: str):
        self.members, self.ident = members, ident

    def where(self, name: str, low: int, high: int) -> CompositionQuery:
        if name not in self.members.columns:
            return self
        return CompositionQuery(self.members.filter(F.col(name).between(low, high)), self.ident)

    @staticmethod
    def union(queries: list[CompositionQuery]) -> DataFrame:
        """The members of all queries, as often as they occur."""
        return reduce(DataFrame.unionByName, (q.members for q in queries))

    @staticmethod
    def intersect(queries: list[CompositionQuery]) -> DataFrame:
        """Members that every query has."""
        return reduce(lambda rows, q: rows.join(q.members.select(q.ident), q.ident, "left_semi"), queries[1:], queries[0].members)

    def includes(self, rows: DataFrame, ident: str) -> DataFrame:
        """``rows`` whose id is among the members."""
        return rows.join(self.members.select(F.col(self.ident).alias(ident)).distinct(), ident, "left_semi")
