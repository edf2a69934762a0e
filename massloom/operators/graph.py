"""Networks of compositions: edges, neighbourhoods, components and paths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.session import Scratch


def unit_edges(nodes: DataFrame, ident: str, counts: list[str]) -> DataFrame:
    """Pairs whose counts differ by at most 1 in total (a, b, distance, weight), a < b.

    Instead of comparing all pairs, every node looks up its own counts with one of them raised by
    one: an equi-join on the counts themselves.
    """
    base = nodes.select(F.col(ident).alias("a"), F.array(*(F.col(c).cast("long") for c in counts)).alias("at"))

    def one_more(j: int) -> Column:
        return F.transform("at", lambda v, i: F.when(i == j, v + 1).otherwise(v))

    raised = F.array(F.col("at"), *map(one_more, range(len(counts))))
    moved = base.select("a", F.posexplode(raised).alias("step", "at"))
    other = base.select(F.col("a").alias("b"), "at")
    pairs = moved.join(other, "at").filter("a <> b AND (step > 0 OR a < b)")
    distance = F.least(F.col("step"), F.lit(1))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), distance.alias("distance")).withColumn("weight", F.lit(1.0))


def belongingness(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Mean weight of each node to the members of each neighbourhood (node, neighbourhood), itself at weight 1.

    Members without an edge to the node count with weight 0.
    """
    both = edges.select("a", "b", "weight").union(edges.select(F.col("b"), F.col("a"), F.col("weight")))
    to_members = both.join(members.select(F.col("node").alias("b"), "neighbourhood"), "b").select(F.col("a").alias("node"), "neighbourhood", "weight")
    own = members.select("node", "neighbourhood", F.lit(1.0).alias("weight"))
    sums = to_members.union(own).groupBy("node", "neighbourhood").agg(F.sum("weight").alias("weight"))
    sizes = members.groupBy("neighbourhood").agg(F.count("*").alias("size"))
    return sums.join(sizes, "neighbourhood").select("node", "neighbourhood", (F.col("weight") / F.col("size")).alias("belongingness"))


def contracted(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Edges (a, b) of longs with the same components, as stars of what each task holds: every id points at the smallest it reaches there.

    A task contracts up to ``most`` edges at a time, so its memory is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}
        held = 0

        def top(i: int) -> int:
            while (j := up.setdefault(i, i)) != i:
                up[i] = i = up.setdefault(j, j)
            return i

        def stars() -> pa.RecordBatch:
            pairs = [(i, top(i)) for i in list(up)]
            pairs = [p for p in pairs if p[0] != p[1]]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = top(x), top(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            held += batch.num_rows
            if held >= most:
                yield stars()
                up.clear()
                held = 0
        yield stars()

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) by alternating large and small stars; a component is its smallest id.

    Edges are contracted in each task first. Rounds end when the table stays the same, which a count
    and a checksum of the written table tell.
    """
    scratch = Scratch(edges.sparkSession, "components")

    def kept(rows: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        out = scratch.keep(rows, name)
        return out, tuple(out.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # a > b from here on
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, seen = kept(contracted(ordered).distinct(), "edges")
    # Ids that only have an edge to themselves, or none to another, are components of their own.
    nodes = scratch.keep(edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).filter("id IS NOT NULL").distinct(), "nodes")
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.keep(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        new, reached = kept(small.filter("a <> b").distinct(), "edges")
        scratch.drop(now, large)
        now = new
        if reached == seen:
            return nodes.join(now.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        seen = reached


def distances_from(edges: DataFrame, sources: DataFrame, rounds: int) -> DataFrame:
    """(id, distance): least total weight from any source over at most ``rounds`` edges; each round is one join and one minimum."""
    scratch = Scratch(edges.sparkSession, "distances")
    both = scratch.keep(edges.select("a", "b", "weight").union(edges.select(F.col("b"), F.col("a"), F.col("weight"))), "edges")
    best = scratch.keep(sources.select("id", F.lit(0.0).alias("distance")).distinct(), "start")
    for _ in range(rounds):
        further = best.join(both, F.col("id") == F.col("a")).select(F.col("b").alias("id"), (F.col("distance") + F.col("weight")).alias("distance"))
        new = scratch.keep(best.union(further).groupBy("id").agg(F.min("distance").alias("distance")), "round")
        scratch.drop(best)
        best = new
    return best


def neighbourhood_labels(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Each row once for every rule it meets, with the rule's name."""
    labels = F.filter(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    return df.withColumn("neighbourhood", F.explode(labels))
