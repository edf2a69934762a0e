"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.session import Scratch

WORD = r"[^\x20\x09-\x0D]+"
ROWS_A_CELL = 50_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """One row per source: source, source_size, target.

    ``sizes`` holds source and source_size. Sources in code point order, null last, take the
    weights in turn. Together they share the sum of all sizes by weight, but a target stops at
    ``max_repeats`` times its source's size and what is over goes to the others by weight. In
    order of limit / weight the shares below the water level are exactly those that stop.
    The table has one row per source, and only such rows meet in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("long")).withColumn("limit", F.col("source_size") * max_repeats)
    by_level = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    stopped = F.coalesce(F.sum("limit").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy(F.lit(1)))
    rows = rows.withColumn("nth", F.row_number().over(by_level)).withColumn("level", (total - stopped) / open_weight)
    fits = F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct("nth", "level"))
    rows = rows.withColumn("water", F.min(fits).over(Window.partitionBy(F.lit(1))))
    return rows.select("source", "source_size", F.least(F.col("limit").cast("double"), F.col("weight") * F.col("water.level")).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """How many words of each document the mix takes: doc_id, source, size, source_size, target, taken.

    Each source's documents queue in the order of a seeded hash, up to ``max_repeats`` times over.
    A copy's virtual finish time is the source's words up to its end, divided by the source's
    target. All copies are then ordered by finish time and taken while their words together stay
    within the budget, the sum of all sizes.

    Positions inside a source and in the global order are sums over whole cells plus a position
    inside one cell, so neither a hot source nor the global order meets in one task. The cut is one
    tuple (time, hash, doc_id, round) which every row compares itself with.

    Null text has size 0; documents without words are taken 0 times. A null source is a source of
    its own. Rows that repeat a doc_id queue as rows of their own and get equal results. An empty
    table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    base = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))).alias("hash"),
    )
    base = scratch.keep(base, "sizes")
    count = base.count()
    digits = 1
    while 16**digits * ROWS_A_CELL < count and digits < 8:
        digits += 1
    slices = max(64, count // ROWS_A_CELL)

    base = base.withColumn("cell", F.substring("hash", 1, digits))
    cells = base.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    sizes = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = scratch.keep(source_targets(sizes, weights, max_repeats), "targets")
    earlier = F.sum("words").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = cells.select("source", "cell", F.coalesce(earlier, F.lit(0)).alias("start"))
    own = F.sum("size").over(Window.partitionBy("source", "cell").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    queued = base.withColumn("own", own).alias("q").join(starts.alias("s"), F.col("q.source").eqNullSafe(F.col("s.source")) & (F.col("q.cell") == F.col("s.cell")))
    queued = queued.select("doc_id", F.col("q.source").alias("source"), "size", "hash", (F.col("start") + F.col("own")).alias("end"))
    # One row per source, so this side is as small as the list of sources; Spark picks the join by its size.
    queued = queued.alias("q").join(targets.alias("t"), F.col("q.source").eqNullSafe(F.col("t.source"))).select("q.*", "source_size", "target")
    queued = scratch.keep(queued, "queue")

    def finish(round_: Column | int) -> Column:
        return (F.col("source_size") * round_ + F.col("end")) / F.col("target")

    copies = queued.filter("size > 0").withColumn("round", F.explode(F.array(*(F.lit(r) for r in range(max_repeats)))))
    copies = copies.withColumn("finish", finish(F.col("round"))).withColumn("slice", F.floor(F.least(F.col("finish"), F.lit(2.0)) * slices))
    filled = copies.groupBy("slice").agg(F.sum("size").alias("words"))
    filled = filled.withColumn("before", F.coalesce(F.sum("words").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    budget = targets.agg(F.sum("source_size").alias("budget"))
    filled = filled.crossJoin(F.broadcast(budget))  # one row
    # The first slice that does not fit as a whole; at most 2 * slices + 1 rows are looked at.
    crossed = filled.filter("before + words > budget").agg(F.min(F.struct("slice", "before", "budget")).alias("at")).select("at.*")
    there = copies.join(F.broadcast(crossed), "slice")  # one row
    taken_words = F.sum("size").over(Window.partitionBy("slice").orderBy("finish", "hash", "doc_id", "round").rowsBetween(Window.unboundedPreceding, 0))
    place = F.struct("finish", "hash", "doc_id", "round")
    last = there.withColumn("so_far", F.col("before") + taken_words).filter("so_far <= budget").agg(F.max(place).alias("last"))
    cut = crossed.agg(F.min("slice").alias("slice")).crossJoin(last)  # one row each

    rows = queued.crossJoin(F.broadcast(cut))

    def taken(round_: int) -> Column:
        at = finish(F.lit(round_))
        slice_ = F.floor(F.least(at, F.lit(2.0)) * slices)
        before = F.col("slice").isNull() | (slice_ < F.col("slice"))
        within = (slice_ == F.col("slice")) & (F.struct(at.alias("finish"), F.col("hash"), F.col("doc_id"), F.lit(round_).alias("round")) <= F.col("last"))
        return F.when((F.col("size") > 0) & (before | F.coalesce(within, F.lit(False))), F.col("size")).otherwise(F.lit(0))

    total = reduce(lambda a, b: a + b, (taken(r) for r in range(max_repeats)))
    return rows.select("doc_id", "source", "size", "source_size", "target", total.cast("long").alias("taken"))


def draw_mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """``docs`` with each row as often as the mix takes it; rows taken 0 times go, all columns stay.

    Null texts have no words and go; a null doc_id is drawn like any other, and rows that share a
    doc_id as often as the one taken most; an empty table gives no rows.
    """
    plan = mix_sources(docs, weights, max_repeats, seed).filter("taken > 0")
    plan = plan.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("taken") / F.col("size")).cast("int")).alias("times"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # whatever the columns are called
    drawn = rows.filter(word_count(F.col("row.text")) > 0).join(plan.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("id")))
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth")).select("row.*")


ORACLE = r"""
WITH base AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(concat(doc_id::VARCHAR, ':mix')) AS hash FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, source_size * 3 AS lim FROM sizes),
levels AS (SELECT *, row_number() OVER w AS nth,
    ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(lim) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev
  FROM weighed WINDOW w AS (ORDER BY lim::DOUBLE / weight, source NULLS LAST)),
water AS (SELECT arg_min(lev, nth) AS lev FROM levels WHERE lev <= lim::DOUBLE / weight),
targets AS (SELECT source, source_size, least(lim::DOUBLE, weight * water.lev) AS target FROM levels, water),
queued AS (SELECT b.*, t.source_size, t.target, sum(size) OVER (PARTITION BY b.source ORDER BY hash, doc_id ROWS UNBOUNDED PRECEDING) AS fin
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT *, (source_size * r + fin)::DOUBLE / target AS finish FROM queued, (SELECT unnest([0, 1, 2]) AS r) WHERE size > 0),
run AS (SELECT *, sum(size) OVER (ORDER BY finish, hash, doc_id, r ROWS UNBOUNDED PRECEDING) AS so_far FROM copies),
got AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM run WHERE so_far <= (SELECT sum(source_size) FROM sizes) GROUP BY doc_id)
SELECT q.doc_id, q.source, q.size, q.source_size, q.target, coalesce(g.taken, 0)::BIGINT AS taken FROM queued q LEFT JOIN got g USING (doc_id)
"""
