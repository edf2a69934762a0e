"""Gap splits, interval merging and clustering along one axis."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.operators import ordered
from massloom.session import Scratch, shuffle_width


def gap_split(df: DataFrame, keys: list[str], at: str, gap: float, ties: list[str] | None = None, name: str = "piece") -> DataFrame:
    """Number the pieces of each key, from 0; a piece ends where the next value is more than ``gap`` further."""
    order = Window.partitionBy(*keys).orderBy(at, *(ties or []))
    new = (F.col(at) - F.lag(at).over(order) > gap).cast("int")
    return df.withColumn("__new", F.coalesce(new, F.lit(0))).withColumn(name, F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def relative_gap_groups(df: DataFrame, keys: list[str], mass: str, window: float, ties: list[str], name: str = "group") -> DataFrame:
    """Groups down the masses of each key; a new one starts where the step from the mass before is over ``window`` times it."""
    order = Window.partitionBy(*keys).orderBy(F.col(mass).desc(), *ties)
    before = F.lag(mass).over(order)
    new = ((before - F.col(mass)) / before > window).cast("int")
    return df.withColumn("__new", F.coalesce(new, F.lit(0))).withColumn(name, F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: float = 0.0, aggregates: list[Column] | None = None) -> DataFrame:
    """Islands of intervals per key: merged where they overlap or lie at most ``gap`` apart."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.coalesce((F.col(start) - reach > gap).cast("int"), F.lit(0)))
    marked = marked.withColumn("island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return marked.groupBy(*keys, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("members"), *(aggregates or []))


def smooth_overlaps(df: DataFrame, mass: str, start: str, end: str, tolerance: float, ident: str) -> DataFrame:
    """Features merged, in the order of mass, into the one before while that is within tolerance and overlaps in time.

    A merged feature has the mean mass of its members and their whole span, which the next one is
    held against. Where the step in mass is over the tolerance nothing can merge, so the rows between
    such steps are a piece that is gone through by itself; pieces are numbered over all rows in cells.
    A piece streams through its task in order, of which only the last feature is held, so a chain of
    close masses takes time, but no memory, that grows with it. Rows with a null mass, start or end
    are no features. Returns mass, start, end and members.
    """
    scratch = Scratch(df.sparkSession, "smooth")
    rows = df.select(F.col(ident).alias("id"), F.col(mass).cast("double").alias("m"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e")).dropna(subset=["m", "s", "e"])
    marked = ordered.previous(scratch.keep(rows, "rows"), "m", ["s", "id"], "before")
    marked = marked.withColumn("new", F.coalesce((F.col("m") - F.col("before") > tolerance * F.col("m")).cast("int"), F.lit(1)))
    pieces = ordered.running(scratch.keep(marked, "marked"), "m", {"piece": ("sum", "new")}, ties=["s", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # piece, mass, start, end, members of the feature that may still grow

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            columns = [*zip(*done, strict=True)][1:] if done else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.float64(), pa.float64(), pa.int64()), strict=True)], ["mass", "start", "end", "members"])

        for batch in batches:
            done = []
            for piece, m, s, e in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held is not None and held[0] == piece and abs(held[1] - m) / m <= tolerance and held[2] <= e and s <= held[3]:
                    n = held[4]
                    held = (piece, (held[1] * n + m) / (n + 1), min(held[2], s), max(held[3], e), n + 1)
                else:
                    if held is not None:
                        done.append(held)
                    held = (piece, m, s, e, 1)
            yield batch_of(done)
        if held is not None:
            yield batch_of([held])

    sorted_pieces = pieces.repartition("piece").sortWithinPartitions("piece", "m", "s", "e", "id").select("piece", "m", "s", "e")
    return sorted_pieces.mapInArrow(run, "mass double, start double, end double, members long")


def greedy_mass_clusters(df: DataFrame, keys: list[str], mass: str, intensity: str, ident: str, tolerance: float) -> DataFrame:
    """The order-dependent form: peaks in descending intensity join the nearest cluster centre within
    tolerance, and the centre moves to the weighted mean.

    Rows are first split where neighbouring masses lie further apart than any cluster can reach, so
    each piece is clustered by itself.
    """
    pieces = relative_gap_groups(df, keys, mass, 2 * tolerance, [ident], "piece")
    size = F.count("*").over(Window.partitionBy(*keys, "piece"))
    pieces = pieces.withColumn("__size", size)
    alone = pieces.filter("__size = 1").drop("__size").withColumn("cluster", F.lit(0).cast("long")).withColumn("centre", F.col(mass).cast("double"))
    # Many pieces go to one call, as most are a few rows.
    bucket = F.pmod(F.xxhash64(*keys, "piece"), F.lit(64 * shuffle_width(df.sparkSession)))
    crowded = pieces.filter("__size > 1").drop("__size").withColumn("__bucket", bucket)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([intensity, ident], ascending=[False, True], kind="stable")
        centres, weights, chosen = [], [], []
        for m, w in zip(rows[mass], rows[intensity], strict=True):
            best = min(range(len(centres)), key=lambda i: abs(centres[i] - m), default=None)
            if best is None or abs(centres[best] - m) > tolerance * m:
                centres.append(m), weights.append(w)
                best = len(centres) - 1
            else:
                weights[best] += w
                centres[best] += (m - centres[best]) * w / max(weights[best], 1e-12)
            chosen.append(best)
        return rows.assign(cluster=pd.Series(chosen, index=rows.index, dtype="int64"), centre=[centres[i] for i in chosen])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="__bucket")
        return pd.concat([one(group) for _, group in rows.groupby([*keys, "piece"], dropna=False, sort=False)])

    schema = ", ".join(f"`{c}` {t}" for c, t in crowded.dtypes if c != "__bucket") + ", cluster long, centre double"
    return alone.unionByName(crowded.groupBy("__bucket").applyInPandas(run, schema))
