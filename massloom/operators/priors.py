"""Prior shares of compositions at a site, and how far each composition belongs to its neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.session import Scratch

EMPTY_ROW = 1e-6  # fixed value: divisor of a composition that belongs nowhere


def composition_shares(rows: DataFrame, group: list[str], prior: float = 0.01, common: float = 1.0, scale: float = 1.0, rounds: int = 30, tolerance: float = 1e-12) -> DataFrame:
    """``rows`` (``group``, id, observed) with ``share``: the fixed point of Dirichlet updates of a site's shares.

    One update turns shares p into (a + o p / sum(o p)) / (1 + sum(a)), where o is what was observed
    and a = ``prior`` * ``scale`` + ``common`` - 1. At its fixed point p is a / (1 + sum(a)) times
    x / (x - o) with one number x for each site, the root of sum(o a / (x - o)) = 1 above all o. That
    root is found by Newton steps on the inverse of the sum, which climb towards it from the left, so
    a round is one sum for each site over its distinct observations, and no site's rows meet in one task.

    Null and negative observations count as zero. A site without any observation keeps equal shares.
    Stops when no site's root moves by more than ``tolerance`` of itself, at the latest after ``rounds``.
    """
    a = prior * scale + common - 1
    if a <= 0:
        raise ValueError("prior * scale + common must be over 1")
    scratch = Scratch(rows.sparkSession, "shares")
    held = rows.withColumn("__o", F.greatest(F.coalesce(F.col("observed").cast("double"), F.lit(0.0)), F.lit(0.0)))
    points = scratch.keep(held.filter("__o > 0").groupBy(*group, "__o").agg((F.count("*") * F.col("__o") * a).alias("__oa")), "points")
    now = scratch.keep(points.groupBy(*group).agg(F.max(F.struct("__o", "__oa")).alias("top")).select(*group, (F.col("top.__o") + F.col("top.__oa")).alias("__x"), F.lit(1.0).alias("__moved")), "start")
    for _ in range(rounds):
        gap = F.col("__x") - F.col("__o")
        sums = points.join(now, group).groupBy(*group).agg(F.first("__x").alias("__x"), F.sum(F.col("__oa") / gap).alias("h"), F.sum(F.col("__oa") / (gap * gap)).alias("slope"))
        step = (F.col("h") * F.col("h") - F.col("h")) / F.col("slope")
        new = scratch.keep(sums.select(*group, (F.col("__x") + step).alias("__x"), F.abs(step / F.col("__x")).alias("__moved")), "roots")
        scratch.drop(now)
        now = new
        if (now.agg(F.max("__moved")).first()[0] or 0.0) <= tolerance:
            break
    sizes = rows.groupBy(*group).agg((F.count("*") * a).alias("__sum"))
    lift = F.when(F.col("__x").isNull(), F.lit(a) / F.col("__sum")).otherwise(F.lit(a) / (1 + F.col("__sum")) * F.col("__x") / (F.col("__x") - F.col("__o")))
    return held.join(sizes, group).join(now.drop("__moved"), group, "left").select(*rows.columns, lift.alias("share"))


def normalised_membership(members: DataFrame, how: str = "colrow", scale: float = 1.0) -> DataFrame:
    """``members`` (id, neighbourhood, weight) with weights scaled so that neighbourhoods (``col``), compositions (``row``) or first the ones, then the others (``colrow``) sum to one.

    ``scale`` multiplies the neighbourhoods' sums. A neighbourhood of no weight has weights of zero,
    and so has a composition that belongs nowhere. Sums are joined back, so a large neighbourhood
    is summed in each task first.
    """
    if how not in ("col", "row", "colrow", "none"):
        raise ValueError(f"unknown normalisation {how!r}")
    out = members.select("id", "neighbourhood", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    if how.startswith("col"):
        sums = out.groupBy("neighbourhood").agg(F.sum("weight").alias("__sum"))
        out = out.join(sums, "neighbourhood").select("id", "neighbourhood", F.when(F.col("__sum") == 0, 0.0).otherwise(F.col("weight") / F.col("__sum") * scale).alias("weight"))
    if how.endswith("row"):
        sums = out.groupBy("id").agg(F.sum("weight").alias("__sum"))
        below = F.when(F.col("__sum") == 0, EMPTY_ROW).otherwise(F.col("__sum"))
        out = out.join(sums, "id").select("id", "neighbourhood", (F.col("weight") / below).alias("weight"))
    return out


def with_membership(nodes: DataFrame, members: DataFrame, neighbourhoods: list) -> DataFrame:
    """``nodes`` with ``belongs``, their weights in the listed neighbourhoods in that order, 0 where they are no members."""
    weights = members.groupBy("id").agg(*(F.sum(F.when(F.col("neighbourhood") == n, F.col("weight")).otherwise(0.0)).alias(f"__{i}") for i, n in enumerate(neighbourhoods)))
    belongs = F.array(*(F.coalesce(F.col(f"__{i}"), F.lit(0.0)) for i in range(len(neighbourhoods))))
    return nodes.join(weights, "id", "left").select(*nodes.columns, belongs.alias("belongs"))
