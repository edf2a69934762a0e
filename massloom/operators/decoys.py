"""Decoys of fragments: a fragment with more than one sugar residue gets a random mass shift that is always the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEEDS = 2**32  # what the generator takes


def _draws(low: float, high: float):
    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shifts = [np.random.RandomState(seed).uniform(low, high, n) for seed, n in zip(batch["seed"], batch["n"])]
            yield pd.DataFrame({"seed": batch["seed"], "shifts": shifts})

    return draw


def shifted_fragments(fragments: DataFrame, low: float = 1.0, high: float = 30.0, largest_kept: int = 1) -> DataFrame:
    """``fragments`` with ``decoy_mass``, their mass and a shift between ``low`` and ``high``.

    They hold (structure, glycan_mass, position, fragment_mass, size). Shifts are those of the
    Mersenne Twister with the rounded glycan mass as its seed (half to even), drawn once for each
    seed; the fragments of a structure with more than ``largest_kept`` residues take them in the order
    of position (equal ones by mass, then size). Smaller ones, those of unknown size, and those
    without a glycan mass that can be a seed keep their mass.
    """
    order = Window.partitionBy("structure").orderBy("position", "fragment_mass", "size").rowsBetween(Window.unboundedPreceding, 0)
    moves = F.coalesce(F.col("size") > largest_kept, F.lit(False))
    seed = F.bround("glycan_mass").cast("long")
    rows = fragments.withColumn("__moves", moves).withColumn("__turn", F.sum(F.col("__moves").cast("int")).over(order) - 1)
    rows = rows.withColumn("__seed", F.when(F.col("__moves") & (seed >= 0) & (seed < SEEDS), seed))
    wanted = rows.filter("__seed IS NOT NULL").groupBy(F.col("__seed").alias("seed")).agg((F.max("__turn") + 1).alias("n"))
    drawn = wanted.mapInPandas(_draws(low, high), "seed long, shifts array<double>").select(F.col("seed").alias("__seed"), F.posexplode("shifts").alias("__turn", "__shift"))
    out = rows.join(drawn, ["__seed", "__turn"], "left")
    return out.select(*fragments.columns, (F.col("fragment_mass") + F.coalesce("__shift", F.lit(0.0))).alias("decoy_mass"))
