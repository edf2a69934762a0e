"""Scans in tables: headers, nearest times, precursor windows, and copies into other stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.operators import ordered, rangejoin
from massloom.session import Scratch

HEADER = ("scan_id", "ms_level", "scan_time", "precursor_mass", "charge")


def headers(scans: DataFrame) -> DataFrame:
    """Scans without their peaks; no peak column is read."""
    return scans.select(*(c for c in HEADER if c in scans.columns))


def survey_scans(scans: DataFrame) -> DataFrame:
    return scans.filter("ms_level = 1")


def at_time(scans: DataFrame, time: float) -> DataFrame:
    """The one scan nearest to a time; of equally near ones the earlier, then the smaller id."""
    return scans.orderBy(F.abs(F.col("scan_time") - time), "scan_time", "scan_id").limit(1)


def precursors_near(scans: DataFrame, masses: DataFrame, mass: str, tolerance: float, start: float | None = None, end: float | None = None) -> DataFrame:
    """Product scans whose precursor lies within ``tolerance`` of each mass, in a range of time."""
    products = scans.filter("ms_level > 1")
    if start is not None:
        products = products.filter(F.col("scan_time") >= start)
    if end is not None:
        products = products.filter(F.col("scan_time") <= end)
    return rangejoin.ppm_join(masses, products, mass, "precursor_mass", tolerance)


def peaks_above(scans: DataFrame, peaks: DataFrame, mass: float) -> DataFrame:
    """Peaks of survey scans over a mass, with their scan."""
    return peaks.filter(F.col("mass") > mass).join(survey_scans(scans), "scan_id")


def loaded_peaks(peaks: DataFrame, minimum_mass: float, share: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Peaks from the lower of 500 and ``minimum_mass`` up, and a row with the intensity that ``share`` of them lie below."""
    kept = peaks.filter(F.col("mass") >= min(500.0, minimum_mass))
    return kept, ordered.exact_percentiles(kept, [], "intensity", [share]).withColumnRenamed("p0", "threshold")


def summary(scans: DataFrame) -> DataFrame:
    """Counts and times by level, as a report on a file gives them."""
    return scans.groupBy("ms_level").agg(F.count("*").alias("scans"), F.min("scan_time").alias("first_time"), F.max("scan_time").alias("last_time"), F.count_distinct("charge").alias("charges"))


def scan_tables(scans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Survey scans, product scans, and which product belongs to which survey scan (precursor_id)."""
    products = scans.filter("ms_level > 1")
    links = products.filter("precursor_id IS NOT NULL").select("precursor_id", F.col("scan_id").alias("product_id"))
    return survey_scans(scans).drop("precursor_id"), products.drop("precursor_id"), links


def new_ids(rows: DataFrame, ident: str, first: int = 1) -> DataFrame:
    """(old, new): consecutive numbers for the ids of ``rows`` in their order, from ``first``; counted in cells, so no task sees all."""
    scratch = Scratch(rows.sparkSession, "ids")
    known = scratch.keep(rows.select(F.col(ident).alias("old")).distinct().withColumn("one", F.lit(1)), "known")
    return ordered.running(known, "old", {"nth": ("sum", "one")}).select("old", (F.col("nth") + (first - 1)).alias("new"))


def migrated(rows: DataFrame, ids: dict[str, DataFrame]) -> DataFrame:
    """``rows`` with each named column's ids as their map (old, new) gives them; rows that refer to nothing go."""
    for column, names in ids.items():
        rows = rows.join(names.select(F.col("old").alias("__old"), F.col("new").alias("__new")), F.col(column) == F.col("__old")).drop("__old")
        rows = rows.withColumn(column, F.col("__new")).drop("__new")
    return rows
