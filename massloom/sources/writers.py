"""Writers: tables, re-importable lists, spectra, journals and networks; each task writes its own files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions import compositions, sequences
from massloom.sources.text import JOURNAL_FIELDS


def write_table(df: DataFrame, path: str, separator: str = ",") -> None:
    """Delimited text with a header; arrays are joined by ;."""
    flat = df.select(*(F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))
    flat.write.csv(path, header=True, sep=separator)


def write_compositions(df: DataFrame, path: str, composition: str = "composition", classes: str = "classes") -> None:
    """One line per composition: its text and, tab-separated, its classes."""
    line = F.concat_ws("\t", compositions.to_text(F.col(composition)), F.array_join(classes, "\t"))
    df.select(F.rtrim(line).alias("value")).write.text(path)


def write_fasta(df: DataFrame, path: str, name: str = "name", sequence: str = "sequence", width: int = 60) -> None:
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), sequences.wrapped(F.col(sequence), width)).alias("value")).write.text(path)


def spectrum_block(title: Column, mass: Column, charge: Column, peaks: Column) -> Column:
    """One spectrum as text; ``peaks`` is array<struct<mz, intensity>>."""
    lines = F.array_join(F.transform(F.array_sort(peaks), lambda p: F.concat_ws(" ", p["mz"].cast("string"), p["intensity"].cast("string"))), "\n")
    return F.concat(F.lit("BEGIN IONS\nTITLE="), title, F.lit("\nPEPMASS="), mass.cast("string"), F.lit("\nCHARGE="), charge.cast("string"), F.lit("+\n"), lines, F.lit("\nEND IONS\n"))


def write_spectra(df: DataFrame, path: str) -> None:
    """Spectra with title, mass, charge and peaks."""
    df.select(spectrum_block(F.col("title"), F.col("mass"), F.col("charge"), F.col("peaks")).alias("value")).write.text(path)


def write_journal(df: DataFrame, path: str) -> None:
    """Match journal: one compressed shard per task."""
    df.select(*(name for name, _ in JOURNAL_FIELDS)).write.csv(path, sep="\t", header=True, compression="gzip")


def write_network(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    lines = nodes.select(F.concat_ws("\t", F.lit("node"), F.col("id").cast("string"), "label").alias("value"))
    more = edges.select(F.concat_ws("\t", F.lit("edge"), F.col("a").cast("string"), F.col("b").cast("string"), F.col("weight").cast("string")).alias("value"))
    lines.union(more).write.text(path)


def write_analysis(df: DataFrame, path: str, analysis: str) -> None:
    """Rows of one analysis as a partition of their own, which a later write of the same analysis replaces."""
    df.withColumn("analysis_id", F.lit(analysis)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("analysis_id").parquet(path)


def drop_analysis(spark: SparkSession, path: str, analysis: str) -> None:
    """Remove one analysis, which is a partition of its own."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/analysis_id={analysis}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_training_spectra(matches: DataFrame, path: str, q_value: str, most: float) -> None:
    """Spectra of matches that are good enough, as text."""
    write_spectra(matches.filter(F.col(q_value) <= most), path)
