"""Readers of text formats: sequences, composition lists, rule files, match journals, networks and tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions import compositions, sequences

JOURNAL = (
    "scan_id string, precursor_mass_accuracy double, peptide_start long, peptide_end long, peptide_id long, protein_id long, hypothesis_id long, glycan_combination_id long, match_type string, "
    "site_combination_index int, glycosylation_type string, glycopeptide_sequence string, mass_shift string, total_score double, peptide_score double, glycan_score double, glycan_coverage double"
)
JOURNAL_FIELDS = [tuple(part.split()) for part in JOURNAL.split(", ")]


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, accession, sequence) of each record; records are split at '>' at the start of a line by the reader itself."""
    records = spark.read.option("lineSep", "\n>").text(path)
    rows = records.select(F.regexp_replace("value", "^>", "").alias("text")).filter("length(trim(text)) > 0")
    rows = rows.withColumn("line", F.substring_index("text", "\n", 1))
    sequence = F.regexp_replace(F.expr("substring(text, length(line) + 2)"), r"[\s*]+", "")
    name = F.rtrim(F.regexp_replace("line", "\r$", ""))
    return rows.select(name.alias("name"), sequences.accession(name).alias("accession"), sequence.alias("sequence"))


def read_peff(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_fasta``, with the header's \\Key=value pairs as a map; lines that begin with # are comments."""
    rows = read_fasta(spark, path).filter("NOT name LIKE '#%'")
    keys = F.regexp_extract_all("name", F.lit(r"\\(\w+)=([^\\]*)"), F.lit(1))
    values = F.transform(F.regexp_extract_all("name", F.lit(r"\\(\w+)=([^\\]*)"), F.lit(2)), lambda v: F.trim(v))
    return rows.withColumn("annotations", F.map_from_arrays(keys, values)).withColumn("name", F.trim(F.regexp_extract("name", r"^([^\\]*)", 1)))


def read_compositions(spark: SparkSession, path: str) -> DataFrame:
    """(composition, text, classes) of each line that any dialect can read; classes follow a tab or two spaces."""
    lines = spark.read.text(path).filter("length(trim(value)) > 0 AND NOT value LIKE '#%'")
    braced = F.regexp_extract("value", r"^\s*(\{[^}]*\}(?:\$\S*)?)", 1)
    parts = F.split(F.trim("value"), r"\t| {2,}")
    text = F.when(braced != "", braced).otherwise(F.trim(parts[0]))
    rest = F.when(braced != "", F.expr("split(trim(substring(value, instr(value, '}') + 1)), '\\\\t| {2,}')")).otherwise(F.slice(parts, 2, F.size(parts)))
    classes = F.filter(F.transform(rest, lambda c: F.trim(c)), lambda c: c != "")
    return lines.select(text.alias("text"), classes.alias("classes")).withColumn("composition", compositions.parse_any(F.col("text"))).filter("composition IS NOT NULL")


@dataclass
class Rules:
    """Bounds by symbol and constraint expressions, as a rule file gives them."""

    bounds: dict[str, tuple[int, int]] = field(default_factory=dict)
    constraints: list[str] = field(default_factory=list)


def parse_rules(text: str) -> Rules:
    """symbol low high lines, a blank line, constraint lines; a second blank line ends, ; begins a comment."""
    rules, section = Rules(), 0
    for raw in text.splitlines():
        line = raw.split(";", 1)[0].strip()
        if raw.lstrip().startswith(";"):
            continue
        if not line:
            if rules.bounds or section:
                section += 1
            if section > 1:
                break
        elif section == 0:
            *symbol, low, high = line.split()
            if int(low) > int(high):
                raise ValueError(f"the bounds of {' '.join(symbol)} are the wrong way round")
            rules.bounds[" ".join(symbol)] = (int(low), int(high))
        else:
            rules.constraints.append(line)
    return rules


def read_journal(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Match journals: tab-separated, with a header, plain or compressed, any number of shards."""
    return spark.read.csv(path, sep="\t", header=True, schema=JOURNAL)


def concatenate_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Delimited files under one header; differing headers are an error."""
    frames = [spark.read.csv(p, header=True) for p in paths]
    for path, frame in zip(paths, frames, strict=True):
        if frame.columns != frames[0].columns:
            raise ValueError(f"{path} has the columns {frame.columns}, not {frames[0].columns}")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def read_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a network file: tab-separated lines that begin with node or edge."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    nodes = parts.filter("p[0] = 'node'").select(F.col("p")[1].cast("long").alias("id"), F.col("p")[2].alias("label"))
    edges = parts.filter("p[0] = 'edge'").select(F.col("p")[1].cast("long").alias("a"), F.col("p")[2].cast("long").alias("b"), F.col("p")[3].cast("double").alias("weight"))
    return nodes, edges
