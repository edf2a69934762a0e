"""XML documents with references between their elements, models as JSON, and checks of sequence files."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.sources.spectra import CHARGE, FLOAT_64, INTENSITY_ARRAY, MS_LEVEL, MZ_ARRAY, SCAN_TIME, SELECTED_MZ

EVIDENCE = "_id string, _peptide_ref string, _dBSequence_ref string, _start int, _end int, _isDecoy boolean"
PEPTIDE = "_id string, PeptideSequence string"
SEQUENCE = "_id string, _accession string, Seq string"
RESULT = "_id string, _spectrumID string, SpectrumIdentificationItem array<struct<_id: string, _peptide_ref: string, _rank: int, _chargeState: int, _experimentalMassToCharge: double, _score: double>>"


def write_elements(df: DataFrame, path: str, tag: str) -> None:
    """Rows as elements ``tag``; columns that begin with _ are attributes."""
    df.write.format("xml").option("rootTag", f"{tag}List").option("rowTag", tag).save(path)


def read_elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements ``tag`` of the documents below ``path``; large documents are split."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def write_identifications(peptides: DataFrame, sequences: DataFrame, evidence: DataFrame, results: DataFrame, path: str) -> None:
    """An mzIdentML document's lists, each in its own folder: Peptide, DBSequence, PeptideEvidence and SpectrumIdentificationResult."""
    for df, tag in ((peptides, "Peptide"), (sequences, "DBSequence"), (evidence, "PeptideEvidence"), (results, "SpectrumIdentificationResult")):
        write_elements(df, f"{path}/{tag}", tag)


def read_identified_peptides(spark: SparkSession, path: str) -> DataFrame:
    """Identified items with their references resolved: spectrum, rank, charge, mz, score, peptide, accession, start, end and is_decoy."""
    part = lambda tag, schema: read_elements(spark, f"{path}/{tag}", tag, schema)
    items = part("SpectrumIdentificationResult", RESULT).select(F.col("_spectrumID").alias("spectrum"), F.explode("SpectrumIdentificationItem").alias("i"))
    items = items.select("spectrum", F.col("i._rank").alias("rank"), F.col("i._chargeState").alias("charge"), F.col("i._experimentalMassToCharge").alias("mz"), F.col("i._score").alias("score"), F.col("i._peptide_ref").alias("peptide_ref"))
    peptides = part("Peptide", PEPTIDE).select(F.col("_id").alias("peptide_ref"), F.col("PeptideSequence").alias("peptide"))
    evidence = part("PeptideEvidence", EVIDENCE).select(F.col("_peptide_ref").alias("peptide_ref"), F.col("_dBSequence_ref").alias("sequence_ref"), F.col("_start").alias("start"), F.col("_end").alias("end"), F.col("_isDecoy").alias("is_decoy"))
    sequences = part("DBSequence", SEQUENCE).select(F.col("_id").alias("sequence_ref"), F.col("_accession").alias("accession"))
    return items.join(peptides, "peptide_ref").join(evidence, "peptide_ref").join(sequences, "sequence_ref").drop("peptide_ref", "sequence_ref")


PROTEIN = "accession array<string>, name string, keyword array<struct<_id: string, _VALUE: string>>, feature array<struct<_type: string, _begin: int, _end: int>>, sequence string"


def read_proteins(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a protein XML file: accession, name, keywords, sequence and features (type, start, end)."""
    rows = read_elements(spark, path, "entry", PROTEIN)
    keywords = F.transform(F.coalesce("keyword", F.array()), lambda k: k["_VALUE"])
    features = F.transform(F.coalesce("feature", F.array()), lambda f: F.struct(f["_type"].alias("type"), f["_begin"].alias("start"), f["_end"].alias("end")))
    return rows.select(F.get("accession", F.lit(0)).alias("accession"), "name", keywords.alias("keywords"), F.regexp_replace("sequence", r"\s+", "").alias("sequence"), features.alias("features"))


def _spectrum(scan_id: str, index: int, level: int, time: float, mz: float | None, charge: int | None, mzs: list[float], intensities: list[float]) -> str:
    term = lambda key, value="": f'<cvParam accession="{key}" value="{value}"/>'
    array = lambda kind, data: f"<binaryDataArray>{term(FLOAT_64)}{term(kind)}<binary>{base64.b64encode(np.array(data, '<f8').tobytes()).decode()}</binary></binaryDataArray>"
    precursor = "" if mz is None else f"<precursorList><selectedIon>{term(SELECTED_MZ, mz)}{'' if charge is None else term(CHARGE, charge)}</selectedIon></precursorList>"
    name = scan_id.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")
    return f'<spectrum id="{name}" index="{index}">{term(MS_LEVEL, level)}<scan>{term(SCAN_TIME, time)}</scan>{precursor}<binaryDataArrayList>{array(MZ_ARRAY, mzs)}{array(INTENSITY_ARRAY, intensities)}</binaryDataArrayList></spectrum>'


def write_mzml(spectra: DataFrame, path: str, compression: str | None = None, together: int = 500) -> None:
    """Spectra (the columns of ``sources.spectra.SPECTRA``) as mzML, one whole document for each task, written ``together`` spectra at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda values: pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"])
        yield line(["<mzML><run><spectrumList>"])
        for batch in batches:
            for start in range(0, batch.num_rows, together):
                yield line([_spectrum(*row) for row in zip(*(c.to_pylist() for c in batch.slice(start, together).columns), strict=True)])
        yield line(["</spectrumList></run></mzML>"])

    names = ["scan_id", "index", "ms_level", "scan_time", "precursor_mz", "precursor_charge", "mz", "intensity"]
    spectra.select(*names).mapInArrow(run, "value string").write.text(path, compression=compression)


def save_model(parameters: DataFrame, path: str) -> None:
    """A fitted model's parameters as JSON lines."""
    parameters.write.json(path)


def load_model(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def checked_sequences(rows: DataFrame, name: str = "name", sequence: str = "sequence") -> DataFrame:
    """Problems of sequence records: (name, problem), for repeated names, empty sequences and letters that are no residue."""
    repeated = rows.groupBy(name).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(name).alias("name"), F.lit("repeated").alias("problem"))
    empty = rows.filter(F.coalesce(F.length(sequence), F.lit(0)) == 0).select(F.col(name).alias("name"), F.lit("empty").alias("problem"))
    odd = rows.filter(F.col(sequence).rlike("[^ACDEFGHIKLMNPQRSTVWYUOBZX]")).select(F.col(name).alias("name"), F.lit("unknown residue").alias("problem"))
    return repeated.unionByName(empty).unionByName(odd)


def prefixed_json(values: Column) -> Column:
    """An array of numbers as text that begins with J."""
    return F.concat(F.lit("J"), F.to_json(values))


def read_prefixed_json(text: Column) -> Column:
    return F.from_json(F.when(text.startswith("J"), F.substring(text, 2, 1 << 30)), "array<int>")
