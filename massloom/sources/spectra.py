"""Readers of spectra and identifications in XML, and of spectra in text."""

from __future__ import annotations

import base64
import io
import re
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Terms of the public controlled vocabulary of mass spectrometry.
MS_LEVEL, SCAN_TIME, MZ_ARRAY, INTENSITY_ARRAY, FLOAT_64, ZLIB, SELECTED_MZ, CHARGE = "MS:1000511", "MS:1000016", "MS:1000514", "MS:1000515", "MS:1000523", "MS:1000574", "MS:1000744", "MS:1000041"
SPECTRA = "scan_id string, index long, ms_level int, scan_time double, precursor_mz double, precursor_charge int, mz array<double>, intensity array<double>"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1] if "}" in tag else tag


def _terms(element: ElementTree.Element) -> dict[str, str]:
    return {e.get("accession"): e.get("value", "") for e in element.iter() if _local(e.tag) == "cvParam"}


def _array(element: ElementTree.Element) -> tuple[str | None, list[float]]:
    terms = _terms(element)
    text = next((e.text or "" for e in element if _local(e.tag) == "binary"), "")
    data = base64.b64decode(text)
    if ZLIB in terms and data:
        data = zlib.decompress(data)
    kind = next((t for t in (MZ_ARRAY, INTENSITY_ARRAY) if t in terms), None)
    return kind, np.frombuffer(data, "<f8" if FLOAT_64 in terms else "<f4").astype(float).tolist()


def _row(element: ElementTree.Element) -> tuple:
    terms = _terms(element)
    arrays = dict(_array(e) for e in element.iter() if _local(e.tag) == "binaryDataArray")
    number = lambda key: float(terms[key]) if terms.get(key) else None
    charge = number(CHARGE)
    return element.get("id"), int(element.get("index", 0)), int(number(MS_LEVEL) or 1), number(SCAN_TIME), number(SELECTED_MZ), None if charge is None else int(charge), arrays.get(MZ_ARRAY, []), arrays.get(INTENSITY_ARRAY, [])


def parse_spectra(content: bytes) -> Iterator[tuple]:
    """Spectra of an mzML document, one at a time; what has been read is let go."""
    for _, element in ElementTree.iterparse(io.BytesIO(content), events=("end",)):
        if _local(element.tag) != "spectrum":
            continue
        yield _row(element)
        element.clear()


_END = "</spectrum>"
_START = re.compile(r"""<spectrum(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*>""")


def parse_part(text: str) -> Iterator[tuple]:
    """Spectra of what a document holds between the ends of two spectra: empty ones, then one without its end. A document with prefixed tags has no such end and comes whole."""
    for start in _START.finditer(text):
        if not start.group().endswith("/>"):
            yield _row(ElementTree.fromstring(text[start.start() :] + _END))
            return
        yield _row(ElementTree.fromstring(start.group()))
    if ":spectrum>" in text:
        yield from parse_spectra(text.encode())


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """Spectra of the mzML files (UTF-8) below ``path``, one row each; files are read spectrum by spectrum, and large ones split where they are not compressed."""

    names = [part.split()[0] for part in SPECTRA.split(", ")]
    doubles = pa.list_(pa.float64())
    types = [pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), doubles, doubles]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0):
                for row in parse_part(text.as_py()):
                    rows.append(row)
                    if len(rows) == 500:
                        yield made(rows)
                        rows = []
            if rows:
                yield made(rows)

    return spark.read.option("lineSep", _END).text(path).mapInArrow(run, SPECTRA)


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """(title, mass, charge, peaks) of spectra in text form."""
    blocks = spark.read.option("lineSep", "BEGIN IONS").text(path).filter("value LIKE '%END IONS%'")
    field = lambda name: F.regexp_extract("value", rf"(?m)^{name}=([^\r\n ]*)", 1)
    pairs = F.regexp_extract_all("value", F.lit(r"(?m)^([0-9.eE+\-]+)[ \t]+([0-9.eE+\-]+)"), F.lit(0))
    peak = lambda line: F.struct(F.split(line, r"[ \t]+")[0].cast("double").alias("mz"), F.split(line, r"[ \t]+")[1].cast("double").alias("intensity"))
    return blocks.select(field("TITLE").alias("title"), field("PEPMASS").cast("double").alias("mass"), F.regexp_extract(field("CHARGE"), r"(\d+)", 1).cast("int").alias("charge"), F.transform(pairs, peak).alias("peaks"))


def read_identifications(spark: SparkSession, path: str, row_tag: str = "SpectrumIdentificationResult") -> DataFrame:
    """Identification results of mzIdentML files by Spark's own XML reader, which splits large files."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)
