"""Protein-like sequences: digestion, sites, decoys and names, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where each protease cuts, as a zero-width pattern.
PROTEASES = {"trypsin": r"(?<=[KR])(?!P)", "lys-c": r"(?<=K)(?!P)", "arg-c": r"(?<=R)(?!P)", "glu-c": r"(?<=E)", "asp-n": r"(?=D)", "chymotrypsin": r"(?<=[FWY])(?!P)"}


def fragments(sequence: Column, pattern: str) -> Column:
    """The pieces between cuts."""
    return F.filter(F.split(sequence, pattern), lambda p: F.length(p) > 0)


def digest(sequence: Column, pattern: str, missed: int, shortest: int, longest: int) -> Column:
    """array<struct<peptide, start, end, missed>>: runs of up to ``missed`` + 1 pieces within the length bounds, without X."""
    pieces = fragments(sequence, pattern)
    n = F.size(pieces)
    starts = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda t, p: t + F.length(p)))

    def runs(i: Column, start: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.least(F.lit(missed), n - 1 - i)), lambda m: F.struct(F.array_join(F.slice(pieces, i + 1, m + 1), "").alias("peptide"), m.alias("missed")))
        return F.transform(made, lambda r: F.struct(r["peptide"].alias("peptide"), start.alias("start"), (start + F.length(r["peptide"])).alias("end"), r["missed"].alias("missed")))

    indexed = F.transform(starts, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    all_runs = F.flatten(F.transform(indexed, lambda e: runs(e["i"], e["s"])))
    kept = F.filter(all_runs, lambda r: F.length(r["peptide"]).between(shortest, longest) & ~r["peptide"].contains("X"))
    return F.when(n > 0, kept).otherwise(F.slice(kept, 1, 0))


def sites(sequence: Column, pattern: str) -> Column:
    """Start positions, from 0, of a pattern that matches at one place (use look-ahead for what follows)."""
    places = F.sequence(F.lit(0), F.greatest(F.length(sequence) - 1, F.lit(0)))
    whole = F.regexp_replace(sequence, pattern, "\u0001")
    return F.filter(F.transform(places, lambda i: F.when(F.substring(whole, i + 1, F.lit(1)) == "\u0001", i)), lambda i: i.isNotNull())


N_SEQUON = r"N(?=[^P][ST])"
O_SITE = r"[ST]"
GAG_SITE = r"S(?=G)"


def in_span(places: Column, start: Column, end: Column) -> Column:
    """Places in the half-open span."""
    return F.filter(places, lambda p: (p >= start) & (p < end))


def reversed_with_sites(sequence: Column, places: Column) -> tuple[Column, Column]:
    n = F.length(sequence)
    return F.reverse(sequence), F.array_sort(F.transform(places, lambda p: n - p - 1))


def accession(name: Column) -> Column:
    """The accession inside >sp|P02763|A1AG1_HUMAN, else the first word."""
    found = F.regexp_extract(name, r"^>?(?:sp|tr)\|([^|]+)\|", 1)
    return F.when(found != "", found).otherwise(F.regexp_extract(name, r"^>?(\S+)", 1))


def wrapped(text: Column, width: int) -> Column:
    return F.regexp_replace(text, f"(.{{{width}}})(?=.)", "$1\n")


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_.\-]+", "_"), r"^_+|_+$", "")


def elapsed(seconds: Column) -> Column:
    """Seconds as text: 1 h 02 m 03.50 s, without leading parts that are zero."""
    hours, minutes = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60)
    rest = seconds % 60
    return (
        F.when(hours > 0, F.format_string("%d h %02d m %05.2f s", hours, minutes, rest))
        .when(minutes > 0, F.format_string("%d m %05.2f s", minutes, rest))
        .otherwise(F.format_string("%.2f s", rest))
    )


def has_keyword(keywords: Column, keyword: str = "Glycoprotein") -> Column:
    """Whether a record's keywords name it; a record without keywords does not."""
    return F.coalesce(F.array_contains(keywords, keyword), F.lit(False))
