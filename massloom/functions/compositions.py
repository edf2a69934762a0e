"""Compositions as map<string,int>: algebra, text forms and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECOY = "#decoy#"


def count(composition: Column, symbol: str) -> Column:
    return F.coalesce(F.element_at(composition, symbol), F.lit(0))


def added(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def subtracted(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))


def distance(a: Column, b: Column) -> Column:
    """L1 over the union of keys."""
    return F.aggregate(F.map_values(F.transform_values(subtracted(a, b), lambda k, v: F.abs(v))), F.lit(0), lambda t, v: t + v)


def edge_weight(d: Column) -> Column:
    return F.when(d == 0, F.lit(1.0)).otherwise(1.0 / d)


def to_text(composition: Column) -> Column:
    """{Fuc:1; Hex:5} in the order of names; zero counts go."""
    entries = F.array_sort(F.filter(F.map_entries(composition), lambda e: e["value"] != 0))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), "; "), F.lit("}"))


def _pairs(text: Column, pattern: str) -> Column:
    names, counts = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    made = F.map_from_arrays(F.array_distinct(names), F.transform(F.array_distinct(names), lambda n: F.lit(0)))
    listed = F.zip_with(names, counts, lambda n, c: F.struct(n.alias("n"), c.cast("int").alias("c")))
    return F.transform_values(made, lambda k, v: F.aggregate(F.filter(listed, lambda e: e["n"] == k), F.lit(0), lambda t, e: t + e["c"]))


def parse_braced(text: Column) -> Column:
    """{Hex:5; HexNAc:4} as a map; null where the text is not of that form."""
    return F.when(text.rlike(r"^\{[^{}]*\}$"), _pairs(text, r"([^:;{}\s][^:;{}]*):\s*(-?\d+)"))


def parse_parenthesised(text: Column) -> Column:
    """HexNAc(4)Hex(5) as a map; null where the text is not of that form."""
    return F.when(text.rlike(r"^([^()\s:]+\(\d+\))+$"), _pairs(text, r"([^()\s:]+)\((\d+)\)"))


def parse_spaced(text: Column) -> Column:
    """Hex:5 HexNAc:4 as a map; null where the text is not of that form."""
    return F.when(text.rlike(r"^[^:\s{}]+:\d+(\s+[^:\s{}]+:\d+)*$"), _pairs(text, r"([^:\s]+):(\d+)"))


def parse_any(text: Column) -> Column:
    """Each dialect in turn."""
    return F.coalesce(parse_braced(text), parse_parenthesised(text), parse_spaced(text))


def as_decoy(composition: Column) -> Column:
    return F.map_concat(F.map_filter(composition, lambda k, v: k != DECOY), F.create_map(F.lit(DECOY), F.lit(2)))


def is_decoy_text(text: Column) -> Column:
    return text.contains(DECOY)


def linearised(composition: Column) -> Column:
    """Each name as often as it counts."""
    return F.flatten(F.transform(F.array_sort(F.map_entries(composition)), lambda e: F.array_repeat(e["key"], e["value"])))


def mass(composition: Column, masses: dict[str, float], base: float = 0.0) -> Column:
    table = F.create_map(*(F.lit(x) for pair in masses.items() for x in pair))
    return F.aggregate(F.map_entries(composition), F.lit(base), lambda t, e: t + e["value"] * F.coalesce(F.element_at(table, e["key"]), F.lit(0.0)))


def parse_formula(text: Column) -> Column:
    """Hex5HexNAc4 as a map; a residue without a number counts once, repeated ones add up."""
    names, counts = (F.regexp_extract_all(text, F.lit(r"([A-Z][A-Za-z@]*?[A-Za-z])(\d+)"), F.lit(i)) for i in (1, 2))
    listed = F.zip_with(names, counts, lambda n, c: F.struct(n.alias("n"), c.cast("int").alias("c")))
    keys = F.array_distinct(names)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.aggregate(F.filter(listed, lambda e: e["n"] == k), F.lit(0), lambda t, e: t + e["c"])))


def internal_size(composition: Column, terminal: tuple[str, ...] = ("Neu5Ac", "Neu5Gc"), side: tuple[str, ...] = ("Fuc", "dHex")) -> Column:
    """Residues that are not terminal, less one where there is more than one side group."""
    total = F.aggregate(F.map_values(composition), F.lit(0), lambda t, v: t + v)
    sides = sum((count(composition, s) for s in side), F.lit(0))
    return total - sum((count(composition, s) for s in terminal), F.lit(0)) - F.when(sides > 1, 1).otherwise(0)
