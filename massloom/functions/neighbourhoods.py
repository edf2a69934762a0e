"""Neighbourhoods of N-glycan compositions as rules in text, for ``expressions.compile_rule``.

They overlap on purpose: a composition belongs to every neighbourhood whose rule it meets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from massloom.operators.expressions import compile_rule
from massloom.operators.graph import neighbourhood_labels

# Names by the number of antennae, from two up.
ANTENNAE = ("bi", "tri", "tetra", "penta", "hexa", "hepta")
SIALIC = "(NeuAc + NeuGc)"


def between(value: str, low: int, high: int) -> str:
    return f"({value} >= {low} and {value} <= {high})"


def n_glycan_rules(mammalian: bool = False) -> dict[str, str]:
    """name -> rule of 14 neighbourhoods: high-mannose, hybrid, and each number of antennae with and without sialic acids.

    With ``mammalian`` a branch may end in a further hexose where it has no sialic acid, so the
    hexoses of a branched neighbourhood reach further up, and each sialic acid takes one of them away.
    """
    rules = {
        "high-mannose": " and ".join([between("Hex", 3, 12), between("HexNAc", 2, 2), between(SIALIC, 0, 0)]),
        "hybrid": " and ".join([between("Hex", 2, 6), between("HexNAc", 2, 4), between(SIALIC, 0, 2)]),
    }
    for more, name in enumerate(ANTENNAE, 1):
        least = 2 + more
        core = between("HexNAc", least, least + 2)
        if mammalian:
            sialylated, plain = f"(Hex >= {least} and Hex < {2 * more + 6} - {SIALIC})", between("Hex", least, 2 * more + 6)
        else:
            sialylated = plain = between("Hex", least, least + 3)
        rules[f"{name}-antennary"] = " and ".join([core, between(SIALIC, 1, least), sialylated])
        rules[f"asialo-{name}-antennary"] = " and ".join([core, between(SIALIC, 0, 1 if more == 1 else 0), plain])
    return rules


def labelled(df: DataFrame, symbol: Callable[[str], Column], rules: dict[str, str]) -> DataFrame:
    """Each composition once for every neighbourhood that it meets; ``symbol`` gives the column of a residue's count.

    Where a count is null a rule that needs it is not met.
    """
    return neighbourhood_labels(df, {name: compile_rule(text, symbol) for name, text in rules.items()})
