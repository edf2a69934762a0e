"""Queries over all matches score a scan also where its precursor speaks for no structure, or where it has none."""

import math

import pytest

from massloom.plans.catalog import CATALOG

SEVEN, EIGHT = (7, "Brand#1"), (8, "Brand#1")

#: Of each query what it must return: a row of values, or () where the pair alone counts.
EXPECTED = {
    "coverage_scorer": {SEVEN: (round((0.05 * 0.5 + 0.5) * 0.8 + 0.2 / 3, 6), 0.05), EIGHT: (round((math.log(2) / math.log(3) / 20 * 0.5 + 0.5) * 0.8, 6), round(math.log(2) / math.log(3) / 20, 6))},
    "peptide_coverage_scorer": {SEVEN: (0.05,), EIGHT: ()},
    "signature_coverage_scorer": {SEVEN: (round((0.05 * 0.5 + 0.5) * 0.8 + 0.2 / 3 - 120, 4),), EIGHT: ()},
    "signature_penalties": {SEVEN: (-120.0,), EIGHT: (-120.0,)},
    "glycan_scorers": {SEVEN: (round(math.log10(940) * math.sqrt(1 / 5), 4), round(math.log10(940) * math.sqrt(1 / 5) - 120, 4))},
    "coverage_weighted_binomial": {SEVEN: (), EIGHT: ()},
    "signature_consistent_candidates": {SEVEN: (), EIGHT: ()},
    "fragment_vectors": {SEVEN: (round(41920 / math.sqrt(2540000 * 1036), 6),), EIGHT: (round(30 / math.sqrt(1036), 6),)},
    "localisation_scores": {SEVEN: (), EIGHT: ()},
    "utilisation_preserved": {SEVEN: (), EIGHT: ()},
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """One structure of mass 1037.5 with a fragment of each series; scan 7 has all three and a precursor of 1900, scan 8 has one and no precursor."""
    root = tmp_path_factory.mktemp("whole")

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")

    write("part", [(3, "Brand#1", 30, 900.0), (4, "Brand#1", 6, 920.0), (5, "Brand#1", 10, 940.0)], "p_partkey long, p_brand string, p_size int, p_retailprice double")
    write("lineitem", [(7, 1.0, 900.0), (7, 1.0, 920.0), (7, 1.0, 940.0), (8, 1.0, 900.0)], "l_orderkey long, l_quantity double, l_extendedprice double")
    write("orders", [(7, 900.0)], "o_orderkey long, o_totalprice double")
    write("nation", [(0,)], "n_nationkey int")
    return str(root)


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_scans_without_a_fitting_precursor_are_scored(spark, tables, name):
    found = {(r["scan"], r["structure"]): tuple(r)[2:] for r in CATALOG[name][0](spark, tables).collect()}
    assert set(found) == set(EXPECTED[name])
    for pair, values in EXPECTED[name].items():
        assert not values or found[pair] == pytest.approx(values, abs=1e-6)


def test_binomial_tails_of_many_fragments_take_few_terms_and_lose_none(spark):
    from pyspark.sql import functions as F

    from massloom.functions import score

    cases = [(n, k, p) for n in (1, 2, 38, 800, 3000) for k in (0, 1, 2, 7, 60, 79, 80, 81, 200, 800) if k <= n for p in (0.0006, 0.01, 0.1, 0.5)]
    rows = spark.createDataFrame(cases, "n int, k int, p double").select("n", "k", "p", score.upper_tail(F.col("n"), F.col("k"), F.col("p")).alias("tail")).collect()
    logs = [0.0]
    for i in range(1, 3001):
        logs.append(logs[-1] + math.log(i))
    for n, k, p, tail in rows:
        terms = [math.exp(logs[n] - logs[i] - logs[n - i] + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1)]
        assert tail == pytest.approx(math.fsum(terms), rel=1e-9, abs=1e-300)
