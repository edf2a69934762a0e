"""Paths over peaks and the graph of peptide masses, against plain definitions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from massloom.operators import peakpaths, peptidegraph

BLOCKS = [("H", 10.0), ("N", 14.0), ("HN", 24.0)]
TOLERANCE = 1e-3
SCHEMA = "scan string, peak int, mass double, intensity double, block string, slot int"


def peaks(seed, n):
    rng = random.Random(seed)
    return [(i, 100.0 + rng.choice([0, 10, 14, 20, 24, 28, 34, 38, 44, 48, 58, 62, 90]) + rng.choice([0, 0, 0.01, 0.4]), float(rng.randint(1, 9))) for i in range(n)]


CASES = {"one": peaks(1, 12), "two": peaks(2, 9), "tied": [(i, 100.0 + 10 * i, 2.0) for i in range(6)], "alone": [(0, 100.0, 1.0)], "apart": [(0, 100.0, 1.0), (1, 103.0, 1.0)]}


def frame(spark):
    rows = [(scan, *p, "x", 1) for scan, found in CASES.items() for p in found]
    rows += [rows[0], (None, 1, 100.0, 1.0, "x", 1), ("one", None, 110.0, 1.0, "x", 1), ("one", 99, None, 1.0, "x", 1), ("one", 98, 110.0, 0.0, "x", 1), ("one", 97, -5.0, 1.0, "x", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def plain_edges(found):
    return [(a, b, name) for a in found for b in found for name, step in BLOCKS if b[1] > a[1] and abs(b[1] - (a[1] + step)) <= (a[1] + step) * TOLERANCE]


def plain_walks(found):
    edges = plain_edges(found)
    walks = [([a, b], [name]) for a, b, name in edges]
    every = list(walks)
    while walks:
        walks = [(nodes + [b], labels + [name]) for nodes, labels in walks for a, b, name in edges if a == nodes[-1]]
        every += walks
    return edges, every


def plain_longest(found):
    edges, every = plain_walks(found)
    inner, outer = {b for _, b, _ in edges}, {a for a, _, _ in edges}
    best = {}
    for nodes, labels in every:
        if nodes[0] not in inner and nodes[-1] not in outer:
            key, rank = (nodes[0][0], nodes[-1][0]), (len(labels), sum(n[2] for n in nodes), labels, nodes)
            best[key] = max(best.get(key, rank), rank)
    return best


def test_edges_depths_and_longest_paths(spark):
    edges = peakpaths.mass_edges(frame(spark), BLOCKS, TOLERANCE)
    found = {(r["scan"], r["start"]["peak"], r["end"]["peak"], r["block"]) for r in edges.collect()}
    assert found == {(scan, a[0], b[0], name) for scan, rows in CASES.items() for a, b, name in plain_edges(rows)}
    depths = {(r["scan"], r["peak"]): r["depth"] for r in peakpaths.path_depths(edges).collect()}
    expected = {}
    for scan, rows in CASES.items():
        links, every = plain_walks(rows)
        for a, _, _ in links:
            expected.setdefault((scan, a[0]), 0)
        for nodes, labels in every:
            expected[scan, nodes[-1][0]] = max(expected.get((scan, nodes[-1][0]), 0), len(labels))
    assert depths == expected
    paths = peakpaths.longest_paths(edges).collect()
    got = {(r["scan"], r["start"], r["end"]): (r["steps"], r["signal"], r["labels"], [tuple(n) for n in r["nodes"]]) for r in paths}
    assert len(got) == len(paths)
    assert got == {(scan, *ends): rank for scan, rows in CASES.items() for ends, rank in plain_longest(rows).items()}
    assert all(r["start_mass"] == r["nodes"][0]["mass"] and r["end_mass"] == r["nodes"][-1]["mass"] for r in paths)
    least = peakpaths.longest_paths(edges, least=3)
    assert {r["steps"] for r in least.collect()} == {v[0] for v in got.values() if v[0] >= 3}
    with pytest.raises(ValueError):
        peakpaths.mass_edges(frame(spark), [("H", 0.0)], TOLERANCE)


def test_disjoint_paths_are_those_of_one_pass(spark):
    paths = peakpaths.longest_paths(peakpaths.mass_edges(frame(spark), BLOCKS, TOLERANCE))
    rows = sorted(paths.collect(), key=lambda r: (r["scan"], -r["signal"], r["start"], r["end"]))

    def one_pass(most):
        taken, used, place = set(), {}, {}
        for r in rows:
            place[r["scan"]] = place.get(r["scan"], 0) + 1
            own, mine = used.setdefault(r["scan"], set()), {n["peak"] for n in r["nodes"]}
            if place[r["scan"]] <= most and not own & mine:
                own |= mine
                taken.add((r["scan"], r["start"], r["end"], place[r["scan"]]))
        return taken

    for most in (None, 2):
        found = peakpaths.disjoint_paths(paths, most).collect()
        assert {(r["scan"], r["start"], r["end"], r["place"]) for r in found} == one_pass(most or 10**9)


def test_grouped_paths_and_path_scores(spark):
    node = lambda peak, mass, intensity: (peak, mass, intensity)
    rows = [
        ("a", ["H"], [node(1, 100.0, 1.0), node(4, 110.0, 10.0)], 100.0), ("a", ["H"], [node(2, 100.4, 3.0), node(4, 110.0, 10.0)], 100.4),
        ("a", ["H"], [node(3, 100.8, 1.0), node(5, 110.8, 1.0)], 100.8), ("a", ["N"], [node(1, 100.0, 1.0), node(6, 114.0, 1.0)], 100.0),
    ]
    df = spark.createDataFrame(rows, "scan string, labels array<string>, nodes array<struct<peak int, mass double, intensity double>>, start_mass double")
    found = {("".join(r["labels"]), r["piece"]): r for r in peakpaths.grouped_paths(df, 5e-3).collect()}
    assert set(found) == {("H", 0), ("H", 1), ("N", 0)}  # 100.8 is near 100.4, but not near the first of the piece
    merged = found["H", 0]
    assert merged["members"] == 2 and merged["signal"] == 14.0 and merged["start_mass"] == pytest.approx((100.0 + 3 * 100.4) / 4) and merged["end_mass"] == 110.0
    score, text = df.select(peakpaths.log_signal(F.col("nodes")), peakpaths.composition(F.array(F.lit("N"), F.lit("H"), F.lit("N")))).first()
    assert score == pytest.approx(1.0) and text == "H:1; N:2"


def test_empty_tables(spark):
    edges = peakpaths.mass_edges(frame(spark).limit(0), BLOCKS, TOLERANCE)
    paths = peakpaths.longest_paths(edges)
    assert paths.isEmpty() and peakpaths.path_depths(edges).isEmpty() and peakpaths.disjoint_paths(paths).isEmpty() and peakpaths.grouped_paths(paths, 1e-3).isEmpty()
    nodes = spark.createDataFrame([], "scan string, peptide_mass double, score double")
    assert peptidegraph.shared_masses(nodes).isEmpty()


def test_path_nodes_score_by_expected_residues(spark):
    nodes = [(i, 500.0 + i, v) for i, v in enumerate((10.0, 100.0, 1000.0))]
    rows = [("a", nodes, 500.0), ("a", nodes[:2], 500.0), ("b", nodes, 500.0)]
    paths = spark.createDataFrame(rows, "scan string, nodes array<struct<peak int, mass double, intensity double>>, start_mass double")
    precursors = spark.createDataFrame([("a", 1500.0), ("b", 600.0)], "scan string, precursor_mass double")
    n = 1000.0 / peptidegraph.AVERAGE_RESIDUE
    (row,) = peptidegraph.path_nodes(precursors, paths).collect()  # b leaves less than one residue
    assert (row["scan"], row["peptide_mass"], row["rest"]) == ("a", 500.0, 1000.0) and row["score"] == pytest.approx(6.0 / (math.log(n) * n / 2))


def test_merged_and_common_masses(spark):
    rng = random.Random(6)
    make = lambda: [(s, round(rng.choice([500.0, 600.0, 700.0]) * (1 + rng.choice([0, 4e-6, 7e-6, 1.2e-5, 1])), 6), rng.random()) for s in "abc" for _ in range(6)]
    schema = "scan string, peptide_mass double, score double"
    stored, novel = make(), make()
    merged = peptidegraph.merged_nodes(spark.createDataFrame(stored, schema), spark.createDataFrame(novel, schema), 5e-6)
    expected = [(*r, True) for r in stored] + [(*r, False) for r in novel if not any(s[0] == r[0] and abs(s[1] - r[1]) <= r[1] * 5e-6 for s in stored)]
    assert sorted(map(tuple, merged.collect())) == sorted(expected)
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "a"), ("a", "missing")], "scan string, other string")
    found = peptidegraph.common_masses(pairs, merged, 5e-6)
    masses = {s: {r[1] for r in expected if r[0] == s} for s in "abc"}
    assert sorted(map(tuple, found.collect())) == sorted((s, o, x, y) for s, o in (("a", "b"), ("c", "a")) for x in masses[s] for y in masses[o] if abs(x - y) <= y * 5e-6)


def test_shared_masses_lose_no_pair(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 39), 500 * (1 + rng.random() * 2e-3), rng.choice([1.0, 2.0])) for _ in range(300)] + [(s, 900.0, 1.0) for s in range(200)] + [(1, None, 1.0), (None, 900.0, 1.0), (777, 1234.5, 1.0)]
    found = peptidegraph.shared_masses(spark.createDataFrame(rows, "scan int, peptide_mass double, score double"), 5e-6).collect()
    known = sorted({m for s, m, _ in rows if s is not None and m is not None})
    first, shared = None, {}
    for before, m in zip([None, *known], known):
        first = m if before is None or m - before > m * 5e-6 else first
        shared[m] = first
    expected = {}
    for s, m, score in rows:
        if s is not None and m is not None:
            expected.setdefault(shared[m], {}).setdefault(s, []).append((score, -m))
    want = {(c, s, -max(v)[1], max(v)[0], len(v), len(scans)) for c, scans in expected.items() if len(scans) > 1 for s, v in scans.items()}
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert len([r for r in found if r["shared"] == 900.0]) == 200


def test_neighbourhoods_of_compositions(spark):
    from massloom.functions import neighbourhoods

    df = spark.createDataFrame([("biantennary", 5, 4, 2, 0), ("galactosylated", 8, 4, 0, 0), ("mannose", 9, 2, 0, 0), ("null", None, 4, 2, 0)], "name string, Hex int, HexNAc int, NeuAc int, NeuGc int")
    names = lambda mammalian: {(r["name"], r["neighbourhood"]) for r in neighbourhoods.labelled(df, F.col, neighbourhoods.n_glycan_rules(mammalian)).collect()}
    assert len(neighbourhoods.n_glycan_rules()) == len(neighbourhoods.n_glycan_rules(True)) == 14
    human, wider = names(False), names(True)
    assert {n for c, n in human if c == "biantennary"} == {"hybrid", "bi-antennary", "tri-antennary"}
    assert {n for c, n in wider if c == "biantennary"} == {"hybrid", "bi-antennary", "tri-antennary"}
    assert {n for c, n in human if c == "galactosylated"} == set()
    assert {n for c, n in wider if c == "galactosylated"} == {"asialo-bi-antennary", "asialo-tri-antennary"}
    assert {n for c, n in human if c == "mannose"} == {"high-mannose"} and not any(c == "null" for c, _ in human | wider)


def test_decoy_fragments_take_the_generators_shifts(spark):
    import numpy as np

    from massloom.operators import decoys

    glycans = {"a": 1216.42, "b": 1216.5, "c": None, "d": -3.0, "e": 1216.4}
    rows = [(s, m, p, 100.0 + 7 * p, size, "x") for s, m in glycans.items() for p, size in enumerate((0, 1, 2, 3, None, 1, 2))] + [("a", 1216.42, 3, 90.0, 2, "y"), ("b", 1216.5, 2, 114.0, 2, "x")]
    schema = "structure string, glycan_mass double, position int, fragment_mass double, size int, seed string"
    df = spark.createDataFrame(rows, schema)
    found = decoys.shifted_fragments(df)
    assert found.columns == [*df.columns, "decoy_mass"]
    expected = []
    for s, mass in glycans.items():
        draws = iter(np.random.RandomState(round(mass)).uniform(1.0, 30.0, 20)) if mass and mass > 0 else None
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[3], r[4] or 0)):
            expected.append((*r, r[3] + next(draws) if draws and (r[4] or 0) > 1 else r[3]))
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)
    assert decoys.shifted_fragments(df.limit(0)).isEmpty()


def test_no_query_is_registered_twice():
    from massloom.plans import catalog

    modules = [getattr(catalog, name) for name in dir(catalog) if name.startswith("catalog_")]
    assert sum(len(m.CATALOG) for m in modules) == len(catalog.CATALOG)
