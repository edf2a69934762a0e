"""Operators that no SQL expresses, against plain definitions on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.functions import score
from massloom.operators import build, coresearch, elution, fdr, fits, mixture, ordered, profiles, sites, spectrum


def test_log_factorials_and_binomial_tails_of_any_size(spark):
    rows = [(n, k, p) for n, k, p in ((0, 0, 0.5), (1, 0, 0.3), (7, 3, 0.5), (171, 20, 0.1), (400, 100, 0.3), (400, 400, 0.3), (5000, 40, 0.01), (5, 9, 0.5))]
    df = spark.createDataFrame(rows, "n int, k int, p double")
    for r in df.select("*", score.log_factorial(F.col("n")).alias("f"), score.binomial_tail(F.col("n"), F.col("k"), F.col("p")).alias("t")).collect():
        assert r["f"] == pytest.approx(math.lgamma(r["n"] + 1), rel=1e-12, abs=1e-12)
        plain = math.fsum(math.exp(math.lgamma(r["n"] + 1) - math.lgamma(i + 1) - math.lgamma(r["n"] - i + 1) + i * math.log(r["p"]) + (r["n"] - i) * math.log1p(-r["p"])) for i in range(r["k"], r["n"]))
        assert r["t"] == pytest.approx(plain, rel=1e-9, abs=1e-300)


@pytest.mark.parametrize("kind,truth", [("gaussian", [10.0, 50.0, 2.0]), ("skewed", [10.0, 50.0, 1.8, 1.5]), ("two_sided", [10.0, 50.0, 1.5, 3.0])])
def test_shapes_are_recovered(kind, truth):
    x = np.linspace(0, 25, 60)
    y = fits.SHAPES[kind](x, np.array(truth))
    p, fitted = fits.fit(x, y, kind)
    assert p == pytest.approx(truth, rel=1e-2) and fits.line_score(y, fitted) > 0.999


def test_several_peaks(spark):
    x = np.linspace(0, 60, 120)
    y = fits.two_sided(x, np.array([12.0, 40.0, 2.0, 3.0])) + fits.two_sided(x, np.array([42.0, 25.0, 3.0, 2.0]))
    rows = [("a", float(t), float(v)) for t, v in zip(x, y, strict=True)] + [("b", 1.0, 2.0), ("b", None, 3.0), ("b", 2.0, None), (None, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, t double, v double")
    for kind in ("peeled", "split", "best"):
        found = {r["k"]: r for r in fits.fitted_shapes(df, ["k"], "t", "v", kind).collect()}
        assert found["a"]["peaks"] == 2 and found["a"]["line_score"] > 0.98
        assert sorted(round(s["centre"]) for s in found["a"]["shapes"]) == [12, 42]
        assert found["b"]["peaks"] == 0 and None not in found


def test_block_smoothing_minimises_what_it_says(spark):
    draw = np.random.default_rng(2)
    n = 9
    w = np.triu(draw.random((n, n)) * (draw.random((n, n)) < 0.5), 1)
    laplacian = np.diag((w + w.T).sum(axis=1)) - w - w.T
    observed = draw.random(n)
    observed[[1, 4, 7]] = np.nan
    values, press = sites.block_smooth(laplacian, observed, 0.7, 1.0)
    seen = ~np.isnan(observed)
    matrix = 0.7 * (laplacian + np.eye(n)) + np.diag(seen.astype(float))
    assert values == pytest.approx(np.linalg.solve(matrix, np.where(seen, observed, 0.0)))
    left_out = []
    for i in np.flatnonzero(seen):
        others = observed.copy()
        others[i] = np.nan
        left_out.append((observed[i] - sites.block_smooth(laplacian, others, 0.7, 1.0)[0][i]) ** 2)
    assert press == pytest.approx(np.mean(left_out))
    nodes = [(s, i, None if math.isnan(observed[i]) else float(observed[i])) for s in (1, 2) for i in range(n)]
    edges = [(s, i, j, float(w[i, j])) for s in (1, 2) for i in range(n) for j in range(n) if w[i, j]]
    out = sites.smooth_sites(spark.createDataFrame(nodes, "site int, id int, observed double"), spark.createDataFrame(edges, "site int, a int, b int, weight double"), "site", [0.7, 2.0], [-1.0])
    found = {(r["site"], r["id"]): r["smooth"] for r in out.filter("strength = 0.7").collect()}
    assert all(found[s, i] == pytest.approx(values[i]) for s in (1, 2) for i in range(n))
    best = sites.best_models(out, "site").select("site", "strength").distinct().collect()
    assert len(best) == 2


def test_robust_line_leaves_outliers_out(spark):
    rng = random.Random(4)
    rows = [(i, float(i), 3.0 + 2.0 * i + rng.gauss(0, 0.1)) for i in range(200)] + [(200 + i, float(i), 900.0 + rng.random()) for i in range(60)]
    a, b = elution.robust_line(spark.createDataFrame(rows, "i int, x double, y double"), "i", "x", "y")
    assert (a, b) == (pytest.approx(3.0, abs=0.2), pytest.approx(2.0, abs=0.01))


def test_mixture_beside_a_fixed_component():
    draw = np.random.default_rng(5)
    sample = np.concatenate([draw.normal(10, 2, 4000), draw.normal(40, 5, 6000)])
    counts, edges = np.histogram(sample, 400)
    x = (edges[1:] + edges[:-1]) / 2
    prior = np.exp(-(((x - 10) / 2) ** 2) / 2) / (2 * math.sqrt(2 * math.pi))
    found, weight = mixture.fit_with_prior(x, counts.astype(float), prior, 1)
    assert weight == pytest.approx(0.4, abs=0.02) and found.means[0] == pytest.approx(40, abs=0.5) and found.deviations[0] == pytest.approx(5, abs=0.3)


def test_look_ups_beyond_the_ends_and_of_nothing(spark):
    refs = spark.createDataFrame([(1.0, 10.0), (2.0, 30.0), (4.0, 0.0)], "v double, y double")
    asked = spark.createDataFrame([(0, -5.0), (1, 1.0), (2, 1.5), (3, 3.0), (4, 9.0), (5, None)], "i int, x double")
    near = {r["i"]: r["v"] for r in ordered.nearest_clamped(asked, refs, "x", "v").collect()}
    assert near == {0: 1.0, 1: 1.0, 2: 1.0, 3: 2.0, 4: 4.0, 5: None}
    line = {r["i"]: r["y"] for r in ordered.interpolated(asked, refs, "x", "v", "y").collect()}
    assert line == {0: 10.0, 1: 10.0, 2: 20.0, 3: 15.0, 4: 0.0, 5: None}
    empty = {r["i"]: r["y"] for r in ordered.interpolated(asked, refs.limit(0), "x", "v", "y").collect()}
    assert set(empty.values()) == {None}


def test_exact_percentiles_of_a_hot_key(spark):
    rng = random.Random(7)
    rows = [("hot", round(rng.random(), 2)) for _ in range(900)] + [("cold", 5.0), ("cold", 7.0), ("cold", None), ("one", 1.0)]
    found = {r["k"]: (r["p0"], r["p1"]) for r in ordered.exact_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [0.5, 0.05]).collect()}
    for k in ("hot", "cold", "one"):
        values = [v for key, v in rows if key == k and v is not None]
        assert found[k] == (pytest.approx(np.percentile(values, 50)), pytest.approx(np.percentile(values, 5)))


def test_core_search_equals_comparing_everything(spark):
    rng = random.Random(8)
    precursors = [(s, 2000.0 + 400 * rng.random()) for s in range(30)]
    glycans = [(g, 800.0 + 20 * g) for g in range(20)]
    shifts = [(g, k, 203.1 * k, k < 2) for g, _ in glycans for k in range(3)]
    peaks = []
    for s, m in precursors:
        g = rng.choice(glycans)
        peaks += [(s, m - g[1] + 203.1 * k + rng.gauss(0, 0.003), rng.random() * 100 + 2) for k in range(3)] + [(s, 1000 + 900 * rng.random(), 5.0) for _ in range(15)]
    frame = spark.createDataFrame
    index = coresearch.ladder_index(frame(glycans, "glycan int, glycan_mass double"), frame(shifts, "glycan int, key int, shift double, is_core boolean"))
    matches = coresearch.ladder_matches(frame(precursors, "scan int, precursor_mass double"), frame(peaks, "scan int, mass double, intensity double"), index, 1e-5, 1.0)
    plain = {}
    for s, m in precursors:
        for g, gm in glycans:
            total, keys = 0.0, set()
            for k in range(3):
                target = m - gm + 203.1 * k
                for ps, pm, i in peaks:
                    if ps == s and abs(pm - target) <= target * 1e-5 and m - gm >= 500:
                        total += math.log(i) * (1 - (abs(pm - target) / target) ** 4)
                        keys.add(k)
            if keys:
                plain[s, g] = total * (len(keys) / 3) ** 0.56 * (len(keys & {0, 1}) / 2) ** 0.42
    found = {(r["scan"], r["glycan"]): r["score"] for r in coresearch.coarse_scores(matches, 500.0).collect()}
    assert found.keys() == plain.keys() and all(found[k] == pytest.approx(v) for k, v in plain.items())


def test_expected_false_targets(spark):
    row = spark.createDataFrame([(0, 0), (50, 0), (3, 5), (100_000, 20_000)], "t long, d long").select("t", "d", fdr.expected_false(F.col("t"), F.col("d"), 1.0).alias("e")).collect()
    for r in row[:3]:
        logs = [m * math.log(0.5) + math.lgamma(m + r["d"] + 1) - math.lgamma(m + 1) - math.lgamma(r["d"] + 1) for m in range(r["t"] + 1)]
        w = np.exp(np.array(logs) - max(logs))
        assert r["e"] == pytest.approx((w * np.arange(r["t"] + 1)).sum() / w.sum())
    assert row[3]["e"] == pytest.approx(20_001, rel=1e-9)


def test_synthesis_and_descendants_end(spark):
    made = build.synthesised(spark.createDataFrame([(1, 0)], "a int, b int"), ["a", "b"], [(F.col("a") > 0, {"b": 1}), (F.col("b") > 1, {"a": 1})], {"a": 3, "b": 3})
    assert {(r["a"], r["b"], r["steps"]) for r in made.collect()} == {(1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 2, 3), (2, 3, 4), (3, 2, 4), (3, 3, 5)}
    tree = spark.createDataFrame([(2, 1), (3, 2), (4, 2), (5, None), (1, 3)], "id int, parent int")  # 1 -> 2 -> 3 -> 1 is a ring
    assert {r["id"] for r in profiles.descendants(tree, spark.createDataFrame([(2,)], "id int")).collect()} == {1, 2, 3, 4}


def test_empty_spectra(spark):
    peaks = spark.createDataFrame([], "scan long, mass double, intensity double")
    fragments = spark.createDataFrame([("s", 1, 100.0, "b", 1, True)], "structure string, fragment int, fragment_mass double, series string, position int, glycosylated boolean")
    assert spectrum.match_fragments(peaks, fragments).collect() == []
    row = spark.createDataFrame([([],), ([5.0],), ([1.0, 2.0],), ([1.0, 2.0, 3.0, 4.0, 5.0],)], "v array<double>").select(*(m.alias(f"m{i}") for i, m in enumerate(spectrum.medians(F.col("v"))))).collect()
    assert [tuple(r) for r in row] == [(0, 0, 0, 0), (5, 0, 0, 0), (1.5, 2, 0, 0), (3, 4.5, 5, 0)]


def test_overlaps_merge_across_any_border_and_by_the_grown_span(spark):
    from massloom.operators import cluster

    rows = [(1, 99.999, 0.0, 10.0), (2, 100.001, 5.0, 12.0), (3, 100.004, 11.0, 20.0), (4, 100.005, 30.0, 40.0), (5, 250.0, 0.0, 1.0), (6, None, 0.0, 1.0)]
    out = cluster.smooth_overlaps(spark.createDataFrame(rows, "id int, m double, s double, e double"), "m", "s", "e", 1e-4, "id").collect()
    assert sorted((round(r["mass"], 5), r["start"], r["end"], r["members"]) for r in out) == [(round((99.999 + 100.001 + 100.004) / 3, 5), 0.0, 20.0, 3), (100.005, 30.0, 40.0, 1), (250.0, 0.0, 1.0, 1)]


def test_components_of_chains_rings_and_loners(spark):
    from massloom.operators import graph

    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(1000, 1400)] + [(5, 9), (9, 7), (7, 5), (3, 3), (20, 21), (22, 21)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    found = {r["id"]: r["component"] for r in graph.components(df).collect()}
    assert found == {**{i: 1000 for i in range(1000, 1401)}, 5: 5, 9: 5, 7: 5, 3: 3, 20: 20, 21: 20, 22: 20}
    assert graph.components(df.limit(0)).collect() == []


def test_scratch_is_cleared(spark):
    from pathlib import Path

    from massloom.session import Scratch, clear_scratch

    scratch = Scratch(spark, "cleared")
    scratch.keep(spark.range(3), "rows")
    assert Path(scratch.root.removeprefix("file:")).exists()
    assert clear_scratch(spark) >= 1 and not Path(scratch.root.removeprefix("file:")).exists()
    assert clear_scratch(spark) == 0
