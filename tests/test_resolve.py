"""Resolved annotations, window ensembles, densities, margins and precursor candidates against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.operators import densities, expressions, graph, representers, rescoring, spectrum, windows


def plain_resolution(features, options, base, rounds):
    """The rounds of assignment, group by group, over dictionaries."""
    out = {}
    by_group = defaultdict(dict)
    for g, f, a, b, _ in features:
        by_group[g][f] = (a, b)
    for g, spans in by_group.items():
        best = {}
        for gg, f, k, s, m, score in options:
            if gg == g and None not in (k, s, m, score) and f in spans:
                best[f, k, s, m] = max(score, best.get((f, k, s, m), score))
        seen = {k for f, k, s, m in best if m == base}
        some = {f for f, k, s, m in best if k in seen}
        best = {o: v for o, v in best.items() if o[1] in seen or o[0] not in some}
        weight = defaultdict(lambda: -1e300)
        for (f, k, s, m), v in best.items():
            weight[k, m] = max(weight[k, m], v)

        def start(left):
            top = defaultdict(lambda: -1e300)
            for (f, k, s, m), v in left.items():
                top[k, m] = max(top[k, m], v)
            totals = defaultdict(float)
            for (k, _), v in top.items():
                totals[k] += v
            key = min(totals, key=lambda k: (-totals[k], k))
            shift = min((m for k, m in top if k == key), key=lambda m: (-top[key, m], m))
            f, k, s, m = min((o for o in left if o[1] == key and o[3] == shift), key=lambda o: (-left[o], o[0], o[2]))
            return f, k, s, m, top[key, shift]

        left, done = dict(best), {}
        for n in range(rounds + 1):
            if not left:
                break
            new = {}
            for f in {o[0] for o in left} if n else ():
                hits = {}
                for o in left:
                    if o[0] == f:
                        shifts = {d[2] for h, d in done.items() if d[0] == o[1] and spans[h][0] <= spans[f][1] and spans[f][0] <= spans[h][1]}
                        if shifts:
                            hits[o] = sum(weight[o[1], m] for m in sorted(shifts))
                if hits:
                    f, k, s, m = min(hits, key=lambda o: (-hits[o], *o[1:]))
                    new[f] = (k, s, m, hits[f, k, s, m], n)
            if not new:
                f, k, s, m, w = start(left)
                new[f] = (k, s, m, w, n)
            done |= new
            left = {o: v for o, v in left.items() if o[0] not in done}
        for f in {o[0] for o in left}:
            _, k, s, m = min((o for o in left if o[0] == f), key=lambda o: (-left[o], *o[1:]))
            done[f] = (k, s, m, left[f, k, s, m], -1)
        out |= {(g, f): d for f, d in done.items()}
    return out


@pytest.mark.parametrize("rounds", [1, 6])
def test_annotations_are_resolved_in_rounds(spark, rounds):
    rng = random.Random(rounds)
    features, options = [], []
    for g in range(12):
        for f in range(rng.randint(1, 9)):
            a = rng.uniform(0, 60)
            features.append((g, 100 * g + f, a, a + rng.uniform(1, 30), 5.0))
            for _ in range(rng.randint(0, 4)):
                options.append((g, 100 * g + f, rng.choice("abc"), rng.choice(["x", "y"]), rng.choice(["none", "none", "nh4", "na"]), float(rng.randint(1, 9))))
    options += options[:5] + [(0, 0, None, "x", "none", 3.0), (0, 0, "a", "x", "none", None), (99, 1, "a", "x", "none", 1.0)]
    f = spark.createDataFrame(features, "group long, feature long, start double, end double, signal double")
    o = spark.createDataFrame(options, "group long, feature long, key string, solution string, shift string, score double")
    found = representers.assign_representers(f, o, "none", 20.0, rounds).collect()
    expected = plain_resolution(features, options, "none", rounds)
    assert len(found) == len(expected)
    assert {(r["group"], r["feature"]): (r["key"], r["solution"], r["shift"], r["weight"], r["round"]) for r in found} == expected
    assert representers.assign_representers(f.limit(0), o.limit(0), "none", 20.0).collect() == []


def test_features_merge_only_where_their_matches_support_it(spark):
    f = spark.createDataFrame([(1, 1, 0.0, 5.0, 10.0), (1, 2, 4.0, 9.0, 20.0), (1, 3, 8.0, 12.0, 40.0)], "group long, feature long, start double, end double, signal double")
    assigned = spark.createDataFrame([(1, i, "k", "s", "none") for i in (1, 2, 3)], "group long, feature long, key string, solution string, shift string")
    matches = spark.createDataFrame([(1, 1, "k", "s", 8.0), (1, 1, "k", "t", 8.0), (1, 2, "k", "t", 9.0), (1, 3, "k", "s", 1.0), (1, 3, "q", "z", 7.0)], "group long, feature long, key string, solution string, score double")
    shares = {(r["feature"], r["solution"]): (round(r["share"], 4), r["place"]) for r in representers.representers(assigned, matches, 5.0).collect()}
    assert shares == {(1, "s"): (0.5, 1), (1, "t"): (0.5, 2), (2, "t"): (1.0, 1)}
    rows = sorted(map(tuple, representers.merged_features(f, assigned, matches, 5.0).collect()), key=repr)
    assert rows == [(1, "k", "s", 0.0, 9.0, 30.0, 2, True), (1, "q", "z", 8.0, 12.0, 40.0, 1, False)]


def test_window_models_equal_dense_fits(spark):
    rng = np.random.default_rng(3)
    n = 300
    t, g = rng.uniform(0, 100, n), rng.integers(0, 4, n)
    x = rng.normal(size=(n, 2))
    y = 5.0 * g + x @ [2.0, -1.0] * (1 + t / 100) + rng.normal(0, 0.01, n)
    y[:6] += 50  # these follow no model
    rows = [(i, int(g[i]), float(t[i]), float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, g long, t double, a double, b double, y double").repartition(3)
    columns = {"a": F.col("a"), "b": F.col("b")}
    model, out = windows.refitted(df, ["id"], ["g"], columns, F.col("y"), "t", 50.0, 25.0, penalty=0.5, cutoff=3.0, rounds=6)
    weight = np.ones(n)
    before = None
    for _ in range(6):
        total, near_sum = np.zeros(n), np.zeros(n)
        for centre in np.arange(-25, 126, 25.0):
            inside = np.abs(t - centre) <= 25
            use = inside & (weight > 0)
            if not use.any():
                continue
            known = sorted(set(g[use]))
            design = np.hstack([x, (g[:, None] == known).astype(float)])
            shrink = np.diag([0.5, 0.5] + [0.0] * len(known))
            m = design[use]
            beta = np.linalg.lstsq(m.T @ (m * weight[use, None]) + shrink, m.T @ (y[use] * weight[use]), rcond=None)[0]
            can = inside & np.isin(g, known)
            near = 1 - np.abs(t - centre) / (25 * windows.EDGE)
            total[can] += (design @ beta * near)[can]
            near_sum[can] += near[can]
        predicted = total / near_sum
        residual = y - predicted
        scale = np.sqrt((weight * residual**2).sum() / weight.sum())
        covered = np.abs(residual) <= 3 * scale
        if before is not None and (covered == before).all():
            break
        before = covered
        weight = np.where(covered, 1.0, 0.0)
    found = sorted(out.collect(), key=lambda r: r["id"])
    assert [r["predicted"] for r in found] == pytest.approx(predicted.tolist(), rel=1e-7)
    assert [r["covered"] for r in found] == covered.tolist() and not covered[:6].any()
    strange = spark.createDataFrame([(1, 77, 50.0, 1.0, 1.0), (2, 1, 9999.0, 1.0, 1.0)], "id long, g long, t double, a double, b double")
    assert [(r["predicted"], r["models"]) for r in model.predict(strange, ["id"], columns, "t").collect()] == [(None, 0), (None, 0)]


def test_product_kernels_equal_the_dense_form_and_tell_classes_apart(spark):
    rng = np.random.default_rng(5)
    true = rng.random(3000) < 0.5
    a, b = rng.normal(np.where(true, 4, 0), 1.0), rng.normal(np.where(true, 10, 3), 2.0)
    decoy = ~true & (rng.random(3000) < 0.5)
    guess = np.where(b > 6, 0.7, 0.3)
    df = spark.createDataFrame([(int(i), float(a[i]), float(b[i]), bool(decoy[i]), float(guess[i])) for i in range(3000)] + [(3000, None, 1.0, False, 0.5)], "i long, a double, b double, d boolean, p double").repartition(3)
    model = densities.product_kernels(df, ["a", "b"], F.col("d"), F.col("p"), grid=32)
    slots = np.stack([np.minimum(((v - v.min()) / ((v.max() - v.min()) / 32)).astype(int), 31) for v in (a, b)], axis=1)
    share, prior = guess.copy(), 0.5
    target = ~decoy
    for _ in range(50):
        parts = []
        for w in (np.where(target, share, 0.0), np.where(target, 1 - share, 1.0)):
            for j in (0, 1):
                mean = np.average(slots[:, j], weights=w)
                h = max(np.sqrt(np.average((slots[:, j] - mean) ** 2, weights=w)) * w.sum() ** -0.2, 0.5)
                density = np.array([(w * np.exp(-(((k - slots[:, j]) / h) ** 2) / 2)).sum() for k in range(32)])
                parts.append(density / density.sum())
        new = share[target].mean()
        good, bad = parts[0][slots[:, 0]] * parts[1][slots[:, 1]] * new, parts[2][slots[:, 0]] * parts[3][slots[:, 1]] * (1 - new)
        share = good / (good + bad)
        # all rows of a cell share one value, first guesses are means of a cell
        if abs(new - prior) < 1e-4:
            break
        prior = new
    found = {r["i"]: r["q"] for r in df.select("i", model.posterior().alias("q")).collect()}
    assert found.pop(3000) is None
    values = np.array([found[i] for i in range(3000)])
    assert np.abs(values - share).max() < 0.02  # guesses are averaged within cells
    assert ((values > 0.5) == true).mean() > 0.97
    assert densities.product_kernels(df.limit(0), ["a", "b"], F.col("d"), F.col("p")) is None
    with pytest.raises(ValueError):
        densities.product_kernels(df, ["a", "b", "p", "i"], F.col("d"), F.col("p"))


def test_margins_minimise_the_squared_hinge_in_a_session_with_components(spark):
    graph.components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).collect()
    rng = np.random.default_rng(8)
    n = 500
    y = np.where(rng.random(n) < 0.4, 1.0, -1.0)
    x = rng.normal(size=(n, 3)) + y[:, None] * [0.8, -0.5, 0.0]
    df = spark.createDataFrame([(*map(float, x[i]), float(y[i])) for i in range(n)], "a double, b double, c double, y double")
    w = rescoring.fit_margin(df, ["a", "b", "c"], "y", cost=2.0)

    def gradient(w):
        slack = np.maximum(0, 1 - y * (x @ w[:3] + w[3]))
        pull = -4 / n * (slack * y)
        return np.append(w[:3] + pull @ x, pull.sum())

    assert np.abs(gradient(w)).max() < 1e-6
    rows = df.withColumn("is_decoy", F.col("y") < 0).withColumn("id", F.monotonically_increasing_id())
    out = rescoring.semi_supervised(rows, ["a", "b", "c"], "is_decoy", "a", rounds=4, train_fdr=0.2).collect()
    score, decoy = np.array([r["svm_score"] for r in out]), np.array([r["is_decoy"] for r in out])
    better = (score[~decoy][:, None] > score[decoy]).mean()
    assert len(out) == n and better > (x[y > 0, 0][:, None] > x[y < 0, 0]).mean()
    few = rescoring.semi_supervised(rows.limit(5), ["a", "b", "c"], "is_decoy", "a").collect()
    assert all(r["svm_score"] == r["a"] for r in few)


def test_candidates_come_from_the_precursor_alone(spark):
    rng = random.Random(2)
    structures = [(f"s{i}", rng.uniform(900, 1100)) for i in range(60)]
    precursors = [(i, rng.uniform(900, 1120)) for i in range(40)] + [(98, None), (99, -3.0)]
    shifts = [("none", 0.0), ("nh4", 17.02655)]
    frames = [spark.createDataFrame(*x) for x in ((precursors, "scan long, precursor_mass double"), (structures, "structure string, structure_mass double"), (shifts, "shift string, shift_mass double"))]
    found = {(r["scan"], r["structure"]): r["shift"] for r in spectrum.precursor_candidates(frames[0], frames[1], 3e-3, frames[2]).collect()}
    expected = {}
    for scan, mass in precursors[:40]:
        for s, m in structures:
            near = [(abs(m - (mass - d)) / (mass - d), name) for name, d in shifts if abs(m - (mass - d)) <= (mass - d) * 3e-3]
            if near:
                expected[scan, s] = min(near)[1]
    assert found == expected and expected
    peaks = spark.createDataFrame([(i, 500.0 + k, 1.0) for i in range(40) for k in range(5)], "scan long, mass double, intensity double")
    fragments = spark.createDataFrame([(s, 500.0 + k + 0.004, k) for s, _ in structures for k in range(5)], "structure string, fragment_mass double, fragment int")
    pairs = spark.createDataFrame(list(expected), "scan long, structure string")
    matched = spectrum.match_candidates(peaks, fragments, pairs, 2e-5).collect()
    assert len(matched) == 5 * len(expected) and {(r["scan"], r["structure"]) for r in matched} == set(expected)
    assert all(round(r["mass"] - 500) == r["fragment"] for r in matched)


@pytest.mark.parametrize("rule,cells,value", [("X + 1 + abs(-2Z) * 5 = 36", {"X": 5, "Z": 3}, True), ("(2(x + 5)) + 5 = 15", {"x": 0}, True), ("(2(x + 5)) + 5 = 25", {"x": 5}, True), ("(2(x + 5)) + 5 = 25", {"x": 4}, False)])
def test_rules_have_their_stated_values(spark, rule, cells, value):
    df = spark.createDataFrame([(cells,)], "c map<string, int>")
    assert df.select(expressions.compile_rule(rule, expressions.in_map(F.col("c"))).alias("r")).first()["r"] is value
