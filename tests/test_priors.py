"""Prior shares and neighbourhood means, against plain definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.operators import priors, sites


def plain_shares(observed, prior):
    o = np.maximum(np.nan_to_num(np.array(observed, dtype=float)), 0)
    a = np.full(len(o), prior)
    p = a / a.sum()
    if not o.any():
        return p
    for _ in range(200_000):
        new = (a + o * p / (o * p).sum()) / (1 + a.sum())
        if np.abs(new - p).max() < 1e-15:
            break
        p = new
    return p


def test_shares_are_the_fixed_point_of_the_updates(spark):
    rng = np.random.default_rng(4)
    cases = {
        "mixed": [5.0, 3.0, 0.0, None, 2.5, -1.0], "ties": [4.0] * 6 + [1.0], "alone": [2.0], "nothing": [0.0, None],
        "many": rng.gamma(2.0, 10.0, 60).tolist(),
    }
    rows = [(site, i, o) for site, values in cases.items() for i, o in enumerate(values)]
    df = spark.createDataFrame(rows, "site string, id int, observed double").withColumn("top", F.lit(1))
    for prior in (0.01, 0.5):
        found = {}
        result = priors.composition_shares(df, ["site"], prior=prior)
        assert result.columns == [*df.columns, "share"]
        for r in result.collect():
            found.setdefault(r["site"], {})[r["id"]] = r["share"]
        for site, values in cases.items():
            got = np.array([found[site][i] for i in range(len(values))])
            assert got == pytest.approx(plain_shares(values, prior), rel=1e-6, abs=1e-9), site
            assert got.sum() == pytest.approx(1.0)
    assert priors.composition_shares(df.limit(0), ["site"]).collect() == []
    with pytest.raises(ValueError):
        priors.composition_shares(df, ["site"], prior=0.0)


def test_membership_sums(spark):
    rng = np.random.default_rng(8)
    matrix = np.where(rng.random((9, 4)) < 0.6, rng.random((9, 4)), 0.0)
    matrix[:, 3] = 0
    matrix[2] = 0
    df = spark.createDataFrame([(i, j, float(matrix[i, j])) for i in range(9) for j in range(4)], "id int, neighbourhood int, weight double")

    def dense(how, scale=1.0):
        out = np.zeros((9, 4))
        for r in priors.normalised_membership(df, how, scale).collect():
            out[r["id"], r["neighbourhood"]] = r["weight"]
        return out

    columns = np.divide(matrix, matrix.sum(0), out=np.zeros_like(matrix), where=matrix.sum(0) > 0)
    rows = lambda m: m / np.where(m.sum(1) == 0, 1e-6, m.sum(1))[:, None]
    assert np.allclose(dense("none"), matrix) and np.allclose(dense("col", 2.0), 2 * columns)
    assert np.allclose(dense("row"), rows(matrix)) and np.allclose(dense("colrow"), rows(columns))
    with pytest.raises(ValueError):
        priors.normalised_membership(df, "rowcol")


def test_sites_are_drawn_towards_their_neighbourhoods(spark):
    n, strength, regularize = 12, 0.4, 1.0
    rng = np.random.default_rng(3)
    scores = [float(v) if i % 3 else None for i, v in enumerate(rng.gamma(3.0, 3.0, n))]
    links = [(i, i + 1, 1.0) for i in range(n - 1)] + [(0, 7, 0.5), (3, 11, 2.0)]
    belongs = np.zeros((n, 2))
    belongs[:7, 0], belongs[5:, 1] = 0.8, 0.6
    nodes = spark.createDataFrame([("s", i, v) for i, v in enumerate(scores)], "site string, id int, observed double")
    edges = spark.createDataFrame([("s", *e) for e in links], "site string, a int, b int, weight double")
    members = spark.createDataFrame([(i, j, float(belongs[i, j])) for i in range(n) for j in range(2) if belongs[i, j]], "id int, neighbourhood int, weight double")
    found = sites.smooth_sites(priors.with_membership(nodes, members, [0, 1]), edges, "site", [strength], [0.0], regularize).orderBy("id").collect()

    full = regularize * np.eye(n)
    for a, b, w in links:
        full[[a, b], [a, b]] += w
        full[[a, b], [b, a]] -= w
    seen = np.array([v is not None for v in scores])
    s = np.array([v or 0.0 for v in scores])
    covariance = np.linalg.inv(full)[np.ix_(seen, seen)] / strength + np.eye(seen.sum())
    inverse = np.linalg.inv(covariance)
    tau = np.linalg.inv(np.eye(2) + belongs[seen].T @ inverse @ belongs[seen]) @ belongs[seen].T @ inverse @ s[seen]
    means = belongs @ tau
    expected = np.linalg.solve(np.diag(seen.astype(float)) + strength * full, s * seen + strength * full @ means)
    assert [r["smooth"] for r in found] == pytest.approx(list(expected), rel=1e-9)
    plain = sites.smooth_sites(nodes, edges, "site", [strength], [0.0], regularize).orderBy("id").collect()
    assert sum(r["smooth"] for r in found) > sum(r["smooth"] for r in plain)  # without means scores are drawn towards zero
