"""Network models of sites: exact smoothing by blocks of the Laplacian, choice of its strength, and priors from fitted models.

A site's network is as large as its list of compositions and is solved in one task, component by
component and each in blocks of neighbouring nodes; sites are spread over tasks.
``smooth.laplacian_smooth`` is the form for one large network.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.operators import strings


def weighted_laplacian(edges: DataFrame) -> DataFrame:
    """(row, column, value) of degree less weight, for undirected edges (a, b, weight)."""
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    off = both.groupBy(F.col("a").alias("row"), F.col("b").alias("column")).agg((-F.sum("weight")).alias("value"))
    diagonal = both.groupBy(F.col("a").alias("row")).agg(F.sum("weight").alias("value")).select("row", F.col("row").alias("column"), "value")
    return off.unionByName(diagonal)


def block_smooth(laplacian: np.ndarray, observed: np.ndarray, strength: float, regularize: float) -> tuple[np.ndarray, float]:
    """(scores of all nodes, mean squared leave-one-out error) for observed scores, NaN where there are none.

    The missing nodes are eliminated by the Schur complement, the observed ones solved, and the
    missing ones read off.
    """
    matrix = laplacian + regularize * np.eye(len(laplacian))
    seen = ~np.isnan(observed)
    if not seen.any():
        return np.zeros(len(observed)), 0.0
    oo, om, mm = matrix[np.ix_(seen, seen)], matrix[np.ix_(seen, ~seen)], matrix[np.ix_(~seen, ~seen)]
    inner = np.linalg.solve(mm, om.T) if (~seen).any() else np.zeros((0, seen.sum()))
    hat = np.linalg.inv(np.eye(seen.sum()) + strength * (oo - om @ inner))
    fitted = hat @ observed[seen]
    press = float(np.mean(((observed[seen] - fitted) / np.maximum(1 - np.diag(hat), 1e-12)) ** 2))
    out = np.empty(len(observed))
    out[seen], out[~seen] = fitted, -inner @ fitted
    return out, press


def neighbourhood_means(laplacian: np.ndarray, observed: np.ndarray, belongs: np.ndarray, strength: float, regularize: float, noise: float = 1.0) -> np.ndarray:
    """tau: the mean of each neighbourhood, given observed scores and how far each node belongs to it.

    Observed scores vary with ``noise``, with the network's own covariance over ``strength`` and with
    means of unit variance; tau is its expectation given the scores.
    """
    matrix = laplacian + regularize * np.eye(len(laplacian))
    seen = ~np.isnan(observed)
    if not seen.any():
        return np.zeros(belongs.shape[1])
    om = matrix[np.ix_(seen, ~seen)]
    schur = matrix[np.ix_(seen, seen)] - om @ (np.linalg.solve(matrix[np.ix_(~seen, ~seen)], om.T) if (~seen).any() else np.zeros((0, seen.sum())))
    of_seen = belongs[seen]
    spread = noise * np.eye(seen.sum()) + np.linalg.pinv(schur) / strength + of_seen @ of_seen.T
    return of_seen.T @ np.linalg.solve(spread, observed[seen])


SMALL = 32  # components up to this size are solved many at a time


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each node the least node of its component."""
    label = np.arange(n)
    while True:
        least, new = np.minimum(label[a], label[b]), label.copy()
        for side in (a, b):
            np.minimum.at(new, side, least)
            np.minimum.at(new, label[side], least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _breadth_first(n: int, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """The levels of a connected network from a node far out, so that edges lie within a level or join neighbouring ones."""
    ends, other = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(ends, kind="stable")
    other, starts = other[order], np.searchsorted(ends[order], np.arange(n + 1))

    def levels(root: int) -> list[np.ndarray]:
        met = np.zeros(n, dtype=bool)
        met[root] = True
        found = [np.array([root])]
        while True:
            near = np.unique(np.concatenate([other[starts[i] : starts[i + 1]] for i in found[-1]]))
            near = near[~met[near]]
            if not len(near):
                return found
            met[near] = True
            found.append(near)

    return levels(int(levels(0)[-1][0]))


def _solve_connected(a: np.ndarray, b: np.ndarray, w: np.ndarray, diagonal: np.ndarray, right: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(solution, diagonal of the inverse) of a connected network's matrix, by elimination from level to level."""
    levels = _breadth_first(len(diagonal), a, b)
    sizes = np.array([len(level) for level in levels])
    if (sizes * sizes).sum() + (sizes[1:] * sizes[:-1]).sum() > most * most:
        raise ValueError(f"a component of {len(diagonal)} compositions is too dense: its blocks hold more than {most} x {most} numbers")
    level_of, place = np.empty(len(diagonal), dtype=int), np.empty(len(diagonal), dtype=int)
    for k, level in enumerate(levels):
        level_of[level], place[level] = k, np.arange(len(level))
    blocks = [np.diag(diagonal[level]) for level in levels]
    across = [np.zeros((m, n)) for m, n in zip(sizes[:-1], sizes[1:], strict=True)]
    for i, j, v in zip(a, b, w, strict=True):
        if level_of[i] == level_of[j]:
            blocks[level_of[i]][place[i], place[j]] -= v
            blocks[level_of[i]][place[j], place[i]] -= v
        else:
            i, j = (i, j) if level_of[i] < level_of[j] else (j, i)  # noqa: PLW2901
            across[level_of[i]][place[i], place[j]] -= v
    inverses, carried, z = [np.linalg.inv(blocks[0])], [], [right[levels[0]]]
    for k, e in enumerate(across):
        g = inverses[k] @ e
        carried.append(g)
        z.append(right[levels[k + 1]] - g.T @ z[k])
        inverses.append(np.linalg.inv(blocks[k + 1] - e.T @ g))
    x, inverse = np.empty_like(right), np.empty(len(diagonal))
    last = len(levels) - 1
    own = inverses[last]
    x[levels[last]], inverse[levels[last]] = own @ z[last], np.diag(own)
    for k in range(last - 1, -1, -1):
        own = inverses[k] + carried[k] @ own @ carried[k].T
        x[levels[k]] = inverses[k] @ z[k] - carried[k] @ x[levels[k + 1]]
        inverse[levels[k]] = np.diag(own)
    return x, inverse


def network_solve(a: np.ndarray, b: np.ndarray, w: np.ndarray, diagonal: np.ndarray, right: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(solution for the columns ``right``, diagonal of the inverse) of the matrix with ``diagonal`` and -w at the edges (a, b).

    Components are solved by themselves; ones with ``right`` of zeros alone keep zeros.
    """
    n = len(diagonal)
    label = _labels(n, a, b)
    order = np.argsort(label, kind="stable")
    roots, starts, sizes = np.unique(label[order], return_index=True, return_counts=True)
    place = np.empty(n, dtype=int)
    place[order] = np.arange(n) - np.repeat(starts, sizes)
    component = np.searchsorted(roots, label)
    asked = np.zeros(len(roots), dtype=bool)
    np.logical_or.at(asked, component, (right != 0).any(axis=1))
    x, inverse, own = np.zeros_like(right), np.zeros(n), component[a]
    for size in np.unique(sizes[asked]):
        chosen = np.flatnonzero(asked & (sizes == size))
        of_size = np.flatnonzero(np.isin(own, chosen))
        if size <= SMALL:
            nodes = order[starts[chosen][:, None] + np.arange(size)]
            matrix = np.zeros((len(chosen), size, size))
            matrix[:, np.arange(size), np.arange(size)] = diagonal[nodes]
            at, i, j = np.searchsorted(chosen, own[of_size]), place[a[of_size]], place[b[of_size]]
            np.subtract.at(matrix, (at, i, j), w[of_size])
            np.subtract.at(matrix, (at, j, i), w[of_size])
            inverted = np.linalg.inv(matrix)
            x[nodes] = inverted @ right[nodes]
            inverse[nodes] = inverted[:, np.arange(size), np.arange(size)]
        else:
            for c in chosen:
                nodes, edges = order[starts[c] : starts[c] + size], of_size[own[of_size] == c]
                x[nodes], inverse[nodes] = _solve_connected(place[a[edges]], place[b[edges]], w[edges], diagonal[nodes], right[nodes], most)
    return x, inverse


def network_smooth(a: np.ndarray, b: np.ndarray, w: np.ndarray, observed: np.ndarray, strength: float, regularize: float, belongs: np.ndarray | None = None, most: int = 4000) -> tuple[np.ndarray, float]:
    """``block_smooth`` of a network given by its edges; with ``belongs``, of what is left over ``neighbourhood_means``, which are added again.

    The matrix is strength * (Laplacian + regularize) plus 1 where a score is observed: eliminating the
    missing nodes from it gives the blocks of ``block_smooth``. The covariance of
    ``neighbourhood_means`` is inverted by the same matrix, so one solution serves both.
    """
    n, seen = len(observed), ~np.isnan(observed)
    if not seen.any():
        return np.zeros(n), 0.0
    degree = np.bincount(a, w, n) + np.bincount(b, w, n)
    y = np.where(seen, observed, 0.0)
    columns = [y[:, None]] if belongs is None else [y[:, None], np.where(seen[:, None], belongs, 0.0)]
    x, inverse = network_solve(a, b, strength * w, seen + strength * (degree + regularize), np.hstack(columns), most)
    values, shift = x[:, 0], np.zeros(n)
    if belongs is not None:
        of_seen = columns[1]
        left = lambda v, solved: v - np.where(seen[:, None], solved, 0.0)
        tau = np.linalg.solve(np.eye(belongs.shape[1]) + of_seen.T @ left(of_seen, x[:, 1:]), of_seen.T @ left(y[:, None], x[:, :1]))[:, 0]
        shift = belongs @ tau
        values = values - x[:, 1:] @ tau
    press = float(np.mean((((observed - shift)[seen] - values[seen]) / np.maximum(1 - inverse[seen], 1e-12)) ** 2))
    return values + shift, press


def smooth_sites(nodes: DataFrame, edges: DataFrame, site: str, strengths: list[float], thresholds: list[float], regularize: float = 1.0, most: int = 4000) -> DataFrame:
    """(site, strength, threshold, press, id, smooth): each site's scores at every strength and every threshold below which a score counts as not observed.

    ``nodes`` holds (site, id, observed), ``edges`` (site, a, b, weight); each combination of site,
    strength and threshold is a task's group of its own. A site may have any number of compositions; only
    a connected network so dense that its blocks hold more than ``most`` x ``most`` numbers is an error,
    rather than a task that outgrows its memory.

    Where ``nodes`` also holds ``belongs`` (``priors.with_membership``), scores are drawn towards the
    means of their neighbourhoods instead of zero: the means are estimated from the observed scores,
    taken away before smoothing and added again.
    """
    grid = F.explode(F.array(*(F.struct(F.lit(float(s)).alias("strength"), F.lit(float(t)).alias("threshold")) for s in strengths for t in thresholds)))
    spread = lambda df: df.withColumn("__g", grid).select(*df.columns, "__g.*")
    keys = [site, "strength", "threshold"]
    by_neighbourhood = "belongs" in nodes.columns

    def run(key: tuple, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(own["id"].unique())
        places = {c: np.minimum(np.searchsorted(ids, links[c].to_numpy()), max(len(ids) - 1, 0)) for c in ("a", "b")}
        inside = (links["a"] != links["b"]).to_numpy()
        for c in ("a", "b"):
            inside = inside & (ids[places[c]] == links[c].to_numpy()) if len(ids) else inside & False
        a, b, w = places["a"][inside], places["b"][inside], links["weight"].to_numpy(dtype=float)[inside]
        observed = own.groupby("id")["observed"].max().reindex(ids).to_numpy(dtype=float)
        observed[~(observed >= key[2])] = np.nan
        belongs = None
        if by_neighbourhood and len(ids):
            belongs = np.stack(own.drop_duplicates("id").set_index("id")["belongs"].reindex(ids).to_list()).astype(float)
        values, press = network_smooth(a, b, w, observed, key[1], regularize, belongs, most)
        return pd.DataFrame({site: [key[0]] * len(ids), "strength": key[1], "threshold": key[2], "press": press, "id": ids, "smooth": values})

    types = dict(nodes.dtypes)
    schema = f"`{site}` {types[site]}, strength double, threshold double, press double, id {types['id']}, smooth double"
    links = spread(edges)
    links = links.select(*(F.col(c).alias(c) for c in links.columns))  # columns of their own, as both may come from one table
    return spread(nodes).groupBy(*keys).cogroup(links.groupBy(*keys)).applyInPandas(run, schema)


def best_models(smoothed: DataFrame, site: str) -> DataFrame:
    """Of each site the rows of the strength and threshold with the least leave-one-out error; the smaller ones of equals."""
    best = smoothed.groupBy(site).agg(F.min(F.struct("press", "strength", "threshold")).alias("b")).select(site, "b.strength", "b.threshold")
    return smoothed.join(best, [site, "strength", "threshold"], "left_semi")


def averaged_models(smoothed: DataFrame, site: str, share: float = 0.95) -> DataFrame:
    """(site, id, smooth): solutions whose error is within 1 / ``share`` of the least, averaged by the inverse of their error."""
    least = smoothed.groupBy(site).agg(F.min("press").alias("__least"))
    near = smoothed.join(least, site).filter(F.col("press") * share <= F.col("__least") + 1e-12)
    w = 1 / (F.col("press") + 1e-12)
    return near.groupBy(site, "id").agg((F.sum(F.col("smooth") * w) / F.sum(w)).alias("smooth"))


def site_priors(rows: DataFrame, models: DataFrame, on: list[str], default: float = 0.0) -> DataFrame:
    """``rows`` with ``prior``, the model's score at their site and composition."""
    return rows.join(models.select(*on, F.col("score").alias("prior")), on, "left").withColumn("prior", F.coalesce("prior", F.lit(default)))


def target_or_decoy_priors(rows: DataFrame, targets: DataFrame, decoys: DataFrame, on: list[str], is_decoy: str) -> DataFrame:
    """As ``site_priors``, each row by the model of its kind."""
    both = targets.withColumn(is_decoy, F.lit(False)).unionByName(decoys.withColumn(is_decoy, F.lit(True)))
    return site_priors(rows, both, [*on, is_decoy])


def priors_by_substring(peptides: DataFrame, proteins: DataFrame, models: DataFrame, seed: int = 6) -> DataFrame:
    """(peptide, composition, prior): the best score of any protein that a peptide stands in; ``models`` holds (protein, composition, score)."""
    found = strings.contained_in(peptides, proteins, "peptide", "sequence", seed).select("peptide", "composition", "protein").distinct()
    return found.join(models, ["protein", "composition"]).groupBy("peptide", "composition").agg(F.max("score").alias("prior"))
