"""Peak shapes fitted to the points of each feature by damped least squares.

A feature's points are a task's group, many features to a call; a fit is a few dozen numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.session import shuffle_width

_ERF = np.vectorize(math.erf, otypes=[float])


def gaussian(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    s = p[2] or 1e-3
    return p[1] / (s * math.sqrt(2 * math.pi)) * np.exp(-((x - p[0]) ** 2) / (2 * s * s))


def skewed(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    s = p[2] or 1e-3
    return gaussian(x, p[:3]) * (1 + _ERF(p[3] * (x - p[0]) / (s * math.sqrt(2))))


def two_sided(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    s = np.where(x < p[0], p[2] or 1e-3, p[3] or 1e-3)
    return p[1] / math.sqrt(2 * math.pi) * np.exp(-((x - p[0]) ** 2) / (2 * s * s))


def _penalty(kind: str, x: np.ndarray, p: np.ndarray) -> float:
    out = 1.0
    if kind in ("skewed", "penalised") and abs(p[2]) > 2:
        out *= p[2] / 2
    if kind == "penalised" and abs(p[3]) > 40:
        out *= p[3] / 2
    if kind in ("penalised", "two_sided") and not x[0] <= p[0] <= x[-1]:
        out *= p[0]
    return out


SHAPES = {"gaussian": gaussian, "skewed": skewed, "penalised": skewed, "two_sided": two_sided}
PARAMETERS = {"gaussian": 3, "skewed": 4, "penalised": 4, "two_sided": 4}


def first_guess(x: np.ndarray, y: np.ndarray, kind: str, centre: float | None = None) -> np.ndarray:
    """The centre, weighted unless given, the height there, and the distances to where the signal is half of it."""
    centre = float(np.average(x, weights=y)) if centre is None else centre
    at = int(np.abs(x - centre).argmin())
    left = next((i for i in range(at, -1, -1) if y[i] <= y[at] / 2), 0)
    right = next((i for i in range(at + 1, len(x)) if y[i] <= y[at] / 2), len(x) - 1)
    sigma = float(abs(centre - x[left]) + abs(centre - x[right])) or 1e-2
    return np.array({"gaussian": [centre, y[at], sigma], "two_sided": [centre, y[at], sigma, sigma]}.get(kind, [centre, y[at], sigma, 1.0]), float)


def fit(x: np.ndarray, y: np.ndarray, kind: str, centre: float | None = None, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(parameters, fitted values) by damped least squares from the first guess."""
    p = first_guess(x, y, kind, centre)
    error = lambda q: y - SHAPES[kind](x, q) * _penalty(kind, x, q)
    r, damp = error(p), 1e-2
    for _ in range(rounds):
        step = 1e-6 * np.maximum(np.abs(p), 1e-3)
        jacobian = np.array([(error(p + d) - r) / s for d, s in zip(np.diag(step), step, strict=True)]).T
        square = jacobian.T @ jacobian
        move = np.linalg.lstsq(square + damp * np.diag(np.maximum(np.diag(square), 1e-12)), -jacobian.T @ r, rcond=None)[0]
        new = error(p + move)
        if np.isfinite(new).all() and new @ new < r @ r:
            small = r @ r - new @ new < 1e-12 * max(r @ r, 1e-300)
            p, r, damp = p + move, new, max(damp / 5, 1e-9)
            if small:
                break
        elif damp > 1e9:
            break
        else:
            damp *= 5
    if kind == "two_sided":
        p[2:] = np.abs(p[2:])  # the sign of a width says nothing
    return p, SHAPES[kind](x, p)


def line_score(y: np.ndarray, fitted: np.ndarray) -> float:
    """1 less the squared error over that of a flat line at half height."""
    flat = ((y - (y.max() + y.min()) / 2) ** 2).sum()
    return float(1 - ((y - fitted) ** 2).sum() / flat) if flat > 0 else 0.0


def split_at_minima(y: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of points between the deepest minima that lie between two maxima, at most ``most`` cuts."""
    inner = np.arange(1, len(y) - 1)
    tops = inner[(y[inner] > y[inner - 1]) & (y[inner] >= y[inner + 1])]
    cuts = [int(a + np.argmin(y[a : b + 1])) for a, b in zip(tops, tops[1:], strict=False)]
    cuts = sorted(sorted(cuts, key=lambda i: y[i])[:most])
    edges = [0, *cuts, len(y) - 1]
    return [(a, b + 1) for a, b in zip(edges, edges[1:], strict=False)]


def _around(y: np.ndarray) -> slice:
    """The highest point and what lies to either side of it down to a tenth of its height, or to where it rises again; five points at least."""
    top = int(y.argmax())
    low, high = top, top
    while low > 0 and (top - low < 2 or y[low - 1] > y[top] / 10 and y[low - 1] <= y[low]):
        low -= 1
    while high < len(y) - 1 and (high - top < 2 or y[high + 1] > y[top] / 10 and y[high + 1] <= y[high]):
        high += 1
    while high - low < 4 and (low > 0 or high < len(y) - 1):
        low, high = max(0, low - 1), min(len(y) - 1, high + 1)
    return slice(low, high + 1)


def fit_feature(x: np.ndarray, y: np.ndarray, kind: str, most: int) -> tuple[list[tuple[str, np.ndarray]], float]:
    """([(shape, parameters)], line score) of one feature.

    ``kind`` is a shape; ``peeled``, where peaks are fitted and taken away until nothing is left that
    stands out, at most ``most``; ``split``, where each part between minima is fitted; or ``best``,
    whichever of these and the single shapes scores highest.
    """
    if kind in SHAPES:
        if len(x) < PARAMETERS[kind] + 1:
            return [], 0.0
        p, fitted = fit(x, y, kind)
        return [(kind, p)], line_score(y, fitted)
    if kind == "peeled":
        rest, parts, total = y.copy(), [], np.zeros(len(y))
        while len(parts) < most and len(x) >= 5 and rest.max() > 0.05 * y.max():
            # From the highest point, and by what lies around it, so that two peaks are not taken for one.
            near = _around(rest)
            p, _ = fit(x[near], np.maximum(rest[near], 0), "two_sided", float(x[rest.argmax()]))
            fitted = two_sided(x, p)
            if line_score(y, total + fitted) <= line_score(y, total) and parts:
                break
            parts.append(("two_sided", p))
            total, rest = total + fitted, rest - fitted
        return parts, line_score(y, total)
    if kind == "split":
        parts, total = [], np.zeros(len(y))
        for a, b in split_at_minima(y, most):
            if b - a >= 5:
                p, fitted = fit(x[a:b], y[a:b], "two_sided")
                parts.append(("two_sided", p))
                total[a:b] = np.maximum(total[a:b], fitted)
            else:
                total[a:b] = np.maximum(total[a:b], y[a:b].mean())
        return parts, line_score(y, total)
    tried = [fit_feature(x, y, k, most) for k in ("penalised", "two_sided", "peeled", "split")]
    return max(tried, key=lambda t: t[1])


def fitted_shapes(df: DataFrame, keys: list[str], at: str, value: str, kind: str = "best", most: int = 3) -> DataFrame:
    """keys, line_score, peaks and shapes, an array of (shape, centre, amplitude, sigma, second), for each feature.

    Points without signal are left out, and points at one time are added up; too few points give no
    shapes and the score 0.
    """
    points = df.filter((F.col(value) > 0) & F.col(at).isNotNull()).groupBy(*keys, F.col(at).cast("double").alias("__x")).agg(F.sum(value).cast("double").alias("__y"))
    series = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__x", "__y"))).alias("__s"))  # one feature's points
    series = series.withColumn("__x", F.transform("__s", lambda p: p["__x"])).withColumn("__y", F.transform("__s", lambda p: p["__y"])).drop("__s")
    schema = ", ".join(f"`{c}` {t}" for c, t in series.dtypes if c in keys) + ", line_score double, peaks int, shapes array<struct<shape: string, centre: double, amplitude: double, sigma: double, second: double>>"

    def run(frames):
        for frame in frames:
            scores, found = [], []
            for x, y in zip(frame["__x"], frame["__y"], strict=True):
                parts, score = fit_feature(np.asarray(x, float), np.asarray(y, float), kind, most)
                scores.append(score)
                found.append([{"shape": k, "centre": p[0], "amplitude": p[1], "sigma": p[2], "second": p[3] if len(p) > 3 else None} for k, p in parts])
            yield pd.DataFrame({**{k: frame[k] for k in keys}, "line_score": scores, "peaks": np.array([len(f) for f in found], np.int32), "shapes": found})

    return series.repartition(4 * shuffle_width(df.sparkSession)).mapInPandas(run, schema)


def fixed_gaussian(df: DataFrame, keys: list[str], at: str, value: str, centre: str, sigma: str) -> DataFrame:
    """keys and amplitude: the best height of a Gaussian whose centre and width are given, in closed form."""
    g = F.exp(-F.pow((F.col(at) - F.col(centre)) / F.col(sigma), F.lit(2.0)) / 2) / (F.col(sigma) * math.sqrt(2 * math.pi))
    return df.withColumn("__g", g).groupBy(*keys).agg((F.sum(F.col("__g") * F.col(value)) / F.sum(F.col("__g") * F.col("__g"))).alias("amplitude"))
