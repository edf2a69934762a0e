"""Regressions from sums: rows are reduced to normal equations in parallel, and only these are solved."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line per key."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"))


def weighted_line_fit(df: DataFrame, keys: list[str], x: Column, y: Column, w: Column, penalty: float = 0.0) -> DataFrame:
    """Weighted line per key; ``penalty`` is added to the diagonal (ridge)."""
    sums = df.groupBy(*keys).agg(F.sum(w).alias("w"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"), F.sum(w * x * y).alias("xy"), F.count("*").alias("n"))
    a, b, d = F.col("w") + penalty, F.col("x"), F.col("xx") + penalty
    det = a * d - b * b
    return sums.select(*keys, ((a * F.col("xy") - b * F.col("y")) / F.nullif(det, F.lit(0.0))).alias("slope"), ((d * F.col("y") - b * F.col("xy")) / F.nullif(det, F.lit(0.0))).alias("intercept"), "n")


@dataclass
class LinearModel:
    names: list[str]
    parameters: np.ndarray
    inverse: np.ndarray
    residual_variance: float
    rows: int

    def predict(self, columns: dict[str, Column]) -> Column:
        out = F.lit(float(self.parameters[0]))
        for name, value in zip(self.names, self.parameters[1:], strict=True):
            out = out + columns[name] * float(value)
        return out

    def interval(self, columns: dict[str, Column], quantile: float) -> Column:
        """Half width of the prediction interval at ``quantile`` standard errors."""
        terms = [F.lit(1.0), *(columns[n] for n in self.names)]
        spread = F.lit(1.0)
        for i, a in enumerate(terms):
            for j, b in enumerate(terms):
                spread = spread + a * b * float(self.inverse[i, j])
        return quantile * F.sqrt(F.lit(self.residual_variance) * spread)


def fit_linear(df: DataFrame, columns: dict[str, Column], y: Column, weight: Column | None = None, penalty: float = 0.0) -> LinearModel:
    """Weighted least squares on any number of columns; one row of sums reaches the driver."""
    w = weight if weight is not None else F.lit(1.0)
    terms = [F.lit(1.0), *columns.values()]
    sums = [F.sum(w * a * b) for i, a in enumerate(terms) for b in terms[i:]] + [F.sum(w * a * y) for a in terms] + [F.sum(w * y * y), F.count("*")]
    row = list(df.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first())
    row = [0.0 if v is None else float(v) for v in row]
    k = len(terms)
    xx = np.zeros((k, k))
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    for (i, j), v in zip(upper, row, strict=False):
        xx[i, j] = xx[j, i] = v
    xy = np.array(row[len(upper) : len(upper) + k])
    yy, n = row[-2], int(row[-1])
    inverse = np.linalg.pinv(xx + penalty * np.eye(k))
    beta = inverse @ xy
    rss = max(0.0, yy - 2 * beta @ xy + beta @ xx @ beta)
    return LinearModel(list(columns), beta, inverse, rss / max(1, n - k), n)
