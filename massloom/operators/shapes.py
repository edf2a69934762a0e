"""Peak shapes from sums: a Gaussian is a parabola in the logarithm, fitted by weighted least squares in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gaussian_shape(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """centre, sigma and points of each key; both null where there are fewer than three points, or no peak that they determine.

    That is where the determinant of the normal equations is a thousandth or less of the product of
    its diagonal, or the curvature of the logarithm is not below -0.001.

    Points weigh by their squared value, which is what a fit of the values themselves would do near
    the top. Times are taken relative to each key's weighted mean, so that sums stay small.
    """
    rows = df.filter(F.col(value) > 0)
    middle = rows.groupBy(*keys).agg((F.sum(F.col(at) * F.col(value)) / F.sum(value)).alias("__mid"))
    rows = rows.join(middle, keys)
    x, y, w = F.col(at) - F.col("__mid"), F.log(F.col(value)), F.pow(F.col(value), F.lit(2.0))
    powers = [F.sum(w * F.pow(x, F.lit(float(p)))).alias(f"s{p}") for p in range(5)]
    moments = [F.sum(w * y * F.pow(x, F.lit(float(p)))).alias(f"t{p}") for p in range(3)]
    s = rows.groupBy(*keys).agg(*powers, *moments, F.first("__mid").alias("__mid"), F.count("*").alias("points"))
    det = F.expr("s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)")
    b = F.expr("s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)")
    c = F.expr("s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)")
    s = s.withColumn("__b", F.try_divide(b, det)).withColumn("__c", F.try_divide(c, det))
    peak = (F.col("points") >= 3) & (det > 1e-3 * F.col("s0") * F.col("s2") * F.col("s4")) & (F.col("__c") < -1e-3)
    return s.select(*keys, F.when(peak, F.col("__mid") - F.col("__b") / (2 * F.col("__c"))).alias("centre"), F.when(peak, F.sqrt(-1 / (2 * F.col("__c")))).alias("sigma"), "points")
