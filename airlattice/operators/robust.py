"""Means and covariances of any number of columns, plain and robust, and the distances they give."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statistics import quantiles


def moments(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance, in one aggregate."""
    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((p, p))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    return np.array([row[f"m{i}"] for i in range(p)], float), cov


def distance(columns: list[str], mean: np.ndarray, cov: np.ndarray) -> Column:
    """Squared Mahalanobis distance, as an expression that stays in the JVM."""
    inverse = np.linalg.inv(cov)
    apart = [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(columns, mean, strict=True)]
    total = F.lit(0.0)
    for i, u in enumerate(apart):
        for j in range(i, len(apart)):
            total = total + F.lit(float(inverse[i, j] * (1 if i == j else 2))) * u * apart[j]
    return total


def concentrated(df: DataFrame, columns: list[str], share: float = 0.75, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the ``share`` of rows that lie closest together, so that the others can't draw them.

    It starts from medians and their absolute deviations; each round takes the exact quantile of the distances, and the
    moments of the rows within it, until they stay or ``rounds`` are over. A round is two aggregates over the table; the driver
    holds a matrix. Rows with a null or NaN in a column don't count.
    """
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    d = df.where(known).select(F.lit(1).alias("one"), *[F.col(c).cast("double").alias(c) for c in columns])

    def exact(x: Column, at: float) -> float:
        return quantiles(d.select("one", x.alias("x")), "one", "x", {"q": at}).first()["q"]

    mean = np.array([exact(F.col(c), 0.5) for c in columns])
    cov = np.diag([(1.4826 * exact(F.abs(F.col(c) - float(m)), 0.5)) ** 2 for c, m in zip(columns, mean, strict=True)])
    for _ in range(rounds):
        near = distance(columns, mean, cov)
        new = moments(d.where(near <= exact(near, share)), columns)
        if all(np.array_equal(a, b) for a, b in zip(new, (mean, cov), strict=True)):
            break
        mean, cov = new
    return mean, cov


def group_distance(df: DataFrame, group: str, reference, columns: list[str]) -> DataFrame:
    """(group, n, distance): of each group's mean from that of the reference group, in the reference group's covariance."""
    mean, cov = moments(df.where(F.col(group).eqNullSafe(F.lit(reference))), columns)
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])
    return g.select(group, "n", F.sqrt(F.greatest(distance(columns, mean, cov), F.lit(0.0))).alias("distance"))
