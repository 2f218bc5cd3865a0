"""Density scores of embeddings: fitted on aggregates of the training rows, scored row by row in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import scratch


def moments(train: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sum and sum of outer products, added up in each partition and then by entry: one covariance reaches the driver."""

    def partial(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[column].to_numpy()).astype(float)
                part = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

    found = train.select(column).mapInPandas(partial, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")["v"].to_numpy()
    if not len(found):
        return 0, np.zeros(0), np.zeros((0, 0))
    d = int(round((-1 + np.sqrt(1 + 4 * (len(found) - 1))) / 2))
    return int(found[0]), found[1 : d + 1], found[d + 1 :].reshape(d, d)


def fit(train: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and inverse covariance; jitter grows until the covariance is positive."""
    n, s, ss = moments(train, column)
    mean = s / n
    cov = (ss - n * np.outer(mean, mean)) / max(1, n - 1)
    for jitter in (0, *(10.0**k for k in range(-15, 0))):
        try:
            low = np.linalg.cholesky(cov + jitter * np.eye(len(cov)))
        except np.linalg.LinAlgError:
            continue
        half = np.linalg.inv(low)
        return mean, half.T @ half
    raise ValueError("the covariance is not positive")


def mahalanobis(df: DataFrame, column: str, model: tuple[np.ndarray, np.ndarray], out: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)  # one mean and one matrix

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        mean, inverse = shared.value
        x = np.stack(v.to_numpy()).astype(float) - mean if len(v) else np.zeros((0, len(mean)))
        return pd.Series(np.sqrt(np.maximum(0, np.einsum("ij,jk,ik->i", x, inverse, x))))

    return df.withColumn(out, score(column))


def scaled(df: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """`column` to [0, 1] by the range of the training scores."""
    lo, hi = train.agg(F.min(column), F.max(column)).first()
    return df.withColumn(column, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.col(column) - F.lit(lo), F.lit(hi) - F.lit(lo)))))


def minimum_covariance(x: np.ndarray, support: float = 0.9, starts: int = 20, steps: int = 10, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """FastMCD: mean and covariance of the `support` share of rows with the smallest determinant found by concentration steps."""
    rng, n = np.random.default_rng(seed), len(x)
    h, best = max(2, int(support * n)), (np.inf, None, None)
    for _ in range(starts):
        rows = rng.choice(n, min(n, x.shape[1] + 1), replace=False)
        for _ in range(steps):
            mean, cov = x[rows].mean(axis=0), np.cov(x[rows].T).reshape(x.shape[1], -1) + 1e-9 * np.eye(x.shape[1])
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            rows = np.argsort(d, kind="stable")[:h]
        value = np.linalg.slogdet(np.cov(x[rows].T).reshape(x.shape[1], -1) + 1e-9 * np.eye(x.shape[1]))[1]
        if value < best[0]:
            best = (value, x[rows].mean(axis=0), np.cov(x[rows].T).reshape(x.shape[1], -1))
    return best[1], best[2] + 1e-9 * np.eye(x.shape[1])


#: The kernel map is spanned by this many training rows at most, the first by hash of their id: a basis, not the rows that are learned from.
LANDMARKS = 512


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gaussian kernel of each row of `a` with each of `b`, of width by the number of columns."""
    return np.exp(-np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T) / b.shape[1])


def _projected(df: DataFrame, column: str, marks: np.ndarray, weights: np.ndarray, offset: np.ndarray, out: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((marks, weights, offset))  # LANDMARKS rows

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        marks, weights, offset = shared.value
        if not len(v):
            return pd.Series([], dtype=object)
        return pd.Series(list(_kernel(np.stack(v.to_numpy()).astype(float), marks) @ weights - offset))

    return df.withColumn(out, project(column))


def _concentrated(rows: DataFrame, column: str, mean: np.ndarray, cov: np.ndarray, support: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Concentration steps over all rows: moments of the nearest `support` share, while their determinant falls. Sums only reach the driver."""
    level = np.inf
    for _ in range(steps):
        near = mahalanobis(rows, column, (mean, np.linalg.inv(cov)), "__d")
        cut = near.agg(F.percentile_approx("__d", support, 10000)).first()[0]
        n, s, ss = moments(near.where(F.col("__d") <= cut), column)
        new_mean = s / n
        new_cov = (ss - n * np.outer(new_mean, new_mean)) / max(1, n - 1) + 1e-9 * np.eye(len(s))
        value = np.linalg.slogdet(new_cov)[1]
        if not value < level - 1e-9:
            break
        mean, cov, level = new_mean, new_cov, value
    return mean, cov


def robust_density(df: DataFrame, train: DataFrame, key: str, column: str, out: str, components: int = 100, support: float = 0.9, steps: int = 5) -> DataFrame:
    """Kernel principal components (Gaussian kernel), then the robust Mahalanobis distance in them.

    Components and covariance come from all training rows, as sums. The kernel map is spanned by LANDMARKS rows (a Nystroem basis): exact up to
    that many training rows, an approximation of the kernel beyond. There are half as many components as training rows at most, so that the
    covariance has full rank. No training rows: null.
    """
    marks = train.orderBy(F.xxhash64(key), key).limit(LANDMARKS).select(column).toPandas()[column]
    if not len(marks):
        return df.withColumn(out, F.lit(None).cast("double"))
    marks = np.stack(marks.to_numpy()).astype(float)
    values, vectors = np.linalg.eigh(_kernel(marks, marks))
    kept = values > 1e-10 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])
    mapped = _projected(train, column, marks, root, np.zeros(root.shape[1]), "__p")
    n, s, ss = moments(mapped, "__p")
    mean = s / n
    vectors = np.linalg.eigh(ss / n - np.outer(mean, mean))[1][:, ::-1][:, : max(1, min(components, n // 2))]
    weights, offset = root @ vectors, mean @ vectors
    path = scratch(df.sparkSession, "density")
    _projected(train.select(column), column, marks, weights, offset, "__p").select("__p").write.parquet(path)
    start = minimum_covariance(_kernel(marks, marks) @ weights - offset, support)
    model = _concentrated(df.sparkSession.read.parquet(path), "__p", *start, support, steps)
    return mahalanobis(_projected(df, column, marks, weights, offset, "__p"), "__p", (model[0], np.linalg.inv(model[1])), out).drop("__p")
