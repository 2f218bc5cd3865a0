"""Estimators that need small dense linear algebra or an order of reading, one group at a time.

A group is one prompt's samples, or one step's: a handful of rows by nature. Each function takes a pandas frame or the matrices of one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dense(pdf: pd.DataFrame, column: str) -> np.ndarray:
    """The matrix of an edge list with columns i and j."""
    ids = {v: k for k, v in enumerate(sorted(set(pdf["i"]) | set(pdf["j"])))}
    out = np.zeros((len(ids), len(ids)))
    out[pdf["i"].map(ids).to_numpy(), pdf["j"].map(ids).to_numpy()] = pdf[column].to_numpy(float)
    return out


def symmetric(w: np.ndarray) -> np.ndarray:
    return (w + w.T) / 2


def normalized_laplacian(w: np.ndarray) -> np.ndarray:
    scale = 1 / np.sqrt(w.sum(axis=1))
    return np.eye(len(w)) - scale[:, None] * w * scale[None, :]


def eccentricity(w: np.ndarray, threshold: float = 0.9) -> float:
    """Length of the offsets of the samples from their mean, in the eigenvectors whose eigenvalue stays under the threshold."""
    values, vectors = np.linalg.eigh(normalized_laplacian(symmetric(w)))
    near = vectors[:, values < threshold]
    return float(np.linalg.norm(near - near.mean(axis=0)))


def laplacian_sum(w: np.ndarray) -> float:
    return float(np.maximum(0, 1 - np.linalg.eigvalsh(normalized_laplacian(symmetric(w)))).sum())


def semantic_sets(entail: np.ndarray, contra: np.ndarray) -> int:
    """Connected parts of the graph of pairs that entail each other more than they contradict."""
    tied = (entail > contra) & (entail.T > contra.T)
    left, parts = set(range(len(entail))), 0
    while left:
        parts, todo = parts + 1, [left.pop()]
        while todo:
            k = todo.pop()
            found = {j for j in left if tied[k, j]}
            left -= found
            todo += found
    return parts


def matrix_exponential(a: np.ndarray) -> np.ndarray:
    """By scaling, a Taylor sum, and squaring."""
    norm = np.abs(a).sum(axis=0).max()
    k = max(0, int(np.ceil(np.log2(norm))) + 1) if norm > 0 else 0
    x, out, term = a / 2**k, np.eye(len(a)), np.eye(len(a))
    for n in range(1, 19):
        term = term @ x / n
        out = out + term
    for _ in range(k):
        out = out @ out
    return out


def kernel_entropy(entail: np.ndarray, neutral: np.ndarray, t: float = 0.3) -> float:
    """Von Neumann entropy of the heat kernel of W = entail + neutral / 2, over ln n. L = W - D of each sample."""
    w = entail + 0.5 * neutral
    k = matrix_exponential(-t * (w - np.diag(w.sum(axis=1))))
    scale = 1 / np.sqrt(np.diag(k))
    k = scale[:, None] * k * scale[None, :] / len(k)
    values = np.linalg.eigvals(k).real
    values = values[values > 0]
    return float(-(values * np.log(values)).sum() / np.log(len(k))) if len(k) > 1 else 0.0


def eigen_score(z: np.ndarray, alpha: float = 1e-3) -> float:
    centred = z - z.mean(axis=1, keepdims=True)
    values = np.linalg.eigvalsh(centred @ z.T + alpha * np.eye(len(z)))
    return float(np.log(np.where(values <= 0, 1e-10, values)).mean())


def greedy_classes(classes: np.ndarray) -> list[int]:
    """Each sample joins the first class whose first member and it entail each other (2 both ways)."""
    firsts: list[int] = []
    out = []
    for k in range(len(classes)):
        for c, f in enumerate(firsts):
            there, back = classes[f, k], classes[k, f]
            if there == 2 and back == 2:
                out.append(c)
                break
        else:
            out.append(len(firsts))
            firsts.append(k)
    return out


def cosine_clusters(vectors: np.ndarray, threshold: float = 0.85) -> list[int]:
    """In order, each vector joins the cluster with the closest running centre if its cosine reaches the threshold."""
    sums, norms, n = np.zeros((16, vectors.shape[1])), np.ones(16), 0
    out = []
    for v in vectors:
        scores = sums[:n] @ v / (np.linalg.norm(v) or 1) / norms[:n]  # all clusters at once
        best = int(np.argmax(scores)) if n else -1
        if n and scores[best] >= threshold:
            sums[best] += v
        else:
            best, n = n, n + 1
            if n > len(sums):
                sums, norms = np.concatenate([sums, np.zeros_like(sums)]), np.concatenate([norms, np.ones_like(norms)])
            sums[best] = v
        norms[best] = np.linalg.norm(sums[best]) or 1
        out.append(best)
    return out


def per_group(df: DataFrame, keys: list[str], function: Callable[[pd.DataFrame], float], out: str = "value") -> DataFrame:
    """One value per group."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, out: [float(function(pdf))]})

    return df.groupBy(*keys).applyInPandas(apply, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"{out} double"]))


def per_matrix(pairs: DataFrame, keys: list[str], columns: list[str], function: Callable[..., float], out: str = "value") -> DataFrame:
    """One value per group of pairs (i, j): `function` gets the matrix of each column. Groups travel as arrays, many to a batch, so that small ones
    cost what their numbers cost; a pair is there once."""
    rows = pairs.groupBy(*keys).agg(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), *(F.col(c).cast("double").alias(c) for c in columns))).alias("__pairs"))
    schema, n_keys = T.StructType([*rows.schema.fields[:-1], T.StructField(out, T.DoubleType())]), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(n_keys)
            cuts = listed.offsets.to_numpy()
            i, j, *w = (listed.values.field(k).to_numpy() for k in range(2 + len(columns)))
            values = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                ids, at = np.unique(np.concatenate([i[a:b], j[a:b]]), return_inverse=True)
                full = np.zeros((len(columns), len(ids), len(ids)))
                full[:, at[: b - a], at[b - a :]] = [x[a:b] for x in w]
                values.append(float(function(*full)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n_keys)), pa.array(values, pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)


def semantic_classes(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, turn, class_id) from pairs with `cls`."""
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        turns = sorted(set(pdf["i"]))
        found = greedy_classes(dense(pdf, "cls"))
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "turn": turns, "class_id": found})

    return pairs.groupBy(*keys).applyInPandas(apply, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "turn long, class_id int"]))
