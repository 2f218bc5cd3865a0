"""A layered uncertainty head over pooled features, trained by full-batch descent on all labelled rows.

Rows are packed into blocks once. In each epoch every task adds up the gradients of its blocks for all heads under training, sums of slices of
them meet by shuffle, and the driver holds one set of weights for each head. Heads of a search train side by side on the same pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import io

#: Bytes of features in one block, numbers in one slice of a gradient, partial sums that one task adds up at most.
BLOCK_BYTES, SLICE, FAN = 4 << 20, 8192, 256


@dataclass(frozen=True)
class Setting:
    """What a search varies."""

    rate: float = 1e-3
    positive_weight: float = 1.0
    hidden: tuple[int, ...] = (256, 128, 64)


@dataclass
class Training:
    """A head under training: weights now, the best ones so far by validation loss, and the moments of Adam."""

    setting: Setting
    layers: list[np.ndarray]
    best: list[np.ndarray] = field(default_factory=list)
    best_loss: float = np.inf
    best_f1: float = 0.0
    losses: list[float] = field(default_factory=list)
    moments: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    gradient: list[np.ndarray] = field(default_factory=list)
    steps: int = 0
    stopped: bool = False


def packed(train: DataFrame, valid: DataFrame, features: str, label: str) -> tuple[DataFrame, int]:
    """Blocks of labelled rows, written, and the width of the features. Labels -100 and null, and null features, are left out.

    Features of different widths, or no labelled row on either side, are errors.
    """
    spark = train.sparkSession
    rows = None
    for df, held in ((train, False), (valid, True)):
        kept = df.where(F.col(label).isNotNull() & (F.col(label) != -100) & F.col(features).isNotNull())
        kept = kept.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), F.lit(held).alias("held"))
        rows = kept if rows is None else rows.unionByName(kept)
    widths = rows.groupBy("held").agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).collect()
    if len(widths) < 2:
        raise ValueError("no labelled rows")
    width = widths[0].least
    if any(w != width for r in widths for w in (r.least, r.most)):
        raise ValueError("features of different widths")
    most = max(1, BLOCK_BYTES // (8 * max(1, width)))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for held, part in pdf.groupby("held"):
                for at in range(0, len(part), most):
                    rows = part.iloc[at : at + most]
                    yield pd.DataFrame({"x": [np.stack(rows["x"].to_numpy()).astype(float).tobytes()], "y": [rows["y"].to_numpy(float).tobytes()], "held": [held]})

    path = io.scratch(spark, "head-rows")
    rows.mapInPandas(pack, "x binary, y binary, held boolean").write.parquet(path)
    return spark.read.parquet(path), width


def begin(width: int, setting: Setting, seed: int = 42) -> Training:
    rng, sizes = np.random.default_rng(seed), (width, *setting.hidden, 1)
    layers = []
    for a, b in zip(sizes, sizes[1:]):
        layers += [rng.normal(scale=np.sqrt(2 / a), size=(a, b)), np.zeros(b)]
    return Training(setting, layers, moments=[(np.zeros_like(v), np.zeros_like(v)) for v in layers])


def logits(layers: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    for k in range(0, len(layers), 2):
        x = x @ layers[k] + layers[k + 1]
        if k + 2 < len(layers):
            x = np.maximum(x, 0)
    return x[:, 0]


def loss(z: np.ndarray, y: np.ndarray, positive_weight: float) -> float:
    """Cross-entropy of logits, positives weighted."""
    return float(np.mean(positive_weight * y * np.logaddexp(0, -z) + (1 - y) * np.logaddexp(0, z)))


def _gradients(layers: list[np.ndarray], x: np.ndarray, y: np.ndarray, positive_weight: float) -> tuple[float, list[np.ndarray]]:
    """Loss and its gradient, summed over rows."""
    inputs = [x]
    for k in range(0, len(layers) - 2, 2):
        inputs.append(np.maximum(inputs[-1] @ layers[k] + layers[k + 1], 0))
    z = (inputs[-1] @ layers[-2] + layers[-1])[:, 0]
    p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    back = ((1 - y) * p - positive_weight * y * (1 - p))[:, None]
    out: list[np.ndarray] = []
    for k in range(len(layers) - 2, -1, -2):
        out = [inputs[k // 2].T @ back, back.sum(axis=0), *out]
        back = (back @ layers[k].T) * (inputs[k // 2] > 0)
    return len(y) * loss(z, y, positive_weight), out


def _sums(blocks: DataFrame, runs: list[Training]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each head: rows, loss and gradient of the training rows as one vector, and rows, loss, hits, calls and positives of the others."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast([(r.layers, r.setting.positive_weight) for r in runs])  # one set of weights for each head

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads = shared.value
        total = [np.zeros(2 + sum(v.size for v in layers)) for layers, _ in heads]
        judged = [np.zeros(5) for _ in heads]
        for pdf in batches:
            for x, y, held in zip(pdf["x"], pdf["y"], pdf["held"], strict=True):
                y = np.frombuffer(y)
                x = np.frombuffer(x).reshape(len(y), -1)
                for k, (layers, weight) in enumerate(heads):
                    if held:
                        z = logits(layers, x)
                        judged[k] += (len(y), len(y) * loss(z, y, weight), ((z > 0) & (y == 1)).sum(), (z > 0).sum(), (y == 1).sum())
                    else:
                        value, gradient = _gradients(layers, x, y, weight)
                        total[k][:2] += (len(y), value)
                        total[k][2:] += np.concatenate([g.ravel() for g in gradient])
        part = TaskContext.get().partitionId()
        for k in range(len(heads)):
            yield pd.DataFrame([(k, -1, part, judged[k].tolist()), *((k, at // SLICE, part, total[k][at : at + SLICE].tolist()) for at in range(0, len(total[k]), SLICE))], columns=["head", "slice", "part", "v"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        return pdf.iloc[:1].assign(v=[np.sum(np.stack(pdf["v"].to_numpy()), axis=0).tolist()], part=int(pdf["part"].iloc[0]) // FAN)

    schema = "head int, slice int, part int, v array<double>"
    sums, parts = blocks.mapInPandas(add, schema), blocks.rdd.getNumPartitions()
    while parts > FAN:
        sums = sums.groupBy("head", "slice", F.floor(F.col("part") / FAN).alias("of")).applyInPandas(join, schema)
        parts = -(-parts // FAN)
    found = sums.groupBy("head", "slice").applyInPandas(join, schema).collect()
    shared.destroy()
    out = []
    for k in range(len(runs)):
        own = {r.slice: np.array(r.v) for r in found if r["head"] == k}
        out.append((np.concatenate([own[s] for s in sorted(own) if s >= 0]), own[-1]))
    return out


def evaluate(blocks: DataFrame, runs: list[Training], patience: int) -> None:
    """One pass: validation of the heads as they are, and their gradients."""
    for run, (total, (n, value, hits, calls, positives)) in zip(runs, _sums(blocks, runs) if runs else (), strict=True):
        run.gradient, at = [], 2
        for v in run.layers:
            run.gradient.append(total[at : at + v.size].reshape(v.shape) / total[0])
            at += v.size
        run.losses.append(value / n)
        if run.losses[-1] < run.best_loss:
            run.best_loss, run.best, run.best_f1 = run.losses[-1], [v.copy() for v in run.layers], float(2 * hits / max(1, calls + positives))
        run.stopped = len(run.losses) - 1 - int(np.argmin(run.losses)) >= patience


def descend(run: Training) -> None:
    """One step of Adam by the gradient of all rows."""
    run.steps += 1
    for k, g in enumerate(run.gradient):
        m, v = run.moments[k]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        run.moments[k] = (m, v)
        run.layers[k] = run.layers[k] - run.setting.rate * (m / (1 - 0.9**run.steps)) / (np.sqrt(v / (1 - 0.999**run.steps)) + 1e-8)


def advance(blocks: DataFrame, runs: list[Training], epochs: int, patience: int) -> None:
    """More epochs of all heads, side by side; one whose validation loss has not improved for `patience` of them stops."""
    evaluate(blocks, [r for r in runs if not r.losses], patience)
    for _ in range(epochs):
        going = [r for r in runs if not r.stopped]
        for run in going:
            descend(run)
        evaluate(blocks, going, patience)


def fit(train: DataFrame, valid: DataFrame, features: str, label: str, setting: Setting = Setting(), epochs: int = 100, patience: int = 5) -> Training:
    """A head whose weights are those of the epoch with the least validation loss. All labelled rows count, in whatever order or layout."""
    blocks, width = packed(train, valid, features, label)
    run = begin(width, setting)
    advance(blocks, [run], epochs, patience)
    return run


def search(train: DataFrame, valid: DataFrame, features: str, label: str, settings: list[Setting], least: int = 3, epochs: int = 27, patience: int = 5) -> list[tuple[Setting, int, float, Training]]:
    """Successive halving by thirds: every setting gets `least` epochs, the better third by validation F1 three times as many, and so on.

    Best first, those that went furthest before the others: setting, epochs, F1, training. Ties keep the order of `settings`.
    """
    blocks, width = packed(train, valid, features, label)
    runs = [begin(width, s) for s in settings]
    going, done, budget = list(range(len(runs))), 0, least
    reached = [0] * len(runs)
    while going and done < epochs:
        advance(blocks, [runs[k] for k in going], budget - done, patience)
        for k in going:
            reached[k] = budget
        going = sorted(going, key=lambda k: (-runs[k].best_f1, k))[: max(1, len(going) // 3)]
        done, budget = budget, min(epochs, budget * 3)
    order = sorted(range(len(runs)), key=lambda k: (-reached[k], -runs[k].best_f1, k))
    return [(runs[k].setting, runs[k].steps, runs[k].best_f1, runs[k]) for k in order]


def apply(df: DataFrame, run: Training, features: str, out: str) -> DataFrame:
    """The head's probability; null for null features."""
    shared = df.sparkSession.sparkContext.broadcast(run.best or run.layers)  # one head

    @F.pandas_udf("double")
    def probability(v: pd.Series) -> pd.Series:
        known = v.notna().to_numpy()
        found = np.full(len(v), np.nan)
        if known.any():
            z = logits(shared.value, np.stack(v[known].to_numpy()).astype(float))
            found[known] = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        return pd.Series([float(p) if k else None for p, k in zip(found, known, strict=True)], dtype=object)

    return df.withColumn(out, probability(features))
