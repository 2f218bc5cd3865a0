"""Calibration: fitted on scored answers (unit, ue, target), applied to others; gives `confidence`, higher for less uncertain."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranked import stretch, with_running
from ..sources import io
from .evaluate import clean, empirical_rank
from .lookup import lookup


def minmax(train: DataFrame, test: DataFrame) -> DataFrame:
    lo, hi = clean(train).agg(F.min(-F.col("ue")), F.max(-F.col("ue"))).first()
    value = F.try_divide(-F.col("ue") - F.lit(lo), F.lit(hi) - F.lit(lo))
    return test.select("unit", F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)).alias("confidence"))


def quantile(train: DataFrame, test: DataFrame) -> DataFrame:
    ranked = empirical_rank(test.select("unit", (-F.col("ue")).alias("c")), train.select("unit", (-F.col("ue")).alias("c")), "unit", "c")
    return ranked.withColumnRenamed("rank_share", "confidence")


def score_cells(train: DataFrame) -> DataFrame:
    """Distinct scores `ue` with their rows `w` and mean target `y`."""
    return clean(train).groupBy("ue").agg(F.count("*").alias("w"), F.avg("target").alias("y"))


def binned_curve(cells: DataFrame, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of bins of nearly equal counts, and the mean target of each bin. A score above an edge belongs to the bin behind it."""
    total, lo, hi = cells.agg(F.sum("w"), F.min("ue"), F.max("ue")).first()
    if total is None or lo == hi:
        return np.array([] if lo is None else [lo]), np.array([] if lo is None else [cells.agg(F.avg("y")).first()[0]])
    ranked = with_running(cells, [], ["ue"], {"cum": F.col("w")})
    inner = ranked.agg(*(F.min(F.when(F.col("cum") >= k * total / bins, F.col("ue"))) for k in range(1, bins))).first()
    edges = np.unique(np.array([lo, *inner, hi]))
    place = F.greatest(F.lit(0), F.size(F.filter(F.array(*map(F.lit, edges.tolist())), lambda e: e < F.col("ue"))) - 1)
    means = {r.k: r.m for r in cells.groupBy(place.alias("k")).agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("m")).collect()}  # a row per bin
    return edges, np.array([means.get(k, 0.0) for k in range(len(edges) - 1)])


def binned(train: DataFrame, test: DataFrame, bins: int = 10) -> DataFrame:
    """The mean target of the score's bin. Scores up to the first edge, or above the last, take the last bin, as index -1 does."""
    edges, means = binned_curve(score_cells(train), bins)
    if len(edges) < 2:
        return test.select("unit", F.lit(float(means[0]) if len(means) else None).cast("double").alias("confidence"))
    out = F.lit(float(means[-1]))
    for k in reversed(range(len(means))):
        out = F.when((F.col("ue") > float(edges[k])) & (F.col("ue") <= float(edges[k + 1])), float(means[k])).otherwise(out)
    return test.select("unit", out.alias("confidence"))


def pool(y: np.ndarray, w: np.ndarray) -> list[list[float]]:
    """Pool adjacent violators, and equal neighbours, for a strictly rising fit: blocks of [mean, weight, members]."""
    blocks: list[list[float]] = []
    for value, weight in zip(y, w, strict=True):
        blocks.append([float(value), float(weight), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0] - 1e-12:
            b, a = blocks.pop(), blocks.pop()
            total = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return blocks


#: Columns of the blocks of a rising fit: mean, weight, weighted sum of x, first and last x.
BLOCK = "mean double, weight double, xw double, first double, last double"


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """Blocks in order of x, pooled until their means rise."""
    if not len(rows):
        return rows
    pooled = pool(rows["mean"].to_numpy(), rows["weight"].to_numpy())
    sizes = np.array([int(b[2]) for b in pooled])
    at = np.cumsum(sizes) - sizes
    return pd.DataFrame({"mean": [b[0] for b in pooled], "weight": [b[1] for b in pooled], "xw": np.add.reduceat(rows["xw"].to_numpy(), at), "first": rows["first"].to_numpy()[at], "last": rows["last"].to_numpy()[at + sizes - 1]})


def _blocks(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> pd.DataFrame:
    return _merge(pd.DataFrame({"mean": y, "weight": w, "xw": x * w, "first": x, "last": x}).astype(float))


#: Blocks that one task merges; points of a curve that are broadcast; stretches of means at most.
MERGED, BROADCAST_POINTS, MOST_CUTS = 50_000, 200_000, 64


def rising_fit(cells: DataFrame) -> DataFrame:
    """Blocks (BLOCK) of the rising fit of (x, y, w), written. However many there are, none of them passes through the driver.

    Cells are pooled within stretches of x first, which changes nothing. If many blocks are left, as of a target that rises with x, they are cut
    where the fit crosses a few levels: the fit is above a level exactly behind the place where the weighted sum of (mean - level) up to there is
    least. What lies between two such places is a fit of its own.
    """
    spark = cells.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        return _blocks(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())

    path = io.scratch(spark, "rising-fit")
    cells.select("x", "y", "w", stretch(cells, ["x"], n).alias("part")).groupBy("part").applyInPandas(fit, BLOCK).write.parquet(f"{path}/stretches")
    blocks = spark.read.parquet(f"{path}/stretches")
    segment, count = F.lit(0), blocks.count()
    if count > MERGED:
        shares = [(k + 1) / (m + 1) for m in [min(MOST_CUTS, -(-4 * count // MERGED))] for k in range(m)]
        found = sorted(set(blocks.agg(F.percentile_approx("mean", shares, 10_000)).first()[0]))
        levels = [a + (b - a) * 0.6180339887 for a, b in zip(found, found[1:])]  # between means, so that no block lies on one
        sums = with_running(blocks, [], ["first"], {"a": F.col("weight") * F.col("mean"), "b": F.col("weight")})
        if levels:
            at = sums.agg(*(F.min(F.struct((F.col("a") - c * F.col("b")).alias("s"), F.col("last").alias("x"))).alias(f"c{k}") for k, c in enumerate(levels))).first()
            places = sorted({c.x for c in at if c.s < 0})
            segment = F.size(F.filter(F.array(*map(F.lit, places)), lambda c: c < F.col("first"))) if places else segment
    merged = blocks.groupBy(segment.alias("segment")).applyInPandas(lambda pdf: _merge(pdf.drop(columns="segment", errors="ignore").sort_values("first", ignore_index=True)), BLOCK)
    merged.write.parquet(f"{path}/blocks")
    return spark.read.parquet(f"{path}/blocks")


def curve_points(blocks: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Points (px, py) of the centered fit: see _points. Means are held within `low` and `high`; the blocks beyond become one at either end."""
    mean = F.least(F.lit(high), F.greatest(F.lit(low), F.col("mean")))
    ends = blocks.withColumn("mean", mean)
    flat = ends.where(F.col("mean").isin(low, high)).groupBy("mean").agg(F.sum("weight").alias("weight"), F.sum("xw").alias("xw"), F.min("first").alias("first"), F.max("last").alias("last"))
    every = ends.where(~F.col("mean").isin(low, high)).select("mean", "weight", "xw", "first", "last").unionByName(flat)
    first, last = blocks.agg(F.min("first"), F.max("last")).first()
    xs = (
        F.when(F.col("mean").isin(low, high), F.array("first", "last"))
        .when(F.col("first") == F.lit(first), F.array("first"))
        .when(F.col("last") == F.lit(last), F.array("last"))
        .otherwise(F.array(F.col("xw") / F.col("weight")))
    )
    return every.select(F.explode(xs).alias("px"), F.col("mean").alias("py"))


def along_curve(df: DataFrame, x: str, points: DataFrame, out: str) -> DataFrame:
    """`df` with `out`, linear between the points of a curve and flat beyond them; null without a point or an x.

    A curve of BROADCAST_POINTS points at most is broadcast. Of a longer one, distinct values meet the points in stretches, each with the points
    next to it, and come back by a join that salts values of many rows.
    """
    spark, count = df.sparkSession, points.count()
    if count == 0:
        return df.withColumn(out, F.lit(None).cast("double"))
    if count <= BROADCAST_POINTS:
        found = points.toPandas().sort_values(["px", "py"])
        shared = spark.sparkContext.broadcast((found["px"].to_numpy(), found["py"].to_numpy()))

        @F.pandas_udf("double")
        def apply(v: pd.Series) -> pd.Series:
            v = v.to_numpy(float)
            return pd.Series(np.where(np.isnan(v), np.nan, np.interp(v, *shared.value)))

        return df.withColumn(out, apply(F.col(x).cast("double")))
    keyed = df.withColumn("__x", F.col(x).cast("double"))
    queries = keyed.select(F.col("__x").alias("x")).where("x is not null and not isnan(x)").distinct()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = points.select(F.col("px").alias("x"), F.struct("px", "py").alias("p")).unionByName(queries.withColumn("p", F.lit(None).cast("struct<px:double,py:double>")))
    both = both.withColumn("part", stretch(points.select(F.col("px").alias("x")), ["x"], n))
    steps = both.where("p is not null").groupBy("part").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))  # a row for each stretch
    steps = both.select("part").distinct().join(steps, "part", "left")
    order = Window.orderBy("part")
    steps = steps.select(F.col("part").alias("__part"), F.last("hi", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("behind"), F.first("lo", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("ahead"))
    within = Window.partitionBy("part").orderBy("x")
    near = both.withColumn("a", F.last("p", ignorenulls=True).over(within.rangeBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("b", F.first("p", ignorenulls=True).over(within.rangeBetween(Window.currentRow, Window.unboundedFollowing)))
    near = near.where("p is null").join(steps, F.col("part") == F.col("__part")).select("x", F.coalesce("a", "behind").alias("a"), F.coalesce("b", "ahead").alias("b"))
    slope = F.try_divide(F.col("b.py") - F.col("a.py"), F.col("b.px") - F.col("a.px"))
    value = F.when(F.col("a").isNull(), F.col("b.py")).when(F.col("b").isNull() | (F.col("a.px") == F.col("b.px")), F.col("a.py")).otherwise(F.col("a.py") + slope * (F.col("x") - F.col("a.px")))
    return lookup(keyed, near.select(F.col("x").alias("__x"), value.alias(out)), "__x").drop("__x").select(*[c for c in df.columns if c != out], out)


def _points(blocks: pd.DataFrame, low: float = 0.0, high: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Each step shrinks to its weighted mean of x, but the outer steps to the first and the last x; steps at `low` or `high` keep both ends."""
    px, py, n = [], [], len(blocks)
    for k, (mean, weight, xw, first, last) in enumerate(blocks.itertuples(index=False)):
        ends = [first, last] if mean in (low, high) else [first] if k == 0 else [last] if k == n - 1 else [xw / weight]
        px += ends
        py += [mean] * len(ends)
    return np.array(px), np.array(py)


def centered_isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Points of the centered rising fit of rows in order of x."""
    return _points(_blocks(x, y, np.ones(len(x)) if w is None else w))


def isotonic(train: DataFrame, test: DataFrame) -> DataFrame:
    """Confidence that falls with ue: a centered isotonic fit in [0, 1], linear between its points, flat beyond them."""
    points = curve_points(rising_fit(score_cells(train).withColumn("x", -F.col("ue"))))
    return along_curve(test.select("unit", (-F.col("ue").cast("double")).alias("__c")), "__c", points, "confidence").select("unit", "confidence")


def isotonic_scores(df: DataFrame) -> DataFrame:
    """`df` with ue replaced by its isotonic estimate of an error."""
    blocks = rising_fit(score_cells(df).select(F.col("ue").alias("x"), (1 - F.col("y")).alias("y"), "w"))
    steps = blocks.select(F.explode(F.array("first", "last")).alias("px"), F.col("mean").alias("py"))
    return along_curve(df, "ue", steps, "__fitted").withColumn("ue", F.col("__fitted")).select(*df.columns)
