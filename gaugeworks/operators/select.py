"""Choosing the best of several candidates, at once or step by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best(candidates: DataFrame, group: str, index: str, score: str, keep: list[str], lowest: bool = True, default: float | None = None) -> DataFrame:
    """One row per group: the candidate with the lowest (or highest) score, the first one among equals. A missing score takes the default."""
    s = F.col(score) if default is None else F.coalesce(F.col(score), F.lit(default))
    order = F.struct((s if lowest else -s).alias("o"), F.col(index).alias("i"))
    picked = candidates.groupBy(group).agg(F.min_by(F.struct(F.col(index).alias("best_idx"), s.alias("best_score"), *keep), order).alias("b"))
    return picked.select(group, "b.*")


def offline_table(candidates: DataFrame, group: str, index: str, scores: list[str], annotation: str) -> DataFrame:
    """Per method: groups used and skipped, accuracy of the lowest-scored candidate, mean accuracy. A group with a missing label or score is skipped."""
    long = candidates.select(group, index, annotation, F.explode(F.map_from_arrays(F.array(*map(F.lit, scores)), F.array(*scores))).alias("method", "score"))
    missing = lambda c: F.col(c).isNull() | F.isnan(c)
    per = long.groupBy("method", group).agg(F.bool_or(missing(annotation) | missing("score")).alias("skip"), F.min_by(1 - F.col(annotation), F.struct("score", index)).alias("hit"), F.avg(1 - F.col(annotation)).alias("mean"))
    used = ~F.col("skip")
    return per.groupBy("method").agg(F.count_if(used).alias("used"), F.count_if("skip").alias("skipped"), F.avg(F.when(used, F.col("hit"))).alias("accuracy"), F.avg(F.when(used, F.col("mean"))).alias("random_accuracy"))


def is_close(a: Column, b: Column) -> Column:
    """Whether two parsed answers agree within a billionth; false if either is missing."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b)), F.lit(0.0)), F.lit(False))


def exactly(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def fold_steps(candidates: DataFrame, run: str, step: str, index: str, text: str, score: Column, lowest: bool, stop: str, most_steps: int = 20) -> DataFrame:
    """Per run: at each step the best candidate is appended, until one holds `stop`, for most_steps steps at most.

    Each step's choice is an aggregate; what remains in order is a fold over a run's at most most_steps choices.
    """
    order = F.struct((score if lowest else -score).alias("o"), F.col(index).alias("i"))
    chosen = candidates.where(F.col(step) < most_steps).groupBy(run, step).agg(F.min_by(F.struct(F.col(text).alias("text"), score.alias("score")), order).alias("c"))
    rows = chosen.groupBy(run).agg(F.sort_array(F.collect_list(F.struct(F.col(step).alias("s"), F.col("c.text").alias("text"), F.col("c.score").alias("score")))).alias("steps"))
    last = F.array_position(F.transform("steps", lambda s: s["text"].contains(stop)), F.lit(True))
    kept = F.when(last > 0, F.slice("steps", F.lit(1), last.cast("int"))).otherwise(F.col("steps"))
    rows = rows.withColumn("kept", kept)
    return rows.select(run, F.array_join(F.transform("kept", lambda s: s["text"]), "\n").alias("trajectory"), F.size("kept").alias("n_steps"), (last > 0).alias("completed"), F.aggregate("kept", F.lit(0.0), lambda a, s: a + s["score"]).alias("total_score"))
