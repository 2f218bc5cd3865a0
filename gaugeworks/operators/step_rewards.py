"""Rewards of the steps of a solution by models of different families: what each is asked, and how its output is read.

Fixed values: the marks, tags and separators that the models were trained with, and the labels they give.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..sources import io
from ..sources.calls import Answers

MARK, TAG, NO_REFERENCE = "<extra_0>", "ки", "\n\n###\n\nThe reference answer is: There is no reference answer for this question."


@dataclass(frozen=True)
class Family:
    """`prompt` of a question and its (trimmed) steps. A whole family is asked once and gives an array with a reward for each step; the others are
    asked about each beginning of the steps, for the reward of its last one. `read` turns the provider's columns into that."""

    prompt: Callable[[Column, Column], Column]
    read: Callable[[], Column]
    whole: bool = False


def _joined(between: str) -> Callable[[Column, Column], Column]:
    return lambda q, steps: F.concat_ws(between, F.array(q), steps, F.array(F.lit("")))


def _numbered(q: Column, steps: Column) -> Column:
    lines = F.transform(steps, lambda s, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), s, F.lit(f" {TAG}")))
    return F.concat(F.trim(q), F.lit(" "), F.array_join(lines, "\n"))


def _dialogue(q: Column, steps: Column) -> Column:
    """The question stands before the first step; each step is a turn that is answered by a plus."""
    turns = F.transform(steps, lambda s, i: F.concat(F.when(i == 0, F.concat(F.trim(q), F.lit(" "))).otherwise(""), s, F.lit("\n+")))
    return F.array_join(turns, "\n")


def _labelled() -> Column:
    last = F.try_element_at("entities", F.lit(-1))
    score = F.try_element_at("scores", F.lit(-1))
    return F.when(last == "LABEL_1", score).when(last == "LABEL_0", 1 - score).otherwise(0.5)


#: Of two logits at each mark the second is that of a good step; at each tag, and behind each plus, the first.
FAMILIES: dict[str, Family] = {
    "marks": Family(lambda q, s: F.concat(q, F.lit("\n"), F.array_join(F.concat(s, F.array(F.lit(""))), MARK)), lambda: F.transform("logits", lambda x: A.sigmoid(x[1] - x[0])), whole=True),
    "tags": Family(_numbered, lambda: F.transform("logits", lambda x: A.sigmoid(x[0] - x[1])), whole=True),
    "flags": Family(lambda q, s: F.concat(q, F.lit("\n"), F.array_join(s, "\n")), lambda: F.transform(F.filter(F.arrays_zip("values", "flags"), lambda x: x["flags"] == 1), lambda x: A.sigmoid(x["values"])), whole=True),
    "dialogue": Family(_dialogue, lambda: A.sigmoid(F.get(F.element_at("logits", -1), F.lit(0)) - F.get(F.element_at("logits", -1), F.lit(1)))),
    "beginnings": Family(lambda q, s: F.concat(q, F.lit(NO_REFERENCE + "\n"), F.array_join(F.concat(s, F.array(F.lit(""))), "\n")), lambda: A.sigmoid(F.col("score"))),
    "labels": Family(_joined("\n\n"), _labelled),
}


def step_rewards(solutions: DataFrame, key: str, question: str, steps: str, family: str, answers: Answers) -> DataFrame:
    """key and `rewards`, one for each step; a solution without steps is not asked about and has none.

    Stops at an output with another number of rewards than steps. Steps are trimmed; null steps and questions are empty. Rows are unique by key.
    """
    kind = FAMILIES[family]
    spark = solutions.sparkSession
    texts = F.transform(F.coalesce(steps, F.array().cast("array<string>")), lambda s: F.trim(F.coalesce(s, F.lit(""))))
    rows = solutions.select(F.col(key).alias("key"), F.coalesce(question, F.lit("")).alias("q"), texts.alias("s"))
    path = io.scratch(spark, "rewards")
    if kind.whole:
        rows.select("key", F.size("s").alias("n"), F.when(F.size("s") > 0, kind.prompt(F.col("q"), F.col("s"))).alias("ask")).write.parquet(path)
        read = answers.ask(spark.read.parquet(path), "ask").withColumn("r", F.when(F.col("n") == 0, F.array().cast("array<double>")).otherwise(kind.read()))
        fits = (F.size("r") == F.col("n")) | F.col("error").isNotNull()
        return read.select(F.col("key").alias(key), F.when(F.coalesce(fits, F.lit(False)), F.col("r")).otherwise(F.raise_error(F.lit("rewards of another number of steps")).cast("array<double>")).alias("rewards"))
    each = rows.select("key", "q", "s", F.explode(F.filter(F.sequence(F.lit(1), F.size("s") + 1), lambda k: k <= F.size("s"))).alias("k"))
    each.select("key", "k", kind.prompt(F.col("q"), F.slice("s", F.lit(1), F.col("k"))).alias("ask")).write.parquet(path)
    read = answers.ask(spark.read.parquet(path), "ask").select(F.col("key").alias("of"), "k", kind.read().alias("r"))
    found = read.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("k", "r"))).alias("x"))
    return rows.select("key").join(found, F.col("key") == F.col("of"), "left").select(F.col("key").alias(key), F.coalesce(F.col("x.r"), F.array().cast("array<double>")).alias("rewards"))
