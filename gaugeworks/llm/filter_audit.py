"""Filter interaction audit: what each of five filters removes in every order they may be applied in.

A cube over the five failure flags and the part gives, for each set of filters, the documents that pass all of them; a step of an order is the
difference between two such sets.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(text: Column, words: Column) -> list[Column]:
    """Failure of filters A to D, which look at one text: few words, repeated words, capitals, symbols."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return [n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike("[#$%&*|]")]


def flagged(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, a bit for each failure of A to D."""
    docs = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    blanks = "\t\n\x0b\x0c\r"
    docs = docs.withColumn("words", F.array_remove(F.split(F.translate("text", blanks, " " * len(blanks)), " "), ""))
    bits = sum((f.cast("int") * (1 << k) for k, f in enumerate(failures(F.col("text"), F.col("words")))), F.lit(0))
    return docs.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.alias("bits"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good and toxic ones, for each part and combination of the flags A to E: at most 32 rows for each part.

    Copies of a text are added up before they meet, so one text may hold any share of the rows.
    """
    per_doc = flagged(docs).groupBy("doc_id", "digest", "bits", "part").agg(F.count("*").alias("n"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(x) for c, x in (("quality", "good"), ("toxic", "toxic"))))
    per_doc = per_doc.join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    texts = per_doc.groupBy("digest", "bits", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null")
    )
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))  # a row for each part and label
    passing = F.col("n_null") + F.when(first, F.col("n_least")).otherwise(0)
    texts = texts.withColumn("passing", passing)
    passing = F.col("passing")
    e = texts.select("part", "bits", "good", "toxic", F.explode(F.array(F.struct(F.lit(False).alias("e"), passing.alias("n")), F.struct(F.lit(True).alias("e"), (F.col("n") - passing).alias("n")))).alias("x"))
    e = e.select("part", "bits", "good", "toxic", "x.*").where("n > 0")
    flags = [(F.col("bits").bitwiseAND(1 << k) != 0).alias(f) for k, f in enumerate(FILTERS[:-1])] + [F.col("e").alias(FILTERS[-1])]
    counts = [F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(f"n_{c}") for c in ("good", "toxic"))]
    return e.groupBy("part", "bits", "e").agg(*counts).select("part", *flags, "n", "n_good", "n_toxic")


def survivors(found: DataFrame) -> DataFrame:
    """For each part and set of filters (bits): documents, good and toxic ones that pass all of the set. Every part has all 32 sets."""
    cube = found.cube("part", *FILTERS).agg(F.grouping("part").alias("any_part"), *(F.grouping(f).alias(f"any_{f}") for f in FILTERS), *(F.sum(c).alias(c) for c in ("n", "n_good", "n_toxic")))
    for f in FILTERS:
        cube = cube.where((F.col(f"any_{f}") == 1) | ~F.col(f))
    chosen = sum(((1 - F.col(f"any_{f}")) * (1 << k) for k, f in enumerate(FILTERS)), F.lit(0))
    passed = cube.where("any_part = 0").select("part", chosen.cast("int").alias("subset"), "n", "n_good", "n_toxic")
    every = found.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("subset"))
    return every.join(passed, ["part", "subset"], "left").fillna(0, ["n", "n_good", "n_toxic"])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (source; null is the empty string), order of the filters and step.

    Null texts are empty; empty texts fail A alone. A null doc_id is not smaller than another and passes E, as do repeated rows of the smallest
    doc_id. Several labels of a document count as one that has any of their marks. An empty table has no part and gives no row.
    """
    passed = survivors(cells(docs, labels))
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            after = before | 1 << FILTERS.index(f)
            steps.append(("".join(order), k + 1, f, before, after))
            before = after
    pairs = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, before int, after int")  # 600 rows, always
    named = lambda x: passed.select(F.col("part").alias(f"part_{x}"), F.col("subset").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "n_good", "n_toxic")))
    rows = named("before").join(F.broadcast(pairs), "before").join(named("after").withColumnRenamed("part_after", "part_before"), ["part_before", "after"])
    lost = {c: (F.col(f"{c}_before") - F.col(f"{c}_after")).cast("long") for c in ("n", "n_good", "n_toxic")}
    rows = rows.select(F.col("part_before").alias("part"), "filter_order", "step", "filter", F.col("n_after").cast("long").alias("kept"), lost["n"].alias("removed"), lost["n_good"].alias("good_lost"), lost["n_toxic"].alias("toxic_lost"))
    own = Window.partitionBy("part", "filter")  # its 120 orders; as a first step it removes all that fail it, as a last one what only it removes
    as_step = lambda k: F.max(F.when(F.col("step") == k, F.col("removed"))).over(own)
    return rows.select(
        "part", "filter_order", "step", "kept", "removed", (as_step(1) - F.col("removed")).alias("redundant"), as_step(len(FILTERS)).alias("unique_fails"),
        "good_lost", "toxic_lost", F.sum("removed").over(own).alias("shapley"),
    )
