"""Deterministic inputs of the estimators, derived from the tables; each stands in for what a model would give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as X
from ..operators import unigrams
from . import io
from .statistics import Statistics


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The statistics of a session.
_STORES: dict[str, Statistics] = {}


def statistics(spark: SparkSession) -> Statistics:
    """Fixtures that several queries read: they are derived once for each version of the tables, and go with the session."""
    key = spark.sparkContext.applicationId
    if key not in _STORES:
        _STORES[key] = Statistics(spark)
    return _STORES[key]


def _unigrams(spark: SparkSession, path: str, name: str, rows: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Texts with the counts of their words, toks, in their group and in all."""
    store = statistics(spark)
    words = store.get(f"{name}-words", "counts by group", [path], lambda: unigrams.model(rows, group, "toks"))
    return store.get(f"{name}-sequences", "counts along the words", [path], lambda: unigrams.counts_along(rows, keys, group, "toks", words))


def sequences(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = ("ll", "lm", "ent")) -> DataFrame:
    """One row per document: arrays in order of words of log-likelihoods under a unigram model of its language (ll) and of all (lm), and of an
    entropy term."""
    docs = io.spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select("doc_id", "lang", X.words(F.col("text")).alias("toks"))
    return unigrams.likelihoods(_unigrams(spark, f"{sf_dir}/documents.parquet", "documents", docs, ["doc_id"], "lang"), fields)


def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per embedding, as a token of the sequence `label`: log-probabilities over 64 tokens."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", "label", A.log_softmax(F.col("e")).alias("lp")).withColumn("token_idx", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as samples of one prompt, with unigram log-likelihoods."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", X.words(F.col("text")).alias("toks"))
    lls = _unigrams(spark, f"{sf_dir}/conversations.parquet", "turns", turns.withColumn("all", F.lit("all")), ["conv_id", "turn"], "all")
    lls = unigrams.likelihoods(lls, ("ll",))
    return turns.join(lls.select("conv_id", "turn", F.col("ll").alias("lls")), ["conv_id", "turn"]).withColumn("logprob", A.total(F.col("lls")))


def sample_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ordered pairs of a conversation's turns, itself included, with stand-ins of entailment from the words they share."""
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(X.words(F.col("text"))).alias("toks"))
    a, b = s.select("conv_id", F.col("turn").alias("i"), F.col("toks").alias("x")), s.select("conv_id", F.col("turn").alias("j"), F.col("toks").alias("y"))
    return similarity(a.join(b, "conv_id"), F.col("i") == F.col("j"), A.set_jaccard)


def similarity(pairs: DataFrame, same, jaccard: Callable[[Column, Column], Column] = A.jaccard) -> DataFrame:
    """Pairs with word arrays x and y to jac, entail, contra, their logits and the class (2 entailed, 1 neutral, 0 contradicted)."""
    p = pairs.withColumn("jac", jaccard(F.col("x"), F.col("y"))).drop("x", "y")
    p = p.withColumn("entail", F.when(same, 1.0).otherwise(F.least(F.lit(1.0), 10 * F.col("jac")))).withColumn("contra", (1 - F.col("entail")) / 2)
    p = p.withColumn("e_logit", F.log(F.col("entail") + 1e-6)).withColumn("c_logit", F.log(F.col("contra") + 1e-6))
    return p.withColumn("cls", F.when(same | (F.col("jac") >= 0.055), 2).when(F.col("jac") < 0.025, 0).otherwise(1))


def claim_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with words: claim_idx, text and n, its number of words. No shuffle."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text"), F.size(X.words(x)).alias("n")))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.filter(lines, lambda x: x["n"] > 0).alias("lines"))
    return docs.select("doc_id", F.posexplode("lines").alias("claim_idx", "c")).select("doc_id", "claim_idx", "c.text", "c.n")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with words as claims: claim_idx, text, positions of its words in the document, and a label (1 wrong, null unknown)."""
    rows = claim_lines(spark, sf_dir)
    before = Window.partitionBy("doc_id").orderBy("claim_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int"))
    key = F.col("doc_id") + F.col("claim_idx")
    label = F.when(key % 11 == 0, None).when(key % 7 == 0, 1.0).otherwise(0.0)
    return rows.select("doc_id", "claim_idx", "text", F.sequence("first", F.col("first") + F.col("n") - 1).alias("ids"), label.alias("verified"))


def claim_values(spark: SparkSession, sf_dir: str, fields: tuple[str, ...], expression: Callable[[Column], Column]) -> DataFrame:
    """doc_id, claim_idx, verified and value: an expression over a document's arrays and the positions of a claim's words. A document meets its
    arrays once, for all its claims."""
    listed = claims(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(F.struct("claim_idx", "verified", "ids")).alias("claims"))
    met = listed.join(sequences(spark, sf_dir, fields), "doc_id")
    each = F.transform("claims", lambda c: F.struct(c["claim_idx"].alias("claim_idx"), c["verified"].alias("verified"), expression(c["ids"]).alias("value")))
    return met.select("doc_id", F.inline(each))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as candidate answers of a question, with three scores and a label (1 wrong, null unknown)."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    label = F.when(F.col("l_orderkey") % 13 == 0, None).when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), (F.row_number().over(order) - 1).alias("cand_idx"), label.alias("annotation"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), (-F.col("l_extendedprice")).alias("price"))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one user on one day as the steps of a trajectory."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type", (F.col("value") / 500).alias("score")))).alias("s"))
    return rows.select(F.concat(F.lit("run"), (F.col("user_id") % 3).cast("string")).alias("run"), "user_id", "day", F.col("s.event_type").alias("steps"), F.col("s.score").alias("step_scores")).withColumn("completed", F.array_contains("steps", "purchase")).withColumn("failed", F.array_contains("steps", "error"))


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of one label as the distributions of four models for one token: (obs, token_idx, model, lp)."""
    d = distributions(spark, sf_dir).withColumn("model", F.col("vec_id") % 4)
    order = Window.partitionBy("label", "model").orderBy("vec_id")
    return d.select(F.col("label").alias("obs"), (F.row_number().over(order) - 1).alias("token_idx"), "model", "lp")


def scored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: a length score against their quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("unit"), "lang", F.log(F.col("n_chars").cast("double")).alias("ue"), F.col("quality").cast("double").alias("target"), F.col("toxic").cast("double").alias("toxic"))


def step_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-ins of reward, validity and redundancy for each claim."""
    c = claims(spark, sf_dir)
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("claim_idx"))
    c = c.withColumn("prev", F.coalesce(before, F.lit("")))
    reward = A.sigmoid((F.length("text") - 40) / F.lit(20.0))
    return c.select("doc_id", "claim_idx", "text", "verified", reward.alias("reward"), reward.alias("validity"), A.jaccard(X.words(F.col("text")), X.words(F.col("prev"))).alias("redundancy"))
