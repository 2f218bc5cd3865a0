"""Estimators over the pairs of one prompt's samples, as edge lists (key, i, j, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def degree_matrix(pairs: DataFrame, key: str | list[str], weight: Column) -> DataFrame:
    """1 minus the mean weight over all ordered pairs: what the trace of the degree matrix comes to."""
    keys = [key] if isinstance(key, str) else key
    return pairs.groupBy(*keys).agg((1 - F.avg(weight)).alias("value"))


def luq(pairs: DataFrame, key: str) -> DataFrame:
    sim = F.exp("e_logit") / (F.exp("e_logit") + F.exp("c_logit"))
    rows = pairs.where("i != j").groupBy(key, "i").agg(F.avg(sim).alias("m"))
    return rows.groupBy(key).agg((1 - F.avg("m")).alias("value"))


def sentence_sar(pairs: DataFrame, probs: DataFrame, key: str, similarity: Column, t: float = 0.001) -> DataFrame:
    """probs: (key, turn, p). Mean of -ln of each sample's probability plus the similar ones' share."""
    other = pairs.withColumn("sim", similarity).join(probs.select(key, F.col("turn").alias("j"), F.col("p").alias("pj")), [key, "j"])
    other = other.groupBy(key, "i").agg(F.sum(F.when(F.col("i") != F.col("j"), F.col("pj") * F.col("sim")).otherwise(0.0)).alias("r"))
    joined = other.join(probs.select(key, F.col("turn").alias("i"), F.col("p").alias("pi")), [key, "i"])
    return joined.groupBy(key).agg(F.avg(-F.log(F.col("pi") + F.col("r") / t)).alias("value"))


def semantic_entropy(samples: DataFrame, key: str, empirical: bool = False) -> DataFrame:
    """samples: (key, turn, logprob, class_id). Minus the mean log-probability of the samples' classes."""
    classes = Window.partitionBy(key, "class_id")
    if empirical:
        lp = F.log(F.count("*").over(classes) / F.count("*").over(Window.partitionBy(key)))
    else:
        top = F.max("logprob").over(classes)
        lp = F.log(F.sum(F.exp(F.col("logprob") - F.col("top"))).over(classes)) + F.col("top")
        samples = samples.withColumn("top", top)
    return samples.withColumn("lp", lp).groupBy(key).agg((-F.avg("lp")).alias("value"))


def label_prob(samples: DataFrame, key: str) -> DataFrame:
    """1 minus the share of the largest class."""
    c = samples.groupBy(key, "class_id").count()
    return c.groupBy(key).agg((1 - F.max("count") / F.sum("count")).alias("value"))
