"""Uncertainty of an ensemble: (obs, token_idx, model, lp) to measures of tokens and of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A


def token_measures(rows: DataFrame) -> DataFrame:
    """Per token: total, data and mutual uncertainty, EPKL, reverse mutual information, and entropies of the likeliest tokens."""
    cells = rows.select("obs", "token_idx", "model", F.posexplode("lp").alias("k", "l"))
    mix = cells.groupBy("obs", "token_idx", "k").agg((F.log(F.sum(F.exp("l"))) - F.log(F.count("*").cast("double"))).alias("l"), F.avg("l").alias("a"), F.avg(F.exp("l")).alias("p"), F.avg(-F.col("l") * F.exp("l")).alias("h"))
    # one row per (obs, token) holds one vocabulary
    out = mix.groupBy("obs", "token_idx").agg(F.sum(-F.col("l") * F.exp("l")).alias("total"), F.sum("h").alias("data"), F.sum(-F.col("p") * F.col("a")).alias("cross"), F.sort_array(F.collect_list(F.struct((-F.col("l")).alias("o"), "k"))).alias("ranked"))
    top = lambda n: A.entropy(A.log_softmax(F.transform(F.slice("ranked", 1, n), lambda s: -s["o"])))
    return out.select("obs", "token_idx", "total", "data", (F.col("total") - F.col("data")).alias("mutual"), (F.col("cross") - F.col("data")).alias("epkl"), (F.col("cross") - F.col("total")).alias("rmi"), *(top(n).alias(f"top{n}") for n in (5, 10, 15)))


def sequence_measures(rows: DataFrame) -> DataFrame:
    """Per obs, each token standing in as a beam with its likeliest log-probability: total uncertainty, RMI and absolute RMI."""
    s = rows.select("obs", F.col("token_idx").alias("beam"), "model", F.array_max("lp").alias("l"))
    b = s.groupBy("obs", "beam").agg((F.log(F.sum(F.exp("l"))) - F.log(F.count("*").cast("double"))).alias("p"), F.collect_list("l").alias("ls"))
    b = b.withColumn("gap", F.transform("ls", lambda x: F.col("p") - x))
    return b.groupBy("obs").agg(
        F.sum(F.exp("p")).alias("z"),
        F.sum(F.exp("p") * F.col("p")).alias("t"),
        F.sum(F.exp("p") * A.mean(F.col("gap"))).alias("r"),
        F.sum(F.exp("p") * A.total(F.transform("gap", F.abs)) / 4).alias("q"),
    ).select("obs", (-F.col("t") / F.col("z")).alias("tu"), (F.col("r") / F.col("z")).alias("rmi"), (F.col("q") / F.col("z")).alias("rmiabs"))


def beam_weighted(tokens: DataFrame, beams: DataFrame, measure: str, equal: bool = False) -> DataFrame:
    """Per obs, the beams' token measures weighted by their probabilities (obs, token_idx, p), or equally."""
    rows = tokens.join(beams, ["obs", "token_idx"])
    w = F.lit(1.0) if equal else F.exp("p")
    return rows.groupBy("obs").agg((F.sum(w * F.col(measure)) / F.sum(w)).alias("value"))
