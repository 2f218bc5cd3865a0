"""Soft matching of texts by the vectors of their tokens: each token meets the nearest one of the other text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import io
from ..sources.calls import Answers


def rarity(texts: DataFrame, text: str, answers: Answers) -> DataFrame:
    """token and idf, ln((texts + 1) / (texts with it + 1)), over distinct texts."""
    each = answers.ask(texts.select(F.col(text).alias("t")).where("t is not null").distinct(), "t").select("t", "tokens")
    counted = each.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    total = each.agg(F.count("*").alias("all"))
    return counted.crossJoin(total).select("token", F.log((F.col("all") + 1) / (F.col("n") + 1)).alias("idf"))  # one row


def soft_scores(pairs: DataFrame, key: str, hypothesis: str, reference: str, answers: Answers, idf: DataFrame | None = None) -> DataFrame:
    """key, precision, recall and f1 of pairs of texts, by cosines of token vectors.

    The provider gives `tokens` and `vectors`, one for each. A distinct text is asked for once. Each token of one text takes the greatest cosine to
    a token of the other; precision is their mean over the hypothesis, recall over the reference, weighted by `idf` (token, idf) where it is
    given; tokens it lacks have weight 0. A pair without a token on either side, or without weight, scores 0; a vector without length has cosine 0.
    Rows are unique by key; null texts are empty.
    """
    spark = pairs.sparkSession
    path = io.scratch(spark, "soft-match")
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.coalesce(F.col(c), F.lit("")).alias("t")) for s, c in ((0, hypothesis), (1, reference))))
    pairs.select(F.col(key).alias("key"), F.inline(sides)).write.parquet(path)
    asked = answers.ask(spark.read.parquet(path), "t").select("key", "side", "tokens", "vectors")
    if idf is not None:
        distinct = asked.select("key", "side", F.explode(F.array_distinct("tokens")).alias("token"))
        weights = distinct.join(idf, "token").groupBy("key", "side").agg(F.map_from_entries(F.collect_list(F.struct("token", "idf"))).alias("w"))
        asked = asked.join(weights, ["key", "side"], "left").withColumn("w", F.transform("tokens", lambda t: F.coalesce(F.try_element_at("w", t), F.lit(0.0))))
    else:
        asked = asked.withColumn("w", F.transform("tokens", lambda t: F.lit(1.0)))
    half = F.struct("vectors", "w")
    rows = asked.groupBy("key").agg(*(F.max(F.when(F.col("side") == s, half)).alias(c) for s, c in ((0, "h"), (1, "r"))))  # two rows a key
    flat = rows.select("key", *(F.col(f"{c}.{x}").alias(f"{c}_{x}") for c in "hr" for x in ("vectors", "w")))

    def unit(v) -> np.ndarray:
        v = np.stack([np.asarray(x, float) for x in v])
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(n > 0, n, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, hv, hw, rv, rw in pdf.itertuples(index=False):
                p = r = 0.0
                if hv is not None and rv is not None and len(hv) and len(rv):
                    cosine = unit(hv) @ unit(rv).T
                    p, r = (float(c @ w / w.sum()) if w.sum() else 0.0 for c, w in ((cosine.max(axis=1), np.asarray(hw, float)), (cosine.max(axis=0), np.asarray(rw, float))))
                out.append((k, p, r, 2 * p * r / (p + r) if p + r else 0.0))
            yield pd.DataFrame(out, columns=[key, "precision", "recall", "f1"])

    kind = T.StructType([T.StructField(key, pairs.schema[key].dataType), *(T.StructField(c, T.DoubleType()) for c in ("precision", "recall", "f1"))])
    return flat.mapInPandas(run, kind)
