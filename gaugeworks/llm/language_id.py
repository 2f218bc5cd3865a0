"""Language ID: a byte convolutional network with filters of several widths, over windows of fixed length that cover the whole text.

A text that is null or has no letter gets `und` with score 0. Ties between classes go to the first in code-point order. Repeated rows are
predicted each; an empty table gives an empty result; without any labelled text every prediction is `und`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_models import fit, with_log_probs
from .common import bucket_of

FOLDS, HELD = 4, 2


def identify(docs: DataFrame) -> DataFrame:
    model, classes = fit(docs, docs.select("doc_id", "lang").where(bucket_of("doc_id", FOLDS) != HELD), "doc_id", "text", "lang", widths=(2, 3, 4), filters=8)
    held = (bucket_of("doc_id", FOLDS) == HELD).alias("held_out")
    if not classes:
        return docs.select("doc_id", held, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    scored = with_log_probs(docs.select("doc_id", "text"), model, "text", "__lp")
    best = F.array_max(F.slice("__lp", 1, len(classes)))
    known = F.col("text").rlike(r"\p{L}")
    return scored.select(
        "doc_id",
        held,
        F.when(known, F.get(F.array(*map(F.lit, classes)), (F.array_position("__lp", best) - 1).cast("int"))).otherwise("und").alias("lang_pred"),
        F.when(known, F.exp(best)).otherwise(0.0).alias("score"),
    )
