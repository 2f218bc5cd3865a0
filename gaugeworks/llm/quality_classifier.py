"""Quality classifier: a byte-level convolutional network over overlapping chunks of the whole document.

A null text counts as empty; an empty text gets the score of a chunk of zeros. Repeated rows are scored each. An empty table gives an
empty result; without any label every score is 0.5. Columns of the input other than id and text never reach the model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_models import fit, with_log_probs
from .common import bucket_of

THRESHOLD = 0.3
FOLDS = 5


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", out_col: str = "score", positive: int = 1) -> DataFrame:
    """`docs` with `out_col`, the probability of label `positive`, learned outside the held-out fold."""
    if out_col in docs.columns:
        raise ValueError(f"the input has a column {out_col}; name another out_col")
    model, classes = fit(docs, labels.where(bucket_of(id_col, FOLDS) != 0), id_col, text_col, label_col)
    if positive not in classes or len(classes) < 2:
        return docs.withColumn(out_col, F.lit(float(positive in classes) if classes else 0.5))
    scored = with_log_probs(docs, model, text_col, f"__{out_col}")
    return scored.withColumn(out_col, F.exp(F.get(f"__{out_col}", F.lit(classes.index(positive))))).drop(f"__{out_col}")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_quality(docs.select("doc_id", "text"), labels).select("doc_id", (bucket_of("doc_id", FOLDS) == 0).alias("held_out"), "score")
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier accepts, with the same columns."""
    return score_quality(docs, labels, out_col="__quality").where(F.col("__quality") >= THRESHOLD).select(*docs.columns)
