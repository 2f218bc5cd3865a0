"""Features of tokens and the linear uncertainty head, on tensors given as array columns."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A


def top_probabilities(log_probs: Column, n: int) -> Column:
    """Probabilities of the n likeliest tokens, in falling order."""
    return F.slice(F.transform(F.reverse(F.array_sort(log_probs)), F.exp), 1, n)


def rank_of(log_probs: Column, token: Column) -> Column:
    """How many tokens are likelier than the given one."""
    return F.size(F.filter(log_probs, lambda v: v > F.get(log_probs, token)))


def lookback_ratio(attention: Column, context: Column) -> Column:
    """Mean attention to the context over the sum of that and the mean attention to what was generated."""
    seen, made = F.slice(attention, F.lit(1), context), F.slice(attention, context + 1, F.greatest(F.size(attention) - context, F.lit(0)))
    a, b = F.coalesce(A.mean(seen), F.lit(0.0)), F.coalesce(A.mean(made), F.lit(0.0))
    return F.coalesce(F.try_divide(a, a + b), F.lit(0.0))


def attention_window(attention: Column, at: Column, width: int) -> Column:
    """Attention to the `width` tokens before the given one, nearest first, zero-padded."""
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: F.coalesce(F.when(at >= k, F.get(attention, at - k)), F.lit(0.0)))


def combined(*parts: Column) -> Column:
    """Features one behind the other; a NaN stops the run."""
    whole = F.concat(*parts)
    return F.when(F.exists(whole, F.isnan), F.raise_error(F.lit("a feature is NaN")).cast("array<double>")).otherwise(whole)


def select_layers(layers: Column, numbers: list[int]) -> Column:
    """Layers by number; negative ones count from the end."""
    return F.array(*(F.try_element_at(layers, F.lit(k + 1 if k >= 0 else k)) for k in numbers))


def adjacent_cosines(layers: Column) -> Column:
    """Cosine of each layer with the next one."""
    return F.zip_with(F.slice(layers, F.lit(1), F.size(layers) - 1), F.slice(layers, F.lit(2), F.size(layers) - 1), A.cosine)


def fit_head(rows: DataFrame, features: str, label: str, positive_weight: float = 1.0, iterations: int = 50, regularization: float = 1e-3):
    """A linear head by weighted cross-entropy; labels -100 and null are left out."""
    kept = rows.where(F.col(label).isNotNull() & (F.col(label) != -100))
    kept = kept.select(array_to_vector(features).alias("features"), F.col(label).cast("double").alias("label"), F.when(F.col(label) == 1, positive_weight).otherwise(1.0).alias("w"))
    return LogisticRegression(maxIter=iterations, regParam=regularization, weightCol="w").fit(kept)


def apply_head(rows: DataFrame, model, features: str, out: str) -> DataFrame:
    """The fitted head's probability, as an expression."""
    return rows.withColumn(out, A.sigmoid(head_logit(F.col(features), [float(x) for x in model.coefficients], float(model.intercept))))


def head_logit(features: Column, weights: list[float], bias: float) -> Column:
    """The same head as an expression."""
    return A.dot(features, F.array(*map(F.lit, weights))) + bias
