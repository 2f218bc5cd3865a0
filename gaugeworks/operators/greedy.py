"""What a generating model gives for each text, as ragged arrays of checked shapes: the contract that estimators rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A

#: Columns of a provider: tokens as generated (n), scores of the vocabulary for each (n x v), and for each head the attention of each token to
#: the ones before it (h x n x at least the token's place).
RAW = "tokens array<int>, logits array<array<double>>, attention array<array<array<double>>>, embedding array<double>"


def checked(df: DataFrame) -> DataFrame:
    """`df`, stopping at a row whose arrays do not fit one another; a row without tokens (a failed call) passes with nulls."""
    n = F.size("tokens")
    widths = F.transform("logits", lambda x: F.size(x))
    wrong = (
        F.when(F.size("logits") != n, "scores for another number of tokens")
        .when(F.array_min(widths) != F.array_max(widths), "vocabularies of different sizes")
        .when(F.exists("tokens", lambda t: t.isNull() | (t < 0)) | F.exists("tokens", lambda t: t >= F.size(F.get("logits", F.lit(0)))), "a token outside the vocabulary")
        .when(F.exists("attention", lambda h: F.size(h) != n), "a head with another number of tokens")
        .when(F.exists("attention", lambda h: F.exists(h, lambda row: row.isNull()) | F.exists(F.transform(h, lambda row, i: F.size(row) < i), lambda short: short)), "a token that sees too few")
    )
    bad = F.when(F.col("tokens").isNotNull(), wrong)
    return df.withColumn("tokens", F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("greedy output: "), bad))).otherwise(F.col("tokens")))


def cut(df: DataFrame, end: int, n_alternatives: int) -> DataFrame:
    """Columns of the contract in place of the raw ones, all cut behind the first end token:

    greedy_tokens (n), log_probs (n x v), lls (n; of the chosen tokens), alternatives (n x n_alternatives structs of token and lp, the chosen one
    first if it is among them, the others by likelihood, ties by token), attention (n arrays; of token i its greatest over the heads to the i
    tokens before it), text_tokens (without the end token), embedding.
    """
    first = F.array_position("tokens", F.lit(end))
    df = checked(df)
    df = df.withColumn("__n", F.when(first > 0, first).otherwise(F.size("tokens")).cast("int"))
    own = [c for c in df.columns if c not in ("tokens", "logits", "attention", "__n")]
    rows = df.select(*own, "__n", F.slice("tokens", F.lit(1), F.col("__n")).alias("greedy_tokens"), F.slice("logits", F.lit(1), F.col("__n")).alias("__logits"), F.col("attention").alias("__heads"), F.when(first > 0, F.col("__n") - 1).otherwise(F.col("__n")).alias("__text"))
    rows = rows.withColumn("log_probs", F.transform("__logits", A.log_softmax))
    lls = F.zip_with("log_probs", "greedy_tokens", lambda lp, t: F.get(lp, t))
    best = F.zip_with("log_probs", "greedy_tokens", lambda lp, t: _chosen_first(A.top_n(lp, n_alternatives), t))
    # token i sees the i tokens before it; the heads are joined row by row
    seen = F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: F.slice(_most(F.transform("__heads", lambda h: F.slice(F.get(h, i), F.lit(1), i))), F.lit(1), i))
    seen = F.when(F.col("__n") > 0, seen).when(F.col("__n") == 0, F.array().cast("array<array<double>>"))
    return rows.select(*own, "greedy_tokens", F.slice("greedy_tokens", F.lit(1), F.col("__text")).alias("text_tokens"), "log_probs", lls.alias("lls"), best.alias("alternatives"), seen.alias("attention"))


def _chosen_first(top: Column, token: Column) -> Column:
    return F.concat(F.filter(top, lambda s: s["token"] == token), F.filter(top, lambda s: s["token"] != token))


def _most(rows: Column) -> Column:
    """The greatest of each place over arrays of one length; of no array, an empty one."""
    none = F.array().cast("array<double>")
    return F.aggregate(rows, none, lambda a, b: F.when(F.size(a) == 0, b).otherwise(F.zip_with(a, b, lambda x, y: F.greatest(x, y))))


def gather(values: Column, positions: Column) -> Column:
    """Values of the tokens at zero-based positions, as those of a claim; places outside are an error."""
    return F.transform(positions, lambda i: F.when((i < 0) | (i >= F.size(values)), F.raise_error(F.lit("no such token")).cast("double")).otherwise(F.get(values, i)))
