"""What a model says of a text with one token left out, of a token's alternatives, and of an answer's truth: texts made for a provider."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import io
from ..sources.calls import Answers, texts_key
from ..sources.providers import PAIR
from .estimators import combine_nli
from .lookup import lookup

#: Similarity of a text of one token to the empty one, and of special tokens, which are never left out.
LONE, SPECIAL = 0.5, 1.0
#: Punctuation and blanks, which words lose before they are compared.
EDGES = "[!-/:-@\\[-`{-~ \\n]+"


def token_similarity(texts: DataFrame, key: str, prompt: str, tokens: str, special: list[str], answers: Answers, between: str = " ") -> DataFrame:
    """key and `similarity`, one value for each token: how alike the whole text and the one without the token are, behind the prompt.

    Texts are read without special tokens. The provider gives `similarity` of a pair; a pair that several tokens or texts share is asked about
    once. A pair is written out where it is asked about only, and no table has a row for each token: a text is shuffled once, its values are written
    and shuffled once, for all its copies. A text without tokens has an empty array. Rows are unique by key; `texts` is read several times.
    """
    toks, head, gap = F.coalesce(tokens, F.array().cast("array<string>")), F.coalesce(F.col(prompt), F.lit("")), len(between)
    never = lambda t: t.isNull() | F.coalesce(t.isin(special), F.lit(False)) if special else t.isNull()
    said = F.concat("head", F.lit(" "), F.array_join(F.filter("toks", lambda t: ~never(t)), between))
    sizes = F.transform("toks", lambda t: F.when(never(t), F.lit(-1)).otherwise(F.length(t)))
    rows = texts.select(F.col(key).alias("key"), head.alias("head"), toks.alias("toks"))
    rows = rows.select("key", F.size("toks").alias("n"), said.alias("said"), sizes.alias("sizes"))
    some = F.col("n") > 1
    found = answers.ask_texts(rows.where(some), "said", "sizes", lambda text, sizes: _without(text, sizes, gap))
    scored = found.select("row_key", F.transform("found", lambda x: F.when(x.isNull(), F.lit(SPECIAL)).otherwise(x["similarity"])).alias("s"))
    rows = rows.select("key", "n", F.when(some, texts_key(F.col("said"), F.col("sizes"))).alias("row_key"))
    return lookup(rows, scored, "row_key").select(F.col("key").alias(key), F.coalesce("s", F.array_repeat(F.lit(LONE), F.col("n"))).alias("similarity"))


def _without(text: str, sizes: list[int], gap: int) -> Iterator[str | None]:
    """Pairs of a text and what is left of it without each token, given the tokens' lengths, of special ones -1: the token goes with the gap behind
    it, the last one with the gap before it."""
    n = sum(size >= 0 for size in sizes)
    start, k = len(text) - sum(size for size in sizes if size >= 0) - gap * (n - 1), 0
    for size in sizes:
        if size < 0:
            yield None
            continue
        k += 1
        stop = start + size
        yield text + PAIR + (text[:start] + text[stop + gap :] if k < n else text[: start - (gap if n > 1 else 0)])
        start = stop + gap


def alternative_relations(rows: DataFrame, key: str, alternatives: str, answers: Answers) -> DataFrame:
    """key and `relations`: for each position, 'entail', 'neutral' or 'contra' of each alternative to the chosen one, which comes first.

    `alternatives` is an array, by position, of arrays of words. Words lose punctuation at their ends. Both directions are judged, each distinct
    pair of words once in all rows, by the greatest of the provider's entail, neutral and contra, and combined. Rows are unique by key; null and
    empty arrays have no relations.
    """
    spark = rows.sparkSession
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("word", F.lit("")), f"^{EDGES}", ""), f"{EDGES}$", "")
    each = rows.select(F.col(key).alias("key"), F.posexplode(alternatives).alias("pos", "words")).select("key", "pos", F.get("words", F.lit(0)).alias("top"), F.posexplode("words").alias("k", "word"))
    each = each.select("key", "pos", "k", bare.alias("word"), F.regexp_replace(F.regexp_replace(F.coalesce("top", F.lit("")), f"^{EDGES}", ""), f"{EDGES}$", "").alias("top"))
    path = io.scratch(spark, "alternatives")
    each.write.parquet(path)
    each = spark.read.parquet(path)
    words = each.select("top", "word").distinct()
    pairs = words.select("top", "word", F.explode(F.array(F.struct(F.lit("f").alias("way"), F.concat("top", F.lit(PAIR), "word").alias("pair")), F.struct(F.lit("b").alias("way"), F.concat("word", F.lit(PAIR), "top").alias("pair")))).alias("x")).select("top", "word", "x.*")
    judged = answers.ask(pairs, "pair")
    best = F.when((F.col("entail") >= F.col("neutral")) & (F.col("entail") >= F.col("contra")), "entail").when(F.col("neutral") >= F.col("contra"), "neutral").otherwise("contra")
    ways = judged.withColumn("c", F.when(F.col("entail").isNotNull(), best)).groupBy(F.col("top").alias("t"), F.col("word").alias("w")).agg(*(F.max(F.when(F.col("way") == x, F.col("c"))).alias(x) for x in "fb"))
    ways = ways.select("t", "w", combine_nli(F.col("f"), F.col("b")).alias("relation"))
    met = each.join(ways, (F.col("top") == F.col("t")) & (F.col("word") == F.col("w")))
    by_pos = met.groupBy("key", "pos").agg(F.sort_array(F.collect_list(F.struct("k", "relation"))).alias("x")).select("key", "pos", F.col("x.relation").alias("r"))
    return by_pos.groupBy(F.col("key").alias(key)).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "r"))), lambda s: s["r"]).alias("relations"))


def truth_prompt(question: Column, answer: Column, ideas: Column | None = None) -> Column:
    """Whether an answer is true, as a question of two choices; with the ideas of sampled answers, one a line."""
    blank = F.lit("")
    said = F.concat(F.lit("\nIdeas:\n"), F.array_join(ideas, "\n")) if ideas is not None else blank
    return F.concat(F.lit("Question: "), F.coalesce(question, blank), said, F.lit("\nProposed answer: "), F.coalesce(answer, blank), F.lit("\nIs it (A) true or (B) false? It is:"))


def p_true(rows: DataFrame, prompt: str, answers: Answers, out: str = "p_true") -> DataFrame:
    """`rows` with -ln of the probability that the provider, which gives `score`, has for the first choice; infinite probabilities of 0 become null."""
    asked = answers.ask(rows, prompt)
    return asked.withColumn(out, F.when(F.col("score") > 0, -F.log("score"))).drop("score", "error", "provider")
