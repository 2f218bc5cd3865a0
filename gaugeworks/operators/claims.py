"""Claims of generated texts by a dialogue in stages: sentences, their claims, the words that say each claim, the tokens that hold these words."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequential
from ..functions import text as X
from ..sources import io
from ..sources.calls import Answers

#: What ends a sentence.
SEPARATORS = re.compile("[.?!。？！\n]")
EXTRACT = "List the claims of this sentence, one a line, each behind a dash.\nSentence: "
MATCH = ("Which words of the sentence say the claim? Reply with the words, comma-separated.\nSentence: ", "\nClaim: ")


def extract(texts: DataFrame, key: str, text: str, tokens: str, claims_of: Answers, words_of: Answers) -> DataFrame:
    """key, sentence_idx, claim_idx (in its sentence), sentence, claim, token_ids, and failure: null, or the stage that a row ended at.

    `tokens` are the decoded tokens of `text`, laid end to end. An unfinished last sentence is left out. Both calls are keyed by their prompt and
    written; a sentence or claim that occurs many times is asked about once. Rows that fail stay, with a reason: 'no reply' of either call, 'no
    claims', 'not found' (words that the sentence does not have in this order), 'no tokens'. Rows are unique by key.
    """
    spark = texts.sparkSession
    spans = F.udf(_spans, "array<struct<sentence:string,start:int,lead:int,tokens:array<string>>>", useArrow=True)
    sentences = texts.select(key, F.posexplode(spans(text, tokens)).alias("sentence_idx", "s")).select(key, "sentence_idx", "s.*")
    path = io.scratch(spark, "sentences")
    sentences.withColumn("ask", F.concat(F.lit(EXTRACT), "sentence")).write.parquet(path)
    asked = claims_of.ask(spark.read.parquet(path), "ask").drop("ask", "provider", "error")
    found = asked.withColumn("claims", F.coalesce(X.bullet_claims(F.col("reply")), F.array().cast("array<string>")))
    found = found.select(key, "sentence_idx", "sentence", "start", "lead", "tokens", F.col("reply").isNull().alias("silent"), F.posexplode_outer("claims").alias("claim_idx", "claim"))
    prompt = F.concat(F.lit(MATCH[0]), "sentence", F.lit(MATCH[1]), "claim")
    path = io.scratch(spark, "claims")
    found.withColumn("ask", F.when(F.col("claim").isNotNull(), prompt)).write.parquet(path)
    asked = words_of.ask(spark.read.parquet(path), "ask")
    place = F.udf(_tokens, "struct<ids:array<int>,failure:string>", useArrow=True)
    rows = asked.withColumn("at", place("sentence", "tokens", "start", "lead", "reply"))
    failure = F.when(F.col("silent"), "no reply").when(F.col("claim").isNull(), "no claims").when(F.col("reply").isNull(), "no reply").otherwise(F.col("at.failure"))
    return rows.select(key, "sentence_idx", "claim_idx", "sentence", "claim", F.when(failure.isNull(), F.col("at.ids")).alias("token_ids"), failure.alias("failure"))


def _spans(text: str | None, tokens) -> list[dict]:
    """Finished sentences with the tokens that lie in them, where the first of these begins in the sentence, and the number of tokens before."""
    text, tokens = text or "", list(tokens) if tokens is not None else []
    out, at, first, begin = [], 0, 0, 0  # begin: where tokens[first] begins
    for piece in SEPARATORS.split(text):
        start, stop = at, at + len(piece)
        at = stop + 1
        if not piece or stop >= len(text):  # what stands behind the last separator is unfinished
            continue
        while first < len(tokens) and begin < start:
            begin += len(tokens[first])
            first += 1
        own, end = [], begin
        for token in tokens[first:]:
            end += len(token)
            if end > stop:
                break
            own.append(token)
        out.append({"sentence": piece, "start": first, "lead": begin - start, "tokens": own})
    return out


def _tokens(sentence: str, tokens, start: int, lead: int, reply: str | None) -> dict | None:
    if reply is None:
        return None
    mask = sequential.match_mask(sentence, [w.strip() for w in reply.strip().split(",")])
    if mask is None:
        return {"ids": None, "failure": "not found"}
    ids = [start + k for k in sequential.tokens_of_mask(mask[lead:], list(tokens))]
    return {"ids": ids, "failure": None if ids else "no tokens"}
