"""Fact checks of claims by a model: in order until the first wrong one, and by dialogues of two calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.calls import Answers, two_calls
from ..sources.providers import Provider

STEP_PROMPT = "Problem: {problem}\nKnown answer: {answer}\nSteps so far: {steps}\nIs this step right? {step}\nReply with 1 if it is, else with 0."


def read_binary(reply: str | None) -> float | None:
    """1 or 0 if a reply has one of the digits only."""
    one, zero = "1" in (reply or ""), "0" in (reply or "")
    return None if one == zero else float(one)


def until_wrong(rows: DataFrame, key: str, problem: str, answer: str, claims: str, provider: Provider, prompt: str = STEP_PROMPT, side_by_side: int = 64) -> DataFrame:
    """key, claim_idx, prompt, reply and label, one row for each claim that was asked about.

    `claims` is an array of structs (sentence, claim, aligned) in order. Claim k is asked about with all sentences up to it, and only where no
    claim before it was found wrong; a reply that cannot be read stops nothing. label: 1 wrong, 0 right, null unread or not aligned to any token.
    Documents do not wait for one another across tasks: each task takes `side_by_side` documents at a time, asks about the next claim of all that
    go on in one call, and lets them go as they end; that also bounds the calls in flight. Nothing is shuffled, and a document of many claims
    costs as many calls but no job. Null problems, answers and sentences are empty texts; no claims, no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), side_by_side):
                part = batch.iloc[at : at + side_by_side]
                going = [(k, p or "", a or "", c, []) for k, p, a, c in zip(part[key], part[problem], part[answer], part[claims], strict=True) if c is not None and len(c)]
                number, out = 0, []
                while going:
                    prompts = []
                    for _, p, a, c, said in going:
                        said.append(c[number]["sentence"] or "")
                        prompts.append(prompt.format(problem=p, answer=a, steps=" ".join(said), step=c[number]["claim"] or ""))
                    replies, kept = provider.answer(prompts)["reply"], []
                    for one, asked, reply in zip(going, prompts, replies, strict=True):
                        found = read_binary(reply)
                        out.append((one[0], number, asked, reply, 1 - found if found is not None and one[3][number]["aligned"] else None))
                        if found != 0 and number + 1 < len(one[3]):
                            kept.append(one)
                    going, number = kept, number + 1
                if out:
                    yield pd.DataFrame(out, columns=[key, "claim_idx", "prompt", "reply", "label"]).astype({"label": "float64"})

    slim = rows.select(key, problem, answer, claims)
    return slim.mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, claim_idx int, prompt string, reply string, label double")


def checked_facts(claims: DataFrame, claim: str, source: str, first: Answers, second: Answers) -> DataFrame:
    """`claims` with first_reply, reply and label: a model says what it makes of a claim, then sums its own reply up in a word. 1 false, 0 true."""
    head = F.concat(F.lit("Is this claim true? "), F.coalesce(claim, F.lit("")), F.lit("\nIt was said about: "), F.coalesce(source, F.lit("")))
    follow = lambda p, r: F.concat(p, F.lit("\nA judge found: "), r, F.lit("\nSum up in one word, True or False."))
    asked = two_calls(claims.withColumn("__prompt", head), first, second, "__prompt", follow)
    return asked.drop("__prompt").withColumn("label", X.fact_check(F.col("reply")))


def verbalized(questions: DataFrame, prompt: str, first: Answers, second: Answers, pattern: str = r"(?i)probability:\s*([01](?:\.\d+)?|\.\d+)") -> DataFrame:
    """`questions` with the model's guess (first_reply), its reply to how likely the guess is right, and ue, 1 less that number; null if unread."""
    follow = lambda p, r: F.concat(p, F.lit("\nGuess: "), r, F.lit("\nHow likely is the guess right? Reply as Probability: 0 to 1."))
    asked = two_calls(questions, first, second, prompt, follow)
    return asked.withColumn("ue", 1 - probability(F.col("reply"), pattern))


def probability(reply: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(reply, pattern, 1), F.lit("")).cast("double")
