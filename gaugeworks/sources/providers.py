"""Model calls behind one interface. A provider is pure: equal input gives equal output, so answers may be cached and asked for again.

Here are deterministic stand-ins only; their outputs carry provider='standin'.
"""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    name: str
    schema: str

    def answer(self, texts: list[str]) -> pd.DataFrame:
        """One row per text, with the columns of `schema`."""


class EchoChat:
    """Replies with the prompt."""

    name, schema = "standin", "reply string"

    def answer(self, texts: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"reply": texts})


class HashScore:
    """A number in [0, 1) from the text's digest, for rewards, claim scores and p(True)."""

    name, schema = "standin", "score double"

    def answer(self, texts: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"score": [int(hashlib.sha256(t.encode()).hexdigest()[:12], 16) / 16**12 for t in texts]})


class PerText:
    """A stand-in given by a function of one text, which returns the values of the schema's columns, none of them a struct."""

    name = "standin"

    def __init__(self, schema: str, function: Callable[[str], tuple]):
        self.schema, self.function = schema, function

    def answer(self, texts: list[str]) -> pd.DataFrame:
        return pd.DataFrame([self.function(t) for t in texts], columns=re.findall(r"(\w+) [a-z]", self.schema))


def digest(*parts) -> str:
    return hashlib.sha256(PAIR.join(map(str, parts)).encode()).hexdigest()


def step_samples(n: int) -> PerText:
    """`n` next steps of a trajectory; one in two ends it."""

    def samples(text: str) -> tuple:
        found = [digest(text, k) for k in range(n)]
        return ([f"- Step {d[:8]}\n" + ("<Answer>:" if d[8] in "01234567" else "") for d in found],)

    return PerText("samples array<string>", samples)


def answer_samples(n: int) -> PerText:
    return PerText("samples array<string>", lambda text: ([" " + digest(text, "answer", k)[:6] for k in range(n)],))


def claim_scores() -> PerText:
    """Uncertainties of up to three claims of a trajectory and a candidate."""

    def scores(text: str) -> tuple:
        d = digest(text)
        return ([int(d[3 * k + 1 : 3 * k + 4], 16) / 4095 for k in range(int(d[0], 16) % 4)],)

    return PerText("uncertainties array<double>", scores)


def prefix_likelihoods() -> PerText:
    """Log-likelihood of each word by its length, the length of the word before it, and the number of words before."""

    def lls(text: str) -> tuple:
        before, _, after = text.partition(PAIR)
        before, out = before.split(), []
        for w in after.split():
            out.append(-math.log(1 + len(w)) - (len(before[-1]) if before else 0) / 100 - 1 / (1 + len(before)))
            before.append(w)
        return (out,)

    return PerText("lls array<double>", lls)


def greedy_outputs(end: int = 7, heads: int = 2) -> PerText:
    """A token of eight for each word, by its digest, up to the end token and three beyond, as a batch is padded; attention by digest as well."""

    def outputs(text: str) -> tuple:
        tokens, logits, attention = [], [], [[] for _ in range(heads)]
        for i, d in enumerate(map(digest, text.split())):
            logits.append([int(c, 16) / 4 for c in d[:8]])
            tokens.append(logits[-1].index(max(logits[-1])))
            for h in range(heads):
                attention[h].append([int(d[8 + (7 * h + j) % 50], 16) / 15 for j in range(i + 1)])
            if end in tokens[:-3]:
                break
        return tokens, logits, attention, [float(len(tokens))]

    return PerText("tokens array<int>, logits array<array<double>>, attention array<array<array<double>>>, embedding array<double>", outputs)


def word_vectors() -> PerText:
    """The words of a text with vectors of four numbers by their digests."""
    return PerText("tokens array<string>, vectors array<array<double>>", lambda t: (t.split(), [[b / 127.5 - 1 for b in bytes.fromhex(digest(w)[:8])] for w in t.split()]))


class HashEmbedding:
    """Sixteen numbers from the text's digest."""

    name, schema = "standin", "vec array<double>"

    def answer(self, texts: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"vec": [[b / 127.5 - 1 for b in hashlib.sha256(t.encode()).digest()[:16]] for t in texts]})


#: Between the two texts of a pair, and between a context and what is scored in it.
PAIR = "\x1e"


def _overlap(text: str) -> float:
    """The Jaccard similarity of a pair's words."""
    a, b = (set(x.split()) for x in text.split(PAIR, 1))
    return len(a & b) / len(a | b) if a | b else 0.0


class OverlapNli:
    """Entailment, neutrality and contradiction of a pair from the words it shares."""

    name, schema = "standin", "entail double, neutral double, contra double"

    def answer(self, texts: list[str]) -> pd.DataFrame:
        entail = [1.0 if t.split(PAIR, 1)[0] == t.split(PAIR, 1)[1] else min(1.0, 10 * _overlap(t)) for t in texts]
        return pd.DataFrame({"entail": entail, "neutral": [(1 - e) / 2 for e in entail], "contra": [(1 - e) / 2 for e in entail]})


class OverlapSimilarity:
    """Similarity of a pair in [0, 1]."""

    name, schema = "standin", "similarity double"

    def answer(self, texts: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"similarity": [_overlap(t) for t in texts]})


class RotatingSamples:
    """`n` continuations of a prompt: its words from the k-th on, then the first ones."""

    name, schema = "standin", "samples array<string>"

    def __init__(self, n: int):
        self.n = n

    def answer(self, texts: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"samples": [[" ".join(w[k:] + w[:k]) for k in range(self.n)] for w in (t.split() for t in texts)]})


class LengthLikelihood:
    """Log-likelihood of each word of a text given a context: the longer the word, and the shorter the context, the less likely."""

    name, schema = "standin", "lls array<double>"

    def answer(self, texts: list[str]) -> pd.DataFrame:
        pairs = [t.split(PAIR, 1) for t in texts]
        return pd.DataFrame({"lls": [[-math.log(1 + len(w)) - 1 / (1 + len(context.split())) for w in text.split()] for context, text in pairs]})


class Alternatives:
    """The `top` most likely words at each position of a text, the chosen one first, as closed models give them: words and log-probabilities."""

    name, schema = "standin", "alternatives array<array<struct<token:string,logprob:double>>>"

    def __init__(self, top: int):
        self.top = top

    def answer(self, texts: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"alternatives": [[[{"token": w + "~" * k, "logprob": -math.log(2) * (k + 1)} for k in range(self.top)] for w in t.split()] for t in texts]})


#: Width of the vector that words of unknown vocabularies are hashed into.
HASHED = 50_000


def hashed_index(token) -> Column:
    """A word's place in that vector."""
    return F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % HASHED


class Retrying:
    """A provider that is asked again after an error of the connection, with the waits of a remote service; the last error is raised.

    A batch is asked as one. If that fails, what is left of it is asked prompt by prompt, each with waits of its own, so an answer that has come
    is not asked for again. Errors of other kinds are raised at once.
    """

    def __init__(self, provider: Provider, waits: tuple[float, ...] = (5, 10, 30, 60, 120), sleep=time.sleep, transient: tuple[type[Exception], ...] = (ConnectionError, TimeoutError)):
        self.provider, self.waits, self.sleep, self.transient = provider, waits, sleep, transient
        self.name, self.schema = provider.name, provider.schema

    def _one(self, text: str, waits: tuple[float, ...]) -> pd.DataFrame:
        for wait in waits:
            try:
                return self.provider.answer([text])
            except self.transient:
                self.sleep(wait)
        return self.provider.answer([text])

    def answer(self, texts: list[str]) -> pd.DataFrame:
        try:
            return self.provider.answer(texts)
        except self.transient:
            if not self.waits:
                raise
            self.sleep(self.waits[0])
        return pd.concat([self._one(t, self.waits[1:]) for t in texts], ignore_index=True)


class Unsteady:
    """Fails `failures` times before each answer; for tests of retries."""

    def __init__(self, provider: Provider, failures: int):
        self.provider, self.failures, self.left = provider, failures, failures
        self.name, self.schema = provider.name, provider.schema

    def answer(self, texts: list[str]) -> pd.DataFrame:
        if self.left:
            self.left -= 1
            raise ConnectionError("busy")
        self.left = self.failures
        return self.provider.answer(texts)


def route_of(model: Column, keys: list[str]) -> Column:
    """The longest of `keys` that a model's name begins with; null if there is none."""
    return F.coalesce(*(F.when(model.startswith(k), F.lit(k)) for k in sorted(keys, key=len, reverse=True)), F.lit(None).cast("string"))


def routed(df: DataFrame, providers: dict[str, Provider], model: str, prompt: str) -> DataFrame:
    """`df` with columns `score`, `route`, `reason` and `provider`, in one pass: each row is scored by the provider of its model's name.

    Any number of names. Rows with a null name, or one that no provider is for, stay, with a null score and the reason for it. All providers give
    a column `score`.
    """
    from pyspark.sql import types as T

    name = F.col(model)
    rows = df.withColumn("route", route_of(name, list(providers)))
    rows = rows.withColumn("reason", F.when(name.isNull(), "no model name").when(F.col("route").isNull(), F.concat(F.lit("no provider for "), name)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.reset_index(drop=True).assign(score=None, provider=None)
            for key, at in pdf.groupby("route").groups.items():  # null routes are in no group
                pdf.loc[at, "score"] = providers[key].answer(pdf.loc[at, prompt].fillna("").tolist())["score"].to_numpy()
                pdf.loc[at, "provider"] = providers[key].name
            yield pdf.astype({"score": "float64"})

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("provider", T.StringType())]))


def apply(df: DataFrame, provider: Provider, prompt: str) -> DataFrame:
    """`df` with the provider's columns; one call for each Arrow batch."""
    from pyspark.sql import types as T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = provider.answer(pdf[prompt].fillna("").tolist())
            yield pd.concat([pdf.reset_index(drop=True), found.reset_index(drop=True)], axis=1)

    return df.mapInPandas(run, T.StructType([*df.schema.fields, *T._parse_datatype_string(provider.schema).fields])).withColumn("provider", F.lit(provider.name))


def ask(df: DataFrame, provider: Provider, prompt: str, cache: DataFrame | None = None) -> DataFrame:
    """As apply, but each distinct prompt is asked once, and not at all if the cache (prompt and the provider's columns) has it; answers are
    written before they are used."""
    from .calls import Answers

    answers = Answers(df.sparkSession, provider)
    if cache is not None:
        answers.add(cache, prompt)
    return answers.ask(df, prompt).drop("error")


def by_prefix(providers: dict[str, Provider], name: str) -> Provider:
    """The provider whose key is the longest beginning of a model's name."""
    keys = sorted((k for k in providers if name.startswith(k)), key=len)
    if not keys:
        raise KeyError(f"no provider for {name}")
    return providers[keys[-1]]
