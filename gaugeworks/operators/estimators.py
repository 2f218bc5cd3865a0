"""Uncertainty estimators as expressions over arrays of one answer: higher means less certain.

ll: log-likelihoods of the answer's tokens; lm: those without the prompt; ent: entropies. An empty array gives null where a mean is taken.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import arrays as A

# Threshold and weight of conditional pointwise mutual information.
TAU, LAMBDA = 0.0656, 3.599


def max_sequence_probability(ll: Column) -> Column:
    return -A.total(ll)


def perplexity(ll: Column) -> Column:
    return -A.mean(ll)


def pmi_terms(ll: Column, lm: Column) -> Column:
    """Minus the pointwise mutual information of each token; the first token has no unconditional part."""
    return F.transform(F.zip_with(ll, lm, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda s, i: -(s["x"] - F.when(i > 0, s["y"]).otherwise(0.0)))


def mean_pmi(ll: Column, lm: Column) -> Column:
    return A.mean(pmi_terms(ll, lm))


def cpmi_terms(ll: Column, lm: Column, ent: Column, tau: float = TAU, weight: float = LAMBDA) -> Column:
    """As pmi_terms, with the unconditional part weighted and taken only where the entropy reaches tau."""
    rows = F.zip_with(F.zip_with(ll, lm, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), ent, lambda s, e: F.struct(s["x"].alias("x"), s["y"].alias("y"), e.alias("e")))
    return F.transform(rows, lambda s, i: -(s["x"] - F.when((i > 0) & (s["e"] >= tau), weight * s["y"]).otherwise(0.0)))


def mean_cpmi(ll: Column, lm: Column, ent: Column) -> Column:
    return A.mean(cpmi_terms(ll, lm, ent))


def token_sar(ll: Column, similarity: Column) -> Column:
    """Surprisal weighted by relevance, one minus the similarity of the answer without the token."""
    relevance = F.transform(similarity, lambda s: 1 - s)
    return F.try_divide(A.total(F.zip_with(ll, relevance, lambda x, r: -x * r)), A.total(relevance))


def model_score(ll: Column) -> Column:
    """Length-normalised log-likelihood."""
    return A.mean(ll)


def focus_weight(lp: Column) -> Column:
    """2 to the entropy in bits, minus the log-probability of the likeliest token."""
    return F.pow(F.lit(2.0), A.entropy(lp) / F.log(F.lit(2.0))) - F.array_max(lp)


def combine_nli(forward: Column, backward: Column) -> Column:
    return F.when(forward == backward, forward).when((forward != "neutral") & (backward != "neutral"), "neutral").when(forward == "neutral", backward).otherwise(forward)


def ccp_token(alternatives: Column, relations: Column) -> Column:
    """ln of the share of entailing alternatives among entailing and contradicting ones; the chosen token comes first and entails."""
    rows = F.zip_with(alternatives, relations, lambda a, r: F.struct(a["lp"].alias("lp"), r.alias("r")))
    some = lambda kinds: A.logsumexp(F.transform(F.filter(rows, lambda s: s["r"].isin(kinds)), lambda s: s["lp"]))
    return some(["entail"]) - some(["entail", "contra"])


def claim_pmi(ll: Column, lm: Column, ids: Column) -> Column:
    return A.total(F.transform(ids, lambda i: -(F.get(ll, i) - F.when(i > 0, F.get(lm, i)).otherwise(0.0))))


def hash_uniform(a: Column, b: Column) -> Column:
    """A repeatable stand-in of a uniform number."""
    return ((a * 1000003 + b * 7919) % 10007) / F.lit(10007.0)


def verbalized(reply: Column, pattern: str) -> Column:
    """One minus the confidence that a reply states; null where it states none."""
    return 1 - F.nullif(F.regexp_extract(reply, pattern, 1), F.lit("")).try_cast("double")


def linguistic(reply: Column, confidences: dict[str, float]) -> Column:
    """One minus the confidence of the first expression, in the dictionary's order, that a reply holds."""
    out = F.lit(None).cast("double")
    for words, c in reversed(confidences.items()):
        out = F.when(reply.contains(words), F.lit(round(1 - c, 12))).otherwise(out)
    return out


def reduce_claim(logits: Column, kind: str) -> Column:
    """Token logits of a claim to one value."""
    p = F.transform(logits, A.sigmoid)
    forms = {"mean_logits": lambda: A.mean(logits), "mean": lambda: A.mean(p), "prod_geom": lambda: A.product(p), "mean_geom": lambda: F.try_divide(A.product(p), F.size(p)), "max": lambda: F.array_max(p), "min": lambda: F.array_min(p)}
    return forms[kind]()


def softmax_pair(positive: Column, negative: Column) -> Column:
    """Probability of the first of two logits."""
    return A.sigmoid(positive - negative)


def flagged(values: Column, flags: Column) -> Column:
    """The values whose flag is set, through a sigmoid: rewards at the ends of steps."""
    return F.transform(F.filter(F.zip_with(values, flags, lambda v, f: F.when(f, v)), lambda v: v.isNotNull()), A.sigmoid)


def majority_mean(votes: Column) -> Column:
    """Share of the votes that say yes; null without votes."""
    return F.try_divide(F.size(F.filter(votes, lambda v: v == 1)), F.size(votes))


def validity_and_redundancy(logits: Column) -> Column:
    """struct<validity, redundancy> of three logits: wrong, redundant, useful."""
    p = A.log_softmax(logits)
    at = lambda k: F.exp(F.get(p, F.lit(k)))
    return F.struct((at(1) + at(2)).alias("validity"), at(1).alias("redundancy"))


def length_penalised(logprob: Column, length: Column, alpha: float) -> Column:
    return F.try_divide(logprob, F.pow(length.cast("double"), F.lit(alpha)))


def shifted(ids: Column, special: Column, context: int) -> Column:
    """Token positions counted without special tokens, behind a context; special ones are dropped."""
    plain = F.filter(ids, lambda i: ~F.get(special, i))
    return F.transform(plain, lambda i: context + i - F.size(F.filter(F.slice(special, F.lit(1), i), lambda s: s)))
