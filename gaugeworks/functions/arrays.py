"""Array expressions: each takes and gives columns and runs inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def mean(x: Column) -> Column:
    """Mean; null for an empty array."""
    return F.try_divide(total(x), F.size(x))


def product(x: Column) -> Column:
    return F.aggregate(x, F.lit(1.0), lambda s, v: s * v)


def drop_last(x: Column) -> Column:
    return F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0)))


def logsumexp(x: Column) -> Column:
    """ln of the sum of exponentials; null for an empty array."""
    top = F.array_max(x)
    return top + F.log(total(F.transform(x, lambda v: F.exp(v - top))))


def log_softmax(x: Column) -> Column:
    """`x` should be a column of its own: it is read again for each element."""
    norm = logsumexp(x)
    return F.zip_with(x, F.array_repeat(norm, F.size(x)), lambda v, n: v - n)


def entropy(log_probs: Column) -> Column:
    """-sum p ln p of an array of log-probabilities; entries without mass add nothing."""
    return -total(F.transform(log_probs, lambda v: F.when(v > float("-inf"), v * F.exp(v)).otherwise(0.0)))


def tempered(log_probs: Column, temperature: float) -> Column:
    """Log-probabilities after division by a temperature."""
    return log_softmax(F.transform(log_probs, lambda v: v / temperature))


def gather(x: Column, ids: Column) -> Column:
    """The elements of x at zero-based positions; positions outside are dropped."""
    return F.filter(F.transform(ids, lambda i: F.get(x, i)), lambda v: v.isNotNull())


def top_n(log_probs: Column, n: int) -> Column:
    """The n most likely (token, lp), ties by token, chosen first."""
    pairs = F.sort_array(F.transform(log_probs, lambda v, i: F.struct((-v).alias("o"), i.alias("token"), v.alias("lp"))))
    return F.transform(F.slice(pairs, 1, n), lambda s: F.struct(s["token"].alias("token"), s["lp"].alias("lp")))


def renyi(log_probs: Column, alpha: float, temperature: float = 2.0) -> Column:
    """Rényi divergence of the tempered distribution from the uniform one."""
    lp = tempered(log_probs, temperature)
    v = F.log(F.size(log_probs).cast("double"))
    if alpha == 1.0:
        return total(F.transform(lp, lambda x: x * F.exp(x))) + v
    power = F.log(total(F.transform(lp, lambda x: F.exp(alpha * x))))
    return (power - (1 - alpha) * v) / (alpha - 1)


def fisher_rao(log_probs: Column, temperature: float = 2.0) -> Column:
    """Fisher-Rao distance of the tempered distribution from the uniform one, scaled to [0, 1]."""
    lp = tempered(log_probs, temperature)
    overlap = total(F.transform(lp, lambda x: F.exp(x / 2))) * F.sqrt(1 / F.size(log_probs))
    return 2 / F.lit(3.141592653589793) * F.acos(F.least(F.lit(1.0), overlap))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def set_jaccard(a: Column, b: Column) -> Column:
    """As jaccard, of arrays without repeats: both are read once."""
    n = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(n, F.size(a) + F.size(b) - n), F.lit(0.0))


def run_starts(x: Column) -> Column:
    """Where each run of equal elements begins; `x` should be a sorted column."""
    return F.filter(F.transform(x, lambda w, i: F.when((i == 0) | (w != F.get(x, i - 1)), i)), lambda i: i.isNotNull())


def numbered(x: Column, starts: Column) -> Column:
    """Sorted words, each with its place in its run, so that sets of them meet as bags do. `starts`: a column of run_starts."""
    end = lambda r: F.coalesce(F.get(starts, r + 1), F.size(x)) - 1
    return F.flatten(F.transform(starts, lambda p, r: F.transform(F.sequence(p, end(r)), lambda q: F.concat(F.get(x, p), F.lit(" "), (q - p).cast("string")))))
