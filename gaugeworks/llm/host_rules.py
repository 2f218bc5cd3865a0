"""Quality rules with host-level verdicts; DataFrame functions only.

Rules of a document fail by themselves (BASE) or only count against its host (SOFT). The failures of each host are aggregated, and each rate
is shrunk with a beta prior fitted on all hosts by the method of moments. A host whose shrunk rate lies DEVIATIONS standard deviations of the
prior above its mean loses its documents; that limit is held between LOWEST_LIMIT and HIGHEST_LIMIT, so that neither hosts that differ little
nor a crowd of bad hosts decide alone.

A null text has no word, so it fails. A null host is a host of its own. Repeated rows count each. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Written

SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent
GRAM = 5
#: See above: the limit of a host's shrunk failure rate.
DEVIATIONS, LOWEST_LIMIT, HIGHEST_LIMIT = 3.0, 0.3, 0.5
#: The hosts' verdicts are broadcast up to this many rows (about 50 bytes each); beyond it they are joined by a salted shuffle.
BROADCAST_HOSTS = 50_000
SALTS = 64


def gram_hashes(words: Column) -> Column:
    """64-bit hashes of all windows of GRAM words, in order. `words` is a column of its own: a lambda evaluates what it names for each element."""
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(0), n - GRAM), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(GRAM))))
    return F.when(n >= GRAM, grams).otherwise(F.array().cast("array<bigint>"))


def with_repeated_words(rows: DataFrame, grams: str, out: str) -> DataFrame:
    """`rows` with the number of words inside windows that occur twice or more, the first occurrence included.

    Texts whose windows all differ, the most, stop at a count of distinct hashes. The others sort their hashes with positions, take those
    equal to a neighbour, and add up what these windows cover. Each step is a column, used twice, so that it is evaluated once.
    """
    many = F.size(grams) != F.size(F.array_distinct(grams))
    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    rows = rows.withColumn("__pairs", F.when(many, pairs).otherwise(F.array().cast("array<struct<g:bigint,i:int>>"))).drop(grams)
    rows = rows.withColumn("__next", F.zip_with("__pairs", F.expr("slice(__pairs, 2, greatest(size(__pairs), 1))"), lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))))
    hit = F.zip_with("__next", F.concat(F.array(F.lit(False)), F.col("__next")), lambda x, y: F.coalesce(x, F.lit(False)) | y)
    spots = F.filter(F.zip_with("__pairs", hit, lambda x, h: F.when(h, x["i"])), lambda i: i.isNotNull())
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    total = F.aggregate(F.sort_array(spots), start, lambda s, i: F.struct((s["n"] + GRAM - F.greatest(F.lit(0), s["to"] - i)).cast("int").alias("n"), (i + GRAM).cast("int").alias("to")))
    return rows.withColumn(out, total["n"].cast("long")).drop("__pairs", "__next")


def measure(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = docs.select(
        F.col(id_col).alias("__id"),
        F.col(host_col).alias("__host"),
        F.filter(F.split(text, SPACES), lambda w: w != "").alias("__words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("__symbols"),
    )
    grams = parts.select(
        "__id",
        "__host",
        F.size("__words").cast("long").alias("__n"),
        F.length(F.array_join("__words", "")).cast("long").alias("__chars"),
        "__symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__dup"),
        F.size("__lines").alias("__n_lines"),
        gram_hashes(F.col("__words")).alias("__grams"),
    )
    return with_repeated_words(grams, "__grams", "__repeat")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per document: its measures, whether it fails by itself, its host's shrunk failure rate, and whether it is kept."""
    failed = (F.col("__n") < LEAST_WORDS) | (100 * F.col("__repeat") > MOST_REPEATED * F.col("__n"))
    soft = failed | (20 * F.col("__symbols") > F.col("__chars")) | (2 * F.col("__dup") > F.col("__n_lines"))
    rows = Written(measure(docs, id_col, text_col, host_col).withColumn("__failed", failed).withColumn("__soft", soft), "host-rules", slim=True).df
    hosts = rows.groupBy("__host").agg(F.count("*").alias("__docs"), F.sum(F.col("__soft").cast("long")).alias("__fails"))
    hosts = Written(hosts, "host-rules-hosts").df
    rate = F.col("__fails") / F.col("__docs")
    # beta prior by moments over the hosts: one row
    moments = hosts.agg(F.avg(rate).alias("__m"), F.var_pop(rate).alias("__v"), F.count("*").alias("__hosts"))
    m, v = F.col("__m"), F.greatest(F.col("__v"), F.lit(1e-6))
    strength = F.least(F.greatest(m * (1 - m) / v - 1, F.lit(1.0)), F.lit(10_000.0))
    prior = moments.select((m * strength).alias("__a"), ((1 - m) * strength).alias("__b"), "__hosts").first()
    a, b, n_hosts = (prior["__a"] or 0.0), (prior["__b"] or 0.0), prior["__hosts"]
    mean = a / (a + b) if a + b else 0.0
    limit = max(LOWEST_LIMIT, min(HIGHEST_LIMIT, mean + DEVIATIONS * math.sqrt(mean * (1 - mean) / (a + b + 1))))
    verdicts = hosts.select(F.col("__host").alias("__h"), ((F.col("__fails") + F.lit(a)) / (F.col("__docs") + F.lit(a + b))).alias("__rate"))
    if n_hosts <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(verdicts), F.col("__host").eqNullSafe(F.col("__h")))
    else:
        salted = verdicts.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__id", "__chars"), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, F.col("__host").eqNullSafe(F.col("__h")) & (F.col("__salt") == F.col("__s")))
    return joined.select(
        F.col("__id").alias(id_col),
        F.col("__n").alias("n_words"),
        F.col("__chars").alias("word_chars"),
        F.col("__symbols").alias("n_symbols"),
        F.col("__dup").alias("n_dup_lines"),
        F.col("__repeat").alias("n_repeat_words"),
        F.col("__failed").alias("base_failed"),
        F.round("__rate", 6).alias("host_rate"),
        (~F.col("__failed") & (F.col("__rate") <= limit)).alias("kept"),
    )
