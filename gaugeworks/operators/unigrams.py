"""Word likelihoods under unigram models, laid along the words of each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import io

#: Words that are looked up where the texts lie, 24 bytes each; the others meet their texts by shuffle. Rows of a batch that are worked on at once.
FREQUENT, ROWS = 500_000, 512
VALUES = ("ll", "lm", "ent")


def model(rows: DataFrame, group: str, tokens: str) -> DataFrame:
    """group, tok and how often it occurs: c in the group, t among all; c_group and c_all, the words of the group and all words. The texts are read
    once."""
    path = io.scratch(rows.sparkSession, "word-counts")
    rows.select(group, F.explode(tokens).alias("tok")).groupBy(group, "tok").agg(F.count("*").alias("c")).write.parquet(path)  # read by three sums
    pairs = rows.sparkSession.read.parquet(path)
    pairs = pairs.withColumn("t", F.sum("c").over(Window.partitionBy("tok")))  # a row for each group
    by_group = pairs.groupBy(group).agg(F.sum("c").alias("c_group"))
    return pairs.join(by_group, group).crossJoin(pairs.agg(F.sum("c").alias("c_all")))  # one row


def _hash(group: Column, tok: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), group, tok)


def likelihoods(counted: DataFrame, fields: tuple[str, ...] = VALUES) -> DataFrame:
    """The columns of `fields` for the counts of `counts_along`: ll (log of the share among the group's words), lm (among all words) and
    ent = -ll exp(ll)."""
    ll = lambda x: F.log(x / F.col("c_group"))
    made = {"ll": F.transform("c", ll), "lm": F.transform("t", lambda x: F.log(x / F.col("c_all"))), "ent": F.transform(F.transform("c", ll), lambda x: -x * F.exp(x))}
    return counted.select(*(x for x in counted.columns if x not in ("c", "t", "c_group", "c_all")), *(made[f].alias(f) for f in fields))


def along(rows: DataFrame, keys: list[str], group: str, tokens: str, words: DataFrame) -> DataFrame:
    """keys, group and the arrays ll, lm and ent, one value for each token."""
    return likelihoods(counts_along(rows, keys, group, tokens, words))


def counts_along(rows: DataFrame, keys: list[str], group: str, tokens: str, words: DataFrame) -> DataFrame:
    """keys, group, the arrays c and t, one count for each token, c_group and c_all. `words` is a model, written or cheap.

    Words go by a hash of 64 bits under which no two words of the model meet: another seed is taken while some do. The FREQUENT most frequent
    ones are looked up in each task. The others, of a text once each, are shuffled to the model and come back as an array in the order of their
    first numbers in the text. Counts are small numbers, which files and shuffles keep in few bytes. Texts without a token or a group are left
    out. Rows are unique by their keys, which are not null.
    """
    spark = rows.sparkSession
    words = words.where(F.col(group).isNotNull())
    seed = next(k for k in range(9) if words.groupBy(_hash(F.col(group), F.col("tok"), k)).count().where("count > 1").isEmpty())
    words = words.select(_hash(F.col(group), F.col("tok"), seed).alias("h"), group, "c", "t", "c_group", "c_all")
    # the least count of which at most FREQUENT words have as much or more
    least = words.groupBy("c").agg(F.count("*").alias("n")).withColumn("n", F.sum("n").over(Window.orderBy(F.desc("c")))).where(F.col("n") <= FREQUENT).agg(F.min("c")).first()[0]
    common = words.where(F.col("c") >= F.lit(least)).select("h", "c", "t").toArrow() if least else pa.table({x: pa.array([], pa.int64()) for x in ("h", "c", "t")})
    h, c, t = (common.column(k).to_numpy() for k in range(3))
    order = np.argsort(h)
    shared = spark.sparkContext.broadcast((h[order], c[order], t[order]))  # FREQUENT words
    asked = rows.where(F.col(group).isNotNull() & (F.size(tokens) > 0)).select(*keys, group, F.transform(tokens, lambda w: _hash(F.col(group), w, seed)).alias("h"))
    n_keys, long = len(keys), T.ArrayType(T.LongType())
    schema = T.StructType([*asked.schema.fields[:-1], T.StructField("c", long), T.StructField("t", long), T.StructField("rare", long)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, c, t = shared.value
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                listed = batch.column(n_keys + 1)
                sizes = np.diff(listed.offsets.to_numpy())
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                names, word = np.unique(listed.flatten().to_numpy(), return_inverse=True)
                place = np.minimum(np.searchsorted(known, names), max(len(known) - 1, 0))
                found = known[place] == names if len(known) else np.zeros(len(names), bool)
                first, second = (np.where(found, x[place], 0)[word] if len(known) else np.zeros(len(word), np.int64) for x in (c, t))
                # distinct rare words of each row, numbered from -1 downwards within it
                missing, n = ~found[word], max(len(names), 1)
                row = np.repeat(np.arange(len(batch)), sizes)[missing]
                rare, number = np.unique(row * n + word[missing], return_inverse=True)
                cuts = np.searchsorted(rare, np.arange(len(batch) + 1) * n).astype(np.int32)
                first[missing] = second[missing] = cuts[row] - number - 1
                columns = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (first, second)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n_keys + 1)), *columns, pa.ListArray.from_arrays(cuts, pa.array(names[rare % n]))], schema.names)

    path = io.scratch(spark, "words-along")
    asked.mapInArrow(run, schema).write.parquet(path)  # read by both sides of the join
    found = spark.read.schema(schema).parquet(path)
    some = found.where(F.size("rare") > 0).select(*keys, F.posexplode("rare").alias("k", "h")).join(words.select("h", "c", "t"), "h")
    met = some.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "c", "t"))).alias("met")).select(*keys, F.col("met.c").alias("rare_c"), F.col("met.t").alias("rare_t"))
    fill = lambda v: F.transform(v, lambda x: F.when(x > 0, x).otherwise(F.get(f"rare_{v}", (-x - 1).cast("int")))).alias(v)
    sums = words.groupBy(group).agg(F.first("c_group").alias("c_group"), F.first("c_all").alias("c_all"))
    return found.join(met, keys, "left").select(*keys, group, fill("c"), fill("t")).join(sums, group)
