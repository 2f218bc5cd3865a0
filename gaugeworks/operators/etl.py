"""Slices, shards, samples, joins and summaries of question-and-answer tables. Positions are dense ranks of a key, counted from 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranked import with_running


#: Rows of a sample that one task may gather; larger ones are ranked in stretches.
ONE_TASK = 10_000


def positions(df: DataFrame, key: str) -> DataFrame:
    """`df` with `position` by the key and `total` rows."""
    return with_running(df, [], [key]).withColumn("position", F.col("rank") - 1).withColumnRenamed("n", "total").drop("rank")


def slice_rows(df: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    return positions(df, key).where(F.col("position").between(start, stop - 1)).drop("position", "total")


def balanced_partition(df: DataFrame, key: str, k: int) -> DataFrame:
    """`part`: the first total % k parts have one row more."""
    size, extra = F.floor(F.col("total") / k), F.col("total") % k
    head = extra * (size + 1)
    part = F.when(F.col("position") < head, F.floor(F.col("position") / (size + 1))).otherwise(extra + F.floor((F.col("position") - head) / F.nullif(size, F.lit(0))))
    return positions(df, key).withColumn("part", part.cast("long")).drop("position", "total")


def floor_partition(df: DataFrame, key: str, k: int) -> DataFrame:
    """`part` of total // k rows each; the rest of the rows is dropped."""
    size = F.floor(F.col("total") / k)
    rows = positions(df, key).withColumn("part", F.floor(F.col("position") / F.nullif(size, F.lit(0))).cast("long"))
    return rows.where(F.col("part") < k).drop("position", "total")


def ceil_partition(df: DataFrame, key: str, k: int) -> DataFrame:
    return positions(df, key).withColumn("part", F.floor(F.col("position") / F.ceil(F.col("total") / k)).cast("long")).drop("position", "total")


def hash_order(key: Column, seed: int) -> Column:
    """A repeatable order that looks random: a multiplicative hash, equal on other engines. Keys of any size stay within a long.

    What of a key lies beyond a million is mixed in as well, with its square, so that a share of very many ids is no residue class of them.
    """
    high = F.floor(key / 1000003).cast("long")
    mixed = F.pmod(high, F.lit(1000003)) * 40503 + F.pmod(high * F.pmod(high, F.lit(1000003)), F.lit(1000003)) * 7919
    return (F.pmod(key, F.lit(1000003)) * 2654435761 + mixed + seed * 40503) % 1000003


def plain_order(key: Column, seed: int) -> Column:
    """The multiplicative hash alone, as SQL writes it; of keys beyond a million it repeats."""
    return (F.pmod(key, F.lit(1000003)) * 2654435761 + seed * 40503) % 1000003


#: An order of rows: of a key's column and a seed.
Order = Callable[[Column, int], Column]


def hash_split(df: DataFrame, key: str, test_share: float, seed: int, order: Order = hash_order) -> DataFrame:
    """`is_test` for a share of the rows, without a shuffle."""
    return df.withColumn("is_test", order(F.col(key), seed) < int(test_share * 1000003))


def subsample(df: DataFrame, key: str, size: float, seed: int, order: Order = hash_order) -> DataFrame:
    """`size` rows, or that share if below 1, by hash order."""
    n = int(size * df.count()) if size < 1 else int(size)
    if n <= ONE_TASK:
        return df.orderBy(order(F.col(key), seed), key).limit(n)
    return with_running(df.withColumn("__h", order(F.col(key), seed)), [], ["__h", key]).where(F.col("rank") <= n).select(*df.columns)


def sample_per_group(df: DataFrame, group: str, key: str, most: int, seed: int, order: Order = hash_order) -> DataFrame:
    by = Window.partitionBy(group).orderBy(order(F.col(group) * 31 + F.col(key), seed), key)
    return df.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= most).drop("__n")


def distinct_sample(df: DataFrame, column: str, key: str, size: int, seed: int, order: Order = hash_order) -> DataFrame:
    """Rows of `size` distinct values, chosen by hash order of the value's first key."""
    firsts = df.groupBy(column).agg(F.min(key).alias("__first"))
    chosen = firsts.orderBy(order(F.col("__first"), seed), "__first").limit(size)
    return df.join(chosen, column, "left_semi")


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Missing columns as nulls of the type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def pending(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows that lack any required column."""
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    return df.where(missing)


def unlabelled(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done, key, "left_anti")


def mismatches(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose stored columns differ from the new ones, nulls counting as values."""
    a, b = old.alias("a"), new.alias("b")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).where(~same).select(F.col(f"a.{key}").alias(key))


def truncate_claims(claims: Column, length: int) -> Column:
    """The claims before the first that ends at or behind `length` tokens. Claims are structs with `ids`."""
    late = F.array_position(F.transform(claims, lambda c: F.coalesce(F.element_at(c["ids"], -1) >= length, F.lit(False))), F.lit(True))
    return F.when(late > 0, F.slice(claims, F.lit(1), (late - 1).cast("int"))).otherwise(claims)


def supervised(labels: Column, claims: Column) -> Column:
    """Whether any label is known and any claim has a token."""
    known = F.exists(labels, lambda x: x.isNotNull() & ~F.isnan(x) & (x != -100))
    return F.coalesce(known, F.lit(False)) & F.coalesce(F.exists(claims, lambda c: F.exists(c["ids"], lambda t: t >= 0)), F.lit(False))


def token_targets(tokens: Column, claims: Column) -> Column:
    """Per token -100, or the label of the last claim that holds it with a known label: 1 for wrong, 0 for right."""
    return F.transform(tokens, lambda t, i: F.coalesce(F.aggregate(claims, F.lit(None).cast("double"), lambda s, c: F.when(F.array_contains(c["ids"], i) & c["verified"].isNotNull(), c["verified"]).otherwise(s)), F.lit(-100.0)))


def dedupe_and_expand(pairs: DataFrame, left: str, right: str, score) -> DataFrame:
    """Each distinct pair is scored once; the score joins back to all pairs."""
    distinct = pairs.select(left, right).distinct()
    return pairs.join(score(distinct), [left, right])
