"""Joins with a table that has one row for each key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most frequent keys that are looked at, the rows from which such a key is salted, and the parts that its rows are dealt to.
MOST_COMMON, LEAST_HOT, SALTS = 1000, 50_000, 64


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """A left join. Keys beyond MOST_COMMON hold less than 1 / MOST_COMMON of all rows each; those that hold many are salted on both sides.

    Reads `rows` twice: write it first if it is dear. Null keys find nothing.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    hot = [r[key] for r in counts.orderBy(F.desc("__n")).limit(MOST_COMMON).where(F.col("__n") > LEAST_HOT).collect()]
    if not hot:
        return rows.join(table, key, "left")
    is_hot = F.col(key).isin(hot)
    others = [c for c in rows.columns if c != key]
    spread = F.pmod(F.xxhash64(*others), F.lit(SALTS)) if others else F.lit(0)
    # rows without a key are spread as well
    salted = rows.withColumn("__salt", F.when(is_hot | F.col(key).isNull(), spread).otherwise(0).cast("long"))
    copies = table.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    return salted.join(copies, [key, "__salt"], "left").drop("__salt")
