"""Ranks and running sums over a global order, without one task for all rows.

Rows are dealt out into stretches of the order by approximate quantiles of its first column, and where a value of it fills whole stretches, by
quantiles of the second column among its rows. These are computed first and are then constants of the plan, so that every branch and every
retried task cuts alike. Running values within a stretch come from a window over the stretch;
what lies before it comes from the table of stretches, one row for each group and stretch, whose size is bounded by groups times stretches. That table is small, but joined without a hint: adaptive execution decides on its measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _below(cuts: list, column: str) -> Column:
    """The number of cuts below a value; cuts are constants."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(column))) if cuts else F.lit(0)


def stretch_or_value(df: DataFrame, column: str, n: int) -> tuple[Column, Column]:
    """The number of a row's stretch, rising with the column, and whether that stretch is a single value that holds over 1 / n of the rows."""
    found = (df.agg(F.percentile_approx(column, [k / n for k in range(1, n)], 10_000)).first()[0] if n > 1 else None) or []
    hot = sorted({v for v in found if found.count(v) > 1})  # each is the greatest value of its stretch
    is_hot = F.col(column).isin(hot) if hot else F.lit(False)
    return _below(sorted(set(found)), column) * 2 + is_hot.cast("int"), is_hot


def stretch(df: DataFrame, order: list[str], n: int) -> Column:
    """The number of a row's stretch, rising with the order; of n stretches or somewhat more."""
    if n < 2:
        return F.lit(0)
    shares = [k / n for k in range(1, n)]
    found = df.agg(F.percentile_approx(order[0], shares, 10_000)).first()[0] or []
    part = _below(sorted(set(found)), order[0]) * (n + 1)
    # a value that is the cut more than once holds over 1 / n of all rows: there are n such values at most
    hot = sorted({v for v in found if found.count(v) > 1})
    numeric = len(order) > 1 and isinstance(df.schema[order[1]].dataType, T.NumericType)
    if not hot or not numeric:
        return part
    within = df.where(F.col(order[0]).isin(hot)).groupBy(order[0]).agg(F.percentile_approx(order[1], shares, 10_000).alias("c")).collect()
    inner = F.lit(0)
    for row in within:
        inner = F.when(F.col(order[0]) == row[0], _below(sorted(set(row["c"])), order[1])).otherwise(inner)
    return part + inner


def with_running(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column] | None = None, partitions: int | None = None) -> DataFrame:
    """`df` with `rank` (from 1, by the ascending `order`, which must be unique in a group), `n` rows of the group, and running sums."""
    sums = sums or {}
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("__part", stretch(df, order, n))
    for k, c in sums.items():
        dealt = dealt.withColumn(f"__v_{k}", c)
    local = Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.withColumn("__rank", F.count(F.lit(1)).over(local))
    for k in sums:
        rows = rows.withColumn(f"__r_{k}", F.sum(f"__v_{k}").over(local))
    stretches = dealt.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__c"), *(F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = stretches.select(
        *(F.col(g).alias(f"__g_{g}") for g in group),
        F.col("__part").alias("__p"),
        F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"),
        F.sum("__c").over(whole).alias("n"),
        *(F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in sums),
    )
    on = F.col("__part") == F.col("__p")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    joined = rows.join(offsets, on)
    return joined.select(*df.columns, (F.col("__rank") + F.col("__o")).alias("rank"), "n", *((F.col(f"__r_{k}") + F.col(f"__o_{k}")).alias(k) for k in sums))
