"""How well a score predicts a target: one row of metrics for each group.

Input rows: group columns, `unit` (unique in a group), `ue` (higher: less certain), `target` (higher: better). Rows whose ue or target is
null or NaN are dropped first. Equal scores are ordered by unit where an order is needed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranked import stretch_or_value, with_running


def clean(df: DataFrame, bound: float = 1e7) -> DataFrame:
    """Without missing targets; infinite scores are cut to the bound."""
    kept = df.where(F.col("target").isNotNull() & ~F.isnan("target") & F.col("ue").isNotNull() & ~F.isnan("ue"))
    return kept.withColumn("ue", F.greatest(F.lit(-bound), F.least(F.lit(bound), F.col("ue").cast("double")))).withColumn("target", F.col("target").cast("double"))


def normalized_target(df: DataFrame, group: list[str]) -> DataFrame:
    """Targets scaled to [0, 1] in their group; a constant target becomes 0.5."""
    bounds = df.groupBy(*group).agg(F.min("target").alias("__lo"), F.max("target").alias("__hi"))
    bounds = bounds.select(*(F.col(g).alias(f"__b_{g}") for g in group), "__lo", "__hi")
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__b_{g}"))
    same = F.abs(F.col("__lo") - F.col("__hi")) <= 1e-8 + 1e-5 * F.abs(F.col("__hi"))
    value = F.when(same, F.lit(0.5)).otherwise((F.col("target") - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)))
    joined = df.join(bounds, on) if group else df.crossJoin(bounds)  # one row of bounds
    return joined.withColumn("target", value).select(*df.columns)


def rejection(df: DataFrame, group: list[str], ue: Column | None = None, max_rejection: float = 1.0) -> DataFrame:
    """PRR: mean, over rejected shares up to the largest, of the mean normalized target of what is kept."""
    rows = normalized_target(clean(df if ue is None else df.withColumn("ue", ue)), group)
    ranked = with_running(rows, group, ["ue", "unit"], {"s": F.col("target")})
    kept = ranked.where(F.col("rank") > F.col("n") - F.floor(F.lit(max_rejection) * F.col("n")))
    return kept.groupBy(*group).agg(F.avg(F.col("s") / F.col("rank")).alias("value"))


def risk_coverage(df: DataFrame, group: list[str], normalize: bool = True) -> DataFrame:
    """RCC-AUC: mean over coverages of the mean (or summed) risk of the most certain part."""
    rows = normalized_target(clean(df), group)
    ranked = with_running(rows, group, ["ue", "unit"], {"s": 1 - F.col("target")})
    return ranked.groupBy(*group).agg(F.avg(F.col("s") / F.col("rank") if normalize else F.col("s")).alias("value"))


def by_score(df: DataFrame, group: list[str], ascending: bool = True) -> DataFrame:
    """Per distinct score: rows `c` and positives `p` at it, and those of all scores before it. Distinct scores combine before any order."""
    cells = df.groupBy(*group, "ue").agg(F.count("*").alias("c"), F.sum(F.col("target")).alias("p"))
    cells = cells.withColumn("__key", F.col("ue") if ascending else -F.col("ue"))
    return with_running(cells, group, ["__key"], {"cum": F.col("c"), "cum_p": F.col("p")}).drop("__key", "rank", "n")


def roc_auc(df: DataFrame, group: list[str]) -> DataFrame:
    """Mann-Whitney with mid-ranks: the chance that a target of 0 has the higher score."""
    cells = by_score(clean(df).withColumn("target", 1 - F.col("target")), group)
    mid = F.col("cum") - F.col("c") + (F.col("c") + 1) / 2
    sums = cells.groupBy(*group).agg(F.sum(mid * F.col("p")).alias("r"), F.sum("p").alias("pos"), F.sum("c").alias("n"))
    return sums.select(*group, F.try_divide(F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * (F.col("n") - F.col("pos"))).alias("value"))


def pr_auc(df: DataFrame, group: list[str], swap: bool = False) -> DataFrame:
    """Average precision of target 1 by ue; with `swap`, of target 0 by -ue."""
    rows = clean(df)
    if swap:
        rows = rows.withColumn("target", 1 - F.col("target")).withColumn("ue", -F.col("ue"))
    cells = by_score(rows, group, ascending=False)
    return cells.groupBy(*group).agg(F.try_divide(F.sum(F.col("cum_p") / F.col("cum") * F.col("p")), F.sum("p")).alias("value"))


def pr_auc_trapezoid(df: DataFrame, group: list[str]) -> DataFrame:
    """Area under the precision-recall polygon of errors against ue, starting at recall 0 and precision 1."""
    cells = by_score(clean(df).withColumn("target", 1 - F.col("target")), group, ascending=False)
    # the point before a cell's own is known from its running sums
    precision, earlier = F.col("cum_p") / F.col("cum"), F.when(F.col("cum") > F.col("c"), (F.col("cum_p") - F.col("p")) / F.nullif(F.col("cum") - F.col("c"), F.lit(0))).otherwise(1.0)
    return cells.groupBy(*group).agg(F.try_divide(F.sum((precision + earlier) / 2 * F.col("p")), F.sum("p")).alias("value"))


def mid_ranks(df: DataFrame, group: list[str], column: str, out: str) -> DataFrame:
    """`df` with average ranks of `column` in its group."""
    cells = df.groupBy(*group, column).agg(F.count("*").alias("__c"))
    cells = with_running(cells, group, [column], {"__cum": F.col("__c")}).withColumn(out, F.col("__cum") - F.col("__c") + (F.col("__c") + 1) / 2)
    cells = cells.select(*(F.col(g).alias(f"__m_{g}") for g in group), F.col(column).alias("__key"), out)
    on = F.col(column) == F.col("__key")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__m_{g}"))
    return df.join(cells, on).drop("__key", *(f"__m_{g}" for g in group))


def spearman(df: DataFrame, group: list[str]) -> DataFrame:
    """Correlation of the average ranks of ue and of -target."""
    rows = clean(df).withColumn("target", -F.col("target"))
    ranked = mid_ranks(mid_ranks(rows, group, "ue", "__x"), group, "target", "__y")
    return ranked.groupBy(*group).agg(F.corr("__x", "__y").alias("value"))


def _dominated(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """Weighted pairs with x' < x and y' < y, by merging: cells sorted by x, then descending y, so that equal x never count."""
    order = np.lexsort((-y, x))
    rank = np.unique(y, return_inverse=True)[1][order].astype(np.int64)
    weight, total, width = w[order].astype(np.int64), 0, 1
    while width < len(rank):
        block = np.arange(len(rank)) // (2 * width)
        right = (np.arange(len(rank)) // width) % 2 == 1
        # in each block, every right cell counts the left cells of lower rank
        turn = np.lexsort((~right, rank, block))
        left_weight = np.where(right[turn], 0, weight[turn])
        running = np.cumsum(left_weight) - left_weight
        start = np.flatnonzero(np.diff(block[turn], prepend=-1))
        base = np.repeat(running[start], np.diff(np.append(start, len(turn))))
        total += int((np.where(right[turn], weight[turn], 0) * (running - base)).sum())
        width *= 2
    return total


def _ties(v: np.ndarray, w: np.ndarray) -> int:
    sums = np.bincount(np.unique(v, return_inverse=True)[1], weights=w).astype(np.int64)
    return int((sums * (sums - 1) // 2).sum())


def pair_counts(df: DataFrame, group: list[str]) -> DataFrame:
    """Per group: n, concordant and discordant pairs of (ue, target), pairs tied in ue and in target.

    Rows combine to distinct (ue, target) cells, and both axes are cut into stretches. Pairs within a stretch of ue are merged in one task for
    each, pairs of one stretch of the target and different ones of ue in another, and all others are counted from sums over the stretches. A
    value that many cells share is a stretch of its own, in which all pairs are tied: it is counted from sums and gathered nowhere.
    """
    cells = clean(df).groupBy(*group, "ue", "target").agg(F.count("*").alias("w"))
    cells = cells.withColumn("__all", F.lit(1))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (x, hot_x), (y, hot_y) = (stretch_or_value(cells, c, n) for c in ("ue", "target"))
    cells = cells.withColumns({"__x": x, "__y": y, "__hot_x": hot_x, "__hot_y": hot_y})
    keys = group or ["__all"]
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n long, concordant long, discordant long, tied_ue long, tied_target long"])

    def counts(x: str, y: str, of_ue: bool, of_target: bool):
        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b, w = pdf[x].to_numpy(), pdf[y].to_numpy(), pdf["w"].to_numpy()
            return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "n": [int(w.sum()) if of_ue else 0], "concordant": [_dominated(a, b, w)], "discordant": [_dominated(a, -b, w)], "tied_ue": [_ties(a, w) if of_ue else 0], "tied_target": [_ties(b, w) if of_target else 0]})

        return count

    zero, tied = F.lit(0).cast("long"), (F.col("w") * (F.col("w") - 1) / 2).cast("long")
    one_ue = cells.where("__hot_x").groupBy(*keys, "__x").agg(F.sum("w").alias("w")).select(*keys, F.col("w").alias("n"), zero.alias("concordant"), zero.alias("discordant"), tied.alias("tied_ue"), zero.alias("tied_target"))
    one_target = cells.where("__hot_y").groupBy(*keys, "__y").agg(F.sum("w").alias("w")).select(*keys, zero.alias("n"), zero.alias("concordant"), zero.alias("discordant"), zero.alias("tied_ue"), tied.alias("tied_target"))
    within_ue = cells.where("not __hot_x").groupBy(*keys, "__x").applyInPandas(counts("ue", "target", True, False), schema)
    coarse = cells.groupBy(*keys, "__x", "__y", "__hot_y", "target").agg(F.sum("w").alias("w"))
    within_target = coarse.where("not __hot_y").groupBy(*keys, "__y").applyInPandas(counts("__x", "target", False, True), schema)
    # as many rows as pairs of stretches for each group
    across = coarse.groupBy(*keys, "__x", "__y").agg(F.sum("w").alias("w")).groupBy(*keys).applyInPandas(counts("__x", "__y", False, False), schema)
    parts = within_ue.unionByName(one_ue).unionByName(within_target).unionByName(one_target).unionByName(across)
    return parts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", "concordant", "discordant", "tied_ue", "tied_target"))).drop("__all")


def kendall(df: DataFrame, group: list[str]) -> DataFrame:
    """Kendall's tau-b of ue and -target."""
    c = pair_counts(df, group).withColumn("__n0", F.col("n") * (F.col("n") - 1) / 2)
    return c.select(*group, F.try_divide((F.col("discordant") - F.col("concordant")).cast("double"), F.sqrt((F.col("__n0") - F.col("tied_ue")) * (F.col("__n0") - F.col("tied_target")))).alias("value"))


def reversed_pairs(df: DataFrame, group: list[str]) -> DataFrame:
    """RPP: share of ordered pairs where the more certain one has the lower target."""
    return pair_counts(df, group).select(*group, (F.col("concordant") / (F.col("n") * F.col("n"))).alias("value"))


def to_probability(df: DataFrame, group: list[str]) -> DataFrame:
    """Scores as error probabilities: all in [-1, 0] are raised by 1; non-negative ones above 1 become 1 - exp(-x); others stay."""
    ranges = df.groupBy(*group).agg(F.min("ue").alias("__lo"), F.max("ue").alias("__hi")).select(*(F.col(g).alias(f"__p_{g}") for g in group), "__lo", "__hi")
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__p_{g}"))
    joined = df.join(ranges, on) if group else df.crossJoin(ranges)  # one row of ranges
    raised = (F.col("__lo") >= -1) & (F.col("__hi") <= 0)
    value = F.when(raised, F.col("ue") + 1).when((F.col("__lo") >= 0) & (F.col("__hi") > 1), 1 - F.exp(-F.col("ue"))).otherwise(F.col("ue"))
    return joined.withColumn("ue", value).select(*df.columns)


def calibration_error(df: DataFrame, group: list[str], bins: int = 10) -> DataFrame:
    """ECE of error probabilities against errors (1 - target); a score of 1 falls in no bin but counts in n. NaN outside [0, 1]."""
    rows = to_probability(clean(df), group).withColumn("__bad", 1 - F.col("target"))
    cells = rows.groupBy(*group, F.floor(F.col("ue") * bins).alias("__bin")).agg(F.count("*").alias("c"), F.sum("ue").alias("e"), F.sum("__bad").alias("t"), F.min("ue").alias("lo"), F.max("ue").alias("hi"))
    inside = (F.col("__bin") >= 0) & (F.col("__bin") < bins)
    out = cells.groupBy(*group).agg(F.sum(F.when(inside, F.abs(F.col("e") - F.col("t"))).otherwise(0.0)).alias("gap"), F.sum("c").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return out.select(*group, F.when((F.col("lo") < 0) | (F.col("hi") > 1), F.lit(float("nan"))).otherwise(F.col("gap") / F.col("n")).alias("value"))


def brier(df: DataFrame, group: list[str]) -> DataFrame:
    """Mean squared difference of error probability and error; NaN if a score lies outside [0, 1]."""
    rows = to_probability(clean(df), group)
    good = F.every((F.col("ue") >= 0) & (F.col("ue") <= 1))
    return rows.groupBy(*group).agg(F.when(good, F.avg(F.pow(1 - F.col("target") - F.col("ue"), F.lit(2)))).otherwise(F.lit(float("nan"))).alias("value"))


def confusion(df: DataFrame, group: list[str], threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall and F1 of errors predicted where ue >= threshold, and precision and recall of the other class."""
    bad, said = F.col("target") < 0.5, F.col("ue") >= threshold
    c = clean(df).groupBy(*group).agg(*(F.count_if(cond).alias(k) for k, cond in (("tp", bad & said), ("fp", ~bad & said), ("fn", bad & ~said), ("tn", ~bad & ~said))))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return c.select(*group, safe(tp + tn, tp + fp + fn + tn).alias("accuracy"), safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"), safe(tn, tn + fn).alias("negative_precision"), safe(tn, tn + fp).alias("negative_recall"))


def normalize_metric(value: Column, random: Column, oracle: Column) -> Column:
    """The value's place between the random and the best score; unchanged where these agree."""
    return F.when(oracle == random, value).otherwise((value - random) / F.nullif(oracle - random, F.lit(0.0)))


def empirical_rank(test: DataFrame, train: DataFrame, key: str, value: str) -> DataFrame:
    """Per test row, the share of train values up to its own; both sides are put in one order, no pairs are formed."""
    both = test.select(F.col(key), F.col(value).alias("v"), F.lit(1).alias("is_test")).unionByName(train.select(F.col(key), F.col(value).alias("v"), F.lit(0).alias("is_test")))
    ranked = with_running(both, [], ["v", "is_test", key], {"seen": 1 - F.col("is_test")})
    n = F.lit(train.count())
    return ranked.where("is_test = 1").select(key, (F.col("seen") / n).alias("rank_share"))


METRICS = {"roc-auc": roc_auc, "pr-auc": pr_auc, "prr": rejection, "rcc-auc": risk_coverage, "spearmanr": spearman, "kendalltau": kendall, "rpp": reversed_pairs, "ece": calibration_error, "bs": brier}


def metrics_table(df: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    """Long table (group, ue_metric, value)."""
    out = None
    for name in names:
        part = METRICS[name](df, group).select(*group, F.lit(name).alias("ue_metric"), "value")
        out = part if out is None else out.unionByName(part)
    return out


def pivot_table(long: DataFrame, rows: str, names: list[str]) -> DataFrame:
    return long.groupBy(rows).pivot("ue_metric", names).agg(F.first("value"))


def best_first(df: DataFrame, lower_is_better: bool, value: str) -> DataFrame:
    order = F.col(value) if lower_is_better else -F.col(value)
    return df.withColumn("place", F.rank().over(Window.orderBy(order)))  # a table of methods, not of rows
