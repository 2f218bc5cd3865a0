"""Queries of the evaluation metrics, calibration and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrate, evaluate
from ..sources import fixtures as S
from . import oracle_ctes as C
from .catalog import query, rounded

_A = f"WITH {C.ANS}, norm AS (SELECT *, (target - min(target) OVER ()) / (max(target) OVER () - min(target) OVER ()) AS y FROM ans), r AS (SELECT *, row_number() OVER (ORDER BY ue, unit) AS k, count(*) OVER () AS n, sum(y) OVER (ORDER BY ue, unit ROWS UNBOUNDED PRECEDING) AS s FROM norm) "


def _metric(name: str, build, sql: str | None) -> None:
    query(name, _A + sql if sql else None)(lambda spark, sf: rounded(build(S.scored_answers(spark, sf)), "value"))


_metric("prr", lambda d: evaluate.rejection(d, []), "SELECT round(avg(s / k), 6) AS value FROM r")
_metric("prr_half", lambda d: evaluate.rejection(d, [], max_rejection=0.5), "SELECT round(avg(s / k), 6) AS value FROM r WHERE k > n - floor(0.5 * n)")
_metric("rcc_auc", lambda d: evaluate.risk_coverage(d, []), "SELECT round(avg((k - s) / k), 6) AS value FROM r")
_metric("rcc_auc_raw", lambda d: evaluate.risk_coverage(d, [], normalize=False), "SELECT round(avg(k - s), 6) AS value FROM r")
_ROC = "c AS (SELECT {g} 1 - target AS bad, rank() OVER ({p} ORDER BY ue) + (count(*) OVER ({pe} ue) - 1) / 2.0 AS mr FROM ans)"
_metric("roc_auc", lambda d: evaluate.roc_auc(d, []), ", " .join(["SELECT round((sum(mr * bad) - sum(bad) * (sum(bad) + 1) / 2) / (sum(bad) * (count(*) - sum(bad))), 6) AS value FROM (SELECT 1 - target AS bad, rank() OVER (ORDER BY ue) + (count(*) OVER (PARTITION BY ue) - 1) / 2.0 AS mr FROM ans)"]))
_CUM = "c AS (SELECT ue, count(*) AS c, sum({t}) AS p FROM ans GROUP BY ue), m AS (SELECT *, sum(c) OVER (ORDER BY {o}) AS cc, sum(p) OVER (ORDER BY {o}) AS cp FROM c) "
_metric("pr_auc", lambda d: evaluate.pr_auc(d, []), "," .join(["SELECT * FROM (WITH " + _CUM.format(t="target", o="ue DESC") + "SELECT round(sum(cp / cc * p) / sum(p), 6) AS value FROM m)"]))
_metric("pr_auc_swapped", lambda d: evaluate.pr_auc(d, [], swap=True), "SELECT * FROM (WITH " + _CUM.format(t="1 - target", o="ue") + "SELECT round(sum(cp / cc * p) / sum(p), 6) AS value FROM m)")
_metric("pr_auc_trapezoid", lambda d: evaluate.pr_auc_trapezoid(d, []), "SELECT * FROM (WITH " + _CUM.format(t="1 - target", o="ue DESC") + "SELECT round(sum((cp / cc + CASE WHEN cc > c THEN (cp - p) / (cc - c) ELSE 1 END) / 2 * p) / sum(p), 6) AS value FROM m)")
_MID = "SELECT rank() OVER (ORDER BY ue) + (count(*) OVER (PARTITION BY ue) - 1) / 2.0 AS x, rank() OVER (ORDER BY -target) + (count(*) OVER (PARTITION BY target) - 1) / 2.0 AS z FROM ans"
_metric("spearman", lambda d: evaluate.spearman(d, []), f"SELECT round(corr(x, z), 6) AS value FROM ({_MID})")
_PAIRS = "SELECT count(*) FILTER (WHERE a.ue < b.ue AND a.target < b.target) AS con, count(*) FILTER (WHERE a.ue < b.ue AND a.target > b.target) AS dis FROM ans a, ans b"
_TIES = "SELECT (SELECT count(*) FROM ans) AS n, (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM ans GROUP BY ue)) AS tx, (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM ans GROUP BY target)) AS ty"
_metric("kendall", lambda d: evaluate.kendall(d, []), f"SELECT round((dis - con) / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)), 6) AS value FROM ({_PAIRS}), ({_TIES})")
_metric("rpp", lambda d: evaluate.reversed_pairs(d, []), f"SELECT round(con / (n * n), 6) AS value FROM ({_PAIRS}), ({_TIES})")
_metric("ece", lambda d: evaluate.calibration_error(d, []), "SELECT round(sum(CASE WHEN b < 10 THEN abs(e - t) ELSE 0 END) / sum(c), 6) AS value FROM (SELECT floor(p * 10) AS b, count(*) AS c, sum(p) AS e, sum(1 - target) AS t FROM (SELECT target, 1 - exp(-ue) AS p FROM ans) GROUP BY floor(p * 10))")
_metric("brier", lambda d: evaluate.brier(d, []), "SELECT round(avg(pow(1 - target - (1 - exp(-ue)), 2)), 6) AS value FROM ans")
_ISO = "SELECT * FROM (WITH " + C.rising("ans", "ue", "1 - target") + ", fitted AS (SELECT target, fit AS p FROM ans JOIN ifit ON ans.ue = ifit.x) {} )"
_metric("ece_isotonic", lambda d: evaluate.calibration_error(calibrate.isotonic_scores(d), []), _ISO.format("SELECT round(sum(CASE WHEN b < 10 THEN abs(e - t) ELSE 0 END) / sum(c), 6) AS value FROM (SELECT floor(p * 10) AS b, count(*) AS c, sum(p) AS e, sum(1 - target) AS t FROM fitted GROUP BY floor(p * 10))"))
_metric("brier_isotonic", lambda d: evaluate.brier(calibrate.isotonic_scores(d), []), _ISO.format("SELECT round(avg(pow(1 - target - p, 2)), 6) AS value FROM fitted"))


@query("target_minmax", _A + "SELECT unit, round(y, 6) AS target FROM norm")
def target_minmax(spark, sf):
    return rounded(evaluate.normalized_target(S.scored_answers(spark, sf), []).select("unit", "target"), "target")


_F1 = "SELECT lang, count(*) FILTER (WHERE target < 0.5 AND ue >= 7) AS tp, count(*) FILTER (WHERE target >= 0.5 AND ue >= 7) AS fp, count(*) FILTER (WHERE target < 0.5 AND ue < 7) AS fn, count(*) FILTER (WHERE target >= 0.5 AND ue < 7) AS tn FROM ans GROUP BY lang"


@query("accuracy_f1", _A + f"SELECT lang, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS negative_precision, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS negative_recall FROM ({_F1})")
def accuracy_f1(spark, sf):
    return rounded(evaluate.confusion(S.scored_answers(spark, sf), ["lang"], 7.0), "accuracy", "precision", "recall", "f1", "negative_precision", "negative_recall")


_BY = "SELECT lang, unit, ue, target, target AS y FROM ans"
_PRRG = "SELECT lang, avg(s / k) AS v, avg(y) AS m FROM (SELECT lang, y, row_number() OVER (PARTITION BY lang ORDER BY {o}, unit) AS k, sum(y) OVER (PARTITION BY lang ORDER BY {o}, unit ROWS UNBOUNDED PRECEDING) AS s FROM ({b})) GROUP BY lang"


@query("oracle_random_normalized", _A + f"SELECT a.lang, round(a.v, 6) AS value, round(o.v, 6) AS best, round(a.m, 6) AS random, round((a.v - a.m) / (o.v - a.m), 6) AS normalized FROM ({_PRRG.format(o='ue', b=_BY)}) a JOIN ({_PRRG.format(o='-target', b=_BY)}) o ON a.lang = o.lang")
def oracle_random_normalized(spark, sf):
    """PRR next to the best and the expected random value, and its place between them."""
    d = S.scored_answers(spark, sf)
    value = evaluate.rejection(d, ["lang"])
    best = evaluate.rejection(d, ["lang"], ue=-F.col("target")).withColumnRenamed("value", "best")
    random = evaluate.normalized_target(evaluate.clean(d), ["lang"]).groupBy("lang").agg(F.avg("target").alias("random"))
    out = value.join(best, "lang").join(random, "lang")
    return rounded(out.withColumn("normalized", evaluate.normalize_metric(F.col("value"), F.col("random"), F.col("best"))), "value", "best", "random", "normalized")


_ROCG = "SELECT lang, (sum(mr * bad) - sum(bad) * (sum(bad) + 1) / 2) / (sum(bad) * (count(*) - sum(bad))) AS v FROM (SELECT lang, 1 - target AS bad, rank() OVER (PARTITION BY lang ORDER BY ue) + (count(*) OVER (PARTITION BY lang, ue) - 1) / 2.0 AS mr FROM ans) GROUP BY lang"
_RCCG = "SELECT lang, avg((k - s) / k) AS v FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY ue, unit) AS k, sum(target) OVER (PARTITION BY lang ORDER BY ue, unit ROWS UNBOUNDED PRECEDING) AS s FROM ans) GROUP BY lang"


@query("metrics_pivot", _A + f"SELECT p.lang, round(p.v, 6) AS prr, round(q.v, 6) AS roc_auc, round(r.v, 6) AS rcc_auc FROM ({_PRRG.format(o='ue', b=_BY)}) p JOIN ({_ROCG}) q ON p.lang = q.lang JOIN ({_RCCG}) r ON p.lang = r.lang")
def metrics_pivot(spark, sf):
    long = evaluate.metrics_table(S.scored_answers(spark, sf), ["lang"], ["prr", "roc-auc", "rcc-auc"])
    wide = evaluate.pivot_table(long, "lang", ["prr", "roc-auc", "rcc-auc"])
    return rounded(wide.withColumnsRenamed({"roc-auc": "roc_auc", "rcc-auc": "rcc_auc"}), "prr", "roc_auc", "rcc_auc")


@query("mean_over_datasets", _A + f"SELECT round(avg(v), 6) AS mean_prr FROM ({_PRRG.format(o='ue', b=_BY)})")
def mean_over_datasets(spark, sf):
    return rounded(evaluate.rejection(S.scored_answers(spark, sf), ["lang"]).agg(F.avg("value").alias("mean_prr")), "mean_prr")


@query("method_places", _A + f"SELECT lang, round(v, 6) AS value, rank() OVER (ORDER BY round(v, 6) DESC) AS place FROM ({_ROCG})")
def method_places(spark, sf):
    return evaluate.best_first(rounded(evaluate.roc_auc(S.scored_answers(spark, sf), ["lang"]), "value"), False, "value").withColumn("place", F.col("place").cast("long"))


@query("ood_auc", "SELECT round((sum(mr * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS value FROM (SELECT CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS y, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS mr FROM documents)")
def ood_auc(spark, sf):
    """In-distribution rows as label 0, the others as 1; a length score."""
    d = S.table(spark, sf, "documents")
    inside = d.where("lang = 'en'").select(F.col("doc_id").alias("unit"), F.col("n_chars").alias("ue"), F.lit(1.0).alias("target"))
    outside = d.where("lang != 'en'").select(F.col("doc_id").alias("unit"), F.col("n_chars").alias("ue"), F.lit(0.0).alias("target"))
    return rounded(evaluate.roc_auc(inside.unionByName(outside), []), "value")


@query("nan_filter", "SELECT count(*) AS kept, round(sum(CASE WHEN v > 1e7 THEN 1e7 ELSE v END), 6) AS total FROM (SELECT CASE WHEN l_linenumber = 3 THEN 1e9 ELSE l_tax END AS v FROM lineitem WHERE l_returnflag <> 'R')")
def nan_filter(spark, sf):
    d = S.table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") == 3, 1e9).otherwise(F.col("l_tax")).alias("ue"), F.when(F.col("l_returnflag") == "R", float("nan")).otherwise(1.0).alias("target"))
    return evaluate.clean(d).agg(F.count("*").alias("kept"), F.round(F.sum("ue"), 6).alias("total"))


@query("rank_against_train", f"WITH {C.ANS} SELECT t.unit, round((SELECT count(*) FROM ans s WHERE s.unit % 10 < 7 AND s.ue <= t.ue) / (SELECT count(*) FROM ans WHERE unit % 10 < 7), 6) AS rank_share FROM ans t WHERE unit % 10 >= 7")
def rank_against_train(spark, sf):
    d = S.scored_answers(spark, sf).select("unit", "ue")
    return rounded(evaluate.empirical_rank(d.where("unit % 10 >= 7"), d.where("unit % 10 < 7"), "unit", "ue"), "rank_share")


_FIT = f"WITH {C.ANS}, f AS (SELECT *, -ue AS c FROM ans WHERE unit % 10 < 7), t AS (SELECT *, -ue AS c FROM ans WHERE unit % 10 >= 7) "


def _split(spark, sf):
    d = S.scored_answers(spark, sf)
    return d.where("unit % 10 < 7"), d.where("unit % 10 >= 7")


@query("minmax_normalizer", _FIT + "SELECT t.unit, round(least(1.0, greatest(0.0, (t.c - lo) / (hi - lo))), 6) AS confidence FROM t, (SELECT min(c) AS lo, max(c) AS hi FROM f)")
def minmax_normalizer(spark, sf):
    train, test = _split(spark, sf)
    return rounded(calibrate.minmax(train, test), "confidence")


@query("quantile_normalizer", _FIT + "SELECT t.unit, round((SELECT count(*) FROM f WHERE f.c <= t.c) / (SELECT count(*) FROM f), 6) AS confidence FROM t")
def quantile_normalizer(spark, sf):
    train, test = _split(spark, sf)
    return rounded(calibrate.quantile(train, test), "confidence")


@query("binned_pcc", _FIT + ", " + C.BINS.format(rows="f") + " SELECT unit, round(coalesce((SELECT m FROM bmean WHERE t.ue > lo AND t.ue <= hi), (SELECT last(m ORDER BY bin) FROM bmean)), 6) AS confidence FROM t")
def binned_pcc(spark, sf):
    train, test = _split(spark, sf)
    return rounded(calibrate.binned(train, test, 10), "confidence")


_STEPS = """, step AS (SELECT fit, sum(x * w) / sum(w) AS mean, min(x) AS a, max(x) AS b, row_number() OVER (ORDER BY fit) AS k, count(*) OVER () AS n FROM ifit GROUP BY fit),
point AS (SELECT DISTINCT x, fit AS y FROM (SELECT CASE WHEN fit IN (0, 1) OR k = 1 THEN a WHEN k = n THEN b ELSE mean END AS x, fit FROM step UNION ALL SELECT b, fit FROM step WHERE fit IN (0, 1))),
lo AS (SELECT unit, max_by(point.x, point.x) AS x0, max_by(point.y, point.x) AS y0 FROM t JOIN point ON point.x <= t.c GROUP BY unit), hi AS (SELECT unit, min_by(point.x, point.x) AS x1, min_by(point.y, point.x) AS y1 FROM t JOIN point ON point.x >= t.c GROUP BY unit)
SELECT t.unit, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (t.c - x0) / (x1 - x0) END, 6) AS confidence FROM t LEFT JOIN lo ON t.unit = lo.unit LEFT JOIN hi ON t.unit = hi.unit"""


@query("isotonic_pcc", _FIT + ", " + C.rising("f", "c", "target") + _STEPS)
def isotonic_pcc(spark, sf):
    train, test = _split(spark, sf)
    return rounded(calibrate.isotonic(train, test), "confidence")


_L = "WITH a AS (SELECT l_returnflag AS g, l_discount AS ue, l_tax AS target, l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100 AS u, l_partkey, l_suppkey FROM lineitem) "


@query("spearman_large", "SELECT g, round(corr(x, z), 6) AS value FROM (SELECT l_returnflag AS g, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS x, rank() OVER (PARTITION BY l_returnflag ORDER BY -l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS z FROM lineitem) GROUP BY g")
def spearman_large(spark, sf):
    d = S.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("ue"), F.col("l_quantity").alias("target"))
    return rounded(evaluate.spearman(d, ["g"]), "value")


@query("roc_auc_large", "SELECT g, round((sum(mr * bad) - sum(bad) * (sum(bad) + 1) / 2) / (sum(bad) * (count(*) - sum(bad))), 6) AS value FROM (SELECT l_linestatus AS g, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS bad, rank() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_linestatus, l_extendedprice) - 1) / 2.0 AS mr FROM lineitem) GROUP BY g")
def roc_auc_large(spark, sf):
    d = S.table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("g"), F.col("l_extendedprice").alias("ue"), F.when(F.col("l_returnflag") == "R", 0.0).otherwise(1.0).alias("target"))
    return rounded(evaluate.roc_auc(d, ["g"]), "value")
