"""Queries of best-of-N selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import select
from ..sources import fixtures as S
from . import oracle_ctes as C
from .catalog import query, rounded


def _best(name: str, order: str, default: str | None = None, **options) -> None:
    s = f"coalesce(tax, {default})" if default else "tax"
    query(name, f"WITH {C.CAND} SELECT question_id, cand_idx AS best_idx, s AS best_score, annotation FROM (SELECT *, {s} AS s, row_number() OVER (PARTITION BY question_id ORDER BY {s} {order}, cand_idx) AS r FROM cand) WHERE r = 1")(
        lambda spark, sf: select.best(S.candidates(spark, sf), "question_id", "cand_idx", "tax", ["annotation"], **options)
    )


_best("bon_argmin", "ASC")
_best("bon_argmax", "DESC", lowest=False)


@query(
    "bon_accuracy_table",
    f"WITH {C.CAND}, l AS (SELECT question_id, cand_idx, annotation, 'discount' AS method, discount AS score FROM cand UNION ALL SELECT question_id, cand_idx, annotation, 'tax', tax FROM cand UNION ALL SELECT question_id, cand_idx, annotation, 'price', price FROM cand), p AS (SELECT method, question_id, bool_or(annotation IS NULL OR score IS NULL) AS skip, arg_min(1 - annotation, (score, cand_idx)) AS hit, avg(1 - annotation) AS mean FROM l GROUP BY method, question_id) SELECT method, count(*) FILTER (WHERE NOT skip) AS used, count(*) FILTER (WHERE skip) AS skipped, round(avg(hit) FILTER (WHERE NOT skip), 6) AS accuracy, round(avg(mean) FILTER (WHERE NOT skip), 6) AS random_accuracy FROM p GROUP BY method",
)
def bon_accuracy_table(spark, sf):
    return rounded(select.offline_table(S.candidates(spark, sf), "question_id", "cand_idx", ["discount", "tax", "price"], "annotation"), "accuracy", "random_accuracy")


_PAIR = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {e} AS correct FROM lineitem"


def _lines(spark, sf, e):
    return S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", e.alias("correct"))


query("bon_correctness_isclose", _PAIR.format(e="coalesce(abs(l_tax - CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount + 1e-13 END) <= 1e-9 * greatest(abs(l_tax), abs(l_discount + 1e-13)), FALSE)"))(
    lambda spark, sf: _lines(spark, sf, select.is_close(F.col("l_tax"), F.when(F.col("l_linenumber") == 2, None).otherwise(F.col("l_discount") + 1e-13)))
)
query("bon_correctness_exact", _PAIR.format(e="coalesce(l_tax = CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount END, FALSE)"))(
    lambda spark, sf: _lines(spark, sf, select.exactly(F.col("l_tax"), F.when(F.col("l_linenumber") == 2, None).otherwise(F.col("l_discount"))))
)


def _steps(spark, sf):
    """Events as candidates: the k-th of a user's events on a day is candidate k % 3 of step k // 3."""
    order = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    e = S.table(spark, sf, "events").withColumn("k", F.row_number().over(order) - 1)
    return e.select(F.concat(F.col("user_id").cast("string"), F.lit("/"), F.to_date("ts").cast("string")).alias("run"), F.floor(F.col("k") / 3).cast("int").alias("step"), (F.col("k") % 3).alias("cand"), F.col("event_type").alias("text"), (F.col("value") / 500).alias("score"))


_ST = """WITH k AS (SELECT CAST(user_id AS VARCHAR) || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS run, event_type, value / 500 AS score, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS k FROM events),
c AS (SELECT run, CAST(floor(k / 3) AS INT) AS step, event_type, {s} AS score, row_number() OVER (PARTITION BY run, CAST(floor(k / 3) AS INT) ORDER BY {s} {o}, k) AS r FROM k), b AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN step END) OVER (PARTITION BY run) AS last FROM c WHERE r = 1 AND step < 20)
SELECT run, string_agg(event_type, chr(10) ORDER BY step) AS trajectory, CAST(count(*) AS INT) AS n_steps, bool_or(last IS NOT NULL) AS completed, round(sum(score), 6) AS total_score FROM b WHERE last IS NULL OR step <= last GROUP BY run"""


def _fold(name: str, score, sql: str, lowest: bool) -> None:
    query(name, _ST.format(s=sql, o="ASC" if lowest else "DESC"))(lambda spark, sf: rounded(select.fold_steps(_steps(spark, sf), "run", "step", "cand", "text", score(), lowest, "purchase"), "total_score"))


_fold("stepwise_min_fold", lambda: F.col("score"), "score", True)
_fold("online_bon_uncertainty", lambda: 1 - F.col("score"), "1 - score", True)
_fold("online_bon_reward", lambda: F.col("score"), "score", False)
_fold("online_bon_validity_redundancy", lambda: F.col("score") - F.length("text") / 50, "score - length(event_type) / 50", False)


@query("stepwise_scores", f"WITH {C.REW} SELECT doc_id, claim_idx, round(1 - reward, 6) AS prm, round(redundancy - validity, 6) AS evaluator, round(1 - validity + 0, 6) AS validity_ue, round(redundancy - validity + 0.5, 6) AS both_ue FROM rew")
def stepwise_scores(spark, sf):
    r = S.step_rewards(spark, sf)
    return rounded(r.select("doc_id", "claim_idx", (1 - F.col("reward")).alias("prm"), (F.col("redundancy") - F.col("validity")).alias("evaluator"), (1 - F.col("validity")).alias("validity_ue"), (F.col("redundancy") - F.col("validity") + 0.5).alias("both_ue")), "prm", "evaluator", "validity_ue", "both_ue")


@query("scorer_signs", f"WITH {C.REW} SELECT doc_id, round(avg(-reward), 6) AS prm, round(avg(redundancy - validity), 6) AS evaluator, round(avg(redundancy), 6) AS redundancy, round(avg(-validity), 6) AS validity FROM rew GROUP BY doc_id")
def scorer_signs(spark, sf):
    r = S.step_rewards(spark, sf).groupBy("doc_id").agg(F.avg(-F.col("reward")).alias("prm"), F.avg(F.col("redundancy") - F.col("validity")).alias("evaluator"), F.avg("redundancy").alias("redundancy"), F.avg(-F.col("validity")).alias("validity"))
    return rounded(r, "prm", "evaluator", "redundancy", "validity")


@query("bon_update", f"WITH {C.CAND} SELECT question_id, cand_idx, map_from_entries([('discount', discount), ('tax', tax)])['tax'] AS old_score, round(discount * 2, 6) AS new_score FROM cand")
def bon_update(spark, sf):
    """Scores of a new method join an older result."""
    c = S.candidates(spark, sf)
    old = c.select("question_id", "cand_idx", F.create_map(F.lit("discount"), "discount", F.lit("tax"), "tax").alias("scores"))
    new = c.select("question_id", "cand_idx", (F.col("discount") * 2).alias("new_score"))
    return rounded(old.join(new, ["question_id", "cand_idx"]).select("question_id", "cand_idx", F.col("scores")["tax"].alias("old_score"), "new_score"), "new_score")
