"""All queries of the library outside its optional subpackage, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import estimators, evaluate
from ..sources import fixtures as S
from . import oracle_ctes as C
from . import q_dialogues, q_estimators, q_etl, q_evaluate, q_features, q_more, q_select, q_similarity, q_text  # noqa: F401
from .catalog import ORACLES, QUERIES, query, rounded

__all__ = ["ORACLES", "QUERIES", "flagship"]

_U = f"WITH {C.TOK}, p AS (SELECT doc_id, lang, -avg(ll) AS ue FROM tok GROUP BY doc_id, lang), a AS (SELECT p.doc_id AS unit, p.lang, ue, CAST(quality AS DOUBLE) AS y FROM p JOIN labels l ON p.doc_id = l.doc_id), "
_R = "r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY ue, unit) AS k, sum(y) OVER (PARTITION BY lang ORDER BY ue, unit ROWS UNBOUNDED PRECEDING) AS s, rank() OVER (PARTITION BY lang ORDER BY ue) + (count(*) OVER (PARTITION BY lang, ue) - 1) / 2.0 AS mr FROM a) "


@query("flagship", _U + _R + "SELECT lang, 'prr' AS ue_metric, round(avg(s / k), 6) AS value FROM r GROUP BY lang UNION ALL SELECT lang, 'rcc-auc', round(avg((k - s) / k), 6) FROM r GROUP BY lang UNION ALL SELECT lang, 'roc-auc', round((sum(mr * (1 - y)) - sum(1 - y) * (sum(1 - y) + 1) / 2) / (sum(1 - y) * sum(y)), 6) FROM r GROUP BY lang")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of the labelled documents against their quality, in each language: rejection, risk-coverage and ROC area."""
    scores = S.sequences(spark, sf_dir, ("ll",)).select("doc_id", "lang", estimators.perplexity(F.col("ll")).alias("ue"))
    labels = S.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("target"))
    rows = scores.join(labels, "doc_id").select(F.col("doc_id").alias("unit"), "lang", "ue", "target")
    # three metrics read these few columns several times each
    rows = rows.persist()
    return rounded(evaluate.metrics_table(rows, ["lang"], ["prr", "rcc-auc", "roc-auc"]), "value")
