"""Queries of slices, shards, joins, sets and summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as X
from ..operators import estimators, etl
from ..sources import fixtures as S
from . import oracle_ctes as C
from .catalog import query, rounded

_POS = "WITH p AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents) "


def _docs(spark, sf):
    return S.table(spark, sf, "documents")


query("slice_offset", _POS + "SELECT doc_id, n_chars FROM p WHERE pos BETWEEN 50 AND 149")(lambda spark, sf: etl.slice_rows(_docs(spark, sf).select("doc_id", "n_chars"), "doc_id", 50, 150))
query("partition_balanced", _POS + "SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) - 1 AS BIGINT) AS part FROM p")(lambda spark, sf: etl.balanced_partition(_docs(spark, sf).select("doc_id"), "doc_id", 7))
query("partition_floor", _POS + "SELECT doc_id, CAST(pos // (n // 7) AS BIGINT) AS part FROM p WHERE pos // (n // 7) < 7")(lambda spark, sf: etl.floor_partition(_docs(spark, sf).select("doc_id"), "doc_id", 7))
query("partition_ceil", _POS + "SELECT doc_id, CAST(floor(pos / ceil(n / 7)) AS BIGINT) AS part FROM p")(lambda spark, sf: etl.ceil_partition(_docs(spark, sf).select("doc_id"), "doc_id", 7))
_H = "(({k}) * 2654435761 + {s} * 40503) % 1000003"
query("train_test_hash_split", f"SELECT doc_id, {_H.format(k='doc_id', s=42)} < 200000 AS is_test FROM documents")(lambda spark, sf: etl.hash_split(_docs(spark, sf).select("doc_id"), "doc_id", 0.2, 42, etl.plain_order))
query("shuffle_select", f"SELECT doc_id FROM documents ORDER BY {_H.format(k='doc_id', s=228)}, doc_id LIMIT 100")(lambda spark, sf: etl.subsample(_docs(spark, sf).select("doc_id"), "doc_id", 100, 228, etl.plain_order))
query("subsample_fraction", f"SELECT doc_id FROM documents ORDER BY {_H.format(k='doc_id', s=7)}, doc_id LIMIT (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM documents)")(lambda spark, sf: etl.subsample(_docs(spark, sf).select("doc_id"), "doc_id", 0.1, 7, etl.plain_order))
query("distinct_question_sample", f"WITH f AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY text), c AS (SELECT text FROM f ORDER BY {_H.format(k='first', s=42)}, first LIMIT 50) SELECT doc_id FROM documents WHERE text IN (SELECT text FROM c)")(lambda spark, sf: etl.distinct_sample(_docs(spark, sf).select("doc_id", "text"), "text", "doc_id", 50, 42, etl.plain_order).select("doc_id"))
query("claim_subsample_cap", f"WITH {C.CLAIM} SELECT doc_id, claim_idx FROM (SELECT doc_id, claim_idx, row_number() OVER (PARTITION BY doc_id ORDER BY {_H.format(k='doc_id * 31 + claim_idx', s=3)}, claim_idx) AS r FROM claim) WHERE r <= 3")(lambda spark, sf: etl.sample_per_group(S.claims(spark, sf).select("doc_id", "claim_idx"), "doc_id", "claim_idx", 3, 3, etl.plain_order))
query("length_filter", "SELECT doc_id, '' AS target_text FROM documents WHERE length(text) <= 1024 ORDER BY doc_id LIMIT 200")(lambda spark, sf: _docs(spark, sf).where(F.length("text") <= 1024).orderBy("doc_id").limit(200).select("doc_id", F.lit("").alias("target_text")))


@query("pending_rows", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL OR toxic IS NULL")
def pending_rows(spark, sf):
    d = _docs(spark, sf).join(S.table(spark, sf, "labels"), "doc_id", "left")
    return etl.pending(etl.ensure_columns(d, {"quality": "int"}), ["quality", "toxic"]).select("doc_id")


def _grouped(spark, sf):
    return S.claims(spark, sf).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("claim_idx", "ids", "verified", "text"))).alias("claims"))


query("supervision_filter", f"WITH {C.CLAIM} SELECT doc_id FROM claim GROUP BY doc_id HAVING count(verified) > 0")(lambda spark, sf: _grouped(spark, sf).where(etl.supervised(F.col("claims.verified"), F.col("claims"))).select("doc_id"))


@query("truncate_claims", f"WITH {C.CLAIM}, l AS (SELECT doc_id, min(claim_idx) FILTER (WHERE first + n - 1 >= 200) AS late, count(*) AS all_claims FROM claim GROUP BY doc_id) SELECT doc_id, coalesce(late, all_claims) AS n_kept FROM l")
def truncate_claims(spark, sf):
    return _grouped(spark, sf).select("doc_id", F.size(etl.truncate_claims(F.col("claims"), 200)).cast("long").alias("n_kept"))


@query("token_targets", f"WITH {C.CLAIM} SELECT doc_id, CAST(first AS BIGINT) + unnest(range(n)) AS pos, coalesce(verified, -100.0) AS target FROM claim")
def token_targets(spark, sf):
    """By a join of tokens with their claims: a later claim would win where two hold one token."""
    c = S.claims(spark, sf).select("doc_id", "claim_idx", "verified", F.explode("ids").alias("pos"))
    last = c.groupBy("doc_id", "pos").agg(F.max(F.when(F.col("verified").isNotNull(), F.struct("claim_idx", "verified"))).alias("w"))
    return last.select("doc_id", "pos", F.coalesce("w.verified", F.lit(-100.0)).alias("target"))


query("reply_tokens", "SELECT doc_id, greatest(len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) - 5, 0) AS n_reply FROM documents")(lambda spark, sf: _docs(spark, sf).select("doc_id", F.size(F.slice(X.words(F.col("text")), 6, 1_000_000_000)).alias("n_reply")))
query("resume_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda spark, sf: etl.unlabelled(_docs(spark, sf).select("doc_id"), S.table(spark, sf, "labels").select("doc_id"), "doc_id"))


@query("resume_validation", "SELECT doc_id FROM documents WHERE doc_id % 9 = 0")
def resume_validation(spark, sf):
    d = _docs(spark, sf).select("doc_id", "lang", "source")
    return etl.mismatches(d.withColumn("lang", F.when(F.col("doc_id") % 9 == 0, None).otherwise(F.col("lang"))), d, "doc_id", ["lang", "source"])


_CACHE = "WITH cache AS (SELECT DISTINCT text AS prompt FROM documents WHERE doc_id % 2 = 0) "
query("cache_miss", _CACHE + "SELECT doc_id FROM documents WHERE text NOT IN (SELECT prompt FROM cache)")(lambda spark, sf: _docs(spark, sf).select("doc_id", "text").join(_docs(spark, sf).where("doc_id % 2 = 0").select("text").distinct(), "text", "left_anti").select("doc_id"))


@query("annotation_lookup", "WITH a AS (SELECT source, lang, max(doc_id) AS last FROM documents GROUP BY source, lang) SELECT d.doc_id, a.last AS annotation FROM documents d LEFT JOIN a ON d.source = a.source AND d.lang = a.lang AND d.lang <> 'fr'")
def annotation_lookup(spark, sf):
    d = _docs(spark, sf)
    a = d.where("lang != 'fr'").groupBy("source", "lang").agg(F.max("doc_id").alias("annotation"))
    return d.join(a, ["source", "lang"], "left").select("doc_id", "annotation")


@query("cached_prediction_join", "WITH p AS (SELECT text, min(doc_id) AS row_idx FROM documents GROUP BY text) SELECT d.doc_id, p.row_idx, substr(d.text, 21) AS reply FROM documents d JOIN p ON d.text = p.text")
def cached_prediction_join(spark, sf):
    d = _docs(spark, sf).select("doc_id", "text")
    p = d.groupBy("text").agg(F.min("doc_id").alias("row_idx"))
    return d.join(p, "text").select("doc_id", "row_idx", F.substring("text", 21, 2**31 - 1).alias("reply"))


query("semi_join_questions", "SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')")(lambda spark, sf: (lambda c: c.join(c.where("role = 'system'").select("conv_id"), "conv_id", "left_semi").select("conv_id", "turn"))(S.table(spark, sf, "conversations")))


@query("union_shards", "SELECT doc_id, doc_id % 3 AS shard FROM documents")
def union_shards(spark, sf):
    out = None
    for k in range(3):
        part = _docs(spark, sf).where(F.col("doc_id") % 3 == k).select("doc_id", F.lit(k).cast("long").alias("shard"))
        out = part if out is None else out.unionByName(part)
    return out


query("method_intersection", "SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'es'")(lambda spark, sf: _docs(spark, sf).where("lang = 'en'").select("source").intersect(_docs(spark, sf).where("lang = 'es'").select("source")))


@query("pair_dedup_reexpand", f"WITH {C.PAIR} SELECT conv_id, i, j, round(jac, 6) AS jac FROM pair WHERE i < j")
def pair_dedup_reexpand(spark, sf):
    c = S.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    pairs = c.select("conv_id", F.col("turn").alias("i"), F.col("text").alias("x")).join(c.select("conv_id", F.col("turn").alias("j"), F.col("text").alias("y")), "conv_id").where("i < j")
    scored = etl.dedupe_and_expand(pairs, "x", "y", lambda d: d.withColumns({"a": X.words(F.col("x")), "b": X.words(F.col("y"))}).select("x", "y", A.jaccard(F.col("a"), F.col("b")).alias("jac")))
    return rounded(scored.select("conv_id", "i", "j", "jac"), "jac")


@query("claim_dataset_stats", f"WITH {C.CLAIM}, d AS (SELECT doc_id, count(*) AS c, count(*) FILTER (WHERE verified IS NULL) AS m FROM claim GROUP BY doc_id) SELECT (SELECT count(*) FROM documents) AS n_rows, CAST(sum(c) AS BIGINT) AS total_claims, round(sum(c) / (SELECT count(*) FROM documents), 6) AS claims_per_row, CAST(sum(m) AS BIGINT) AS missing FROM d")
def claim_dataset_stats(spark, sf):
    d = _docs(spark, sf).select("doc_id").join(_grouped(spark, sf), "doc_id", "left")
    n = F.coalesce(F.size("claims"), F.lit(0))
    known = F.coalesce(F.size(F.filter("claims", lambda c: c["verified"].isNull())), F.lit(0))
    out = d.agg(F.count("*").alias("n_rows"), F.sum(n).alias("total_claims"), F.sum(known).alias("missing"))
    return out.select("n_rows", "total_claims", F.round(F.coalesce(F.try_divide("total_claims", "n_rows"), F.lit(0.0)), 6).alias("claims_per_row"), "missing")


@query("label_stats", f"WITH {C.CLAIM}, d AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE verified = 1) AS p FROM claim GROUP BY doc_id) SELECT round(avg(n), 6) AS labels_per_row, CAST(sum(p) AS BIGINT) AS positives, count(*) FILTER (WHERE p > 0) AS rows_with_positive FROM d")
def label_stats(spark, sf):
    return _grouped(spark, sf).agg(F.round(F.avg(F.size("claims")), 6).alias("labels_per_row"), F.sum(F.size(F.filter("claims", lambda c: c["verified"] == 1))).alias("positives"), F.count_if(F.exists("claims", lambda c: F.coalesce(c["verified"] == 1, F.lit(False)))).alias("rows_with_positive"))


query("label_counts", f"WITH {C.CLAIM} SELECT count(*) FILTER (WHERE verified = 0) AS zeros, count(*) FILTER (WHERE verified = 1) AS ones, count(*) FILTER (WHERE verified IS NULL) AS unknown FROM claim")(lambda spark, sf: S.claims(spark, sf).agg(F.count_if(F.col("verified") == 0).alias("zeros"), F.count_if(F.col("verified") == 1).alias("ones"), F.count_if(F.col("verified").isNull()).alias("unknown")))


@query("test_stats", f"WITH {C.CLAIM}, d AS (SELECT doc_id, coalesce(max(verified), 0) AS bad FROM claim GROUP BY doc_id) SELECT (SELECT count(*) FROM d WHERE bad = 0) AS problems_correct, (SELECT count(*) FROM d WHERE bad = 1) AS problems_incorrect, count(*) FILTER (WHERE verified = 0) AS steps_correct, count(*) FILTER (WHERE verified = 1) AS steps_incorrect, round(100 * avg(verified), 6) AS percent_incorrect FROM claim")
def test_stats(spark, sf):
    c = S.claims(spark, sf).groupBy("doc_id").agg(F.coalesce(F.max("verified"), F.lit(0.0)).alias("bad"), F.count_if(F.col("verified") == 0).alias("right"), F.count_if(F.col("verified") == 1).alias("wrong"))
    out = c.agg(F.count_if(F.col("bad") == 0).alias("problems_correct"), F.count_if(F.col("bad") == 1).alias("problems_incorrect"), F.sum("right").alias("steps_correct"), F.sum("wrong").alias("steps_incorrect"))
    return out.withColumn("percent_incorrect", F.round(100 * F.try_divide(F.col("steps_incorrect"), F.col("steps_correct") + F.col("steps_incorrect")), 6))


@query("run_metrics", f"WITH {C.TRAJ} SELECT run, count(*) AS total, count(*) FILTER (WHERE completed) AS completed, count(*) FILTER (WHERE failed) AS errors, count(*) FILTER (WHERE completed AND NOT failed) AS correct, round(count(*) FILTER (WHERE completed AND NOT failed) / count(*), 6) AS accuracy, round(count(*) FILTER (WHERE completed AND NOT failed) / count(*) FILTER (WHERE completed), 6) AS accuracy_of_completed, round(avg(len(steps)) FILTER (WHERE completed), 6) AS avg_steps, round(sum(list_sum(step_scores)) / sum(len(step_scores)), 6) AS avg_score FROM traj GROUP BY run")
def run_metrics(spark, sf):
    t = S.trajectories(spark, sf).withColumn("right", F.col("completed") & ~F.col("failed"))
    out = t.groupBy("run").agg(F.count("*").alias("total"), F.count_if("completed").alias("completed"), F.count_if("failed").alias("errors"), F.count_if("right").alias("correct"), F.avg(F.when(F.col("completed"), F.size("steps"))).alias("avg_steps"), F.try_divide(F.sum(A.total(F.col("step_scores"))), F.sum(F.size("step_scores"))).alias("avg_score"))
    out = out.withColumn("accuracy", F.col("correct") / F.col("total")).withColumn("accuracy_of_completed", F.try_divide("correct", "completed"))
    return rounded(out, "accuracy", "accuracy_of_completed", "avg_steps", "avg_score")


query("counts_by_type", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")(lambda spark, sf: S.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")))
for _k, _f in (("mean", F.avg), ("min", F.min), ("max", F.max)):
    query(f"claim_reduce_{_k}", f"WITH {C.REW} SELECT doc_id, round({'avg' if _k == 'mean' else _k}(reward), 6) AS value FROM rew GROUP BY doc_id")(lambda spark, sf, f=_f: rounded(S.step_rewards(spark, sf).groupBy("doc_id").agg(f("reward").alias("value")), "value"))
_SG = "1 / (1 + exp(-(ll + 8)))"
for _k, _q in (("mean_logits", "avg(ll + 8)"), ("mean", f"avg({_SG})"), ("prod_geom", f"exp(sum(ln({_SG})))"), ("mean_geom", f"exp(sum(ln({_SG}))) / count(*)"), ("max", f"max({_SG})"), ("min", f"min({_SG})")):
    query(f"token_to_claim_{_k}", f"WITH {C.TOK}, {C.CLAIM} SELECT c.doc_id, claim_idx, round({_q}, 6) AS value FROM claim c JOIN tok t ON c.doc_id = t.doc_id AND t.pos BETWEEN c.first AND c.first + c.n - 1 GROUP BY c.doc_id, claim_idx")(
        lambda spark, sf, k=_k: rounded(S.claim_values(spark, sf, ("ll",), lambda ids: estimators.reduce_claim(F.transform(ids, lambda i: F.get("ll", i) + 8), k)).select("doc_id", "claim_idx", "value"), "value")
    )


@query("candidate_score_aggregates", f"WITH {C.CAND} SELECT question_id, round(avg(discount), 6) AS mean, max(discount) AS max, min(discount) AS min, round(median(discount), 6) AS median, round(stddev_pop(discount), 6) AS std, count(*) AS n FROM cand GROUP BY question_id")
def candidate_score_aggregates(spark, sf):
    g = S.candidates(spark, sf).groupBy("question_id").agg(F.avg("discount").alias("mean"), F.max("discount").alias("max"), F.min("discount").alias("min"), F.median("discount").alias("median"), F.stddev_pop("discount").alias("std"), F.count("*").alias("n"))
    return rounded(g.fillna({"mean": 0.5, "max": 0.5, "min": 0.5, "median": 0.5, "std": 0.0}), "mean", "median", "std")


@query("ensemble_scorer_mean", f"WITH {C.CAND} SELECT question_id, cand_idx, round((2 * discount + 3 * CASE WHEN cand_idx % 5 = 0 THEN 0.5 ELSE tax END) / 5, 6) AS score FROM cand")
def ensemble_scorer_mean(spark, sf):
    """A scorer that fails counts 0.5."""
    c = S.candidates(spark, sf).withColumn("tax", F.when(F.col("cand_idx") % 5 == 0, None).otherwise(F.col("tax")))
    return rounded(c.select("question_id", "cand_idx", ((2 * F.coalesce("discount", F.lit(0.5)) + 3 * F.coalesce("tax", F.lit(0.5))) / 5).alias("score")), "score")


query("multiref_max", f"WITH {C.PAIR} SELECT conv_id, i, round(max(jac), 6) AS value FROM pair WHERE i <> j GROUP BY conv_id, i")(lambda spark, sf: rounded(S.sample_pairs(spark, sf).where("i != j").groupBy("conv_id", "i").agg(F.max(F.when(~F.isnan("jac"), F.col("jac"))).alias("value")), "value"))
query("align_max_mean", f"WITH {C.PAIR} SELECT conv_id, round(avg(m), 6) AS value FROM (SELECT conv_id, j, max(jac) AS m FROM pair WHERE i <> j GROUP BY conv_id, j) GROUP BY conv_id")(lambda spark, sf: rounded(S.sample_pairs(spark, sf).where("i != j").groupBy("conv_id", "j").agg(F.max("jac").alias("m")).groupBy("conv_id").agg(F.avg("m").alias("value")), "value"))


@query("idf", f"WITH {C.TOK}, d AS (SELECT DISTINCT doc_id, tok FROM trows) SELECT tok, round(ln((SELECT count(*) FROM documents) / (count(*) + 1)), 6) AS idf FROM d GROUP BY tok")
def idf(spark, sf):
    d = _docs(spark, sf)
    n = d.agg(F.count("*").alias("n"))
    df = d.select(F.explode(F.array_distinct(X.words(F.col("text")))).alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))
    return rounded(df.crossJoin(n).select("tok", F.log(F.col("n") / (F.col("df") + 1)).alias("idf")), "idf")  # one row


@query("class_histogram", f"WITH {C.DIST} SELECT label, k % 4 AS class_id, round(sum(exp(l)), 6) AS mass FROM cell GROUP BY label, k % 4")
def class_histogram(spark, sf):
    c = S.distributions(spark, sf).select("label", F.posexplode("lp").alias("k", "l"))
    return rounded(c.groupBy("label", (F.col("k") % 4).alias("class_id")).agg(F.sum(F.exp("l")).alias("mass")), "mass")


query("original_order", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS original_index FROM documents")(lambda spark, sf: etl.positions(_docs(spark, sf).select("doc_id"), "doc_id").select("doc_id", F.col("position").alias("original_index")))


@query("prefix_prompts", f"WITH {C.CLAIM} SELECT doc_id, claim_idx, string_agg(text, chr(10)) OVER (PARTITION BY doc_id ORDER BY claim_idx) AS prompt FROM claim")
def prefix_prompts(spark, sf):
    """Each claim with all before it, as a fact check is asked."""
    w = Window.partitionBy("doc_id").orderBy("claim_idx").rowsBetween(Window.unboundedPreceding, 0)
    c = S.claims(spark, sf)
    return c.select("doc_id", "claim_idx", F.array_join(F.collect_list("text").over(w), "\n").alias("prompt"))


@query("generation_stats", r"WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations), q AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(ref), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS b FROM p WHERE ref IS NOT NULL) SELECT round(avg(CASE WHEN trim(text) = trim(ref) THEN 1 ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN contains(text, '.') THEN 1 ELSE 0 END), 6) AS finished, round(avg(CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END), 6) AS jaccard FROM q")
def generation_stats(spark, sf):
    c = S.table(spark, sf, "conversations").withColumn("ref", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("ref IS NOT NULL")
    c = c.withColumns({"a": X.words(F.lower("text")), "b": X.words(F.lower("ref"))})
    return c.agg(F.round(F.avg((F.trim("text") == F.trim("ref")).cast("int")), 6).alias("accuracy"), F.round(F.avg(F.col("text").contains(".").cast("int")), 6).alias("finished"), F.round(F.avg(A.jaccard(F.col("a"), F.col("b"))), 6).alias("jaccard"))
