"""Queries of the remaining rows: scorers, replies, chunks, maps, result files, run observers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import sequential
from ..functions import text as X
from ..operators import ensembles, estimators, evaluate, spectral
from ..sources import fixtures as S
from ..sources import io
from . import oracle_ctes as C
from .catalog import query, rounded


@query("result_glob", "SELECT CASE user_id % 3 WHEN 0 THEN 'process reward' WHEN 1 THEN 'validity' ELSE 'learned head' END AS kind, count(*) AS n FROM events GROUP BY user_id % 3")
def result_glob(spark, sf):
    """Result files of several runs, read by one pattern; the kind of model is in the file's folder."""
    path = io.scratch(spark, "results")
    e = S.table(spark, sf, "events").select("event_id", "user_id")
    for k, name in enumerate(("run_reward", "run_validity", "run_head")):
        e.where(F.col("user_id") % 3 == k).write.json(f"{path}/{name}")
    rows = spark.read.json(f"{path}/*").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("name"))
    return rows.groupBy(X.model_kind(F.col("name")).alias("kind")).agg(F.count("*").alias("n"))


@query("details_csv", f"WITH {C.CLAIM} SELECT doc_id, count(*) AS n_claims FROM claim GROUP BY doc_id")
def details_csv(spark, sf):
    path = io.scratch(spark, "details")
    io.save_details(S.claims(spark, sf).groupBy("doc_id").agg(F.collect_list("claim_idx").alias("claims")), path)
    back = spark.read.schema("doc_id long, claims string").csv(path, header=True)
    return back.select("doc_id", F.size(F.from_json("claims", "array<int>")).cast("long").alias("n_claims"))


@query("shift_claims", f"WITH {C.CLAIM}, t AS (SELECT doc_id, claim_idx, CAST(first AS BIGINT) + unnest(range(n)) AS pos FROM claim) SELECT doc_id, claim_idx, count(*) AS n, min(7 + pos - pos // 10) AS first_id FROM t WHERE pos % 10 <> 9 GROUP BY doc_id, claim_idx")
def shift_claims(spark, sf):
    """Every tenth token stands in as special. Positions map by arithmetic on a join of tokens, one row per token."""
    t = S.claims(spark, sf).select("doc_id", "claim_idx", F.explode("ids").alias("pos"))
    special = S.table(spark, sf, "documents").select("doc_id", F.posexplode(X.words(F.col("text"))).alias("pos", "w")).select("doc_id", "pos", (F.col("pos") % 10 == 9).alias("special"))
    from pyspark.sql import Window

    before = F.sum(F.col("special").cast("int")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    plain = special.withColumn("new", 7 + F.col("pos") - before).where("NOT special")
    return t.join(plain, ["doc_id", "pos"]).groupBy("doc_id", "claim_idx").agg(F.count("*").alias("n"), F.min("new").alias("first_id"))


@query("claim_pr_auc", f"WITH {C.TOK}, {C.CLAIM}, s AS (SELECT c.doc_id, claim_idx, any_value(verified) AS y, round(avg(-ll), 9) AS ue FROM claim c JOIN tok t ON c.doc_id = t.doc_id AND t.pos BETWEEN c.first AND c.first + c.n - 1 WHERE verified IS NOT NULL GROUP BY c.doc_id, claim_idx), k AS (SELECT ue, count(*) AS c, sum(y) AS p FROM s GROUP BY ue), m AS (SELECT *, sum(c) OVER (ORDER BY ue DESC) AS cc, sum(p) OVER (ORDER BY ue DESC) AS cp FROM k) SELECT round(sum(cp / cc * p) / sum(p), 6) AS value FROM m")
def claim_pr_auc(spark, sf):
    c = S.claim_values(spark, sf, ("ll",), lambda ids: -A.mean(A.gather(F.col("ll"), ids))).where("verified IS NOT NULL")
    rows = c.select((F.col("doc_id") * 100_000 + F.col("claim_idx")).alias("unit"), F.round("value", 9).alias("ue"), F.col("verified").alias("target"))
    return rounded(evaluate.pr_auc(rows.persist(), []), "value")


_W = f"WITH {C.ENS}, mix AS (SELECT obs, token_idx, k, ln(sum(exp(l))) - ln(count(*)) AS l FROM ecell GROUP BY obs, token_idx, k), tot AS (SELECT obs, token_idx, -sum(l * exp(l)) AS v FROM mix GROUP BY obs, token_idx), dat AS (SELECT obs, token_idx, avg(h) AS v FROM (SELECT obs, token_idx, model, -sum(l * exp(l)) AS h FROM ecell GROUP BY obs, token_idx, model) GROUP BY obs, token_idx), s AS (SELECT obs, token_idx, model, max(l) AS l FROM ecell GROUP BY obs, token_idx, model), b AS (SELECT obs, token_idx, ln(sum(exp(l))) - ln(count(*)) AS p FROM s GROUP BY obs, token_idx) "
for _m, _v in (("total", "tot.v"), ("data", "d.v"), ("mutual", "tot.v - d.v")):
    for _equal in (False, True):

        def _beams(spark, sf, measure=_m, equal=_equal):
            e = S.ensemble(spark, sf)
            s = e.groupBy("obs", "token_idx").agg((F.log(F.sum(F.exp(F.array_max("lp")))) - F.log(F.count("*").cast("double"))).alias("p"))
            return rounded(ensembles.beam_weighted(ensembles.token_measures(e), s, measure, equal), "value")

        _w = "1.0" if _equal else "exp(p)"
        query(f"ens_beam_{_m}{'_equal' if _equal else ''}", _W + f"SELECT obs, round(sum({_w} * ({_v})) / sum({_w}), 6) AS value FROM tot JOIN dat d USING (obs, token_idx) JOIN b USING (obs, token_idx) GROUP BY obs")(_beams)

query("length_penalty", f"WITH {C.SAMP} SELECT conv_id, turn, round(logprob / pow(len, 0.6), 6) AS value FROM samp")(lambda spark, sf: rounded(S.samples(spark, sf).select("conv_id", "turn", estimators.length_penalised(F.col("logprob"), F.size("lls"), 0.6).alias("value")), "value"))
query("flatten_keys", "SELECT event_id, 'props/k' AS key, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value FROM events")(
    lambda spark, sf: S.table(spark, sf, "events").select("event_id", F.explode(F.transform_keys(F.from_json("props", "map<string,string>"), lambda k, _: F.concat(F.lit("props/"), k))).alias("key", "value"))
)
query("class_map", f"WITH {C.PAIR}, c AS (SELECT conv_id, i AS turn, min(j) AS class_id FROM pair WHERE cls = 2 GROUP BY conv_id, i) SELECT conv_id, turn, class_id, count(*) OVER (PARTITION BY conv_id, class_id) AS class_size FROM c")(
    lambda spark, sf: (
        lambda c: c.groupBy("conv_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("turn", "class_id"))).alias("to_class"))
        .select("conv_id", "to_class", F.explode("to_class").alias("turn", "class_id"))
        .select("conv_id", "turn", "class_id", F.size(F.filter(F.map_values("to_class"), lambda v: v == F.col("class_id"))).cast("long").alias("class_size"))
    )(S.sample_pairs(spark, sf).where("cls = 2").groupBy("conv_id", F.col("i").alias("turn")).agg(F.min("j").alias("class_id")))
)


@query("align_chunks", r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents) SELECT doc_id, k // 350 AS pos, array_to_string(w[k + 1:k + 350], ' ') AS chunk FROM (SELECT doc_id, w, unnest(range(0, len(w), 350)) AS k FROM w)")
def align_chunks(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"), 350)).alias("pos", "chunk"))


query("fact_check_parse", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.0 WHEN doc_id % 3 = 1 THEN 1.0 END AS label FROM documents")(
    lambda spark, sf: S.table(spark, sf, "documents").select("doc_id", X.fact_check(F.when(F.col("doc_id") % 6 == 0, "True.").when(F.col("doc_id") % 6 == 3, "是").when(F.col("doc_id") % 6 == 1, '"False"').when(F.col("doc_id") % 6 == 4, "否").otherwise("unsure")).alias("label"))
)
query("prm_softmax_pair", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(exp(l_tax) / (exp(l_tax) + exp(l_discount)), 6) AS reward FROM lineitem")(
    lambda spark, sf: rounded(S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", estimators.softmax_pair(F.col("l_tax"), F.col("l_discount")).alias("reward")), "reward")
)


@query("step_reward_gather", f"WITH {C.DIST} SELECT vec_id, CAST(k // 16 AS INT) AS step, round(1 / (1 + exp(-l)), 6) AS reward FROM cell WHERE k % 16 = 15")
def step_reward_gather(spark, sf):
    d = S.distributions(spark, sf).withColumn("flags", F.transform("lp", lambda x, i: i % 16 == 15))
    return rounded(d.select("vec_id", F.posexplode(estimators.flagged(F.col("lp"), F.col("flags"))).alias("step", "reward")), "reward")


query("majority_mean", "SELECT l_orderkey, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem GROUP BY l_orderkey")(
    lambda spark, sf: rounded(S.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list((F.col("l_returnflag") == "R").cast("int")).alias("v")).select("l_orderkey", estimators.majority_mean(F.col("v")).alias("share")), "share")
)


@query("evaluator_scores", f"WITH {C.DIST}, z AS (SELECT vec_id, e[1] AS a, e[2] AS b, e[3] AS c FROM demb) SELECT vec_id, round((exp(b) + exp(c)) / (exp(a) + exp(b) + exp(c)), 6) AS validity, round(exp(b) / (exp(a) + exp(b) + exp(c)), 6) AS redundancy FROM z")
def evaluator_scores(spark, sf):
    e = S.table(spark, sf, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 3).alias("z"))
    return rounded(e.select("vec_id", estimators.validity_and_redundancy(F.col("z")).alias("r")).select("vec_id", "r.validity", "r.redundancy"), "validity", "redundancy")


@query("focus")
def focus(spark, sf):
    """Attention stands in as a decay over distance, down to 2^-48; tokens of an even number are keywords."""

    def value(pdf):
        pdf = pdf.sort_values("vec_id")
        edges = ((k, j, 0.5 ** (k - j)) for k in range(len(pdf)) for j in range(max(0, k - 48), k))
        return sequential.focus(pdf["base"].tolist(), (pdf["vec_id"] % 2 == 0).tolist(), edges) or 0.0

    d = S.distributions(spark, sf).select("label", "vec_id", estimators.focus_weight(F.col("lp")).alias("base"))
    return rounded(spectral.per_group(d, ["label"], value), "value")


for _name, _fn in (("smart_l", sequential.smart_l), ("smart_n", sequential.smart_n)):

    def _smart(spark, sf, fn=_fn):
        """Sentences of consecutive turns, matched by word overlap."""
        from pyspark.sql import Window

        def score(a, b):
            x, y = sequential.merged_sentences(a), sequential.merged_sentences(b)
            return fn([[sequential.lexical_score(p, h, "rouge1") for h in y] for p in x])

        c = S.table(spark, sf, "conversations").withColumn("ref", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("ref IS NOT NULL")
        return rounded(c.select("conv_id", "turn", F.udf(score, "double", useArrow=True)("text", "ref").alias("value")), "value")

    query(_name)(_smart)


@query("binned_edges", f"WITH {C.ANS}, " + C.BINS.format(rows="ans") + " SELECT CAST(bin AS INT) AS bin, round(lo, 6) AS edge, round(m, 6) AS mean FROM bmean")
def binned_edges(spark, sf):
    from ..operators import calibrate

    edges, means = calibrate.binned_curve(calibrate.score_cells(S.scored_answers(spark, sf)), 10)
    return spark.createDataFrame([(k, float(np.round(edges[k], 6)), float(np.round(means[k], 6))) for k in range(len(means))], "bin int, edge double, mean double")


@query("multi_dataset_load", "SELECT doc_id, TRY_CAST(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang || '' END AS BIGINT) AS label FROM documents WHERE doc_id % 4 IN (0, 1)")
def multi_dataset_load(spark, sf):
    """A nested list of data sets, one of them by a split, in one table; a label that is no number becomes null."""
    a, b = io.scratch(spark, "set-a"), io.scratch(spark, "set-b")
    d = S.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("label"), F.when(F.col("doc_id") % 4 == 1, "test").otherwise("train").alias("split"))
    d.where("doc_id % 4 = 0").write.parquet(a)
    d.where("doc_id % 4 > 0").write.parquet(b)
    return io.load_many(spark, [[a], f"{b}:test"], 228, "doc_id", {"label": "bigint"}).select("doc_id", "label")


@query("observed_run", "SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total FROM documents")
def observed_run(spark, sf):
    """What a run's callback reports: counts gathered while the rows are written."""
    path = io.scratch(spark, "observed")
    got = io.observed(S.table(spark, sf, "documents").select("doc_id", "n_chars"), lambda d: d.write.parquet(path), n=F.count(F.lit(1)), total=F.sum("n_chars"))
    return spark.createDataFrame([(got["n"], got["total"])], "n long, total long")


@query("source_dispatch", "SELECT doc_id, lang AS language, CAST(n_chars AS DOUBLE) AS length FROM documents")
def source_dispatch(spark, sf):
    """Read by suffix, renamed and cast."""
    path = io.scratch(spark, "dispatch") + ".csv"
    S.table(spark, sf, "documents").select("doc_id", "lang", "n_chars").write.csv(path, header=True)
    return io.read(spark, path, io.kind_of(path)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("language"), F.col("n_chars").cast("double").alias("length"))


@query("batch_ids", "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 32 AS BIGINT) AS batch FROM documents")
def batch_ids(spark, sf):
    """Rows in batches of 32 in order of their key."""
    from ..operators import etl

    return etl.positions(S.table(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id", F.floor(F.col("position") / 32).cast("long").alias("batch"))


@query("random_baseline", f"WITH {C.ANS} SELECT lang, round(avg(target), 6) AS prr, round(1 - avg(target), 6) AS rcc_auc, 0.5 AS roc_auc FROM ans GROUP BY lang")
def random_baseline(spark, sf):
    """What a random score is worth on average: exact expectations in place of a thousand shuffles."""
    d = evaluate.normalized_target(evaluate.clean(S.scored_answers(spark, sf)), ["lang"])
    return rounded(d.groupBy("lang").agg(F.avg("target").alias("prr"), (1 - F.avg("target")).alias("rcc_auc")).withColumn("roc_auc", F.lit(0.5)), "prr", "rcc_auc")
