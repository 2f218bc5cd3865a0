"""Queries of the estimators over pairs, classes, spectra and densities, of steps, and of text overlap metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import sequential
from ..functions import text as X
from ..operators import density, evaluate, pairs, spectral
from ..sources import fixtures as S
from . import oracle_ctes as C
from .catalog import query, rounded

_KEY = ["conv_id"]


def _spectral(name: str, columns: list[str], function) -> None:
    query(name)(lambda spark, sf: rounded(spectral.per_matrix(S.sample_pairs(spark, sf), _KEY, columns, function), "value"))


for _k, _c, _w in (("entail", "entail", lambda m: m), ("contra", "contra", lambda m: 1 - m), ("jaccard", "jac", lambda m: m + np.diag(1 - np.diag(m)))):
    _spectral(f"eccentricity_{_k}", [_c], lambda m, w=_w: spectral.eccentricity(w(m)))
    _spectral(f"eigval_laplacian_{_k}", [_c], lambda m, w=_w: spectral.laplacian_sum(w(m)))
_spectral("kernel_language_entropy", ["entail", "contra"], lambda e, c: spectral.kernel_entropy(e, 1 - e - c))

_CC = """, tie AS (SELECT a.conv_id, a.i, a.j FROM pair a JOIN pair b ON a.conv_id = b.conv_id AND a.i = b.j AND a.j = b.i WHERE a.entail > a.contra AND b.entail > b.contra),
reach AS (SELECT conv_id, i, j FROM tie UNION SELECT r.conv_id, r.i, t.j FROM reach r JOIN tie t ON r.conv_id = t.conv_id AND r.j = t.i),
root AS (SELECT conv_id, i, min(j) AS r FROM reach GROUP BY conv_id, i) SELECT conv_id, CAST(count(DISTINCT r) AS DOUBLE) AS value FROM root GROUP BY conv_id"""
query("num_sem_sets", f"WITH RECURSIVE {C.PAIR}{_CC}")(lambda spark, sf: spectral.per_matrix(S.sample_pairs(spark, sf), _KEY, ["entail", "contra"], spectral.semantic_sets))


@query("eigenscore")
def eigenscore(spark, sf):
    e = S.table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 16).alias("part"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rounded(spectral.per_group(e, ["label", "part"], lambda p: spectral.eigen_score(np.stack(p.sort_values("vec_id")["v"].to_numpy()))), "value")


def _classes(spark, sf):
    """Classes stand in by the word-overlap graph: a sample's class is the least sample whose overlap with it counts as entailment."""
    p = S.sample_pairs(spark, sf)
    # no filter of pairs: pushed into their join, it would compare their words once more for each case of cls
    return p.groupBy("conv_id", F.col("i").alias("turn")).agg(F.min(F.when(F.col("cls") == 2, F.col("j"))).alias("class_id")).where("class_id IS NOT NULL")


_CLS = f"WITH {C.SAMP}, {C.PAIR}, cls AS (SELECT conv_id, i AS turn, min(j) AS class_id FROM pair WHERE cls = 2 GROUP BY conv_id, i), s AS (SELECT samp.*, class_id FROM samp JOIN cls ON samp.conv_id = cls.conv_id AND samp.turn = cls.turn) "


def _samples_in_classes(spark, sf):
    return S.samples(spark, sf).select("conv_id", "turn", (F.col("logprob") / F.size("lls")).alias("logprob")).join(_classes(spark, sf), ["conv_id", "turn"])


query("semantic_entropy", _CLS + "SELECT conv_id, round(-avg(v), 6) AS value FROM (SELECT conv_id, ln(sum(exp(logprob / len)) OVER (PARTITION BY conv_id, class_id)) AS v FROM s) GROUP BY conv_id")(lambda spark, sf: rounded(pairs.semantic_entropy(_samples_in_classes(spark, sf), "conv_id"), "value"))
query("semantic_entropy_empirical", _CLS + "SELECT conv_id, round(-avg(v), 6) AS value FROM (SELECT conv_id, ln(count(*) OVER (PARTITION BY conv_id, class_id) / count(*) OVER (PARTITION BY conv_id)) AS v FROM s) GROUP BY conv_id")(lambda spark, sf: rounded(pairs.semantic_entropy(_samples_in_classes(spark, sf), "conv_id", empirical=True), "value"))
query("label_prob", _CLS + "SELECT conv_id, round(1 - max(c) / sum(c), 6) AS value FROM (SELECT conv_id, count(*) AS c FROM s GROUP BY conv_id, class_id) GROUP BY conv_id")(lambda spark, sf: rounded(pairs.label_prob(_samples_in_classes(spark, sf), "conv_id"), "value"))
query("semantic_classes")(lambda spark, sf: spectral.semantic_classes(S.sample_pairs(spark, sf), _KEY))


@query("token_semantic_entropy")
def token_semantic_entropy(spark, sf):
    """Token classes by cosine clustering of the tokens' embeddings; minus the mean of P ln P over the classes."""

    def value(p):
        labels = spectral.cosine_clusters(np.stack(p.sort_values("vec_id")["v"].to_numpy()), 0.5)
        w = np.exp(p.sort_values("vec_id")["lp0"].to_numpy(float))
        mass = np.bincount(labels, w / w.sum())
        return -(mass * np.log(mass)).mean()

    d = S.distributions(spark, sf).join(S.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "vec_id")
    return rounded(spectral.per_group(d.select("label", "vec_id", "v", F.element_at("lp", 1).alias("lp0")), ["label"], value), "value")


for _k in ("rouge1", "rouge2", "rougeL", "BLEU"):

    def _lexical(spark, sf, kind=_k):
        c = S.table(spark, sf, "conversations").select("conv_id", "turn", "text")
        p = c.select("conv_id", F.col("turn").alias("i"), F.col("text").alias("a")).join(c.select("conv_id", F.col("turn").alias("j"), F.col("text").alias("b")), "conv_id").where("i < j")
        return rounded(p.select("conv_id", sequential.lexical_udf(kind)("a", "b").alias("s")).groupBy("conv_id").agg((-F.avg("s")).alias("value")), "value")

    def _quality(spark, sf, kind=_k):
        c = S.table(spark, sf, "conversations").withColumn("ref", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("ref IS NOT NULL")
        if kind == "BLEU":
            return rounded(c.select("conv_id", "turn", sequential.lexical_udf("sentence_bleu")("text", "ref").alias("value")), "value")
        score = sequential.lexical_udf(kind)
        return rounded(c.select("conv_id", "turn", F.try_divide(score("text", "ref"), score("ref", "ref")).alias("value")), "value")

    query(f"lexical_similarity_{_k.lower()}")(_lexical)
    query(_k.lower())(_quality)


@query("rouge1_overlap", rf"WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations), w AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS tok, 'a' AS s FROM p WHERE ref IS NOT NULL UNION ALL SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(ref), '[\x20\x09-\x0D]+'), lambda x: x <> '')), 'b' FROM p WHERE ref IS NOT NULL), c AS (SELECT conv_id, turn, tok, count(*) FILTER (WHERE s = 'a') AS a, count(*) FILTER (WHERE s = 'b') AS b FROM w GROUP BY conv_id, turn, tok) SELECT conv_id, turn, round(2 * sum(least(a, b)) / (sum(a) + sum(b)), 6) AS value FROM c GROUP BY conv_id, turn")
def rouge1_overlap(spark, sf):
    """Unigram overlap with DataFrame functions only; a pair of texts meets in one row, so a task holds a few rows' words."""
    c = S.table(spark, sf, "conversations").withColumn("ref", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("ref IS NOT NULL")
    bag = lambda col: F.sort_array(F.flatten(F.collect_list(F.coalesce(X.words(F.lower(col)), F.array().cast("array<string>")))))
    t = c.groupBy("conv_id", "turn").agg(bag("text").alias("a"), bag("ref").alias("b")).where(F.size("a") + F.size("b") > 0)
    t = t.withColumns({"p": A.run_starts(F.col("a")), "q": A.run_starts(F.col("b"))})
    hits = F.size(F.array_intersect(A.numbered(F.col("a"), F.col("p")), A.numbered(F.col("b"), F.col("q"))))
    return rounded(t.select("conv_id", "turn", (2 * hits / (F.size("a") + F.size("b"))).alias("value")), "value")


@query("cosine_similarity", f"WITH {C.DIST}, c AS (SELECT vec_id, label, e, lead(e) OVER (PARTITION BY label ORDER BY vec_id) AS f FROM demb) SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda k: e[k] * f[k])) / (sqrt(list_sum(list_transform(e, lambda x: x * x))) * sqrt(list_sum(list_transform(f, lambda x: x * x)))), 6) AS value FROM c WHERE f IS NOT NULL")
def cosine_similarity(spark, sf):
    e = S.table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    e = e.withColumn("f", F.lead("e").over(Window.partitionBy("label").orderBy("vec_id"))).where("f IS NOT NULL")
    return rounded(e.select("vec_id", A.cosine(F.col("e"), F.col("f")).alias("value")), "value")


@query("embedding_pooling", f"WITH {C.DIST}, u AS (SELECT label, unnest(e) AS x, unnest(range(64)) AS k FROM demb) SELECT label, k, round(avg(x), 6) AS mean, round(max(x), 6) AS max, round(sum(x), 6) AS sum FROM u GROUP BY label, k")
def embedding_pooling(spark, sf):
    e = S.table(spark, sf, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "x"))
    return rounded(e.groupBy("label", "k").agg(F.avg("x").alias("mean"), F.max("x").alias("max"), F.sum("x").alias("sum")), "mean", "max", "sum")


@query("leave_one_out", r"WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM conversations) SELECT conv_id, turn, unnest(range(len(w))) AS pos, unnest(list_transform(range(len(w)), lambda k: array_to_string(list_concat(w[1:k], w[k + 2:]), ' '))) AS text FROM t")
def leave_one_out(spark, sf):
    """The texts that a similarity model would compare with the whole: one word left out."""
    t = S.table(spark, sf, "conversations").select("conv_id", "turn", X.words(F.col("text")).alias("w"))
    rows = t.where(F.size("w") > 0).select("conv_id", "turn", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("pos"))
    return rows.select("conv_id", "turn", "pos", F.array_join(F.concat(F.slice("w", F.lit(1), F.col("pos")), F.slice("w", F.col("pos") + 2, F.size("w"))), " ").alias("text"))


def _split(spark, sf):
    e = S.table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return e, e.where("vec_id % 10 < 7"), e.where("vec_id % 10 >= 7")


@query("mahalanobis")
def mahalanobis(spark, sf):
    _, train, test = _split(spark, sf)
    return rounded(density.mahalanobis(test, "v", density.fit(train, "v"), "value").select("vec_id", "value"), "value")


@query("mahalanobis_scaled")
def mahalanobis_scaled(spark, sf):
    _, train, test = _split(spark, sf)
    model = density.fit(train, "v")
    return rounded(density.scaled(density.mahalanobis(test, "v", model, "value"), density.mahalanobis(train, "v", model, "value"), "value").select("vec_id", "value"), "value")


@query("relative_mahalanobis")
def relative_mahalanobis(spark, sf):
    everything, train, test = _split(spark, sf)
    rows = density.mahalanobis(density.mahalanobis(test, "v", density.fit(train.where("label < 5"), "v"), "md"), "v", density.fit(everything, "v"), "md0")
    return rounded(rows.select("vec_id", (F.col("md") - F.col("md0")).alias("value")), "value")


@query("ppl_md")
def ppl_md(spark, sf):
    """Mean of the ranks of two scores among the training rows."""
    _, train, test = _split(spark, sf)
    model = density.fit(train, "v")
    both = lambda d: density.mahalanobis(d, "v", model, "md").select("vec_id", "md", (-A.mean(F.col("v"))).alias("ppl"))
    a = evaluate.empirical_rank(both(test), both(train), "vec_id", "md").withColumnRenamed("rank_share", "a")
    b = evaluate.empirical_rank(both(test), both(train), "vec_id", "ppl").withColumnRenamed("rank_share", "b")
    return rounded(a.join(b, "vec_id").select("vec_id", ((F.col("a") + F.col("b")) / 2).alias("value")), "value")


@query("rde")
def rde(spark, sf):
    _, train, test = _split(spark, sf)
    return rounded(density.robust_density(test, train, "vec_id", "v", "value").select("vec_id", "value"), "value")


def _step_pairs(spark, sf):
    """Samples of a step: lines of documents of one source, five at a time."""
    c = S.claim_lines(spark, sf).select(F.floor(F.col("doc_id") / 5).alias("group_id"), "claim_idx", (F.col("doc_id") % 5).alias("turn"), F.array_distinct(X.words(F.col("text"))).alias("toks"))
    met = c.groupBy("group_id", "claim_idx").agg(F.collect_list(F.struct("turn", "toks")).alias("s"))  # five at most, as ids are unique
    each = F.flatten(F.transform("s", lambda a: F.transform("s", lambda b: F.struct(a["turn"].alias("i"), b["turn"].alias("j"), a["toks"].alias("x"), b["toks"].alias("y")))))
    return S.similarity(met.select("group_id", "claim_idx", F.inline(each)), F.col("i") == F.col("j"))


_SP = rf"""WITH {C.CLAIM}, sset AS (SELECT doc_id // 5 AS group_id, claim_idx, doc_id % 5 AS turn, list_distinct(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS t FROM claim),
sj AS (SELECT a.group_id, a.claim_idx, a.turn AS i, b.turn AS j, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) AS jac FROM sset a JOIN sset b ON a.group_id = b.group_id AND a.claim_idx = b.claim_idx),
sp AS (SELECT *, CASE WHEN i = j THEN 1.0 ELSE least(1.0, 10 * jac) END AS entail FROM sj) """
query("steps_degmat", _SP + "SELECT group_id, claim_idx, round(1 - avg(entail), 6) AS value FROM sp GROUP BY group_id, claim_idx")(lambda spark, sf: rounded(pairs.degree_matrix(_step_pairs(spark, sf), ["group_id", "claim_idx"], F.col("entail")), "value"))
query("steps_dissimilarity_nli", _SP + "SELECT group_id, claim_idx, round(1 - avg(entail), 6) AS value FROM sp WHERE i = 0 AND j <> 0 GROUP BY group_id, claim_idx")(lambda spark, sf: rounded(_step_pairs(spark, sf).where("i = 0 AND j != 0").groupBy("group_id", "claim_idx").agg((1 - F.avg("entail")).alias("value")), "value"))
query("steps_dissimilarity_ccp", _SP + "SELECT group_id, claim_idx, round(1 - avg(entail / (entail + (1 - entail) / 2 + 1e-9)), 6) AS value FROM sp WHERE i = 0 AND j <> 0 GROUP BY group_id, claim_idx")(
    lambda spark, sf: rounded(_step_pairs(spark, sf).where("i = 0 AND j != 0").groupBy("group_id", "claim_idx").agg((1 - F.avg(F.col("entail") / (F.col("entail") + F.col("contra") + 1e-9))).alias("value")), "value")
)


@query("steps_semantic_entropy", _SP + ", c AS (SELECT group_id, claim_idx, i, min(j) AS class_id FROM sp WHERE i = j OR jac >= 0.055 GROUP BY group_id, claim_idx, i) SELECT group_id, claim_idx, round(-avg(v), 6) AS value FROM (SELECT group_id, claim_idx, ln(count(*) OVER (PARTITION BY group_id, claim_idx, class_id) / count(*) OVER (PARTITION BY group_id, claim_idx)) AS v FROM c) GROUP BY group_id, claim_idx")
def steps_semantic_entropy(spark, sf):
    c = _step_pairs(spark, sf).where("cls = 2").groupBy("group_id", "claim_idx", "i").agg(F.min("j").alias("class_id"))
    c = c.withColumn("key", F.struct("group_id", "claim_idx"))
    return rounded(pairs.semantic_entropy(c, "key", empirical=True).select("key.group_id", "key.claim_idx", "value"), "value")


query("steps_eccentricity")(lambda spark, sf: rounded(spectral.per_matrix(_step_pairs(spark, sf), ["group_id", "claim_idx"], ["entail"], spectral.eccentricity), "value"))
query("steps_num_sem_sets", "WITH RECURSIVE" + _SP[4:] + """, tie AS (SELECT a.group_id, a.claim_idx, a.i, a.j FROM sp a JOIN sp b ON a.group_id = b.group_id AND a.claim_idx = b.claim_idx AND a.i = b.j AND a.j = b.i WHERE a.entail > (1 - a.entail) / 2 AND b.entail > (1 - b.entail) / 2),
reach AS (SELECT group_id, claim_idx, i, j FROM tie UNION SELECT r.group_id, r.claim_idx, r.i, t.j FROM reach r JOIN tie t ON r.group_id = t.group_id AND r.claim_idx = t.claim_idx AND r.j = t.i),
root AS (SELECT group_id, claim_idx, i, min(j) AS r FROM reach GROUP BY group_id, claim_idx, i) SELECT group_id, claim_idx, CAST(count(DISTINCT r) AS DOUBLE) AS value FROM root GROUP BY group_id, claim_idx""")(lambda spark, sf: spectral.per_matrix(_step_pairs(spark, sf), ["group_id", "claim_idx"], ["entail", "contra"], spectral.semantic_sets))


@query("steps_lexical_similarity")
def steps_lexical_similarity(spark, sf):
    c = S.claims(spark, sf).select(F.floor(F.col("doc_id") / 5).alias("group_id"), "claim_idx", (F.col("doc_id") % 5).alias("turn"), "text")
    p = c.select("group_id", "claim_idx", F.col("turn").alias("i"), F.col("text").alias("a")).join(c.select("group_id", "claim_idx", F.col("turn").alias("j"), F.col("text").alias("b")), ["group_id", "claim_idx"]).where("i < j")
    return rounded(p.select("group_id", "claim_idx", sequential.lexical_udf("rougeL")("a", "b").alias("s")).groupBy("group_id", "claim_idx").agg((-F.avg("s")).alias("value")), "value")


for _k in ("rouge1", "rouge2", "rougeL"):

    def _dissimilarity(spark, sf, kind=_k):
        """The step as given, sample 0, against the other samples of it."""
        c = S.claims(spark, sf).select(F.floor(F.col("doc_id") / 5).alias("group_id"), "claim_idx", (F.col("doc_id") % 5).alias("turn"), "text")
        given, others = c.where("turn = 0").select("group_id", "claim_idx", F.col("text").alias("a")), c.where("turn > 0").select("group_id", "claim_idx", F.col("text").alias("b"))
        p = given.join(others, ["group_id", "claim_idx"])
        return rounded(p.select("group_id", "claim_idx", sequential.lexical_udf(kind)("a", "b").alias("s")).groupBy("group_id", "claim_idx").agg((1 - F.avg("s")).alias("value")), "value")

    query(f"steps_dissimilarity_{_k.lower()}")(_dissimilarity)
