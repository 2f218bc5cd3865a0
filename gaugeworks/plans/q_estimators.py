"""Queries of the likelihood, distribution, sample, claim and ensemble estimators."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import ensembles, estimators, pairs
from ..sources import fixtures as S
from . import oracle_ctes as C
from .catalog import query, rounded


def _fields(sql: str) -> tuple[str, ...]:
    """The token fields that a formula reads."""
    return tuple(f for f in ("ll", "lm", "ent") if re.search(rf"\b{f}\b", sql))


def _per_document(name: str, expression, sql: str) -> None:
    query(name, f"WITH {C.TOK} SELECT doc_id, round({sql}, 6) AS value FROM tok GROUP BY doc_id, n")(lambda spark, sf: rounded(S.sequences(spark, sf, _fields(sql)).select("doc_id", expression().alias("value")), "value"))


_per_document("max_seq_prob", lambda: estimators.max_sequence_probability(F.col("ll")), "-sum(ll)")
_per_document("perplexity", lambda: estimators.perplexity(F.col("ll")), "-avg(ll)")
_per_document("mean_token_entropy", lambda: A.mean(F.col("ent")), "avg(ent)")
_per_document("mean_pmi", lambda: estimators.mean_pmi(F.col("ll"), F.col("lm")), "-avg(ll - CASE WHEN pos > 0 THEN lm ELSE 0 END)")
_per_document("mean_cpmi", lambda: estimators.mean_cpmi(F.col("ll"), F.col("lm"), F.col("ent")), "-avg(ll - CASE WHEN pos > 0 AND ent >= 0.0656 THEN 3.599 * lm ELSE 0 END)")
_per_document("token_sar", lambda: estimators.token_sar(F.col("ll"), F.transform("ent", lambda e: 1 - e)), "sum(-ll * ent) / sum(ent)")
_per_document("model_score_seq", lambda: estimators.model_score(F.col("lm")), "avg(lm)")


def _per_token(name: str, expression, sql: str) -> None:
    query(name, f"WITH {C.TOK} SELECT doc_id, pos, round({sql}, 6) AS value FROM tok WHERE pos < n - 1")(lambda spark, sf: rounded(S.sequences(spark, sf, _fields(sql)).select("doc_id", F.posexplode(A.drop_last(expression())).alias("pos", "value")), "value"))


_per_token("token_max_prob", lambda: F.transform("ll", lambda x: -F.exp(x)), "-exp(ll)")
_per_token("token_entropy", lambda: F.col("ent"), "ent")
_per_token("token_pmi", lambda: estimators.pmi_terms(F.col("ll"), F.col("lm")), "-(ll - CASE WHEN pos > 0 THEN lm ELSE 0 END)")
_per_token("token_cpmi", lambda: estimators.cpmi_terms(F.col("ll"), F.col("lm"), F.col("ent")), "-(ll - CASE WHEN pos > 0 AND ent >= 0.0656 THEN 3.599 * lm ELSE 0 END)")
_per_token("model_score_token", lambda: F.transform("lm", lambda x: -x), "-lm")


@query("log_softmax", f"WITH {C.DIST} SELECT vec_id, k, round(l, 6) AS lp FROM cell")
def log_softmax(spark, sf):
    return rounded(S.distributions(spark, sf).select("vec_id", F.posexplode("lp").alias("k", "lp")), "lp")


@query("top_n_alternatives", f"WITH {C.DIST} SELECT vec_id, r - 1 AS alt, k AS token, round(l, 6) AS lp FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY l DESC, k) AS r FROM cell) WHERE r <= 5")
def top_n_alternatives(spark, sf):
    d = S.distributions(spark, sf).select("vec_id", F.posexplode(A.top_n(F.col("lp"), 5)).alias("alt", "t"))
    return rounded(d.select("vec_id", "alt", "t.token", "t.lp"), "lp")


def _per_sequence(name: str, expression, sql: str) -> None:
    query(name, f"WITH {C.DIST}, v AS ({sql}) SELECT label, round(avg(v), 6) AS value FROM v GROUP BY label")(lambda spark, sf: rounded(S.distributions(spark, sf).select("label", expression().alias("v")).groupBy("label").agg(F.avg("v").alias("value")), "value"))


_per_sequence("distribution_entropy", lambda: A.entropy(F.col("lp")), "SELECT label, vec_id, -sum(l * exp(l)) AS v FROM cell GROUP BY label, vec_id")
_T = "t AS (SELECT label, vec_id, l / 2 - ln(sum(exp(l / 2)) OVER (PARTITION BY vec_id)) AS q FROM cell)"
_per_sequence("renyi_neg", lambda: A.renyi(F.col("lp"), 0.5), f"WITH {_T} SELECT label, vec_id, (ln(sum(exp(0.5 * q))) - 0.5 * ln(64)) / (0.5 - 1) AS v FROM t GROUP BY label, vec_id")
_per_sequence("renyi_neg_kl", lambda: A.renyi(F.col("lp"), 1.0), f"WITH {_T} SELECT label, vec_id, sum(q * exp(q)) + ln(64) AS v FROM t GROUP BY label, vec_id")
_per_sequence("fisher_rao", lambda: A.fisher_rao(F.col("lp")), f"WITH {_T} SELECT label, vec_id, 2 / pi() * acos(least(1.0, sum(exp(q / 2)) * sqrt(1.0 / 64))) AS v FROM t GROUP BY label, vec_id")


@query("focus_token_weight", f"WITH {C.DIST}, b AS (SELECT vec_id, label, max(l) AS top, sum(-l * exp(l)) / ln(2) AS h FROM cell GROUP BY vec_id, label) SELECT vec_id, label, round(pow(2, h) - top, 6) AS value FROM b")
def focus_token_weight(spark, sf):
    """The part of Focus that needs no attention: 2 to the entropy plus the negative log-likelihood."""
    d = S.distributions(spark, sf)
    return rounded(d.select("vec_id", "label", estimators.focus_weight(F.col("lp")).alias("value")), "value")


_LP = f"WITH {C.SAMP} "
query("mc_seq_entropy", _LP + "SELECT conv_id, round(-avg(logprob), 6) AS value FROM samp GROUP BY conv_id")(lambda spark, sf: rounded(S.samples(spark, sf).groupBy("conv_id").agg((-F.avg("logprob")).alias("value")), "value"))
query("mc_norm_seq_entropy", _LP + "SELECT conv_id, round(-avg(logprob / len), 6) AS value FROM samp WHERE len > 0 GROUP BY conv_id")(
    lambda spark, sf: rounded(S.samples(spark, sf).where(F.size("lls") > 0).groupBy("conv_id").agg((-F.avg(F.col("logprob") / F.size("lls"))).alias("value")), "value")
)


def _per_conversation(name: str, build, sql: str) -> None:
    query(name, f"WITH {C.PAIR} {sql}")(lambda spark, sf: rounded(build(S.sample_pairs(spark, sf)), "value"))


_N2 = "SELECT p.conv_id, round(1 - sum({w}) / any_value(n * n), 6) AS value FROM pair p JOIN psize s ON p.conv_id = s.conv_id GROUP BY p.conv_id"
_per_conversation("degmat_jaccard", lambda p: pairs.degree_matrix(p, "conv_id", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("jac"))), _N2.format(w="CASE WHEN i = j THEN 1 ELSE jac END"))
_per_conversation("degmat_entail", lambda p: pairs.degree_matrix(p, "conv_id", F.col("entail")), _N2.format(w="entail"))
_per_conversation("degmat_contra", lambda p: pairs.degree_matrix(p, "conv_id", 1 - F.col("contra")), _N2.format(w="1 - contra"))
_per_conversation("luq", lambda p: pairs.luq(p, "conv_id"), "SELECT conv_id, round(1 - avg(m), 6) AS value FROM (SELECT conv_id, i, avg(exp(e_logit) / (exp(e_logit) + exp(c_logit))) AS m FROM pair WHERE i <> j GROUP BY conv_id, i) GROUP BY conv_id")


_SAR = f"WITH {C.SAMP}, {C.PAIR}, r AS (SELECT p.conv_id, p.i, sum(CASE WHEN p.i <> p.j THEN exp(b.logprob / b.len) * jac ELSE 0 END) AS other FROM pair p JOIN samp b ON p.conv_id = b.conv_id AND p.j = b.turn GROUP BY p.conv_id, p.i) "


@query("sentence_sar", _SAR + "SELECT r.conv_id, round(avg(-ln(exp(a.logprob / a.len) + other / 0.001)), 6) AS value FROM r JOIN samp a ON r.conv_id = a.conv_id AND r.i = a.turn GROUP BY r.conv_id")
def sentence_sar(spark, sf):
    s = S.samples(spark, sf).select("conv_id", "turn", F.exp(F.col("logprob") / F.size("lls")).alias("p"))
    return rounded(pairs.sentence_sar(S.sample_pairs(spark, sf), s, "conv_id", F.col("jac")), "value")


@query(
    "sar",
    f"WITH {C.SAMP}, {C.PAIR}, q AS (SELECT conv_id, turn, exp(-sum(-ll * -ll) / sum(-ll) / 10) AS p FROM stok GROUP BY conv_id, turn), r AS (SELECT p.conv_id, p.i, sum(CASE WHEN p.i <> p.j THEN b.p * jac ELSE 0 END) AS other FROM pair p JOIN q b ON p.conv_id = b.conv_id AND p.j = b.turn GROUP BY p.conv_id, p.i) SELECT r.conv_id, round(avg(-ln(a.p + other / 0.001)), 6) AS value FROM r JOIN q a ON r.conv_id = a.conv_id AND r.i = a.turn GROUP BY r.conv_id",
)
def sar(spark, sf):
    """Token relevance stands in as surprisal; a tenth of the token score keeps the probabilities in range."""
    s = S.samples(spark, sf).where(F.size("lls") > 0)
    s = s.select("conv_id", "turn", F.exp(-estimators.token_sar(F.col("lls"), F.transform("lls", lambda x: 1 + x)) / 10).alias("p"))
    return rounded(pairs.sentence_sar(S.sample_pairs(spark, sf), s, "conv_id", F.col("jac")), "value")


_CCP = f"WITH {C.DIST}, a AS (SELECT vec_id, l, k, row_number() OVER (PARTITION BY vec_id ORDER BY l DESC, k) AS r FROM cell), m AS (SELECT vec_id, l, r, CASE WHEN r = 1 OR k % 3 = 0 THEN 'e' WHEN k % 3 = 1 THEN 'c' ELSE 'n' END AS nli FROM a WHERE r <= 8), t AS (SELECT vec_id, ln(sum(CASE WHEN nli = 'e' THEN exp(l) ELSE 0 END)) - ln(sum(CASE WHEN nli <> 'n' THEN exp(l) ELSE 0 END)) AS c FROM m GROUP BY vec_id) "


@query("ccp", _CCP + "SELECT label, round(-exp(sum(c) / 10), 6) AS value FROM t JOIN demb USING (vec_id) GROUP BY label")
def ccp(spark, sf):
    """The relation of an alternative to the chosen token stands in by its number; a tenth of the sum keeps the value in range."""
    d = S.distributions(spark, sf).withColumn("alts", A.top_n(F.col("lp"), 8))
    relation = F.transform("alts", lambda a, i: F.when((i == 0) | (a["token"] % 3 == 0), "entail").when(a["token"] % 3 == 1, "contra").otherwise("neutral"))
    d = d.withColumn("nli", relation)
    return rounded(d.select("label", estimators.ccp_token(F.col("alts"), F.col("nli")).alias("c")).groupBy("label").agg((-F.exp(F.sum("c") / 10)).alias("value")), "value")


@query("nli_combine", "WITH r AS (SELECT unnest(['entail', 'neutral', 'contra']) AS f), x AS (SELECT a.f AS forward, b.f AS backward FROM r a, r b) SELECT forward, backward, CASE WHEN forward = backward THEN forward WHEN forward <> 'neutral' AND backward <> 'neutral' THEN 'neutral' WHEN forward = 'neutral' THEN backward ELSE forward END AS combined FROM x")
def nli_combine(spark, sf):
    kinds = spark.sql("SELECT a.f AS forward, b.f AS backward FROM VALUES ('entail'), ('neutral'), ('contra') a(f) JOIN VALUES ('entail'), ('neutral'), ('contra') b(f)")
    return kinds.withColumn("combined", estimators.combine_nli(F.col("forward"), F.col("backward")))


def _per_claim(name: str, expression, sql: str) -> None:
    query(name, f"WITH {C.TOK}, {C.CLAIM} SELECT c.doc_id, claim_idx, round({sql}, 6) AS value FROM claim c JOIN tok t ON c.doc_id = t.doc_id AND t.pos BETWEEN c.first AND c.first + c.n - 1 GROUP BY c.doc_id, claim_idx")(
        lambda spark, sf: rounded(S.claim_values(spark, sf, _fields(sql), expression).select("doc_id", "claim_idx", "value"), "value")
    )


_per_claim("claim_max_prob", lambda ids: estimators.max_sequence_probability(A.gather(F.col("ll"), ids)), "-sum(ll)")
_per_claim("claim_perplexity", lambda ids: estimators.perplexity(A.gather(F.col("ll"), ids)), "-avg(ll)")
_per_claim("claim_max_entropy", lambda ids: F.array_max(A.gather(F.col("ent"), ids)), "max(ent)")
_per_claim("claim_pmi", lambda ids: estimators.claim_pmi(F.col("ll"), F.col("lm"), ids), "-sum(ll - CASE WHEN t.pos > 0 THEN lm ELSE 0 END)")
_per_claim("claim_ccp", lambda ids: -F.exp(A.total(F.transform(A.gather(F.col("ent"), ids), lambda e: -e))), "-exp(sum(-ent))")
_per_claim("focus_claim", lambda ids: A.mean(A.gather(F.col("ent"), ids)), "avg(ent)")


@query("claim_random_hash", f"WITH {C.CLAIM} SELECT doc_id, claim_idx, round(((doc_id * 1000003 + claim_idx * 7919) % 10007) / 10007.0, 6) AS value FROM claim")
def claim_random_hash(spark, sf):
    c = S.claims(spark, sf)
    return rounded(c.select("doc_id", "claim_idx", estimators.hash_uniform(F.col("doc_id"), F.col("claim_idx")).alias("value")), "value")


@query("p_true", f"WITH {C.SAMP} SELECT conv_id, turn, round(-logprob / len, 6) AS value FROM samp")
def p_true(spark, sf):
    return rounded(S.samples(spark, sf).where(F.size("lls") > 0).select("conv_id", "turn", (-F.col("logprob") / F.size("lls")).alias("value")), "value")


@query("p_true_empirical", "SELECT conv_id, round(1 - avg(CASE WHEN contains(text, 'the') THEN 1 ELSE 0 END), 6) AS value FROM conversations GROUP BY conv_id")
def p_true_empirical(spark, sf):
    s = S.table(spark, sf, "conversations")
    return rounded(s.groupBy("conv_id").agg((1 - F.avg(F.col("text").contains("the").cast("int"))).alias("value")), "value")


@query("verbalized_1s", r"SELECT doc_id, round(1 - TRY_CAST(nullif(regexp_extract('Confidence: ' || CASE WHEN doc_id % 5 = 0 THEN 'none' ELSE '0.' || CAST(n_chars AS VARCHAR) END, 'Confidence: ([0-9.]+)', 1), '') AS DOUBLE), 6) AS value FROM documents")
def verbalized_1s(spark, sf):
    d = S.table(spark, sf, "documents")
    reply = F.concat(F.lit("Confidence: "), F.when(F.col("doc_id") % 5 == 0, "none").otherwise(F.concat(F.lit("0."), F.col("n_chars").cast("string"))))
    return rounded(d.select("doc_id", estimators.verbalized(reply, r"Confidence: ([0-9.]+)").alias("value")), "value")


@query("linguistic_1s", "SELECT conv_id, turn, CASE WHEN contains(text, 'Almost certain') THEN 0.05 WHEN contains(text, 'that') THEN 0.2 WHEN contains(text, 'for') THEN 0.4 WHEN contains(text, 'on') THEN 0.7 END AS value FROM conversations")
def linguistic_1s(spark, sf):
    s = S.table(spark, sf, "conversations")
    return s.select("conv_id", "turn", estimators.linguistic(F.col("text"), {"Almost certain": 0.95, "that": 0.8, "for": 0.6, "on": 0.3}).alias("value"))


_E = f"WITH {C.ENS}, mix AS (SELECT obs, token_idx, k, count(*) AS m, ln(sum(exp(l))) - ln(count(*)) AS l FROM ecell GROUP BY obs, token_idx, k), tot AS (SELECT obs, token_idx, -sum(l * exp(l)) AS v FROM mix GROUP BY obs, token_idx), dat AS (SELECT obs, token_idx, avg(h) AS v FROM (SELECT obs, token_idx, model, -sum(l * exp(l)) AS h FROM ecell GROUP BY obs, token_idx, model) GROUP BY obs, token_idx) "


def _ensemble(name: str, measure: str, sql: str) -> None:
    query(name, _E + f"SELECT obs, token_idx, round({sql}, 6) AS value FROM tot JOIN dat d USING (obs, token_idx)" if "FROM" not in sql else _E + sql)(lambda spark, sf: rounded(ensembles.token_measures(S.ensemble(spark, sf)).select("obs", "token_idx", F.col(measure).alias("value")), "value"))


_ensemble("ens_pe_total", "total", "tot.v")
_ensemble("ens_pe_data", "data", "d.v")
_ensemble("ens_pe_mi", "mutual", "tot.v - d.v")
_EP = "e AS (SELECT obs, token_idx, k, avg(l) AS a, avg(exp(l)) AS p FROM ecell GROUP BY obs, token_idx, k)"
_ensemble("ens_pe_epkl", "epkl", f", {_EP}, c AS (SELECT obs, token_idx, -sum(p * a) AS v FROM e GROUP BY obs, token_idx) SELECT c.obs, c.token_idx, round(c.v - d.v, 6) AS value FROM c JOIN dat d USING (obs, token_idx)")
_ensemble("ens_pe_rmi", "rmi", f", {_EP}, c AS (SELECT obs, token_idx, -sum(p * a) AS v FROM e GROUP BY obs, token_idx) SELECT c.obs, c.token_idx, round(c.v - t.v, 6) AS value FROM c JOIN tot t USING (obs, token_idx)")
for _k in (5, 10, 15):
    _ensemble(f"ens_entropy_top{_k}", f"top{_k}", f", r AS (SELECT *, row_number() OVER (PARTITION BY obs, token_idx ORDER BY l DESC, k) AS r FROM mix), z AS (SELECT obs, token_idx, l - ln(sum(exp(l)) OVER (PARTITION BY obs, token_idx)) AS q FROM r WHERE r <= {_k}) SELECT obs, token_idx, round(-sum(q * exp(q)), 6) AS value FROM z GROUP BY obs, token_idx")

_ES = f"WITH {C.ENS}, s AS (SELECT obs, token_idx AS beam, model, max(l) AS l FROM ecell GROUP BY obs, token_idx, model), b AS (SELECT obs, beam, ln(sum(exp(l))) - ln(count(*)) AS p, avg(l) AS a FROM s GROUP BY obs, beam), w AS (SELECT obs, beam, p, a, exp(p) / sum(exp(p)) OVER (PARTITION BY obs) AS w FROM b) "
query("ens_seq_tu", _ES + "SELECT obs, round(-sum(w * p), 6) AS value FROM w GROUP BY obs")(lambda spark, sf: rounded(ensembles.sequence_measures(S.ensemble(spark, sf)).select("obs", F.col("tu").alias("value")), "value"))
query("ens_seq_rmi", _ES + "SELECT obs, round(sum(w * (p - a)), 6) AS value FROM w GROUP BY obs")(lambda spark, sf: rounded(ensembles.sequence_measures(S.ensemble(spark, sf)).select("obs", F.col("rmi").alias("value")), "value"))
query("ens_seq_rmiabs", _ES + "SELECT w.obs, round(sum(w.w * abs(w.p - s.l)) / 4, 6) AS value FROM w JOIN s ON w.obs = s.obs AND w.beam = s.beam GROUP BY w.obs")(lambda spark, sf: rounded(ensembles.sequence_measures(S.ensemble(spark, sf)).select("obs", F.col("rmiabs").alias("value")), "value"))
