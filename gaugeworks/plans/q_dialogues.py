"""Queries of runs that call models: generation loops, chunked runs, checks that depend on earlier replies, scores of shared prefixes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import claims, estimators, fact_checks, focus, greedy, online, prefix_scores, relations, soft_match, step_rewards
from ..sources import calls, io
from ..sources import fixtures as S
from ..sources import providers as P
from . import oracle_ctes as C
from .catalog import query, rounded


def _turns(spark, sf):
    return S.table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws("/", "conv_id", "turn").alias("id"), F.coalesce("text", F.lit("")).alias("text"))


_DIG = "sha256({0} || chr(30) || CAST({1} AS VARCHAR))"
_STEP = f"list_transform([0, 1, 2], lambda k: '- Step ' || substr({_DIG.format('traj', 'k')}, 1, 8) || chr(10) || CASE WHEN substr({_DIG.format('traj', 'k')}, 9, 1) < '8' THEN '<Answer>:' ELSE '' END)"
_ANS = f"list_transform([0, 1, 2], lambda k: ' ' || substr(sha256(traj || chr(30) || 'answer' || chr(30) || CAST(k AS VARCHAR)), 1, 6))"
_HEX = "CAST('0x' || {} AS BIGINT)"


@query(
    "online_bon_loop",
    f"""WITH RECURSIVE r AS (
  SELECT conv_id || '/' || turn AS id, coalesce(text, '') AS traj, 0 AS n, CAST([] AS DOUBLE[]) AS scores, 'step' AS phase FROM conversations
  UNION ALL
  SELECT id, traj || c[best], n + 1, CASE WHEN phase = 'step' THEN list_append(scores, s[best]) ELSE scores END,
         CASE WHEN phase = 'answer' THEN 'done' WHEN contains(c[best], '<Answer>:') THEN 'answer' WHEN n = 19 THEN 'done' ELSE 'step' END
  FROM (SELECT *, list_position(s, list_min(s)) AS best FROM (
    SELECT *, list_transform(list_transform(c, lambda x: sha256(traj || chr(30) || x)), lambda d: coalesce(list_avg(list_transform(range({_HEX.format('substr(d, 1, 1)')} % 4), lambda k: {_HEX.format('substr(d, CAST(3 * k + 2 AS INT), 3)')} / 4095.0)), 0.5)) AS s
    FROM (SELECT *, CASE WHEN phase = 'step' THEN {_STEP} ELSE {_ANS} END AS c FROM r WHERE phase <> 'done')))
) SELECT id, sha256(traj) AS trajectory_sha256, n AS n_steps, round(list_sum(scores), 6) AS total_score FROM r WHERE phase = 'done'""",
)
def online_bon_loop(spark, sf):
    """Each turn opens a trajectory that grows by the best of three steps until one ends it, then by the best of three answers."""
    loop = online.Loop(P.step_samples(3), P.answer_samples(3), P.claim_scores())
    found = online.best_of_n(_turns(spark, sf), "id", "text", loop, io.scratch(spark, "online"))
    total = F.aggregate("step_scores", F.lit(0.0), lambda s, x: s + x)
    return rounded(found.select("id", F.sha2("trajectory", 256).alias("trajectory_sha256"), F.size("steps").alias("n_steps"), total.alias("total_score")), "total_score")


@query("chunked_resume", "SELECT doc_id, round(CAST('0x' || substr(sha256(text), 1, 12) AS BIGINT) / 281474976710656.0, 6) AS score FROM documents")
def chunked_resume(spark, sf):
    """Documents scored in ten chunks: a first run ends after four of them, a second one does the rest."""
    docs = S.table(spark, sf, "documents").select("doc_id", "text")
    path, every = io.scratch(spark, "chunks"), max(1, -(-docs.count() // 10))
    work = lambda rows: P.apply(rows, P.HashScore(), "text").select("doc_id", "score")
    calls.in_chunks(docs, "doc_id", work, path, every, at_once=2, most=4)
    return rounded(calls.in_chunks(docs, "doc_id", work, path, every, at_once=2), "score")


_LIST = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


@query(
    "prefix_rescoring",
    f"""WITH d AS (SELECT doc_id, list_prepend(lang, {_LIST.format('text')}) AS w FROM documents WHERE lang IS NOT NULL), t AS (SELECT doc_id, w, unnest(range(2, len(w) + 1)) AS i FROM d)
SELECT doc_id, count(*) AS n_tokens, round(sum(-ln(1 + length(w[i])) - length(w[i - 1]) / 100.0 - 1 / (1.0 + (i - 1))), 4) AS logprob FROM t GROUP BY doc_id""",
)
def prefix_rescoring(spark, sf):
    """Whole documents as candidates for the prompt that names their language; copies and common beginnings are scored once."""
    docs = S.table(spark, sf, "documents").where("lang is not null").select("doc_id", "lang", X.words(F.coalesce("text", F.lit(""))).alias("w"))
    found = prefix_scores.forced_scores(docs, "lang", "doc_id", F.col("lang"), "w", calls.Answers(spark, P.prefix_likelihoods()))
    total = F.aggregate("lls", F.lit(0.0), lambda s, x: s + x)
    return found.where(F.size("lls") > 0).select("doc_id", F.size("lls").cast("long").alias("n_tokens"), F.round(total, 4).alias("logprob"))


def _judge(text: str) -> tuple:
    d = P.digest(text)[0]
    return ("0" if d in "012" else "0 or 1, unclear" if d == "f" else "1",)


@query(
    "fact_check_waves",
    f"""WITH {C.CLAIM}, s AS (SELECT doc_id, claim_idx, text, string_agg(text, ' ') OVER (PARTITION BY doc_id ORDER BY claim_idx) AS steps FROM claim), p AS (
  SELECT s.*, 'Problem: ' || coalesce(source, '') || chr(10) || 'Known answer: ' || coalesce(lang, '') || chr(10) || 'Steps so far: ' || steps || chr(10) || 'Is this step right? ' || s.text || chr(10) || 'Reply with 1 if it is, else with 0.' AS prompt FROM s JOIN documents d ON s.doc_id = d.doc_id
), j AS (SELECT doc_id, claim_idx, CASE WHEN substr(sha256(prompt), 1, 1) < '3' THEN 1.0 WHEN substr(sha256(prompt), 1, 1) < 'f' THEN 0.0 END AS label FROM p),
f AS (SELECT *, min(CASE WHEN label = 1 THEN claim_idx END) OVER (PARTITION BY doc_id) AS wrong FROM j) SELECT doc_id, claim_idx, label FROM f WHERE wrong IS NULL OR claim_idx <= wrong""",
)
def fact_check_waves(spark, sf):
    """The lines of each document as claims, checked in order up to the first wrong one."""
    lines = S.claims(spark, sf).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("claim_idx", F.col("text").alias("sentence"), F.col("text").alias("claim"), (F.size("ids") > 0).alias("aligned")))).alias("claims"))
    docs = S.table(spark, sf, "documents").select("doc_id", "source", "lang").join(lines, "doc_id")
    return fact_checks.until_wrong(docs, "doc_id", "source", "lang", "claims", P.PerText("reply string", _judge)).select("doc_id", "claim_idx", "label")


def _opinion(text: str) -> tuple:
    d = P.digest(text)
    return (f"The claim was looked at.\n\nTwo sources speak for it, {int(d[0], 16)} against.\nSo: {d[1:5]}",)


def _verdict(text: str) -> tuple:
    d = P.digest(text)[0]
    return ("True." if d in "01234567" else "It is False" if d < "e" else "I cannot say",)


_CALL = "'Is this claim true? ' || claim || chr(10) || 'It was said about: ' || input"


@query(
    "two_call_fact_check",
    f"""WITH q AS (SELECT conv_id, turn, {_CALL.replace('claim ||', "coalesce(text, '') ||").replace('input', "coalesce(role, '')")} AS p FROM conversations),
a AS (SELECT *, 'The claim was looked at.' || chr(10) || chr(10) || 'Two sources speak for it, ' || {_HEX.format('substr(sha256(p), 1, 1)')} || ' against.' || chr(10) || 'So: ' || substr(sha256(p), 2, 4) AS r FROM q),
b AS (SELECT *, substr(sha256(p || chr(10) || 'A judge found: ' || r || chr(10) || 'Sum up in one word, True or False.'), 1, 1) AS h FROM a)
SELECT conv_id, turn, sha256(r) AS first_sha256, CASE WHEN h < '8' THEN 0.0 WHEN h < 'e' THEN 1.0 END AS label FROM b""",
)
def two_call_fact_check(spark, sf):
    """Each turn as a claim: an opinion of several lines, summed up by a second call."""
    turns = S.table(spark, sf, "conversations").select("conv_id", "turn", "text", "role")
    found = fact_checks.checked_facts(turns, "text", "role", calls.Answers(spark, P.PerText("reply string", _opinion)), calls.Answers(spark, P.PerText("reply string", _verdict)))
    return found.select("conv_id", "turn", F.sha2("first_reply", 256).alias("first_sha256"), "label")


@query(
    "verbalized_two_stage",
    """WITH a AS (SELECT conv_id, turn, coalesce(text, '') AS p, 'g' || substr(sha256(coalesce(text, '')), 1, 4) AS g FROM conversations),
b AS (SELECT *, sha256(p || chr(10) || 'Guess: ' || g || chr(10) || 'How likely is the guess right? Reply as Probability: 0 to 1.') AS h FROM a)
SELECT conv_id, turn, g AS guess, CASE WHEN substr(h, 1, 1) <> '0' THEN round(1 - CAST('0.' || (CAST('0x' || substr(h, 2, 2) AS BIGINT) % 90 + 10) AS DOUBLE), 6) END AS ue FROM b""",
)
def verbalized_two_stage(spark, sf):
    """A guess, then how likely the model holds it; one reply in sixteen has no number."""

    def sure(text: str) -> tuple:
        d = P.digest(text)
        return (f"Let me think.\nprobability:  0.{int(d[1:3], 16) % 90 + 10}, I would say" if d[0] != "0" else "That is hard to say.",)

    first, second = P.PerText("reply string", lambda t: ("g" + P.digest(t)[:4],)), P.PerText("reply string", sure)
    found = fact_checks.verbalized(_turns(spark, sf), "text", calls.Answers(spark, first), calls.Answers(spark, second))
    return rounded(found.select("conv_id", "turn", F.col("first_reply").alias("guess"), "ue"), "ue")


def _claims_of(prompt: str) -> tuple:
    """One claim for each part between commas that has a word; sentences under three words have none."""
    sentence = prompt.removeprefix(claims.EXTRACT)
    parts = [p.strip() for p in sentence.split(",") if p.strip()]
    if len(sentence.split()) < 3 or not parts:
        return ("- There aren't any claims in this sentence.",)
    return ("Here they are:\n" + "\n".join(f"- {p}" for p in parts),)


def _words_of(prompt: str) -> tuple:
    return (", ".join(prompt.rsplit(claims.MATCH[1], 1)[1].split()),)


@query(
    "claim_extraction",
    r"""WITH t AS (SELECT conv_id || '/' || turn AS id, regexp_split_to_array(coalesce(text, ''), '[.?!。？！\n]') AS p FROM conversations),
s AS (SELECT id, list_filter(p[:len(p) - 1], lambda x: x <> '') AS s FROM t), e AS (SELECT id, CAST(unnest(range(len(s))) AS INT) AS sentence_idx, unnest(s) AS sentence FROM s),
c AS (SELECT *, list_filter(list_transform(string_split(sentence, ','), lambda x: trim(x)), lambda x: x <> '') AS c, len(list_filter(regexp_split_to_array(sentence, '\s+'), lambda w: w <> '')) AS n FROM e)
SELECT id, sentence_idx, CAST(unnest(range(len(c))) AS INT) AS claim_idx, unnest(c) AS claim, CAST(length(regexp_replace(unnest(c), '\s', '', 'g')) AS INT) AS n_tokens, NULL AS failure FROM c WHERE n >= 3 AND len(c) > 0
UNION ALL SELECT id, sentence_idx, NULL, NULL, NULL, 'no claims' FROM c WHERE n < 3 OR len(c) = 0""",
)
def claim_extraction(spark, sf):
    """Sentences of all turns, their claims, and the characters, as tokens, that say them."""
    turns = _turns(spark, sf).withColumn("tokens", F.filter(F.split("text", ""), lambda c: c != ""))
    found = claims.extract(turns, "id", "text", "tokens", calls.Answers(spark, P.PerText("reply string", _claims_of)), calls.Answers(spark, P.PerText("reply string", _words_of)))
    return found.select("id", "sentence_idx", "claim_idx", "claim", F.when(F.col("token_ids").isNotNull(), F.size("token_ids")).alias("n_tokens"), "failure")


_D = f"d AS (SELECT conv_id, turn, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT conv_id, turn, {_LIST.format('text')} AS w FROM conversations))"


@query(
    "greedy_contract",
    f"""WITH {_D}, l AS (SELECT *, sha256(w) AS h, list_transform(range(8), lambda j: {_HEX.format("substr(sha256(w), CAST(j + 1 AS INT), 1)")} / 4.0) AS z FROM d),
t AS (SELECT *, list_position(z, list_max(z)) - 1 AS token, ln(list_sum(list_transform(z, lambda x: exp(x)))) AS norm FROM l),
e AS (SELECT *, min(CASE WHEN token = 7 THEN i END) OVER (PARTITION BY conv_id, turn) AS stop FROM t),
k AS (SELECT *, list_sort(list_transform(range(8), lambda j: (-z[j + 1], j))) AS o FROM e WHERE stop IS NULL OR i <= stop)
SELECT conv_id, turn, i AS pos, CAST(token AS INT) AS token, round(z[token + 1] - norm, 6) AS ll, CAST(o[2][2] AS INT) AS second_token, round(-o[2][1] - norm, 6) AS second_lp,
       round(coalesce(list_sum(list_transform(range(i), lambda j: greatest({_HEX.format("substr(h, CAST(9 + j % 50 AS INT), 1)")}, {_HEX.format("substr(h, CAST(9 + (7 + j) % 50 AS INT), 1)")}) / 15.0)), 0), 6) AS attention_sum
FROM k""",
)
def greedy_contract(spark, sf):
    """Each turn's generation by the contract: cut at its end token, alternatives with the chosen token first, attention over all heads."""
    asked = calls.Answers(spark, P.greedy_outputs()).ask(_turns(spark, sf), "text")
    found = greedy.cut(asked, 7, 3)
    each = F.transform("greedy_tokens", lambda t, i: F.struct(i.alias("pos"), t.alias("token"), F.get("lls", i).alias("ll"), F.get(F.get("alternatives", i), F.lit(1)).alias("second"), F.aggregate(F.get("attention", i), F.lit(0.0), lambda s, x: s + x).alias("attention_sum")))
    rows = found.select("conv_id", "turn", F.inline(each))
    return rounded(rows.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "token", "ll", F.col("second.token").alias("second_token"), F.col("second.lp").alias("second_lp"), "attention_sum"), "ll", "second_lp", "attention_sum")


_VEC = f"list_transform([1, 3, 5, 7], lambda j: {_HEX.format('substr(sha256(w), CAST(j AS INT), 2)')} / 127.5 - 1)"


@query(
    "bert_score",
    f"""WITH {_D}, v AS (SELECT conv_id, turn, i, w, {_VEC} AS v FROM d), u AS (SELECT conv_id, turn, i, w, list_transform(v, lambda x: x / sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3] + v[4] * v[4])) AS v FROM v),
texts AS (SELECT DISTINCT coalesce(text, '') AS t FROM conversations), df AS (SELECT w, count(DISTINCT t) AS n FROM (SELECT t, unnest({_LIST.format('t')}) AS w FROM texts) GROUP BY w),
idf AS (SELECT w, ln(((SELECT count(*) FROM texts) + 1) / (n + 1)) AS idf FROM df),
prev AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
c AS (SELECT p.conv_id, p.turn, a.i AS i, a.w AS wa, b.i AS j, b.w AS wb, a.v[1] * b.v[1] + a.v[2] * b.v[2] + a.v[3] * b.v[3] + a.v[4] * b.v[4] AS x
      FROM prev p JOIN u a ON p.conv_id = a.conv_id AND p.turn = a.turn JOIN u b ON p.conv_id = b.conv_id AND p.before = b.turn),
h AS (SELECT conv_id, turn, sum(x * idf) / sum(idf) AS p FROM (SELECT conv_id, turn, i, wa, max(x) AS x FROM c GROUP BY ALL) m JOIN idf ON wa = idf.w GROUP BY ALL),
r AS (SELECT conv_id, turn, sum(x * idf) / sum(idf) AS r FROM (SELECT conv_id, turn, j, wb, max(x) AS x FROM c GROUP BY ALL) m JOIN idf ON wb = idf.w GROUP BY ALL)
SELECT q.conv_id || '/' || q.turn AS id, round(coalesce(p, 0), 6) AS precision, round(coalesce(r, 0), 6) AS recall, round(coalesce(2 * p * r / (p + r), 0), 6) AS f1 FROM prev q LEFT JOIN h USING (conv_id, turn) LEFT JOIN r USING (conv_id, turn) WHERE before IS NOT NULL""",
)
def bert_score(spark, sf):
    """Each turn against the one before it, words weighted by their rarity over all turns."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = _turns(spark, sf).withColumn("before", before).where("before is not null")
    answers = calls.Answers(spark, P.word_vectors())
    return rounded(soft_match.soft_scores(pairs, "id", "text", "before", answers, soft_match.rarity(_turns(spark, sf), "text", answers)), "precision", "recall", "f1")


@query(
    "focus_turns",
    f"""WITH RECURSIVE {_D}, t AS (SELECT conv_id || '/' || turn AS id, list(CAST(length(w) AS DOUBLE) / 4 ORDER BY i) AS base, list(length(w) > 5 ORDER BY i) AS kw FROM d GROUP BY conv_id, turn),
r AS (SELECT id, base, kw, 0 AS k, CAST([] AS DOUBLE[]) AS s FROM t UNION ALL
  SELECT id, base, kw, k + 1, list_append(s, base[k + 1] + coalesce(0.9 * list_sum(list_transform(b, lambda j: s[j] / (k + 1 - j))) / list_sum(list_transform(b, lambda j: 1.0 / (k + 1 - j))), 0))
  FROM (SELECT *, list_filter(range(greatest(k - 7, 1), k + 1), lambda j: kw[j]) AS b FROM r WHERE k < len(base)))
SELECT id, round(list_avg(list_transform(list_filter(range(1, k + 1), lambda i: kw[i]), lambda i: s[i])), 6) AS value FROM r WHERE k = len(base)""",
)
def focus_turns(spark, sf):
    """Turns as generations: words over five letters are keywords, and each word attends to the eight before it."""
    words = X.words(F.col("text"))
    rows = _turns(spark, sf).select("id", words.alias("w")).where(F.size("w") > 0)
    edges = F.flatten(F.transform("w", lambda _, i: F.transform(F.filter(F.sequence(F.lit(1), F.lit(8)), lambda d: d <= i), lambda d: F.struct(i.alias("i"), (i - d).alias("j"), (1 / d).alias("a")))))
    rows = rows.select("id", F.transform("w", lambda w: F.length(w) / 4).alias("base"), F.transform("w", lambda w: F.length(w) > 5).alias("keyword"), edges.alias("edges"))
    return rounded(focus.focus(rows, "id", "base", "keyword", "edges"), "value")


@query(
    "left_out_similarity",
    f"""WITH t AS (SELECT conv_id || '/' || turn AS id, coalesce(role, '') AS head, {_LIST.format('text')} AS w FROM conversations),
r AS (SELECT *, unnest(range(len(w))) AS pos FROM t), p AS (SELECT id, pos, w, w[pos + 1] AS tok, list_filter(list_concat(string_split(head, ' '), list_filter(w, lambda x: x NOT IN ('the', 'a'))), lambda x: x <> '') AS a,
  list_filter(list_concat(string_split(head, ' '), list_filter(list_concat(w[1:pos], w[pos + 2:]), lambda x: x NOT IN ('the', 'a'))), lambda x: x <> '') AS b FROM r)
SELECT id, pos, round(CASE WHEN len(w) = 1 THEN 0.5 WHEN tok IN ('the', 'a') THEN 1.0 WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS similarity FROM p""",
)
def left_out_similarity(spark, sf):
    """How much each word of a turn matters to what it says; two articles stand in as special tokens."""
    turns = S.table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "role", X.words(F.coalesce("text", F.lit(""))).alias("w"))
    found = relations.token_similarity(turns, "id", "role", "w", ["the", "a"], calls.Answers(spark, P.OverlapSimilarity()))
    return rounded(found.select("id", F.posexplode("similarity").alias("pos", "similarity")).withColumn("pos", F.col("pos").cast("long")), "similarity")


def _nli(pair: str) -> tuple:
    d = P.digest(pair)[0]
    return (0.8, 0.1, 0.1) if d < "6" else (0.1, 0.8, 0.1) if d < "b" else (0.1, 0.1, 0.8)


_KIND = "CASE WHEN substr({0}, 1, 1) < '6' THEN 'entail' WHEN substr({0}, 1, 1) < 'b' THEN 'neutral' ELSE 'contra' END"


@query(
    "ccp_by_provider",
    f"""WITH {_D}, l AS (SELECT *, list_transform(range(8), lambda j: {_HEX.format("substr(sha256(w), CAST(j + 1 AS INT), 1)")} / 4.0) AS z FROM d),
t AS (SELECT *, list_position(z, list_max(z)) - 1 AS token, ln(list_sum(list_transform(z, lambda x: exp(x)))) AS norm FROM l),
e AS (SELECT *, min(CASE WHEN token = 7 THEN i END) OVER (PARTITION BY conv_id, turn) AS stop FROM t),
k AS (SELECT conv_id, turn, i, token, norm, unnest(list_sort(list_transform(range(8), lambda j: (-z[j + 1], j)))[1:4]) AS o FROM e WHERE stop IS NULL OR i <= stop),
n AS (SELECT conv_id, turn, i, -o[1] - norm AS lp, {_KIND.format("sha256('t' || token || chr(30) || 't' || o[2])")} AS f, {_KIND.format("sha256('t' || o[2] || chr(30) || 't' || token)")} AS b FROM k),
c AS (SELECT *, CASE WHEN f = b THEN f WHEN f <> 'neutral' AND b <> 'neutral' THEN 'neutral' WHEN f = 'neutral' THEN b ELSE f END AS r FROM n),
s AS (SELECT conv_id, turn, i, sum(exp(lp)) FILTER (WHERE r = 'entail') AS same, sum(exp(lp)) FILTER (WHERE r <> 'neutral') AS known FROM c GROUP BY ALL)
SELECT conv_id || '/' || turn AS id, count(*) AS n, round(-sum(ln(same) - ln(known)), 6) AS ccp FROM s GROUP BY ALL""",
)
def ccp_by_provider(spark, sf):
    """Claim-conditioned probability with a model's word on each alternative: outputs by contract, relations of distinct pairs of words, score."""
    found = greedy.cut(calls.Answers(spark, P.greedy_outputs()).ask(_turns(spark, sf), "text"), 7, 4).where(F.size("greedy_tokens") > 0)
    found = found.select("id", "alternatives", F.transform("alternatives", lambda a: F.transform(a, lambda s: F.concat(F.lit("t"), s["token"].cast("string")))).alias("words"))
    path = io.scratch(spark, "outputs")
    found.write.parquet(path)
    found = spark.read.parquet(path)
    related = relations.alternative_relations(found, "id", "words", calls.Answers(spark, P.PerText("entail double, neutral double, contra double", _nli)))
    rows = found.join(related, "id").select("id", F.inline(F.arrays_zip("alternatives", "relations")))
    return rounded(rows.withColumn("c", estimators.ccp_token(F.col("alternatives"), F.col("relations"))).groupBy("id").agg(F.count("*").alias("n"), (-F.sum("c")).alias("ccp")), "ccp")


@query(
    "p_true_prompts",
    f"""WITH t AS (SELECT conv_id || '/' || turn AS id, coalesce(role, '') AS role, coalesce(text, '') AS text, {_LIST.format('text')} AS w FROM conversations),
p AS (SELECT id, 'Question: ' || role || chr(10) || 'Ideas:' || chr(10) || array_to_string(w, ' ') || chr(10) || array_to_string(list_concat(w[2:], w[1:1]), ' ') || chr(10) || 'Proposed answer: ' || text || chr(10) || 'Is it (A) true or (B) false? It is:' AS p FROM t)
SELECT id, round(-ln({_HEX.format('substr(sha256(p), 1, 12)')} / 281474976710656.0), 6) AS p_true FROM p""",
)
def p_true_prompts(spark, sf):
    """Two samples of each turn as ideas, and whether the model holds the turn itself for true."""
    turns = S.table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "role", F.coalesce("text", F.lit("")).alias("text"))
    sampled = calls.Answers(spark, P.RotatingSamples(2)).ask(turns, "text").drop("error", "provider")
    rows = sampled.select("id", relations.truth_prompt(F.col("role"), F.col("text"), F.col("samples")).alias("prompt"))
    return rounded(relations.p_true(rows, "prompt", calls.Answers(spark, P.HashScore())).select("id", "p_true"), "p_true")


def _logits(n, text: str) -> tuple:
    """Two logits for each of n(text) places, by digest."""
    return ([[int(c, 16) / 4 for c in P.digest(text, k)[:2]] for k in range(n(text))],)


def _values(text: str) -> tuple:
    """A value for each line, of which the first, the question, is no step."""
    n = text.count("\n") + 1
    return [int(P.digest(text, k)[0], 16) / 4 - 2 for k in range(n)], [int(k > 0) for k in range(n)]


def _entities(text: str) -> tuple:
    d = P.digest(text)
    return (["LABEL_0", f"LABEL_{int(d[0], 16) % 2}"], [0.1, int(d[1:4], 16) / 4095]) if d[0] != "f" else ([], [])


_SCORERS = {
    "marks": P.PerText("logits array<array<double>>", lambda t: _logits(lambda x: x.count(step_rewards.MARK), t)),
    "tags": P.PerText("logits array<array<double>>", lambda t: _logits(lambda x: x.count(" " + step_rewards.TAG), t)),
    "flags": P.PerText("values array<double>, flags array<int>", _values),
    "dialogue": P.PerText("logits array<array<double>>", lambda t: _logits(lambda x: 2, t)),
    "beginnings": P.PerText("score double", lambda t: (int(P.digest(t)[:2], 16) / 64 - 2,)),
    "labels": P.PerText("entities array<string>, scores array<double>", _entities),
}

_SIG = "1 / (1 + exp(-({0})))"
_AT = "sha256(p || chr(30) || CAST({0} AS VARCHAR))"
_DIFF = "({0} - {1}) / 4.0"


def _pair_sql(at: str, good: int) -> str:
    a, b = (_HEX.format(f"substr({_AT.format(at)}, {k}, 1)") for k in (1, 2))
    return _SIG.format(_DIFF.format(*((a, b) if good == 0 else (b, a))))


@query(
    "reward_families",
    f"""WITH l AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, trim(replace(coalesce(text, ''), chr(10), ' '), ' ') AS s, 'How does it go on, ' || conv_id || '?' AS q FROM conversations),
w AS (SELECT conv_id, q, list(s ORDER BY k) AS s FROM l GROUP BY conv_id, q), b AS (SELECT conv_id, q, unnest(range(1, len(s) + 1)) AS k, s FROM w), e AS (SELECT conv_id, q, k, s[1:k] AS s FROM b),
whole AS (SELECT conv_id, 'marks' AS family, len(s) AS n, q || chr(10) || array_to_string(s, '{step_rewards.MARK}') || '{step_rewards.MARK}' AS p FROM w
  UNION ALL SELECT conv_id, 'tags', len(s), q || ' ' || array_to_string(list_transform(s, lambda x, i: 'Step ' || i || ': ' || x || ' {step_rewards.TAG}'), chr(10)) FROM w
  UNION ALL SELECT conv_id, 'flags', len(s), q || chr(10) || array_to_string(s, chr(10)) FROM w),
part AS (SELECT conv_id, 'dialogue' AS family, k, q || ' ' || array_to_string(list_transform(s, lambda x: x || chr(10) || '+'), chr(10)) AS p FROM e
  UNION ALL SELECT conv_id, 'beginnings', k, q || chr(10) || chr(10) || '###' || chr(10) || chr(10) || 'The reference answer is: There is no reference answer for this question.' || chr(10) || array_to_string(s, chr(10)) || chr(10) FROM e
  UNION ALL SELECT conv_id, 'labels', k, q || chr(10) || chr(10) || array_to_string(s, chr(10) || chr(10)) || chr(10) || chr(10) FROM e),
r AS (SELECT conv_id, family, k, CASE family WHEN 'marks' THEN {_pair_sql('k - 1', 1)} WHEN 'tags' THEN {_pair_sql('k - 1', 0)} ELSE {_SIG.format(_HEX.format(f"substr({_AT.format('k')}, 1, 1)") + ' / 4.0 - 2')} END AS reward
  FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM whole)
  UNION ALL SELECT conv_id, family, k, CASE family WHEN 'dialogue' THEN {_pair_sql('1', 0)} WHEN 'beginnings' THEN {_SIG.format(_HEX.format('substr(sha256(p), 1, 2)') + ' / 64.0 - 2')}
    ELSE CASE WHEN substr(sha256(p), 1, 1) = 'f' THEN 0.5 WHEN {_HEX.format('substr(sha256(p), 1, 1)')} % 2 = 1 THEN {_HEX.format('substr(sha256(p), 2, 3)')} / 4095.0 ELSE 1 - {_HEX.format('substr(sha256(p), 2, 3)')} / 4095.0 END END FROM part)
SELECT conv_id, family, CAST(k - 1 AS INT) AS step, round(reward, 6) AS reward FROM r""",
)
def reward_families(spark, sf):
    """The turns of each conversation as the steps of a solution, scored by a model of each family."""
    line = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))
    turns = S.table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("s")))).alias("x"))
    rows = turns.select("conv_id", F.concat(F.lit("How does it go on, "), F.col("conv_id").cast("string"), F.lit("?")).alias("q"), F.col("x.s").alias("steps"))
    out = None
    for family, scorer in _SCORERS.items():
        found = step_rewards.step_rewards(rows, "conv_id", "q", "steps", family, calls.Answers(spark, scorer))
        part = found.select("conv_id", F.lit(family).alias("family"), F.posexplode("rewards").alias("step", "reward"))
        out = part if out is None else out.unionByName(part)
    return rounded(out, "reward")


def _graded(text: str) -> tuple:
    d = [int(c, 16) for c in P.digest(text)[:8]]
    grade = ("Correct", "Incorrect", "not given")[d[0] % 3]
    steps = "All steps are correct,\nas far as I see." if d[1] % 4 == 0 else f"The steps:\n```python\n[{d[2] % 2}, {d[3] % 2}]\n```\nas asked." if d[1] % 4 < 3 else "I cannot say\nwhich."
    marks = ", ".join(str(x % 2) for x in d[4 : 6 + d[6] % 3])
    return f"Let me look at it.\n\n<Grade>: {grade}\nThat is all.", steps, f'{{\n  "correctness": [{marks}]\n}}' if d[7] else f"[{marks}]\nis what I found"


_NIB = _HEX.format("substr(h, {0}, 1)")


@query(
    "parsed_replies",
    f"""WITH t AS (SELECT conv_id || '/' || turn AS id, sha256(coalesce(text, '')) AS h FROM conversations),
n AS (SELECT id, {_NIB.format(1)} % 3 AS g, {_NIB.format(2)} % 4 AS s, [{_NIB.format(3)} % 2, {_NIB.format(4)} % 2] AS l, list_transform(range(5, 7 + {_NIB.format(7)} % 3), lambda k: {_NIB.format('CAST(k AS INT)')} % 2) AS m, {_NIB.format(8)} AS j FROM t)
SELECT id, CASE g WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 END AS grade, CASE WHEN s = 0 THEN CAST([] AS BIGINT[]) WHEN s < 3 THEN l END AS steps,
       CASE WHEN j = 0 OR len(m) NOT IN (2, 3) THEN [NULL, NULL, NULL] WHEN len(m) = 3 THEN list_transform(m, lambda x: 1.0 - x) ELSE list_append(list_transform(m, lambda x: 1.0 - x), NULL) END AS labels
FROM n""",
)
def parsed_replies(spark, sf):
    """Replies of several lines of a judge, asked about each turn: a grade, a list of wrong steps, labels of three claims as JSON."""
    judge = P.PerText("graded string, listed string, labelled string", _graded)
    asked = calls.Answers(spark, judge).ask(_turns(spark, sf), "text")
    return asked.select("id", X.grade(F.col("graded")).alias("grade"), X.label_list(F.col("listed")).alias("steps"), X.json_labels(F.col("labelled"), F.lit(3)).alias("labels"))
