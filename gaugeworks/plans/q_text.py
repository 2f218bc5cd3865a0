"""Queries of prompts, answers, steps, sentences and replies."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import arrays as A
from ..functions import sequential
from ..functions import text as X
from ..sources import fixtures as S
from . import oracle_ctes as C
from .catalog import query, rounded

PROMPT = "Solve it step by step.\n<Question>: {q}<|im_end|>\n"
OTHER = "Q: {q}\nA:"


def _docs(spark, sf):
    """Documents with their text on one line as the question, and a reply in steps."""
    d = S.table(spark, sf, "documents").select("doc_id", "text", "n_chars", "lang")
    d = d.withColumn("q", F.trim(F.translate("text", "\n", " ")))
    tail = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("#### 1,"), F.col("n_chars").cast("string"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("so \\boxed{x="), F.col("n_chars").cast("string"), F.lit("%}"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("<Answer>: 3 or "), F.col("n_chars").cast("string"))).otherwise("none")
    return d.withColumn("reply", F.concat(F.lit("- Step 1: "), "q", F.when(F.col("doc_id") % 3 == 0, "").otherwise("\n- Step 2: done"), F.lit("\n"), tail))


_D = r"""WITH d0 AS (SELECT doc_id, text, n_chars, lang, trim(translate(text, chr(10), ' ')) AS q FROM documents),
d AS (SELECT *, '- Step 1: ' || q || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || '- Step 2: done' END || chr(10) || CASE doc_id % 4 WHEN 0 THEN '#### 1,' || n_chars WHEN 1 THEN 'so \boxed{x=' || n_chars || '%}' WHEN 2 THEN '<Answer>: 3 or ' || n_chars ELSE 'none' END AS reply FROM d0) """


def _text(name: str, expression, sql: str) -> None:
    query(name, _D + f"SELECT doc_id, {sql} AS value FROM d")(lambda spark, sf: _docs(spark, sf).select("doc_id", expression().alias("value")))


_P = "'Solve it step by step.' || chr(10) || '<Question>: ' || q || '<|im_end|>' || chr(10)"
_text("prompt_format", lambda: X.apply_template(PROMPT, F.col("q")), _P)
_text("prompt_inverse", lambda: X.invert_template(PROMPT, F.when(F.col("doc_id") % 2 == 0, X.apply_template(PROMPT, F.col("q"))).otherwise(F.col("q"))), "q")
_text("prompt_swap", lambda: X.apply_template(OTHER, X.invert_template(PROMPT, X.apply_template(PROMPT, F.col("q")))), "'Q: ' || q || chr(10) || 'A:'")
_text("question_tag", lambda: X.question_tag(X.apply_template(PROMPT, F.col("q"))), "nullif(q, '')")
_text("question_from_trajectory", lambda: X.question_of(F.concat("q", F.lit("\n\nReasoning Steps:\n- Step 1: go"))), "CASE WHEN q = '' THEN chr(10) || chr(10) || 'Reasoning Steps:' || chr(10) || '- Step 1: go' ELSE q END")
_text("mcq_format", lambda: X.multiple_choice(F.col("q"), F.array("lang", F.col("n_chars").cast("string"), F.lit("none"))), "q || chr(10) || '  A. ' || lang || chr(10) || '  B. ' || n_chars || chr(10) || '  C. none'")
_text("facts_answer", lambda: X.facts_answer(F.col("doc_id") % 2 == 0, F.array("lang", "q")), "CASE WHEN doc_id % 2 = 0 THEN 'Yes' ELSE 'No' END || ', according to the facts: 1. ' || lang || ' 2. ' || q")
_text("parse_final_answer", lambda: X.final_answer(F.col("reply")), "CASE doc_id % 4 WHEN 0 THEN CAST('1' || n_chars AS DOUBLE) WHEN 1 THEN CAST(n_chars AS DOUBLE) WHEN 2 THEN CAST(n_chars AS DOUBLE) ELSE TRY_CAST(list_last(regexp_extract_all(replace(reply, ',', ''), '[-+]?\\d*\\.?\\d+')) AS DOUBLE) END".replace("\\\\", "\\"))
_text("step_boundary_complete", lambda: X.step_complete(F.col("reply"), F.length("reply"), 90), "contains(reply, '<Answer>:') OR doc_id % 3 <> 0 OR length(reply) >= 90 OR len(regexp_extract_all(reply, '- Step')) >= 2")
_text("trajectory_complete", lambda: X.trajectory_complete(F.col("reply")), "doc_id % 3 = 0 AND doc_id % 4 = 2")
_text("step_text_extract", lambda: X.step_text(F.col("reply")), "trim(CASE WHEN doc_id % 3 <> 0 THEN '- Step 1: ' || q WHEN doc_id % 4 = 2 THEN '- Step 1: ' || q ELSE reply END)")
_text("step_normaliser", lambda: X.step_normal(F.col("reply")), "substr(reply, 11)")
_text("refusal_filter", lambda: X.refusal_to_empty(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Please provide more. "), "q")).otherwise(F.col("q"))), "CASE WHEN doc_id % 5 = 0 THEN '' ELSE q END")
_text("normalize_text", lambda: X.normalize(F.col("q")), r"regexp_replace(lower(trim(q)), '[!-/:-@\[-`{-~]', '', 'g')")
_text("grade_parse", lambda: X.grade(F.concat(F.lit("<Grade>: "), F.when(F.col("doc_id") % 3 == 0, "Correct").when(F.col("doc_id") % 3 == 1, "Incorrect").otherwise("unsure"))), "CASE doc_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 END")
_text("reply_binary", lambda: X.binary_reply(F.col("n_chars").cast("string")), "CASE WHEN contains(CAST(n_chars AS VARCHAR), '1') AND contains(CAST(n_chars AS VARCHAR), '0') THEN NULL WHEN contains(CAST(n_chars AS VARCHAR), '1') THEN 1.0 WHEN contains(CAST(n_chars AS VARCHAR), '0') THEN 0.0 END")
_text("accuracy", lambda: (F.trim("q") == F.trim("lang")).cast("int"), "CAST(trim(q) = trim(lang) AS INT)")
_text("model_kind", lambda: X.model_kind(F.when(F.col("doc_id") % 3 == 0, "run_Reward.json").when(F.col("doc_id") % 3 == 1, "judge_validity.json").otherwise("head_x.json")), "CASE doc_id % 3 WHEN 0 THEN 'process reward' WHEN 1 THEN 'validity' ELSE 'learned head' END")
_text("reply_list_parse", lambda: X.label_list(F.when(F.col("doc_id") % 4 == 0, "All steps are correct").when(F.col("doc_id") % 4 == 1, F.concat(F.lit("```python\n[1, 0, "), F.col("n_chars").cast("string"), F.lit("]\n```"))).when(F.col("doc_id") % 4 == 2, "[0, 1]").otherwise("unclear")), "CASE doc_id % 4 WHEN 0 THEN [] WHEN 1 THEN [1, 0, n_chars] WHEN 2 THEN [0, 1] END")
_text("reply_json_labels", lambda: X.json_labels(F.when(F.col("doc_id") % 3 == 0, '{"correctness": [1, 0, 1]}').when(F.col("doc_id") % 3 == 1, '{"correctness": [0, 0]}').otherwise("broken"), F.lit(3)), "CASE doc_id % 3 WHEN 0 THEN [0.0, 1.0, 0.0] WHEN 1 THEN [1.0, 1.0, NULL] ELSE [NULL, NULL, NULL] END")
_text("bullet_claims", lambda: X.bullet_claims(F.concat(F.lit("- "), F.col("q"), F.lit("\nnote\n- There aren't any claims.\n- x"))), "[trim(q), 'x']")
_text("steps_by_marker", lambda: X.steps_by_marker(F.col("reply")), "list_transform(list_filter(['- Step 1: ' || q || CASE WHEN doc_id % 3 = 0 AND doc_id % 4 <> 2 THEN substr(reply, length('- Step 1: ' || q) + 1) ELSE '' END, CASE WHEN doc_id % 3 <> 0 THEN '- Step 2: done' || CASE WHEN doc_id % 4 <> 2 THEN substr(reply, length('- Step 1: ' || q || chr(10) || '- Step 2: done') + 1) ELSE '' END END, CASE WHEN doc_id % 4 = 2 THEN '<Answer>: 3 or ' || n_chars END], lambda x: x IS NOT NULL), lambda x: trim(x))")


@query("reply_reason_result", _D + "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 END AS result, CASE WHEN doc_id % 4 < 2 THEN q ELSE '' END AS reason FROM d")
def reply_reason_result(spark, sf):
    d = _docs(spark, sf)
    reply = F.when(F.col("doc_id") % 4 < 2, F.concat(F.lit("[REASON]: "), "q", F.lit("\n[RESULT]: "), (1 - F.col("doc_id") % 4).cast("string"))).when(F.col("doc_id") % 4 == 2, "``` 1 ```").otherwise("unsure")
    return d.withColumn("r", reply).select("doc_id", X.reason_and_result(F.col("r")).alias("x")).select("doc_id", "x.result", "x.reason")


@query("reply_binary_cumulative", f"WITH {C.CLAIM}, l AS (SELECT doc_id, claim_idx, CASE WHEN verified IS NULL THEN NULL ELSE 1 - verified END AS r FROM claim), m AS (SELECT *, coalesce(min(r) OVER (PARTITION BY doc_id ORDER BY claim_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before FROM l) SELECT doc_id, claim_idx, 1 - r AS label FROM m WHERE before > 0")
def reply_binary_cumulative(spark, sf):
    """Labels up to the first error of each document: later claims were never asked about."""
    from pyspark.sql import Window

    reply = F.when(F.col("verified").isNull(), "10").when(F.col("verified") == 1, "0").otherwise("1")
    c = S.claims(spark, sf).select("doc_id", "claim_idx", X.binary_reply(reply).alias("r"))
    before = F.coalesce(F.min("r").over(Window.partitionBy("doc_id").orderBy("claim_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    return c.withColumn("before", before).where("before > 0").select("doc_id", "claim_idx", (1 - F.col("r")).alias("label"))


query("steps_by_newline", f"WITH {C.CLAIM} SELECT doc_id, claim_idx, first AS token_from, first + n - 1 AS token_to FROM claim")(lambda spark, sf: S.claims(spark, sf).select("doc_id", "claim_idx", F.element_at("ids", 1).alias("token_from"), F.element_at("ids", -1).alias("token_to")))
query("sentences_terminated", r"SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[^.?!\n]*[.?!\n]'), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: x <> '') AS sentences FROM conversations")(lambda spark, sf: S.table(spark, sf, "conversations").select("conv_id", "turn", X.sentences(F.col("text")).alias("sentences")))
query("token_jaccard", f"WITH {C.PAIR} SELECT conv_id, i, j, round(jac, 6) AS value FROM pair WHERE i < j")(lambda spark, sf: rounded(S.sample_pairs(spark, sf).where("i < j").select("conv_id", "i", "j", F.col("jac").alias("value")), "value"))
query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")(lambda spark, sf: S.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")))
query("prompt_conversation", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")(
    lambda spark, sf: S.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n\n").alias("prompt"))
)


def _turns(spark, sf):
    return S.table(spark, sf, "conversations").select("conv_id", "turn", "text")


@query("sentences_merged")
def sentences_merged(spark, sf):
    split = sequential.text_list_udf(sequential.merged_sentences)
    return _turns(spark, sf).select("conv_id", "turn", F.posexplode(split(F.col("text"))).alias("claim_idx", "claim"))


@query("thinking_steps")
def thinking_steps(spark, sf):
    split = sequential.text_list_udf(sequential.thinking_sentences)
    return _turns(spark, sf).select("conv_id", "turn", F.posexplode(split(F.concat(F.lit("<think>"), "text", F.lit("</think> So it is.")))).alias("claim_idx", "claim"))


@query("word_match_mask")
def word_match_mask(spark, sf):
    mask = F.udf(lambda t: sequential.match_mask(t, t.replace(",", " ").replace(".", " ").split()[::2]), "string", useArrow=True)
    return _turns(spark, sf).select("conv_id", "turn", mask("text").alias("mask"))


@query("token_char_align")
def token_char_align(spark, sf):
    def tokens(t):
        mask = sequential.match_mask(t, t.split()[:3]) or " " * len(t)
        return sequential.tokens_of_mask(mask, [t[k : k + 4] for k in range(0, len(t), 4)])

    return _turns(spark, sf).select("conv_id", "turn", F.udf(tokens, "array<int>", useArrow=True)("text").alias("aligned_token_ids"))


@query("word_merge_conf")
def word_merge_conf(spark, sf):
    def merge(t):
        tokens = [t[k : k + 3] for k in range(0, len(t), 3)]
        parts, confidences = sequential.split_edges(tokens, [round((len(p) + k % 7) / 10, 6) for k, p in enumerate(tokens)])
        return [{"word": w, "confidence": c} for w, c in sequential.merge_words(parts, confidences)]

    rows = _turns(spark, sf).select("conv_id", "turn", "text")
    words = T.StructField("w", T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("confidence", T.DoubleType())])))
    schema = T.StructType([*rows.schema.fields[:2], words])

    def run(batches):
        """A few turns at a time are Python objects, however many come in a batch."""
        for whole in batches:
            for at in range(0, len(whole), 64):
                batch = whole.slice(at, 64)
                found = [merge(t) for t in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, to_arrow_type(words.dataType))], schema.names)

    rows = rows.mapInArrow(run, schema)
    return rows.select("conv_id", "turn", F.posexplode("w").alias("word_idx", "x")).select("conv_id", "turn", "word_idx", "x.word", "x.confidence")
