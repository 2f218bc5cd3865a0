"""Queries of token features, the linear head, sources, sinks and providers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features, heads
from ..sources import fixtures as S
from ..sources import io, providers
from . import oracle_ctes as C
from .catalog import query, rounded


@query("feature_top_probs", f"WITH {C.DIST} SELECT vec_id, r - 1 AS pos, round(exp(l), 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY l DESC) AS r FROM cell) WHERE r <= 4")
def feature_top_probs(spark, sf):
    return rounded(S.distributions(spark, sf).select("vec_id", F.posexplode(features.top_probabilities(F.col("lp"), 4)).alias("pos", "p")), "p")


query("feature_rank", f"WITH {C.DIST} SELECT a.vec_id, count(*) FILTER (WHERE b.l > a.l) AS rank FROM cell a JOIN cell b ON a.vec_id = b.vec_id WHERE a.k = 3 GROUP BY a.vec_id")(lambda spark, sf: S.distributions(spark, sf).select("vec_id", features.rank_of(F.col("lp"), F.lit(3)).alias("rank")))
query("feature_lookback", f"WITH {C.DIST}, c AS (SELECT vec_id, avg(exp(l)) FILTER (WHERE k < 16) AS a, avg(exp(l)) FILTER (WHERE k >= 16) AS b FROM cell GROUP BY vec_id) SELECT vec_id, round(a / (a + b), 6) AS ratio FROM c")(
    lambda spark, sf: rounded(S.distributions(spark, sf).withColumn("att", F.transform("lp", F.exp)).select("vec_id", features.lookback_ratio(F.col("att"), F.lit(16)).alias("ratio")), "ratio")
)
query("feature_attention_window", f"WITH {C.DIST} SELECT vec_id, 2 - k AS pos, round(exp(l), 6) AS a FROM cell WHERE k < 3 UNION ALL SELECT vec_id, 3, 0.0 FROM demb")(
    lambda spark, sf: rounded(S.distributions(spark, sf).withColumn("att", F.transform("lp", F.exp)).select("vec_id", F.posexplode(features.attention_window(F.col("att"), F.lit(3), 4)).alias("pos", "a")), "a")
)


@query("feature_layer_cosines", f"WITH {C.DIST}, p AS (SELECT vec_id, label, unnest(range(4)) AS layer, e FROM demb), s AS (SELECT vec_id, layer, list_slice(e, layer * 16 + 1, layer * 16 + 16) AS x FROM p), q AS (SELECT vec_id, layer, x, lead(x) OVER (PARTITION BY vec_id ORDER BY layer) AS y FROM s) SELECT vec_id, layer AS pos, round(list_sum(list_transform(range(1, 17), lambda k: x[k] * y[k])) / (sqrt(list_sum(list_transform(x, lambda v: v * v))) * sqrt(list_sum(list_transform(y, lambda v: v * v)))), 6) AS cosine FROM q WHERE y IS NOT NULL")
def feature_layer_cosines(spark, sf):
    """An embedding's quarters stand in as layers."""
    e = S.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    layers = e.select("vec_id", F.array(*(F.slice("v", 16 * k + 1, 16) for k in range(4))).alias("layers"))
    return rounded(layers.select("vec_id", F.posexplode(features.adjacent_cosines(features.select_layers(F.col("layers"), [0, 1, 2, -1]))).alias("pos", "cosine")), "cosine")


@query("head_expression", f"WITH {C.DIST} SELECT vec_id, round(e[1] * 0.5 - e[2] * 0.25 + 0.1, 6) AS logit FROM demb")
def head_expression(spark, sf):
    e = S.table(spark, sf, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("v"))
    return rounded(e.select("vec_id", features.head_logit(F.col("v"), [0.5, -0.25], 0.1).alias("logit")), "logit")


@query("linear_head")
def linear_head(spark, sf):
    """Learned on the training rows of the embeddings: is the label below 5?"""
    e = S.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("label") < 5).cast("int").alias("y"))
    model = features.fit_head(e.where("vec_id % 10 < 7"), "v", "y", positive_weight=1.5)
    return rounded(features.apply_head(e.where("vec_id % 10 >= 7"), model, "v", "p").select("vec_id", "y", "p"), "p")


def _head_rows(spark, sf):
    e = S.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("label") < 5).cast("int").alias("y"))
    return [e.where(c) for c in ("vec_id % 10 < 5", "vec_id % 10 IN (5, 6)", "vec_id % 10 >= 7")]


@query("layered_head")
def layered_head(spark, sf):
    """The head of three hidden layers, by gradients of all training rows, stopped early by the validation rows."""
    train, valid, test = _head_rows(spark, sf)
    run = heads.fit(train, valid, "v", "y", heads.Setting(positive_weight=1.5), epochs=30)
    return rounded(heads.apply(test, run, "v", "p").select("vec_id", "y", "p"), "p")


@query("head_search")
def head_search(spark, sf):
    """Learning rates and positive weights, trained side by side and judged by validation F1, the worse ones ended early."""
    train, valid, _ = _head_rows(spark, sf)
    settings = [heads.Setting(rate=r, positive_weight=w, hidden=(32, 16)) for r in (1e-2, 1e-3, 1e-4) for w in (1.0, 2.0, 4.0)]
    found = heads.search(train, valid, "v", "y", settings)
    rows = [(k, s.rate, s.positive_weight, n, round(f, 6)) for k, (s, n, f, _) in enumerate(found)]
    return spark.createDataFrame(rows, "place int, rate double, positive_weight double, epochs int, f1 double")


@query("csv_source", "SELECT 'Q: ' || CAST(doc_id AS VARCHAR) || chr(10) || 'A:' AS input_text, lang AS target_text FROM documents")
def csv_source(spark, sf):
    """Written as CSV and read back through the loader."""
    path = io.scratch(spark, "csv")
    S.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("question"), "lang").write.csv(path, header=True)
    return io.load(spark, path, "csv", "question", "lang", template="Q: {q}\nA:")


@query("json_source", "SELECT CAST(doc_id AS VARCHAR) AS input_text, '' AS target_text FROM documents")
def json_source(spark, sf):
    path = io.scratch(spark, "json")
    S.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("question")).write.json(path)
    return io.load(spark, path, "json", "question", None)


@query("split_source", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents WHERE doc_id % 5 = 0")
def split_source(spark, sf):
    path = io.scratch(spark, "split")
    S.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split")).write.partitionBy("split").parquet(path)
    return io.pick_split(spark.read.parquet(path), "test").select("doc_id", "split")


@query("shard_source", "SELECT doc_id, doc_id AS original_index FROM documents")
def shard_source(spark, sf):
    path = io.scratch(spark, "shards")
    d = S.table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("original_index"))
    for k in range(3):
        d.where(F.col("doc_id") % 3 == k).write.parquet(f"{path}/part_{k}")
    return io.load_shards(spark, [f"{path}/part_{k}" for k in range(3)], "original_index")


@query("archive_roundtrip", f"WITH {C.ANS} SELECT 'sequence' AS level, 'LengthScore' AS name, CAST(unit AS VARCHAR) AS unit_id, round(ue, 6) AS value FROM ans")
def archive_roundtrip(spark, sf):
    path = io.scratch(spark, "archive")
    rows = S.scored_answers(spark, sf).select(F.lit("sequence").alias("level"), F.lit("LengthScore").alias("name"), F.col("unit").cast("string").alias("unit_id"), F.round("ue", 6).alias("value"))
    io.save_archive({"estimations": rows}, path)
    return io.load_archive(spark, path)["estimations"].select("level", "name", "unit_id", "value")


@query("resumable_append", "SELECT doc_id, length(text) AS score FROM documents")
def resumable_append(spark, sf):
    """Scored in two runs: the second one only scores what the first one left."""
    path = io.scratch(spark, "resume")
    d = S.table(spark, sf, "documents").select("doc_id", "text")
    score = lambda df: df.select("doc_id", F.length("text").cast("long").alias("score"))
    io.append_missing(d.where("doc_id % 2 = 0"), score, "doc_id", path, "doc_id long, score long")
    return io.append_missing(d, score, "doc_id", path, "doc_id long, score long")


@query("provider_cache", "SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS reply_length FROM conversations")
def provider_cache(spark, sf):
    """A stand-in chat model, asked once for each distinct prompt."""
    rows = S.table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    answered = providers.ask(rows, providers.EchoChat(), "prompt")
    return answered.select("conv_id", "turn", F.length("reply").cast("long").alias("reply_length"))


@query("review_sheet", f"WITH {C.CLAIM} SELECT doc_id, text AS claim, verified AS label FROM claim")
def review_sheet(spark, sf):
    rows = S.claims(spark, sf).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("claim_idx", "text", "verified"))).alias("c"))
    return io.explode_checked(rows.select("doc_id", F.col("c.text").alias("claims"), F.col("c.verified").alias("labels")), "claims", "labels").select("doc_id", F.col("claims").alias("claim"), F.col("labels").alias("label"))


_TURNS = r"turns AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM conversations)"


def _pairs_asked(spark, sf, provider):
    t = S.table(spark, sf, "conversations")
    a, b = (t.select("conv_id", F.col("turn").alias(k), F.col("text").alias(f"t_{k}")) for k in "ij")
    rows = a.join(b, "conv_id").where("i < j").withColumn("prompt", F.concat("t_i", F.lit(providers.PAIR), "t_j"))
    return providers.ask(rows, provider, "prompt")


@query("nli_provider", f"WITH {C.PAIR}, same AS (SELECT a.conv_id, a.turn AS i, b.turn AS j, a.text = b.text AS eq FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id) SELECT conv_id, i, j, round(e, 6) AS entail, round((1 - e) / 2, 6) AS neutral, round((1 - e) / 2, 6) AS contra FROM (SELECT p.conv_id, p.i, p.j, CASE WHEN eq THEN 1.0 ELSE least(1.0, 10 * jac) END AS e FROM pair p JOIN same s ON p.conv_id = s.conv_id AND p.i = s.i AND p.j = s.j WHERE p.i < p.j)")
def nli_provider(spark, sf):
    """Each distinct pair of turns asked once."""
    return rounded(_pairs_asked(spark, sf, providers.OverlapNli()).select("conv_id", "i", "j", "entail", "neutral", "contra"), "entail", "neutral", "contra")


@query("similarity_provider", f"WITH {C.PAIR} SELECT conv_id, i, j, round(jac, 6) AS similarity FROM pair WHERE i < j")
def similarity_provider(spark, sf):
    return rounded(_pairs_asked(spark, sf, providers.OverlapSimilarity()).select("conv_id", "i", "j", "similarity"), "similarity")


@query("step_sampling", f"WITH {_TURNS} SELECT conv_id, turn, k AS sample_idx, array_to_string(list_concat(w[k + 1:], w[1:k]), ' ') AS text FROM turns, (SELECT unnest(range(4)) AS k)")
def step_sampling(spark, sf):
    """Four samples of each step, one row each."""
    rows = S.table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    asked = providers.ask(rows, providers.RotatingSamples(4), "prompt")
    return asked.select("conv_id", "turn", F.posexplode("samples").alias("sample_idx", "text")).select("conv_id", "turn", F.col("sample_idx").cast("long").alias("sample_idx"), "text")


@query("conditional_scores", f"WITH {_TURNS}, p AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY conv_id ORDER BY turn), []) AS c FROM turns) SELECT conv_id, turn, round(list_sum(list_transform(w, lambda x: -ln(1 + length(x)) - 1 / (1 + len(c)))), 6) AS logprob, CAST(len(w) AS INT) AS n FROM p")
def conditional_scores(spark, sf):
    """The log-likelihood of each turn given the one before it."""
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    rows = S.table(spark, sf, "conversations").select("conv_id", "turn", F.concat(before, F.lit(providers.PAIR), F.col("text")).alias("prompt"))
    asked = providers.ask(rows, providers.LengthLikelihood(), "prompt")
    total = F.when(F.size("lls") > 0, F.aggregate("lls", F.lit(0.0), lambda s, x: s + x))
    return rounded(asked.select("conv_id", "turn", total.alias("logprob"), F.size("lls").alias("n")), "logprob")


@query("hashed_alternatives", f"WITH {_TURNS}, tok AS (SELECT conv_id, turn, unnest(w) AS w, unnest(range(len(w))) AS pos FROM turns), alt AS (SELECT *, w || repeat('~', CAST(k AS BIGINT)) AS token, -ln(2) * (k + 1) AS lp FROM tok, (SELECT unnest(range(5)) AS k)) SELECT conv_id, turn, pos, CAST('0x' || substr(sha256(token), 1, 8) AS BIGINT) % 50000 AS idx, round(max(lp), 6) AS logprob FROM alt GROUP BY ALL")
def hashed_alternatives(spark, sf):
    """Top words of a closed model at each position, in a hashed vocabulary; of words in one place the likelier one counts."""
    rows = S.table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    asked = providers.ask(rows, providers.Alternatives(5), "prompt").select("conv_id", "turn", F.posexplode("alternatives").alias("pos", "a"))
    cells = asked.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.explode("a").alias("x")).select("conv_id", "turn", "pos", providers.hashed_index(F.col("x.token")).alias("idx"), "x.logprob")
    return rounded(cells.groupBy("conv_id", "turn", "pos", "idx").agg(F.max("logprob").alias("logprob")), "logprob")


@query("retried_provider", "SELECT conv_id, turn, length(text) AS reply_length FROM conversations")
def retried_provider(spark, sf):
    """A model whose calls fail twice before each answer."""
    rows = S.table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    steady = providers.Retrying(providers.Unsteady(providers.EchoChat(), 2), waits=(0.0, 0.0, 0.0))
    return providers.ask(rows, steady, "prompt").select("conv_id", "turn", F.length("reply").cast("long").alias("reply_length"))


@query("routed_scores", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'reward' WHEN 1 THEN 'reason' ELSE 'reason-large' END AS route, round(CAST('0x' || substr(sha256(CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN 'v:' || text ELSE 'r:' || text END), 1, 12) AS BIGINT) / 281474976710656.0, 6) AS score FROM conversations")
def routed_scores(spark, sf):
    """Scorers by the beginning of a model's name, the longest one first."""
    model = F.when(F.col("turn") % 3 == 0, "reward-7b").when(F.col("turn") % 3 == 1, "reason-7b").otherwise("reason-large-34b")
    rows = S.table(spark, sf, "conversations").select("conv_id", "turn", model.alias("model"), F.concat(F.when(F.col("turn") % 3 == 1, "v:").when(F.col("turn") % 3 == 2, "r:").otherwise(""), F.col("text")).alias("prompt"))
    scorers = {"reward": providers.HashScore(), "reason": providers.HashScore(), "reason-large": providers.HashScore()}
    return rounded(providers.routed(rows, scorers, "model", "prompt").select("conv_id", "turn", "route", "score"), "score")
