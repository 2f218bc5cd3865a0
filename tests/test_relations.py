"""Texts made for a provider: tokens left out, alternatives, truth."""

import json
import random
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import relations
from gaugeworks.sources import calls, providers


def asked(folder):
    return [t for f in folder.iterdir() for t in json.loads(f.read_text())]


def test_tokens_left_out(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, rng.choice(["ask", None, "what now"]), rng.choices(["red", "blue", "</s>", "tin"], k=rng.randrange(0, 7))) for k in range(50)] + [(98, "q", None), (99, "q", ["</s>"])]
    df = spark.createDataFrame(rows, "id long, p string, w array<string>").repartition(3)
    provider = calls.Replay(providers.OverlapSimilarity(), str(tmp_path))
    got = {r.id: r.similarity for r in relations.token_similarity(df, "id", "p", "w", ["</s>"], calls.Answers(spark, provider)).collect()}
    pairs = set()
    for k, p, w in rows:
        want = []
        for i, t in enumerate(w or []):
            if len(w) == 1:
                want.append(0.5)
            elif t == "</s>":
                want.append(1.0)
            else:
                said = lambda ws: (p or "") + " " + " ".join(x for x in ws if x != "</s>")
                pair = said(w) + providers.PAIR + said(w[:i] + w[i + 1 :])
                pairs.add(pair)
                want.append(providers.OverlapSimilarity().answer([pair])["similarity"][0])
        assert got[k] == pytest.approx(want)
    assert len(got) == len(rows) and Counter(asked(tmp_path)) == Counter(pairs)
    assert relations.token_similarity(df.where("false"), "id", "p", "w", [], calls.Answers(spark, provider)).count() == 0


def test_relations_of_alternatives(spark, tmp_path):
    rng = random.Random(6)
    kind = {"entail": (0.7, 0.2, 0.1), "neutral": (0.1, 0.8, 0.1), "contra": (0.0, 0.2, 0.8)}
    nli = lambda pair: ["entail", "neutral", "contra"][int(providers.digest(pair)[0], 16) % 3]
    provider = calls.Replay(providers.PerText("entail double, neutral double, contra double", lambda t: kind[nli(t)]), str(tmp_path))
    rows = [(k, [[rng.choice([" yes", "no.", "'maybe'", "yes", "42", "?!"]) for _ in range(rng.randrange(0, 4))] for _ in range(rng.randrange(0, 5))]) for k in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, alts array<array<string>>").repartition(3)
    got = {r.id: r.relations for r in relations.alternative_relations(df, "id", "alts", calls.Answers(spark, provider)).collect()}
    strip, pairs = lambda w: w.strip(string.punctuation + " \n"), set()
    for k, alts in rows:
        want = []
        for words in alts or []:
            own = []
            for w in words:
                a, b = strip(words[0]), strip(w)
                f, r = nli(a + providers.PAIR + b), nli(b + providers.PAIR + a)
                pairs |= {a + providers.PAIR + b, b + providers.PAIR + a}
                own.append(f if f == r else "neutral" if "neutral" not in (f, r) else r if f == "neutral" else f)
            if own:
                want.append(own)
        assert got.get(k, []) == want
    assert Counter(asked(tmp_path)) == Counter(pairs)


def test_truth_prompts(spark):
    df = spark.createDataFrame([(1, "q", "a", ["x", "y"]), (2, None, None, [])], "id int, q string, a string, i array<string>")
    got = {r.id: (r.p, r.b) for r in df.select("id", relations.truth_prompt(F.col("q"), F.col("a"), F.col("i")).alias("p"), relations.truth_prompt(F.col("q"), F.col("a")).alias("b")).collect()}
    assert got[1] == ("Question: q\nIdeas:\nx\ny\nProposed answer: a\nIs it (A) true or (B) false? It is:", "Question: q\nProposed answer: a\nIs it (A) true or (B) false? It is:")
    assert got[2][1] == "Question: \nProposed answer: \nIs it (A) true or (B) false? It is:"
    scores = providers.PerText("score double", lambda t: (0.0 if t == "z" else 0.5,))
    rows = spark.createDataFrame([("z",), ("h",), (None,)], "p string")
    assert {r.p: r.t for r in relations.p_true(rows, "p", calls.Answers(spark, scores), "t").collect()} == {"z": None, "h": pytest.approx(0.693147, abs=1e-6), None: None}


def test_reward_families(spark):
    from gaugeworks.operators import step_rewards

    rows = [(1, "q", ["a ", None, "c"]), (2, None, ["x"]), (3, "q", []), (4, "q", None)]
    df = spark.createDataFrame(rows, "id int, q string, s array<string>")
    said = {}
    for family, schema, value in (("marks", "logits array<array<double>>", lambda t: ([[0.0, 1.0]] * t.count("<extra_0>"),)), ("tags", "logits array<array<double>>", lambda t: ([[0.0, 1.0]] * t.count("ки"),)), ("flags", "values array<double>, flags array<int>", lambda t: ([0.0, 1.0] * 3, [0, 1] * t.count("\n") + [0, 0] * (3 - t.count("\n")))), ("dialogue", "logits array<array<double>>", lambda t: ([[9.0, 9.0], [1.0, 0.0]],)), ("beginnings", "score double", lambda t: (float(len(t) % 3),)), ("labels", "entities array<string>, scores array<double>", lambda t: (["LABEL_0"], [0.9]) if "c" in t else ([], []))):
        got = {r.id: r.rewards for r in step_rewards.step_rewards(df, "id", "q", "s", family, calls.Answers(spark, providers.PerText(schema, value))).collect()}
        assert got[3] == got[4] == [] and len(got[1]) == 3 and len(got[2]) == 1, family
        said[family] = got[1]
    high, low = pytest.approx(0.7310586), pytest.approx(0.2689414)
    assert said["marks"] == [high] * 3 and said["tags"] == [low] * 3 and said["flags"] == [high] * 3 and said["dialogue"] == [high] * 3
    assert said["labels"] == [0.5, 0.5, pytest.approx(0.1)]
    prompts = df.where("id = 1").select(*(f.prompt(F.col("q"), F.array(F.lit("a"), F.lit(""), F.lit("c"))).alias(n) for n, f in step_rewards.FAMILIES.items())).first()
    assert prompts.marks == "q\na<extra_0><extra_0>c<extra_0>" and prompts.tags == "q Step 1: a ки\nStep 2:  ки\nStep 3: c ки" and prompts.flags == "q\na\n\nc"
    assert prompts.dialogue == "q a\n+\n\n+\nc\n+" and prompts.labels == "q\n\na\n\n\n\nc\n\n" and prompts.beginnings.endswith("question.\na\n\nc\n")
    with pytest.raises(Exception, match="another number of steps"):
        step_rewards.step_rewards(df, "id", "q", "s", "marks", calls.Answers(spark, providers.PerText("logits array<array<double>>", lambda t: ([[0.0, 1.0]],)))).collect()
