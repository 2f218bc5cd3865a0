"""What is shuffled and written to disk, which must stay near the size of the table."""

import json
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import prefix_scores, relations
from gaugeworks.sources import calls, providers


def asked(folder):
    return [t for f in folder.iterdir() for t in json.loads(f.read_text())]


def shuffled(spark):
    """Bytes that all stages so far have shuffled."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def on_disk(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))


def plain_scores(rows):
    return {(g, k): providers.prefix_likelihoods().answer([(g or "") + providers.PAIR + " ".join(w)])["lls"][0] for g, k, w in rows}


def test_prefix_tree_has_no_row_for_each_token(spark, tmp_path, monkeypatch):
    """A text is shuffled about once, its values are written once."""
    monkeypatch.setattr("gaugeworks.sources.io.scratch", lambda spark, label: f"file://{tmp_path}/{label}")
    rng = random.Random(1)
    rows = [("en", k, ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(2000)]) for k in range(80)]
    rows += [("en", 100 + k, rows[k][2][:1500] + rows[k + 1][2][:50]) for k in range(10)]
    spark.createDataFrame(rows, "g string, k int, w array<string>").write.parquet(f"{tmp_path}-rows")
    df, before = spark.read.parquet(f"{tmp_path}-rows"), shuffled(spark)
    got = {(r.g, r.k): r.lls for r in prefix_scores.forced_scores(df, "g", "k", F.col("g"), "w", calls.Answers(spark, providers.prefix_likelihoods())).collect()}
    want = plain_scores(rows)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    words, text = sum(len(w) for _, _, w in rows), sum(len(x) + 1 for _, _, w in rows for x in w)
    # nine bytes a word at most for the values
    assert shuffled(spark) - before < 1.5 * text and on_disk(tmp_path) < 9 * words + 100_000


@pytest.mark.parametrize("in_flight", [1, 3, 40])
def test_prefix_tree_across_stretches(spark, tmp_path, in_flight):
    """Each edge is asked for once however many stretches there are, and a second run on the same answers asks for nothing."""
    rng = random.Random(in_flight)
    rows = []
    for k in range(150):
        stem = rng.choice(rows)[2][: rng.randrange(0, 9)] if rows and rng.random() < 0.7 else []
        rows.append((rng.choice(["a b", "a", None]), k, [*stem, *rng.choices(["ab", "c", "d\x1f0", "é", "\x01"], k=rng.randrange(0, 6))]))
    df = spark.createDataFrame(rows, "g string, k int, w array<string>").repartition(4)
    want, folder = {}, tmp_path / "asked"
    folder.mkdir()
    # a value of two for each word: nothing may be cut by the number of words
    double = providers.PerText("lls array<double>", lambda t: ([x for v in providers.HashScore().answer([t.replace(providers.PAIR, " ").strip().rsplit(" ", n)[0] for n in range(len(t.split(providers.PAIR)[1].split(" ")))])["score"][::-1] for x in (v, -v)],))
    for g, k, w in rows:
        want[g, k] = double.answer([(g or "") + providers.PAIR + " ".join(w)])["lls"][0] if w else []
    answers = calls.Answers(spark, calls.Replay(double, str(folder)), f"file://{tmp_path}/answers", in_flight)
    got = {(r.g, r.k): r.lls for r in prefix_scores.forced_scores(df, "g", "k", F.col("g"), "w", answers).collect()}
    assert got == want
    once, nodes = asked(folder), {(g, *w[:n]) for g, _, w in rows for n in range(1, len(w) + 1)}
    assert max(Counter(once).values()) == 1 and sum(len(t.split(providers.PAIR)[1].split(" ")) for t in once) == len(nodes)
    assert answers.written().count() == len(once)
    again = calls.Answers(spark, calls.Replay(double, str(folder)), f"file://{tmp_path}/answers", in_flight)
    assert {(r.g, r.k): r.lls for r in prefix_scores.forced_scores(df, "g", "k", F.col("g"), "w", again).collect()} == want
    assert len(asked(folder)) == len(once)


def test_prefix_tree_with_failed_calls(spark, tmp_path):
    """Candidates behind a failed call have no values, and it is asked again the next time."""
    rows = [("q", k, w.split()) for k, w in enumerate(["a b c", "a b d", "a x", "y z", "a b c", "y"])]
    df = spark.createDataFrame(rows, "g string, k int, w array<string>")
    provider = lambda fails: calls.Replay(providers.prefix_likelihoods(), str(tmp_path), fails)
    answers = lambda fails: calls.Answers(spark, provider(fails), f"file://{tmp_path.parent}/{tmp_path.name}-answers", failures=(ConnectionError,))
    run = lambda a: {r.k: r.lls for r in prefix_scores.forced_scores(df, "g", "k", F.col("g"), "w", a).collect()}
    want = {k: v for (_, k), v in plain_scores(rows).items()}
    assert run(answers(lambda t: t.endswith("\x1eb"))) == {0: [], 1: [], 2: want[2], 3: want[3], 4: [], 5: want[5]}
    n = len(asked(tmp_path))
    assert run(answers(lambda t: False)) == want and asked(tmp_path).count("q a\x1eb") == 1 and len(asked(tmp_path)) == n + 1


def plain_similarities(rows, special):
    said = lambda p, ws: p + " " + " ".join(x for x in ws if x not in special)
    one = lambda p, w, i: 1.0 if w[i] in special else providers._overlap(said(p, w) + providers.PAIR + said(p, w[:i] + w[i + 1 :]))
    return {k: [0.5] * len(w) if len(w) < 2 else [one(p, w, i) for i in range(len(w))] for k, p, w in rows}


def test_left_out_tokens_have_no_rows(spark, tmp_path, monkeypatch):
    """A text is shuffled about once, and its values."""
    monkeypatch.setattr("gaugeworks.sources.io.scratch", lambda spark, label: f"file://{tmp_path}/{label}")
    rng = random.Random(2)
    rows = [(k, "q", ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(200)]) for k in range(600)]
    spark.createDataFrame(rows, "id long, p string, w array<string>").write.parquet(f"{tmp_path}-rows")
    df, before = spark.read.parquet(f"{tmp_path}-rows"), shuffled(spark)
    # values without order, as a model's are
    scores = providers.PerText("similarity double", lambda t: (providers.HashScore().answer([t])["score"][0],))
    got = relations.token_similarity(df, "id", "p", "w", ["</s>"], calls.Answers(spark, scores)).selectExpr("count(*)", "sum(size(similarity))", "count(distinct similarity[7])").first()
    words, text = sum(len(w) for _, _, w in rows), sum(len(x) + 1 for _, _, w in rows for x in w)
    assert tuple(got) == (len(rows), words, len(rows))
    # a text and a length for each word, then nine bytes a word at most for its value
    assert shuffled(spark) - before < 1.5 * text + 10 * words and on_disk(tmp_path) < 10 * words


def test_left_out_tokens_of_earlier_runs(spark, tmp_path):
    """One text by several tokens; a second run asks for what failed only, and what a table of answers has is not asked for."""
    words = [["red", "red", "tin"], ["</s>", "red", "red", "tin"], ["red red", "tin"], ["red", "</s>", "red", "tin"], ["red", "red", "tin"], ["one", "two"], ["</s>", "</s>"], ["x"], []]
    rows = [(k, "q", w) for k, w in enumerate(words)]
    df = spark.createDataFrame(rows, "id long, p string, w array<string>").repartition(3)
    folder = tmp_path / "asked"
    folder.mkdir()
    answers = lambda fails: calls.Answers(spark, calls.Replay(providers.OverlapSimilarity(), str(folder), fails), f"file://{tmp_path}/answers", failures=(ConnectionError,))
    run = lambda a: {r.id: r.similarity for r in relations.token_similarity(df, "id", "p", "w", ["</s>"], a).collect()}
    want = plain_similarities(rows, ["</s>"])
    first = answers(lambda t: "one" in t.split(providers.PAIR)[1])
    known = "q red red tin" + providers.PAIR + "q red red"
    first.add(spark.createDataFrame([(known, 0.25)], "prompt string, similarity double"), "prompt")
    for k in (0, 1, 2, 3, 4):
        want[k][-1] = 0.25
    got = run(first)
    assert got == want | {5: [want[5][0], None]}
    n = len(asked(folder))
    # without the first and the second red, without red red, and without one; that without two failed
    assert Counter(asked(folder)) == Counter("q red red tin" + providers.PAIR + x for x in ("q red tin", "q tin")) + Counter(["q one two" + providers.PAIR + "q two"]) and n == 3
    assert run(answers(lambda t: False)) == want
    assert asked(folder).count("q one two" + providers.PAIR + "q one") == 1 and len(asked(folder)) <= n + 2
    m = len(asked(folder))
    assert run(answers(lambda t: False)) == want and len(asked(folder)) == m


def test_many_copies_of_a_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("gaugeworks.sources.calls.LEAST_HOT", 5)
    monkeypatch.setattr("gaugeworks.operators.lookup.LEAST_HOT", 5)
    rows = [(k, "q", ["a", "b", "a"] if k % 3 else ["c", str(k % 2)]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, p string, w array<string>").repartition(3)
    provider = calls.Replay(providers.OverlapSimilarity(), str(tmp_path))
    got = {r.id: r.similarity for r in relations.token_similarity(df, "id", "p", "w", [], calls.Answers(spark, provider)).collect()}
    assert got == plain_similarities(rows, []) and len(asked(tmp_path)) == 3 + 2 + 2
