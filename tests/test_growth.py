"""What queries read, write and hold at once, which must not grow faster than their tables."""

import json
import random
import time
import uuid

from gaugeworks.functions import sequential
from gaugeworks.operators import unigrams
from gaugeworks.plans import q_similarity
from gaugeworks.sources import calls, providers


def watched(df, folder):
    """`df`, which leaves a file in a folder for each time that one of its parts is read."""

    def run(batches):
        (folder / uuid.uuid4().hex).touch()
        yield from batches

    return df.mapInArrow(run, df.schema)


def test_word_model_reads_its_texts_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", ["x", "y", "x"]), ("b", ["x"]), (None, ["z"]), ("b", [])], "g string, w array<string>").coalesce(1)
    found = {(r.g, r.tok): (r.c, r.t, r.c_group, r.c_all) for r in unigrams.model(watched(rows, tmp_path), "g", "w").collect()}
    assert found == {("a", "x"): (2, 3, 3, 5), ("a", "y"): (1, 1, 3, 5), ("b", "x"): (1, 3, 1, 5)}
    assert len(list(tmp_path.iterdir())) == 1


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_common_subsequences_of_long_texts():
    """Against the table of all pairs of positions; texts of ten thousand words take a moment, not minutes."""
    rng = random.Random(1)
    for _ in range(400):
        few = rng.choice([1, 2, 5, 40])
        a, b = ([str(rng.randrange(few)) for _ in range(rng.randrange(n))] for n in (25, 70))
        assert sequential.common_length(a, b) == sequential.common_length(b, a) == plain_common(a, b)
    began = time.perf_counter()
    a, b = ([str(rng.randrange(3000)) for _ in range(10_000)] for _ in range(2))
    assert sequential.common_length(a, b) > 100 and sequential.common_length(a, a) == 10_000
    assert time.perf_counter() - began < 2


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_a_pair_are_compared_once(spark, sf):
    found = plan(q_similarity._classes(spark, sf))
    assert "array_union" not in found and [x.count("array_intersect") for x in found.splitlines() if "array_intersect" in x] == [2]  # one expression
    assert not any("Join" in x and "array_intersect" in x for x in found.splitlines())


def test_overlap_of_bags_without_a_row_for_each_word(spark, tmp_path):
    rows = [(1, 0, "A a b  c"), (1, 1, "a B b"), (1, 2, ""), (1, 3, " "), (1, 4, None), (1, 5, "x x x"), (1, 6, "x y")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = q_similarity.rouge1_overlap(spark, str(tmp_path))
    assert {r.turn: r.value for r in df.collect()} == {0: round(4 / 7, 6), 1: 0.0, 4: 0.0, 5: 0.4}
    assert "Generate" not in plan(df)


def test_a_provider_is_asked_for_few_prompts_at_once(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "concat('word ', id) AS prompt")
    answers = calls.Answers(spark, calls.Replay(providers.Alternatives(5), str(tmp_path)), in_flight=1)
    assert answers.ask(rows, "prompt").where("size(alternatives) = 2").count() == 1000
    asked = [json.loads(f.read_text()) for f in tmp_path.iterdir()]
    assert sum(map(len, asked)) == 1000 and max(map(len, asked)) <= calls.PROMPTS


def test_a_provider_is_asked_for_fewer_prompts_where_its_answers_are_large(spark, tmp_path):
    """A megabyte or so of answers at once, not 25; the same by rows, and by parts of texts."""
    large = providers.PerText("reply string", lambda t: (t[-1] * 100_000,))
    most = lambda folder: max(len(json.loads(f.read_text())) for f in folder.iterdir()) * 100_000
    rows = spark.range(0, 300, 1, 1).selectExpr("concat('word ', id) AS prompt")
    for name in ("ask", "rows", "parts"):
        (tmp_path / name).mkdir()
        answers = calls.Answers(spark, calls.Replay(large, str(tmp_path / name)), in_flight=1)
        if name == "ask":
            found = answers.ask(rows, "prompt")
        elif name == "rows":
            found = answers.ask_rows(rows, ["prompt"], lambda p: [p, None, p], "a").selectExpr("prompt", "a[0].reply AS reply", "a").where("a[0] = a[2] AND a[1] IS NULL")
        else:
            found = answers.ask_parts(rows.selectExpr("prompt", "array(1) AS parts"), "prompt", "parts", lambda t, k: t).selectExpr("text AS prompt", "reply")
        assert found.where("reply = repeat(right(prompt, 1), 100000)").count() == 300
        assert most(tmp_path / name) <= 1_000_000
