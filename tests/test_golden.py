"""Small cases with values that follow from the definitions, and numpy re-computations."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeworks.functions import arrays as A
from gaugeworks.functions import sequential as Q
from gaugeworks.functions import text as X
from gaugeworks.operators import calibrate, density, ensembles, estimators, etl, evaluate, features, pairs, select, spectral
from gaugeworks.plans.ranked import with_running
from gaugeworks.registry import Operator, Registry
from gaugeworks.sources import io, providers


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def doubles(*x):
    return F.array(*map(F.lit, x)).cast("array<double>")


def answers(spark, ue, target):
    return spark.createDataFrame([(k, float(u), None if t is None else float(t)) for k, (u, t) in enumerate(zip(ue, target))], "unit long, ue double, target double")


def metric(spark, name, ue, target):
    return evaluate.METRICS[name](answers(spark, ue, target), []).first().value


def test_likelihoods(spark):
    ll = doubles(-1, -3)
    assert one(spark, estimators.max_sequence_probability(ll)) == 4.0
    assert one(spark, estimators.perplexity(ll)) == 2.0
    assert one(spark, estimators.perplexity(F.array().cast("array<double>"))) is None


def test_metrics_by_hand(spark):
    assert metric(spark, "rpp", [1, 2], [0, 1]) == 0.25
    assert metric(spark, "prr", [1, 2], [1, 0]) == 0.75
    assert metric(spark, "rcc-auc", [1, 2], [1, 0]) == 0.25
    assert metric(spark, "ece", [0.05, 0.95], [1, 0]) == pytest.approx(0.05)
    assert metric(spark, "roc-auc", [1, 2, 3, 4], [1, 1, 0, 0]) == 1.0
    assert metric(spark, "roc-auc", [1, 1, 1], [1, 0, 1]) == 0.5
    assert metric(spark, "roc-auc", [1, 2, 9], [1, 0, None]) == 1.0
    assert math.isnan(metric(spark, "bs", [-3, 0.5], [1, 0]))
    assert metric(spark, "prr", [3, 1], [1, 1]) == 0.5


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 1)), min_size=4, max_size=40))
def test_rank_metrics_against_numpy(spark, rows):
    ue, target = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    n = len(ue)
    con = sum(ue[i] < ue[j] and target[i] < target[j] for i in range(n) for j in range(n))
    dis = sum(ue[i] < ue[j] and target[i] > target[j] for i in range(n) for j in range(n))
    c = evaluate.pair_counts(answers(spark, ue, target), []).first()
    assert (c.concordant, c.discordant) == (con, dis)
    bad, good = ue[target == 0], ue[target == 1]
    want = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) if len(bad) and len(good) else None
    got = metric(spark, "roc-auc", ue, target)
    assert got == (pytest.approx(want) if want is not None else None)
    assert metric(spark, "roc-auc", 3 * ue + 1, target) == (pytest.approx(want) if want is not None else None)
    assert metric(spark, "prr", -target, target) >= metric(spark, "prr", ue, target) - 1e-9


def test_running_values_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(g, (k * 37) % 101, float(k)) for g in ("a", None) for k in range(101)], "g string, k long, v double")
    for parts in (1, 3, 8):
        for r in with_running(rows.repartition(5), ["g"], ["k"], {"s": F.col("v")}, partitions=parts).collect():
            assert r["rank"] == r.k + 1 and r.n == 101
            assert r.s == sum(j for j in range(101) if (j * 37) % 101 <= r.k)


def test_distributions_against_numpy(spark):
    x = np.random.default_rng(0).normal(size=20)
    lp = x - np.log(np.exp(x).sum())
    col = doubles(*x.tolist())
    assert np.allclose(one(spark, A.log_softmax(col)), lp)
    assert one(spark, A.entropy(doubles(*lp.tolist()))) == pytest.approx(-(lp * np.exp(lp)).sum())
    q = lp / 2 - np.log(np.exp(lp / 2).sum())
    assert one(spark, A.renyi(doubles(*lp.tolist()), 0.5)) == pytest.approx((np.log(np.exp(0.5 * q).sum()) - 0.5 * np.log(20)) / -0.5)
    assert one(spark, A.fisher_rao(doubles(*[math.log(0.05)] * 20))) == pytest.approx(0, abs=1e-6)
    assert [t.token for t in one(spark, A.top_n(doubles(0.1, 0.5, 0.5, 0.2), 3))] == [1, 2, 3]
    assert one(spark, A.gather(doubles(1, 2, 3), F.array(F.lit(2), F.lit(0), F.lit(9)))) == [3, 1]


def test_pairs_and_spectra(spark):
    rows = [(0, i, j, 1.0 if i == j else 1 / 3) for i in range(2) for j in range(2)]
    p = spark.createDataFrame(rows, "k long, i long, j long, w double")
    assert pairs.degree_matrix(p, "k", F.col("w")).first().value == pytest.approx(1 / 3)
    classes = spark.createDataFrame([(0, 0, -1.0, 0), (0, 1, -2.0, 0), (0, 2, -3.0, 1)], "k long, turn long, logprob double, class_id int")
    assert pairs.label_prob(classes, "k").first().value == pytest.approx(1 / 3)
    both = math.log(math.exp(-1) + math.exp(-2))
    assert pairs.semantic_entropy(classes, "k").first().value == pytest.approx(-(2 * both - 3) / 3)
    same = np.ones((4, 4))
    assert spectral.laplacian_sum(same) == pytest.approx(1) and spectral.laplacian_sum(np.eye(4)) == pytest.approx(4)
    assert spectral.eccentricity(same) == pytest.approx(0, abs=1e-7)
    a = np.random.default_rng(1).normal(size=(5, 5))
    values, vectors = np.linalg.eig(a)
    assert np.allclose(spectral.matrix_exponential(a), (vectors @ np.diag(np.exp(values)) @ np.linalg.inv(vectors)).real)
    assert spectral.semantic_sets(np.array([[1, 0.9, 0], [0.9, 1, 0], [0, 0, 1.0]]), np.full((3, 3), 0.5)) == 2
    assert spectral.greedy_classes(np.array([[2, 2, 0], [2, 2, 0], [0, 0, 2]])) == [0, 0, 1]
    assert spectral.cosine_clusters(np.array([[1, 0], [0.99, 0.1], [0, 1.0]])) == [0, 0, 1]
    assert spectral.kernel_entropy(np.eye(3), np.zeros((3, 3))) == pytest.approx(1)


def test_density(spark):
    x = np.random.default_rng(2).normal(size=(200, 3)) @ np.array([[1, 0.4, 0], [0, 2, 0], [0, 0, 0.5]])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(5)
    mean, inverse = density.fit(df, "v")
    assert np.allclose(mean, x.mean(0)) and np.allclose(inverse, np.linalg.inv(np.cov(x.T)))
    got = {r.id: r.d for r in density.mahalanobis(df, "v", (mean, inverse), "d").collect()}
    assert got[7] == pytest.approx(math.sqrt((x[7] - mean) @ inverse @ (x[7] - mean)))
    far = np.vstack([x, x[:10] + 50])
    centre, _ = density.minimum_covariance(far, 0.8)
    assert np.abs(centre - x.mean(0)).max() < 0.5


@pytest.mark.parametrize("landmarks", [1000, 60])
def test_robust_density_learns_from_all_rows(spark, monkeypatch, landmarks):
    """With a landmark for each row, the components are those of the centred kernel matrix; with fewer, distances stay near."""
    monkeypatch.setattr(density, "LANDMARKS", landmarks)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6))
    train = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(4)
    test = spark.createDataFrame([(0, [0.0] * 6), (1, [3.0] * 6)], "id long, v array<double>")
    got = {r.id: r.d for r in density.robust_density(test, train, "id", "v", "d", components=8, support=1.0).collect()}
    k = density._kernel(x, x)
    values, vectors = np.linalg.eigh(k - k.mean(0)[None, :] - k.mean(1)[:, None] + k.mean())
    basis = vectors[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    project = lambda a: (lambda q: (q - k.mean(0)[None, :] - q.mean(1)[:, None] + k.mean()) @ basis)(density._kernel(a, x))
    p, q = project(x), project(np.array([[0.0] * 6, [3.0] * 6]))
    want = np.sqrt(np.einsum("ij,jk,ik->i", q - p.mean(0), np.linalg.inv(np.cov(p.T)), q - p.mean(0)))
    assert [got[0], got[1]] == pytest.approx(list(want), rel=1e-3 if landmarks > 300 else 0.15)
    robust = {r.id: r.d for r in density.robust_density(test, train, "id", "v", "d").collect()}
    assert robust[1] > robust[0]
    assert [r.d for r in density.robust_density(test, train.where("id < 0"), "id", "v", "d").collect()] == [None, None]


def test_ensembles(spark):
    same = [math.log(0.7), math.log(0.3)]
    e = spark.createDataFrame([(0, 0, m, same) for m in range(4)], "obs long, token_idx int, model long, lp array<double>")
    r = ensembles.token_measures(e).first()
    assert r.mutual == pytest.approx(0, abs=1e-9) and r.epkl == pytest.approx(0, abs=1e-9) and r.total == pytest.approx(-(0.7 * same[0] + 0.3 * same[1]))


def test_calibration(spark):
    px, py = calibrate.centered_isotonic(np.array([1, 2, 3, 4.0]), np.array([1, 21, 41, 34.0]))
    assert np.interp([1, 2, 3, 4], px, py).tolist() == [1, 21, 29.25, 37.5]  # the last step keeps its outer end only
    train, test = answers(spark, range(10), [1] * 5 + [0] * 5), answers(spark, [-5, 2, 9, 50], [None] * 4)
    assert [r.confidence for r in calibrate.minmax(train, test).orderBy("unit").collect()] == [1, pytest.approx(7 / 9), 0, 0]
    assert [r.confidence for r in calibrate.quantile(train, test).orderBy("unit").collect()] == [1, 0.8, 0.1, 0]
    fitted = [r.confidence for r in calibrate.isotonic(train, test).orderBy("unit").collect()]
    assert fitted == sorted(fitted, reverse=True) and fitted[0] == 1 and fitted[-1] == 0


def test_selection(spark):
    rows = [(1, 0, 0.5, 0.0), (1, 1, 0.2, 1.0), (1, 2, 0.2, 0.0), (2, 0, None, 0.0), (3, 0, 0.1, None)]
    c = spark.createDataFrame(rows, "q long, i int, s double, a double")
    best = {r.q: (r.best_idx, r.best_score) for r in select.best(c, "q", "i", "s", ["a"], default=0.5).collect()}
    assert best == {1: (1, 0.2), 2: (0, 0.5), 3: (0, 0.1)}
    t = select.offline_table(c, "q", "i", ["s"], "a").first()
    assert (t.used, t.skipped, t.accuracy) == (1, 2, 0.0)
    steps = spark.createDataFrame([(0, 0, 0, "a", 0.9), (0, 0, 1, "b", 0.1), (0, 1, 0, "<Answer>: 1", 0.3), (0, 2, 0, "late", 0.0)], "r long, s int, i int, t string, u double")
    f = select.fold_steps(steps, "r", "s", "i", "t", F.col("u"), True, "<Answer>:").first()
    assert (f.trajectory, f.n_steps, f.completed) == ("b\n<Answer>: 1", 2, True)


def test_partitions(spark):
    d = spark.range(10)
    size = lambda df: sorted(r["count"] for r in df.groupBy("part").count().collect())
    assert size(etl.balanced_partition(d, "id", 3)) == [3, 3, 4]
    assert size(etl.floor_partition(d, "id", 3)) == [3, 3, 3]
    assert size(etl.ceil_partition(d, "id", 3)) == [2, 4, 4]
    assert etl.slice_rows(d, "id", 2, 5).count() == 3


@pytest.mark.parametrize(("text", "value"), [("x #### 1,234", 1234), ("\\boxed{x=5%}", 5), ("a <Answer>: 3 or 4", 4), ("none", None), ("<Answer>: none 1", 1), ("\\boxed{two}", None), ("-2.5 then .5", 0.5), ("#### x", None), ("1_000", 0)])
def test_final_answer(spark, text, value):
    assert one(spark, X.final_answer(F.lit(text))) == value


def test_replies(spark):
    assert one(spark, X.label_list(F.lit("[1, 0]"))) == [1, 0] and one(spark, X.label_list(F.lit("no"))) is None
    assert one(spark, X.json_labels(F.lit('{"correctness": [0]}'), F.lit(2))) == [1.0, None]
    r = one(spark, X.reason_and_result(F.lit("[Reason]: it: fits\n[RESULT]: 0")))
    assert (r.result, r.reason) == (0.0, "it: fits")
    assert one(spark, estimators.combine_nli(F.lit("entail"), F.lit("contra"))) == "neutral"
    assert one(spark, estimators.combine_nli(F.lit("neutral"), F.lit("contra"))) == "contra"
    assert one(spark, X.sentences(F.lit("One. Two! tail"))) == ["One.", "Two!"]
    assert one(spark, X.trajectory_complete(F.lit("- Step 1: a\n<Answer>: 2"))) is True
    assert one(spark, X.trajectory_complete(F.lit("- Step 1: a\n- Step 2: b\n<Answer>: 2"))) is False
    assert one(spark, X.step_text(F.lit("- Step 1: a\n- Step 2: b"))) == "- Step 1: a"
    assert one(spark, X.invert_template("Q: {q} A:", F.lit("Q: why? A:"))) == "why?"
    assert one(spark, features.lookback_ratio(doubles(0.2, 0.2, 0.1), F.lit(2))) == pytest.approx(2 / 3)


def test_sequential_texts():
    assert Q.merged_sentences("Dr. Who paid 3.14 dollars in all. Yes! And this one is long enough.") == ["Dr. Who paid 3.14 dollars in all. Yes!", "And this one is long enough."]
    assert Q.thinking_sentences("<think>First thought here now. Second rest</think> out.") == ["First thought here now."]
    s = "Lanny Flaherty is an American actor born on December 18, 1949, in Pensacola, Florida."
    assert Q.match_mask(s, ["Lanny", "Flaherty", "born", "on", "December", "18", "1949"]).rstrip() == "^^^^^ ^^^^^^^^                      ^^^^ ^^ ^^^^^^^^ ^^  ^^^^"
    assert Q.match_mask(s, ["born", "Lanny"]) is None
    assert Q.tokens_of_mask("^^  ^", ["ab", "cd", "e"]) == [0, 2]
    assert Q.merge_words(["he", "llo", ",", "you"], [0.9, 0.5, 0.8, 0.7]) == [("hello", 0.5), (",", 0.8), ("you", 0.7)]
    assert Q.with_spaces(["he", "llo", ",", "you", "!"], "hello, you!") == ["he", "llo", ", ", "you", "!"]
    assert Q.split_edges([" (he", "llo), ", "it's\n", " "], [0.9, 0.5, 0.8, 0.7]) == (["(", "he", "llo", ")", ",", " ", "it's"], [1.0, 0.9, 0.5, 1.0, 1.0, 1.0, 0.8])
    assert Q.split_edges([], []) == ([], []) and Q.split_edges(["\n", " "], [0.5, 0.5]) == ([], [])
    assert Q.merge_words(*Q.split_edges(["he", "llo, ", "you"], [0.9, 0.5, 0.7])) == [("hello", 0.5), (",", 1.0), (" ", 1.0), ("you", 0.7)]
    assert Q.rouge_l(list("abcd"), list("axcd")) == pytest.approx(0.75) and Q.bleu(list("abcd"), list("abcd")) == pytest.approx(1)
    assert Q.smart_l([[1.0, 0.0], [0.0, 1.0]]) == 1.0 and Q.smart_n([[1.0, 0.0], [0.0, 1.0]]) == 1.0


def test_registry_orders_and_refuses_cycles(spark):
    r = Registry()
    r.add(Operator("a", lambda d: d.withColumn("a", F.col("id") + 1), ("a",), ("id",)))
    r.add(Operator("b", lambda d: d.withColumn("b", F.col("a") * 2), ("b",), ("a",)))
    assert [o.name for o in r.plan(["b"], ["id"])] == ["a", "b"]
    assert r.run(spark.range(3), ["b"]).agg(F.sum("b")).first()[0] == 12
    with pytest.raises(ValueError):
        r.add(Operator("a", lambda d: d))
    r.add(Operator("c", lambda d: d, ("c",), ("d",)))
    r.add(Operator("d", lambda d: d, ("d",), ("c",)))
    with pytest.raises(ValueError):
        r.plan(["c"])
    with pytest.raises(KeyError):
        r.plan(["nowhere"])


def test_resume_and_archive(spark, tmp_path):
    d, path = spark.range(10), f"file://{tmp_path}/scores"
    calls = []

    def score(df):
        calls.append(df.count())
        return df.withColumn("s", F.col("id") * 2)

    io.append_missing(d.where("id < 4"), score, "id", path, "id long, s long")
    assert io.append_missing(d, score, "id", path, "id long, s long").count() == 10 and calls == [4, 6]
    io.save_archive({"metrics": d.select(F.lit("claim").alias("level"), "id")}, f"file://{tmp_path}/archive")
    assert io.load_archive(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/archive")["metrics"].count() == 10
    with pytest.raises(ValueError):
        io.pick_split(d.withColumn("split", F.lit("train")), "nope")


def test_providers(spark):
    d = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "p string")
    got = providers.ask(d, providers.HashScore(), "p").collect()
    assert len(got) == 4 and len({r.score for r in got if r.p == "a"}) == 1
    cache = spark.createDataFrame([("a", 0.5)], "p string, score double")
    assert {r.score for r in providers.ask(d, providers.HashScore(), "p", cache).collect() if r.p == "a"} == {0.5}
    assert providers.by_prefix({"x": 1, "x/y": 2}, "x/y-7b") == 2


def test_head_learns(spark):
    rng = np.random.default_rng(3)
    rows = [(v.tolist(), int(v[0] > 0) if k % 9 else -100) for k, v in enumerate(rng.normal(size=(400, 3)))]
    df = spark.createDataFrame(rows, "v array<double>, y int")
    scored = features.apply_head(df, features.fit_head(df, "v", "y"), "v", "p").where("y >= 0").collect()
    assert np.mean([(r.p > 0.5) == bool(r.y) for r in scored]) > 0.95


def test_layered_head(spark):
    """A label no linear head can learn; training ends early; a search leaves a hopeless rate behind; gradients are those of the loss."""
    from gaugeworks.operators import heads

    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 2))
    rows = [(k, v.tolist() if k != 7 else None, int(v[0] * v[1] > 0) if k % 11 else (-100 if k % 2 else None)) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int").repartition(3)
    train, valid = df.where("id < 600"), df.where("id >= 600")
    run = heads.fit(train, valid, "v", "y", heads.Setting(rate=2e-2, hidden=(32, 16)), epochs=60)
    assert run.best_loss == min(run.losses) < run.losses[-1] + 1e-12
    got = heads.apply(df, run, "v", "p").collect()
    assert [r.id for r in got if r.p is None] == [7]
    assert np.mean([(r.p > 0.5) == bool(r.y) for r in got if r.id >= 600 and r.y in (0, 1)]) > 0.93
    again = heads.fit(train.repartition(7), valid, "v", "y", heads.Setting(rate=2e-2, hidden=(32, 16)), epochs=60)
    assert again.losses == pytest.approx(run.losses, abs=1e-6)
    found = heads.search(train, valid, "v", "y", [heads.Setting(rate=r, hidden=(32, 16)) for r in (0.0, 3e-2, 1e-9)], least=6, epochs=18)
    assert found[0][0].rate == 3e-2 and found[0][1] > 6 >= found[1][1] and found[0][2] > 0.85
    with pytest.raises(ValueError):
        heads.fit(train.where("y = -100"), valid, "v", "y")
    a, y = x[:20], (x[:20, 0] > 0).astype(float)
    layers = [v + 0.1 * rng.normal(size=v.shape) for v in heads.begin(2, heads.Setting(hidden=(4, 3))).layers]  # off the kinks
    for k, g in enumerate(heads._gradients(layers, a, y, 3.0)[1]):
        for at in np.ndindex(g.shape):
            up, down = [v.copy() for v in layers], [v.copy() for v in layers]
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert g[at] / len(y) == pytest.approx((heads.loss(heads.logits(up, a), y, 3.0) - heads.loss(heads.logits(down, a), y, 3.0)) / 2e-6, abs=1e-5)


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("triplicate", "triplic"), ("hopeful", "hope"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("sky", "sky")])
def test_stems(word, stem):
    from gaugeworks.functions.stemmer import stem as found

    assert found(word) == stem


def test_overlap_scores():
    assert Q.lexical_score("The cats were hopping.", "the cat was hopped", "rouge1") == pytest.approx(0.75)
    assert Q.sentence_bleu("the cat sat on the mat.", "The cat sat on the mat") == pytest.approx(100)
    assert Q.sentence_bleu("dog", "cat") == 0 and 0 < Q.sentence_bleu("the cat sat", "the cat ran") < 100
    assert Q.translation_words("It costs 3.5, (maybe)!") == ["it", "costs", "3.5", ",", "(", "maybe", ")", "!"]
