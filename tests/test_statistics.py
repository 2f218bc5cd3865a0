"""Statistics that are kept, word likelihoods, and the contracts of token-level outputs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import focus, greedy, soft_match, unigrams
from gaugeworks.sources import calls, providers
from gaugeworks.sources.statistics import Statistics, version


def test_statistics_follow_their_input(spark, tmp_path):
    table, built = f"file://{tmp_path}/in", []
    spark.range(5).write.parquet(table)
    store = Statistics(spark, f"file://{tmp_path}/store")

    def build(k):
        def run():
            built.append(k)
            return spark.read.parquet(table).agg(F.sum("id").alias("s"))

        return run

    assert [store.get("sum", "sum", [table], build(k)).first().s for k in range(2)] == [10, 10] and built == [0]
    spark.range(7).write.mode("overwrite").parquet(table)
    assert store.get("sum", "sum", [table], build(2)).first().s == 21 and built == [0, 2] and len(store.held()) == 1
    spark.range(100, 101).write.mode("append").parquet(table)
    assert store.get("sum", "sum", [table], build(3)).first().s == 121 and len(store.held()) == 1
    store.get("sum", "another definition", [table], build(4))
    assert len(store.held()) == 2 and built == [0, 2, 3, 4]

    def broken():
        return spark.read.parquet(table).select(F.raise_error(F.lit("broken")))

    with pytest.raises(Exception, match="broken"):
        store.get("other", "x", [table], broken)
    assert len(store.held()) == 2
    store.drop("sum")
    assert store.held() == [] and store.get("sum", "sum", [table], build(5)).first().s == 121
    store.drop()
    assert store.held() == [] and version(spark, table) == version(spark, table)


@pytest.mark.parametrize("frequent", [10_000, 6, 0])
def test_word_likelihoods(spark, monkeypatch, frequent):
    monkeypatch.setattr(unigrams, "FREQUENT", frequent)
    monkeypatch.setattr(unigrams, "ROWS", 7)
    rng = random.Random(6)
    rows = [(k, rng.choice(["en", "fr", None]), rng.choices([f"w{j}" for j in range(14)], [1 / (j + 1) for j in range(14)], k=rng.randrange(0, 12))) for k in range(90)] + [(900, "en", None), (901, "de", ["w0", "w0"])]
    df = spark.createDataFrame(rows, "id long, lang string, toks array<string>").repartition(3)
    words = unigrams.model(df, "lang", "toks")
    got = {r.id: r for r in unigrams.along(df, ["id"], "lang", "toks", words).collect()}
    known = [(k, g, w) for k, g, w in rows if g and w]
    pair, group = (Counter(f(g, t) for _, g, w in known for t in w) for f in (lambda g, t: (g, t), lambda g, t: g))
    tok = Counter(t for _, _, w in rows for t in w or ())  # words of no group count among all
    assert set(got) == {k for k, _, _ in known}
    for k, g, w in known:
        ll = [math.log(pair[g, t] / group[g]) for t in w]
        assert got[k].ll == pytest.approx(ll) and got[k].ent == pytest.approx([-x * math.exp(x) for x in ll])
        assert got[k].lm == pytest.approx([math.log(tok[t] / sum(tok.values())) for t in w])


def plain_greedy(tokens, logits, attention, end, n):
    stop = tokens.index(end) + 1 if end in tokens else len(tokens)
    lp = np.array(logits[:stop], float).reshape(stop, 5)
    lp = lp - np.log(np.exp(lp).sum(1, keepdims=True))
    best = [sorted(range(lp.shape[1]), key=lambda t: (-lp[k, t], t))[:n] for k in range(stop)]
    best = [[t for t in b if t == tokens[k]] + [t for t in b if t != tokens[k]] for k, b in enumerate(best)]
    seen = [[max(h[i][j] for h in attention) for j in range(i)] for i in range(stop)] if attention else [[] for _ in range(stop)]
    return tokens[:stop], tokens[: stop - (end in tokens)], lp, [lp[k, tokens[k]] for k in range(stop)], best, seen


RAW = f"id long, {greedy.RAW}"


def test_greedy_contract(spark):
    rng = random.Random(7)
    rows = []
    for k in range(60):
        n, heads = rng.randrange(0, 9), rng.randrange(0, 4)
        rows.append((k, [rng.randrange(5) for _ in range(n)], [[rng.choice([0.0, 1.0, 2.5, -3.0]) for _ in range(5)] for _ in range(n)], [[[rng.random() for _ in range(i + rng.randrange(2))] for i in range(n)] for _ in range(heads)], [0.5]))
    df = spark.createDataFrame([*rows, (99, None, None, None, None)], RAW)
    got = {r.id: r for r in greedy.cut(df, 4, 3).collect()}
    assert got[99].greedy_tokens is None and got[99].lls is None and got[99].attention is None
    for k, tokens, logits, attention, _ in rows:
        r = got[k]
        own, text, lp, ll, best, seen = plain_greedy(tokens, logits, attention, 4, 3)
        assert r.greedy_tokens == own and r.text_tokens == text and r.lls == pytest.approx(ll) and r.embedding == [0.5]
        assert [[a.token for a in p] for p in r.alternatives] == best and [a.lp for p in r.alternatives for a in p] == pytest.approx([lp[i, t] for i, p in enumerate(best) for t in p])
        assert [len(s) for s in r.attention] == [len(s) for s in seen] and sum(r.attention, []) == pytest.approx(sum(seen, []))


@pytest.mark.parametrize(("row", "why"), [
    ((1, [1, 2], [[0.0, 1.0, 2.0]], [], []), "another number"),
    ((1, [1, 2], [[0.0, 1.0, 2.0], [0.0]], [], []), "different sizes"),
    ((1, [1, 3], [[0.0, 1.0, 2.0]] * 2, [], []), "outside the vocabulary"),
    ((1, [1, -1], [[0.0, 1.0, 2.0]] * 2, [], []), "outside the vocabulary"),
    ((1, [1, 2], [[0.0, 1.0, 2.0]] * 2, [[[0.1]]], []), "head with another"),
    ((1, [1, 2], [[0.0, 1.0, 2.0]] * 2, [[[0.1], []]], []), "sees too few"),
])
def test_greedy_shapes_are_checked(spark, row, why):
    with pytest.raises(Exception, match=why):
        greedy.cut(spark.createDataFrame([row], RAW), 0, 2).collect()


def test_gather(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [2, 0], [3])], "v array<double>, p array<int>, q array<int>")
    assert df.select(greedy.gather(F.col("v"), F.col("p")).alias("g")).first().g == [3.0, 1.0]
    with pytest.raises(Exception, match="no such token"):
        df.select(greedy.gather(F.col("v"), F.col("q")).alias("g")).collect()


def test_soft_scores(spark, tmp_path):
    vectors = {"a": [1, 0], "b": [0, 2], "c": [1, 1], "z": [0, 0]}
    provider = calls.Replay(providers.PerText("tokens array<string>, vectors array<array<double>>", lambda t: (t.split(), [[float(x) for x in vectors[w]] for w in t.split()])), str(tmp_path))
    rows = [(1, "a b", "a c"), (2, "a", "a"), (3, "", "a"), (4, None, None), (5, "z a", "b"), (6, "c c a", "b a")]
    df = spark.createDataFrame(rows, "k int, h string, r string")
    answers = calls.Answers(spark, provider)

    def plain(h, r, idf=None):
        h, r = (h or "").split(), (r or "").split()
        if not h or not r:
            return (0, 0, 0)
        cos = lambda x, y: float(np.dot(vectors[x], vectors[y]) / ((np.linalg.norm(vectors[x]) or 1) * (np.linalg.norm(vectors[y]) or 1)))
        weigh = lambda own, other: (lambda w: sum(w(x) * max(cos(x, y) for y in other) for x in own) / sum(map(w, own)) if sum(map(w, own)) else 0)((lambda x: 1.0) if idf is None else (lambda x: idf.get(x, 0.0)))
        p, q = weigh(h, r), weigh(r, h)
        return (p, q, 2 * p * q / (p + q) if p + q else 0)

    got = {x.k: tuple(x)[1:] for x in soft_match.soft_scores(df, "k", "h", "r", answers).collect()}
    assert all(got[k] == pytest.approx(plain(h, r)) for k, h, r in rows) and len(got) == 6
    idf = soft_match.rarity(df, "r", answers)
    table = {x.token: x.idf for x in idf.collect()}
    refs = {r for _, _, r in rows if r is not None}
    assert table == pytest.approx({w: math.log((len(refs) + 1) / (sum(w in r.split() for r in refs) + 1)) for w in ("a", "b", "c")})
    got = {x.k: tuple(x)[1:] for x in soft_match.soft_scores(df, "k", "h", "r", answers, idf).collect()}
    assert all(got[k] == pytest.approx(plain(h, r, table)) for k, h, r in rows)
    asked = [t for f in tmp_path.iterdir() for t in __import__("json").loads(f.read_text())]
    assert max(Counter(asked).values()) == 1
    assert soft_match.soft_scores(df.where("false"), "k", "h", "r", answers).count() == 0


def test_focus_over_edges_equals_the_dense_recurrence(spark):
    rng, rows, want = random.Random(3), [], {}
    for k in range(40):
        n = rng.randrange(0, 12)
        base, keyword = [rng.random() for _ in range(n)], [rng.random() < 0.6 for _ in range(n)]
        dense = [[rng.random() if rng.random() < 0.5 and j < i else 0.0 for j in range(n)] for i in range(n)]
        scores = []
        for i in range(n):
            w = [dense[i][j] if keyword[j] else 0.0 for j in range(i)]
            scores.append(base[i] + (0.7 * float(np.dot(w, scores)) / sum(w) if sum(w) else 0.0))
        kept = [s for s, use in zip(scores, keyword) if use]
        want[k] = float(np.mean(kept)) if kept else None
        edges = [(i, j, a) for i in range(n) for j, a in enumerate(dense[i]) if a]
        rng.shuffle(edges)
        rows.append((k, base, keyword, edges))
    df = spark.createDataFrame([*rows, (99, None, None, None)], "id long, b array<double>, k array<boolean>, e array<struct<i:int,j:int,a:double>>")
    got = {r.id: r.value for r in focus.focus(df, "id", "b", "k", "e", 0.7).collect()}
    assert got.pop(99) is None and {k: v is None for k, v in got.items()} == {k: v is None for k, v in want.items()}
    assert all(got[k] == pytest.approx(v) for k, v in want.items() if v is not None)
