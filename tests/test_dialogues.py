"""Runs that call models: each against a plain loop, with a count of the calls, and stopped in the middle."""

import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import text as X
from gaugeworks.operators import claims, fact_checks, heads, lookup, online, prefix_scores
from gaugeworks.sources import calls, providers


def asked(folder):
    """Every prompt of every call."""
    return [t for f in folder.iterdir() for t in json.loads(f.read_text())]


def replay(provider, tmp_path, name="calls", fails=lambda t: False):
    folder = tmp_path / name
    folder.mkdir(exist_ok=True)
    return calls.Replay(provider, str(folder), fails), folder


def texts(spark, values, column="p"):
    return spark.createDataFrame(list(enumerate(values)), f"id long, {column} string")


# routing, retries, answers

def test_routing_has_no_cap_on_names(spark):
    rows = [(k, f"prm-{k}", f"t{k}") for k in range(1500)] + [(1500, None, "t"), (1501, "other", "t"), (1502, "prm-large-1", None)]
    df = spark.createDataFrame(rows, "id long, model string, p string").repartition(5)
    got = {r.id: r for r in providers.routed(df, {"prm": providers.HashScore(), "prm-large": providers.HashScore()}, "model", "p").collect()}
    assert len(got) == 1503 and sum(r.score is not None for r in got.values()) == 1501
    assert got[5].route == "prm" and got[1502].route == "prm-large" and got[5].reason is None
    assert got[1500].score is None and got[1500].reason == "no model name" and got[1501].reason == "no provider for other"
    assert got[5].score == providers.HashScore().answer(["t5"])["score"][0]


def test_retries_go_prompt_by_prompt():
    class Flaky:
        name, schema = "x", "reply string"

        def __init__(self):
            self.calls, self.left = [], {"b": 2}

        def answer(self, t):
            self.calls.append(list(t))
            if any(self.left.get(x, 0) for x in t):
                for x in t:
                    self.left[x] = max(0, self.left.get(x, 0) - 1)
                raise TimeoutError
            return providers.EchoChat().answer(t)

    flaky, waits = Flaky(), []
    got = providers.Retrying(flaky, (1, 2, 4), waits.append).answer(["a", "b", "c"])
    assert list(got["reply"]) == ["a", "b", "c"] and flaky.calls == [["a", "b", "c"], ["a"], ["b"], ["b"], ["c"]] and waits == [1, 2]

    class Broken(Flaky):
        def answer(self, t):
            self.calls.append(t)
            raise KeyError("a bug")

    broken = Broken()
    with pytest.raises(KeyError):
        providers.Retrying(broken, (1, 2), waits.append).answer(["a"])
    assert len(broken.calls) == 1


def test_answers_are_asked_for_once(spark, tmp_path):
    provider, folder = replay(providers.HashScore(), tmp_path, fails=lambda t: t == "bad")
    path = f"file://{tmp_path}/answers"
    df = texts(spark, ["a", "b", "a", None, "bad", "c"]).repartition(3)
    one = calls.Answers(spark, provider, path, in_flight=2, failures=(ConnectionError,))
    for _ in range(2):
        got = one.ask(df, "p")
        rows = {r.id: r for r in got.collect()}
        assert got.count() == 6 and rows[0].score == rows[2].score != rows[1].score
        assert rows[3].score is None and rows[3].provider is None and rows[3].error is None
        assert rows[4].score is None and "down" in rows[4].error
    assert sorted(asked(folder)) == ["a", "b", "c"]
    mended, _ = replay(providers.HashScore(), tmp_path)
    again = calls.Answers(spark, mended, path, failures=(ConnectionError,))
    assert {r.id: r.score is None for r in again.ask(df, "p").collect()} == {0: False, 1: False, 2: False, 3: True, 4: False, 5: False}
    assert sorted(asked(folder)) == ["a", "b", "bad", "c"]
    with pytest.raises(Exception, match="down"):
        calls.Answers(spark, provider, f"file://{tmp_path}/others").ask(df, "p")
    assert one.ask(df.where("false"), "p").count() == 0


def test_lookup_of_hot_and_null_keys(spark, monkeypatch):
    rows = [(k, "hot" if k % 2 else None if k % 3 else f"k{k}") for k in range(900)]
    left, right = spark.createDataFrame(rows, "id long, k string"), spark.createDataFrame([("hot", 1), ("k0", 2), ("k6", 3)], "k string, v int")
    want = sorted(left.join(right, "k", "left").select("id", "k", "v").collect(), key=lambda r: r.id)
    monkeypatch.setattr(lookup, "LEAST_HOT", 50)
    got = lookup.lookup(left, right, "k")
    assert got.columns == ["k", "id", "v"] and sorted(got.select("id", "k", "v").collect(), key=lambda r: r.id) == want


# chunks

def test_a_run_that_dies_keeps_its_chunks(spark, tmp_path):
    flag = tmp_path / "fault"
    flag.write_text("")
    at = str(flag)

    def fails(t):
        import os

        return t == "t17" and os.path.exists(at)

    provider, folder = replay(providers.HashScore(), tmp_path, fails=fails)
    df = texts(spark, [f"t{k}" for k in range(40)])
    work = lambda rows: providers.apply(rows, provider, "p").select("id", "score")
    path = f"file://{tmp_path}/run"
    with pytest.raises(Exception, match="down"):
        calls.in_chunks(df, "id", work, path, 5)
    before = Counter(asked(folder))
    flag.unlink()
    got = calls.in_chunks(df, "id", work, path, 5)
    assert got.count() == 40 and got.select("id").distinct().count() == 40
    counts = Counter(asked(folder))
    # only the chunk that died may be asked for again: what else had been asked before is not
    chunk = {r.p for r in spark.read.parquet(f"{path}/input/000000").where(F.col("chunk") == spark.read.parquet(f"{path}/input/000000").where("p = 't17'").first().chunk).collect()}
    assert before and max(counts.values()) <= 2 and {t for t, n in counts.items() if n == 2} <= chunk and len(chunk) < 20
    # new keys are a generation of their own; old ones are not asked for
    more = texts(spark, [f"t{k}" for k in range(47)])
    assert calls.in_chunks(more, "id", work, path, 5, at_once=3).count() == 47
    assert Counter(asked(folder)) - counts == Counter(f"t{k}" for k in range(40, 47))
    assert calls.in_chunks(more, "id", work, path, 5).count() == 47 and len(asked(folder)) == sum(counts.values()) + 7


def test_chunks_end_early_and_start_empty(spark, tmp_path):
    df = texts(spark, [f"t{k}" for k in range(30)] + [None]).union(spark.createDataFrame([(None, "x"), (None, "y")], "id long, p string"))
    work = lambda rows: rows.select("id", F.length("p").alias("n"))
    path = f"file://{tmp_path}/run"
    assert calls.in_chunks(df.where("false"), "id", work, path, 4).collect() == []
    some = calls.in_chunks(df, "id", work, path, 4, most=2)
    assert 0 < some.count() < 33
    assert sorted(map(str, calls.in_chunks(df, "id", work, path, 4).collect())) == sorted(map(str, work(df).collect()))


# online best-of-N

def plain_loop(question, loop):
    trajectory, steps, scores = question, [], []
    pick = lambda cands: min(((float(np.mean(u)) if len(u) else 0.5, k) for k, u in enumerate(loop.scores.answer([trajectory + providers.PAIR + c for c in cands])["uncertainties"])), default=None)
    for _ in range(loop.most_steps):
        cands = loop.steps.answer([trajectory])["samples"][0]
        if not cands:
            break
        score, k = pick(cands)
        trajectory, steps, scores = trajectory + cands[k], [*steps, cands[k]], [*scores, score]
        if "<Answer>:" in cands[k]:
            cands = loop.answers.answer([trajectory])["samples"][0]
            k = pick(cands)[1]
            trajectory, steps = trajectory + cands[k], [*steps, cands[k]]
            break
    return trajectory, steps, pytest.approx(scores), bool(steps)


def sometimes_none(text):
    found = providers.step_samples(3).function(text)[0]
    return ([] if providers.digest(text)[5] == "0" else found,)


@pytest.mark.parametrize("most", [3, 20])
def test_online_loop(spark, tmp_path, most):
    rows = [f"question {k % 37}" for k in range(60)] + ["", None]
    df = texts(spark, rows, "q")
    steps, step_calls = replay(providers.PerText("samples array<string>", sometimes_none), tmp_path, "steps")
    scores, score_calls = replay(providers.claim_scores(), tmp_path, "scores")
    loop = online.Loop(steps, providers.answer_samples(3), scores, most_steps=most)
    path = f"file://{tmp_path}/loop"
    # stopped after every round, and begun anew each time
    counts = [online.best_of_n(df, "id", "q", loop, path, most_rounds=1).count() for _ in range(3)]
    got = {r.id: tuple(r)[2:] for r in online.best_of_n(df, "id", "q", loop, path).collect()}
    assert counts == sorted(counts) and counts[0] < 62 == len(got)
    plain = online.Loop(steps.provider, loop.answers, scores.provider, most_steps=most)
    assert got == {k: plain_loop(q or "", plain) for k, q in enumerate(rows)}
    assert max(Counter(asked(step_calls)).values()) == 1 and max(Counter(asked(score_calls)).values()) == 1
    n = len(asked(step_calls))
    assert online.best_of_n(df, "id", "q", loop, path).count() == 62 and len(asked(step_calls)) == n
    with pytest.raises(ValueError, match="other questions"):
        online.best_of_n(df.where("id < 9"), "id", "q", loop, path)


def test_online_loop_leaves_texts_where_they_lie(spark, tmp_path):
    rows = [random.Random(k).randbytes(20_000).hex() for k in range(40)]
    texts(spark, rows, "q").repartition(4).write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    began, loop = shuffled(), online.Loop(providers.step_samples(3), providers.answer_samples(3), providers.claim_scores())
    got = {r.id: tuple(r)[2:] for r in online.best_of_n(df, "id", "q", loop, f"file://{tmp_path}/loop").collect()}
    assert shuffled() - began < sum(map(len, rows)) / 2
    assert got == {k: plain_loop(q, loop) for k, q in enumerate(rows)}


@pytest.mark.parametrize("few", [0, 10_000])
def test_trajectories_that_meet(spark, tmp_path, monkeypatch, few):
    """Questions that are what another one's trajectory becomes, at the same round or a later one; runs that stop after every round."""
    monkeypatch.setattr(online, "FEW", few)
    loop = online.Loop(providers.step_samples(3), providers.answer_samples(3), providers.claim_scores())
    rows = ["a", "b", "a", "a"]
    for q in ("a", "b", "c"):
        trajectory, steps = plain_loop(q, loop)[:2]
        rows += [q + "".join(steps[:k]) for k in range(len(steps) + 1)]
    step_calls, score_calls = (replay(p, tmp_path, n) for p, n in ((loop.steps, "steps"), (loop.scores, "scores")))
    kept = online.Loop(step_calls[0], loop.answers, score_calls[0])
    df, path = texts(spark, rows, "q"), f"file://{tmp_path}/loop"
    for _ in range(2):
        online.best_of_n(df, "id", "q", kept, path, most_rounds=1)
    got = {r.id: tuple(r)[2:] for r in online.best_of_n(df, "id", "q", kept, path).collect()}
    assert got == {k: plain_loop(q, loop) for k, q in enumerate(rows)}
    assert max(Counter(asked(step_calls[1])).values()) == 1 and max(Counter(asked(score_calls[1])).values()) == 1


def test_online_loop_asks_for_nothing_again_after_a_stop_within_a_round(spark, tmp_path):
    broken = providers.PerText("uncertainties array<double>", lambda t: 1 / 0)
    step, calls_of = replay(providers.step_samples(3), tmp_path, "steps")
    df, path, whole = texts(spark, ["x", "y", "x"], "q"), f"file://{tmp_path}/loop", providers.claim_scores()
    with pytest.raises(Exception, match="ZeroDivisionError"):
        online.best_of_n(df, "id", "q", online.Loop(step, providers.answer_samples(3), broken), path)
    assert sorted(asked(calls_of)) == ["x", "y"]
    loop = online.Loop(step, providers.answer_samples(3), whole)
    got = {r.id: tuple(r)[2:] for r in online.best_of_n(df, "id", "q", loop, path).collect()}
    assert got == {k: plain_loop(q, online.Loop(step.provider, loop.answers, whole)) for k, q in enumerate("xyx")}
    assert max(Counter(asked(calls_of)).values()) == 1


def test_online_loop_takes_the_greatest(spark, tmp_path):
    score = providers.PerText("uncertainties array<double>", lambda t: ([float(t[-1])],))
    step = providers.PerText("samples array<string>", lambda t: (["a1", "a3", "b3"],))
    loop = online.Loop(step, step, score, most_steps=2, lowest=False)
    got = online.best_of_n(texts(spark, ["q"], "q"), "id", "q", loop, f"file://{tmp_path}/x").first()
    assert got.steps == ["a3", "a3"] and got.step_scores == [3.0, 3.0] and got.completed
    assert online.best_of_n(texts(spark, ["q"], "q").where("false"), "id", "q", loop, f"file://{tmp_path}/y").count() == 0


# prefix tree

def tree_edges(rows):
    """Edges of the radix trees of all groups, by counting children."""
    n, by = 0, defaultdict(set)
    for g, _, w in rows:
        by[g].add(tuple(w or ()))
    for found in by.values():
        nodes, ends = defaultdict(set), Counter()
        for w in found:
            for k in range(len(w)):
                nodes[w[:k]].add(w[k])
            ends[w] += 1
        n += sum(len(kids) for p, kids in nodes.items() if p == () or len(kids) > 1 or ends[p])
    return n


def test_shared_prefixes_are_scored_once(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for k in range(160):
        stem = rng.choice(rows)[2][: rng.randrange(0, 9)] if rows and rng.random() < 0.7 else []
        rows.append((rng.choice([1, 1, 2, None]), k, [*stem, *rng.choices(["ab", "c", "def", "é"], k=rng.randrange(0, 6))]))
    rows.append((2, 900, None))
    df = spark.createDataFrame(rows, "g int, k int, w array<string>").repartition(4)
    provider, folder = replay(providers.prefix_likelihoods(), tmp_path)
    prompt = F.when(F.col("g") == 1, F.lit("tell me more")).otherwise(F.col("g").cast("string"))
    got = prefix_scores.forced_scores(df, "g", "k", prompt, "w", calls.Answers(spark, provider)).collect()
    plain = providers.prefix_likelihoods()
    want = {(g, k): plain.answer([{1: "tell me more", 2: "2", None: ""}[g] + providers.PAIR + " ".join(w or [])])["lls"][0] for g, k, w in rows}
    assert len(got) == len(rows) and all(r.lls == pytest.approx(want[r.g, r.k], abs=1e-12) for r in got)
    assert len(asked(folder)) == tree_edges(rows) < sum(map(bool, want.values())) * 2
    assert sum(len(t.split(providers.PAIR)[1].split()) for t in asked(folder)) < 0.8 * sum(len(w or []) for _, _, w in rows)
    assert prefix_scores.forced_scores(df.where("false"), "g", "k", prompt, "w", calls.Answers(spark, provider)).count() == 0


# fact checks

def test_checks_stop_at_the_first_wrong_step(spark, tmp_path):
    rng = random.Random(9)
    docs = []
    for k in range(150):
        docs.append((k, rng.choice(["p", None, "q"]), "a", [(f"s{rng.randrange(50)}" if rng.random() < 0.9 else None, f"c{rng.randrange(9)}", rng.random() < 0.8) for _ in range(rng.randrange(0, 12))]))
    docs += [(900, "p", None, None), (901, "p", "a", [("s", "c", True)] * 300)]
    df = spark.createDataFrame(docs, "id long, problem string, answer string, claims array<struct<sentence:string,claim:string,aligned:boolean>>").repartition(3)
    reply = lambda t: ({"0": "0", "1": "0", "f": "10", "e": "?"}.get(providers.digest(t)[0], "1"),)
    provider, folder = replay(providers.PerText("reply string", reply), tmp_path)
    got = {(r.id, r.claim_idx): r.label for r in fact_checks.until_wrong(df, "id", "problem", "answer", "claims", provider, side_by_side=7).collect()}
    want, prompts = {}, Counter()
    for k, p, a, cs in docs:
        for i in range(len(cs or [])):
            prompt = fact_checks.STEP_PROMPT.format(problem=p or "", answer=a or "", steps=" ".join(c[0] or "" for c in cs[: i + 1]), step=cs[i][1])
            prompts[prompt] += 1
            r = reply(prompt)[0]
            label = {"0": 1.0, "1": 0.0}.get(r)
            want[k, i] = label if cs[i][2] else None
            if label == 1.0:
                break
    assert got == want and Counter(asked(folder)) == prompts and 1.0 in got.values() and None in got.values()
    assert max(len(json.loads(f.read_text())) for f in folder.iterdir()) <= 7
    assert fact_checks.until_wrong(df.where("false"), "id", "problem", "answer", "claims", provider).count() == 0


def test_two_calls(spark, tmp_path):
    first, one = replay(providers.PerText("reply string", lambda t: (f"{t.splitlines()[0]}!\nmore",)), tmp_path, "one", fails=lambda t: "down" in t)
    second, two = replay(providers.PerText("reply string", lambda t: ("True" if "fine" in t else "It is False" if "odd" in t else "?",)), tmp_path, "two")
    df = spark.createDataFrame([(1, "fine", "s"), (2, "odd", None), (3, "down", "s"), (4, None, None), (5, "fine", "s")], "id int, claim string, source string")
    got = {r.id: (r.first_reply, r.label) for r in fact_checks.checked_facts(df, "claim", "source", calls.Answers(spark, first, failures=(ConnectionError,)), calls.Answers(spark, second)).collect()}
    assert {k: v[1] for k, v in got.items()} == {1: 0.0, 2: 1.0, 3: None, 4: None, 5: 0.0} and got[3][0] is None
    assert len(asked(one)) == 3 and len(asked(two)) == 3 and all("A judge found: Is this claim true?" in t for t in asked(two))
    sure = providers.PerText("reply string", lambda t: ({"a": "Probability: 0.25", "b": "PROBABILITY:1.", "c": "who knows"}[t[0]],))
    rows = {r.p: r.ue for r in fact_checks.verbalized(texts(spark, ["a", "b", "c", None]), "p", calls.Answers(spark, providers.EchoChat()), calls.Answers(spark, sure)).collect()}
    assert rows == {"a": 0.75, "b": 0.0, "c": None, None: None}


# claims

def plain_claims(text, tokens, claims_of, words_of):
    """Sentence by sentence: tokens from the first that begins in the sentence, laid along it, those under a matched word."""
    out, at = [], 0
    pieces = re.split("[.?!。？！\n]", text)
    ends = np.cumsum([0, *map(len, tokens)])
    number = 0
    for k, piece in enumerate(pieces):
        start, at = at, at + len(piece) + 1
        if not piece or k == len(pieces) - 1:
            continue
        first = int(np.searchsorted(ends, start))
        own = [(i, ends[i] - start, ends[i + 1] - start) for i in range(first, len(tokens)) if ends[i + 1] - start <= len(piece)]
        reply = claims_of(claims.EXTRACT + piece)
        found = [c[2:].strip() for c in reply.split("\n") if c.startswith("- ") and "there aren't any claims" not in c.lower()] if reply else []
        if not found:
            out.append((number, None, None, "no claims" if reply else "no reply"))
        for j, claim in enumerate(found):
            words, marked, pos, ok = [w.strip() for w in words_of(claims.MATCH[0] + piece + claims.MATCH[1] + claim).split(",")], set(), 0, True
            for w in words:
                spots = [m for m in range(pos, len(piece)) if w and piece.startswith(w, m) and (m == 0 or not piece[m - 1].isalpha()) and (m + len(w) >= len(piece) or not piece[m + len(w)].isalpha())]
                if not spots:
                    ok = False
                    break
                marked |= set(range(spots[0], spots[0] + len(w)))
                pos = spots[0] + len(w)
            ids = [i for i, a, b in own if marked & set(range(a, b))]
            out.append((number, j, ids if ok and ids else None, None if ok and ids else "not found" if not ok else "no tokens"))
        number += 1
    return out


def test_claims_of_whole_texts(spark, tmp_path):
    from gaugeworks.plans.q_dialogues import _claims_of, _words_of

    rng = random.Random(2)
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("text").distinct().collect()
    rows = [r.text for r in rows][:150] + ["One claim, two, one claim. Odd end", "", None, "...", "A b c。D e, f g！", "He said no. He said no. He said no."] * 2
    data = []
    for k, t in enumerate(rows):
        tokens, at = [], 0
        while at < len(t or ""):
            n = rng.randrange(1, 6)
            tokens.append(t[at : at + n])
            at += n
        data.append((k, t, tokens))
    odd = lambda p: ", ".join(p.rsplit(claims.MATCH[1], 1)[1].split()[::-1]) if len(p) % 5 == 0 else _words_of(p)[0]
    some = lambda p: "" if len(p) % 7 == 0 else _claims_of(p)[0]
    first, one = replay(providers.PerText("reply string", lambda p: (some(p),)), tmp_path, "one")
    second, two = replay(providers.PerText("reply string", lambda p: (odd(p),)), tmp_path, "two")
    df = spark.createDataFrame(data, "id long, text string, tokens array<string>").repartition(3)
    got = claims.extract(df, "id", "text", "tokens", calls.Answers(spark, first), calls.Answers(spark, second)).collect()
    want = [(k, s, j, ids, "no claims" if f == "no reply" else f) for k, t, tokens in data for s, j, ids, f in plain_claims(t or "", tokens, some, odd)]
    order = lambda x: (x[0], x[1], -1 if x[2] is None else x[2])
    assert sorted(((r.id, r.sentence_idx, r.claim_idx, r.token_ids, r.failure) for r in got), key=order) == sorted(want, key=order)
    assert {r.failure for r in got} >= {None, "no claims", "not found"}
    assert max(Counter(asked(one)).values()) == 1 == max(Counter(asked(two)).values())


def test_claims_without_a_reply(spark, tmp_path):
    first, _ = replay(providers.PerText("reply string", lambda p: ("- x y",)), tmp_path, fails=lambda t: "gone" in t)
    second, _ = replay(providers.PerText("reply string", lambda p: ("x, y",)), tmp_path, "two", fails=lambda t: "lost" in t)
    df = spark.createDataFrame([(1, "x y gone.x y lost.x y.", [c for c in "x y gone.x y lost.x y."])], "id long, text string, tokens array<string>")
    down = (ConnectionError,)
    got = claims.extract(df, "id", "text", "tokens", calls.Answers(spark, first, failures=down), calls.Answers(spark, second, failures=down)).collect()
    assert {(r.sentence_idx, r.claim, r.failure) for r in got} == {(0, None, "no reply"), (1, "x y", "no reply"), (2, "x y", None)}
    assert [r.token_ids for r in got if r.failure is None] == [[18, 20]]


# heads

def plain_fit(setting, train, valid, epochs, width):
    """Full-batch Adam on one machine, written for one hidden layer."""
    (x, y), (vx, vy) = train, valid
    a, b, c, d = (v.copy() for v in heads.begin(width, setting).layers)
    state, losses = [[np.zeros_like(v), np.zeros_like(v)] for v in (a, b, c, d)], []
    bce = lambda z, t: np.mean(setting.positive_weight * t * np.log1p(np.exp(-z)) + (1 - t) * np.log1p(np.exp(z)))
    for epoch in range(epochs + 1):
        losses.append(bce((np.maximum(vx @ a + b, 0) @ c + d)[:, 0], vy))
        if epoch == epochs:
            return [a, b, c, d], losses
        h = np.maximum(x @ a + b, 0)
        p = 1 / (1 + np.exp(-(h @ c + d)[:, 0]))
        r = (((1 - y) * p - setting.positive_weight * y * (1 - p)) / len(y))[:, None]
        back = (r @ c.T) * (h > 0)
        new = []
        for v, g, s in zip((a, b, c, d), (x.T @ back, back.sum(0), h.T @ r, r.sum(0)), state, strict=True):
            s[0], s[1] = 0.9 * s[0] + 0.1 * g, 0.999 * s[1] + 0.001 * g * g
            new.append(v - setting.rate * (s[0] / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(s[1] / (1 - 0.999 ** (epoch + 1))) + 1e-8))
        a, b, c, d = new


@pytest.mark.parametrize("fan", [256, 2])
def test_head_equals_one_machine(spark, monkeypatch, fan):
    monkeypatch.setattr(heads, "FAN", fan)
    monkeypatch.setattr(heads, "SLICE", 7)
    monkeypatch.setattr(heads, "BLOCK_BYTES", 8 * 3 * 40)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 3))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=700) > 0).astype(float)
    df = spark.createDataFrame([(k, v.tolist(), float(t)) for k, (v, t) in enumerate(zip(x, y))], "id long, v array<double>, y double").repartition(5)
    settings = [heads.Setting(0.02, 1.0, (6,)), heads.Setting(0.005, 3.0, (4,))]
    blocks, width = heads.packed(df.where("id < 500"), df.where("id >= 500"), "v", "y")
    runs = [heads.begin(width, s) for s in settings]
    heads.advance(blocks, runs, 4, 99)
    heads.advance(blocks, runs, 8, 99)
    for run, s in zip(runs, settings):
        layers, losses = plain_fit(s, (x[:500], y[:500]), (x[500:], y[500:]), 12, 3)
        assert run.losses == pytest.approx(losses, abs=1e-6) and run.steps == 12
        assert all(np.abs(a - b).max() < 1e-6 for a, b in zip(run.layers, layers, strict=True))


def test_head_refuses_mixed_widths(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0], 0)], "id long, v array<double>, y int")
    with pytest.raises(ValueError, match="widths"):
        heads.packed(df, df, "v", "y")
