"""Operators 1 to 3 and the pipeline against versions that share no code with them."""

import math
import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from gaugeworks.llm import byte_cnn, mixing

from .conftest import documents


# 1 the rounding

def chain(*values):
    """Spark's xxhash64 of longs (and of ints, given as a pair with their width)."""
    h = 42
    for v in values:
        v, width = v if isinstance(v, tuple) else (v, 8)
        h = xxhash.xxh64_intdigest(int(v).to_bytes(width, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def plain_meeting(a, b, level):
    """Words move from one to the other until one of the two holds whole copies; [key, copies, fraction, size]."""
    sa, sb = a[3], b[3]
    gain, loss = min((1 - a[2]) * sa, b[2] * sb), min(a[2] * sa, (1 - b[2]) * sb)
    draw = (chain(a[0], b[0], sa, sb, (level, 4)) % (1 << 52) + 0.5) / (1 << 52)
    move = gain if draw * (gain + loss) < loss else -loss
    for x, part in ((a, move / sa), (b, -move / sb)):
        x[2] += part
        if x[2] < 1e-9 or x[2] > 1 - 1e-9:
            x[1], x[2] = x[1] + round(x[2]), 0.0


def plain_mix(rows, targets):
    """rows: (id, source, size), all distinct. Copies of each id."""
    sizes, per = defaultdict(int), defaultdict(list)
    for _, s, n in rows:
        sizes[s] += n
    out = {}
    for i, s, n in rows:
        rate = min(targets[s] / sizes[s], 3.0) if sizes[s] else 0.0
        whole = math.floor(rate + 1e-12)
        item = [chain(i, n, 0), whole if n else 0, rate - whole if n and rate - whole > 1e-9 else 0.0, n]
        out[i] = item
        per[s].append(item)
    for items in per.values():
        n_blocks = max(1, -(-len(items) // 64))
        blocks = defaultdict(list)
        for x in items:
            if x[2] > 0:
                blocks[chain(x[0]) % n_blocks].append(x)
        level = 0
        while True:
            left = {}
            for k, xs in blocks.items():
                held = None
                for x in sorted(xs, key=lambda x: (-x[3], x[0])):
                    if held is None:
                        held = x
                        continue
                    plain_meeting(held, x, level)
                    held = held if held[2] > 0 else x if x[2] > 0 else None
                if held is not None:
                    left[k] = held
            if len(left) <= 1:
                for x in left.values():
                    x[1] += x[2] >= 0.5
                break
            blocks = defaultdict(list)
            for k, x in left.items():
                blocks[k // 64].append(x)
            level += 1
    return {i: x[1] for i, x in out.items()}


def test_rounding_equals_a_walk_through_the_meetings(spark):
    rng = random.Random(31)
    sources = [rng.choice(["a", "a", "a", "b", "c"]) for _ in range(6000)]
    texts = [" ".join(["w"] * rng.choice([0, 1, 3, 7, 30, 30])) for _ in sources]
    rows = mixing.mix(documents(spark, texts, sources=sources)).collect()
    targets = {sources[r.doc_id]: r.target for r in rows}
    want = plain_mix([(k, s, len(t.split())) for k, (s, t) in enumerate(zip(sources, texts))], targets)
    # all sources settle at the last level together: a source of one block is carried through the later ones unchanged
    wrong = [r.doc_id for r in rows if r.copies != want[r.doc_id]]
    assert not wrong and len({r.copies for r in rows}) > 2


# 2, 3 the network

@pytest.mark.parametrize("widths", [(2, 4), (2, 3, 4), (1, 5)])
def test_fused_scoring_equals_a_plain_convolution(widths):
    rng = np.random.default_rng(3)
    net = byte_cnn.ByteCnn(3, widths, filters=4, seed=9)
    for b in net.b:
        b += rng.normal(size=b.shape).astype(np.float32)

    def window(x):
        pooled = []
        for w, b, k in zip(net.w, net.b, widths):
            best = np.full(4, -np.inf)
            for p in range(byte_cnn.WINDOW - k + 1):
                best = np.maximum(best, sum(w[j, x[p + j]].astype(float) for j in range(k)))
            pooled.append(best + b)
        z = np.maximum(np.concatenate(pooled), 0) @ net.v + net.c
        return z - np.log(np.exp(z).sum())

    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 3, 511, 512, 513, 960, 1400)]
    want = []
    for t in texts:
        parts = []
        at = 0
        while True:
            start = max(0, min(at, len(t) - byte_cnn.WINDOW))
            parts.append(window(t[start : start + byte_cnn.WINDOW].ljust(byte_cnn.WINDOW, b"\0")))
            if start + byte_cnn.WINDOW >= len(t):
                break
            at += byte_cnn.STRIDE
        mean = np.mean(parts, axis=0)
        want.append(mean - np.log(np.exp(mean).sum()))
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts])
    got = net.text_log_probs(data, np.cumsum(lengths) - lengths, lengths)
    assert np.abs(got - np.array(want)).max() < 1e-5


# the pipeline

def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def jaccard_components(rows):
    """Least (id) of each component of documents whose sets of five-word shingles have a similarity of 0.8 or more."""
    sets = {}
    for i, t in rows:
        w = fold(t).encode().split()
        sets[i] = frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or (x and y and min(len(x), len(y)) * 5 >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y)):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {find(i) for i in sets}


def clean_of(rows, items):
    """Ids of documents of which under one word in twenty lies in a window of a benchmark item."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    windows = defaultdict(set)
    for t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[n].add(tuple(w[k : k + n]))
    kept = set()
    for i, t in rows:
        w, hit = words(t), set()
        for n, grams in windows.items():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(w)):
            kept.add(i)
    return kept


def test_pipeline_stage_by_stage(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    from gaugeworks.llm import queries

    judged = {r.doc_id: r.predicted for r in queries.op2_quality_classifier(spark, sf).collect()}
    good = stages[0](spark, docs, sf).persist()
    assert {i for i, _ in rows(good)} == {i for i, p in judged.items() if p} and good.columns == docs.columns
    single = stages[1](spark, good, sf).persist()
    assert {i for i, _ in rows(single)} == jaccard_components(rows(good)) and single.count() < good.count()
    clean = stages[2](spark, single, sf).persist()
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {i for i, _ in rows(clean)} == clean_of(rows(single), items)
    masked, before = dict(rows(stages[3](spark, clean, sf))), dict(rows(clean))
    assert set(masked) == set(before)
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = 0
    for i, t in before.items():
        secrets = [m[1] for m in assign.finditer(t or "") if len(m[1]) >= 6] + [m[0] for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20] + [m[0] for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 24]
        found += len(secrets)
        assert masked[i] == t or secrets
        assert not any(s in masked[i] for s in secrets)
    assert found
    mixed = stages[4](spark, clean, sf).collect()
    assert {r.doc_id for r in mixed} == set(before) and all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", before[r.doc_id] or "")) for r in mixed)


# cases owed

def test_chats_of_long_texts_and_extra_columns(spark):
    import hashlib

    from gaugeworks.llm import chat_format

    long = "x</s>[INST]\\ <|a|> " * 12_000
    rows = [(1, 0, "user", long, "f", 7), (1, 1, "assistant", long, "f", 7), (2, 0, None, "", "f", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, n_escaped int")
    got = {r.conv_id: r for r in chat_format.digest(chat_format.format_chats(df)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(f"user\n{long}\nassistant\n{long}\n".encode()).hexdigest()
    assert got[1].loss_chars == len(long) and got[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest() and got[1].n_escaped == 2
    assert got[2].n_turns == 1 and got[2].loss_chars == 0


def test_repeated_labelled_ids_of_different_texts(spark):
    """Which text of an id is learned from does not depend on where the rows lie, and each row is scored by its own text."""
    from gaugeworks.llm import quality_classifier, toxicity

    rng = random.Random(12)
    texts = [" ".join(rng.choice(["fine", "vile", "tin", "oak", f"w{k % 7}"]) for _ in range(30)) for k in range(240)]
    docs = documents(spark, texts, ids=[k // 2 for k in range(240)])
    labels = spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(120)] + [(5, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for run in (quality_classifier.classify, toxicity.classify):
        a, b = (sorted((r.doc_id, round(r.score, 9)) for r in run(d, labels).collect()) for d in (docs, docs.repartition(7)))
        assert a == b and len(a) == 240


def test_equal_texts_without_ids(spark):
    from gaugeworks.llm import simhash

    text = "one text that occurs again and again without an id of its own"
    docs = documents(spark, [text, text, "another text altogether, told at some length here", text, "another text altogether, told at some length here"], ids=[None, None, None, 4, None])
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(4, text), (None, "another text altogether, told at some length here")], key=str)


def test_set_numbers_that_collide(spark):
    """Sets whose 64-bit numbers agree get others: the number of a digest is stubbed to a few values."""
    from pyspark.sql import functions as F

    from gaugeworks.llm import simhash
    from gaugeworks.llm.common import Scope

    sets = spark.createDataFrame([(bytes([k]) * 16,) for k in range(9)], "digest binary")
    real, scope = F.xxhash64, Scope()
    try:
        F.xxhash64 = lambda *c: real(*c) % 3 if len(c) == 1 else real(*c)
        ids = [r.id for r in simhash._set_ids(sets, scope).collect()]
    finally:
        F.xxhash64 = real
    assert len(set(ids)) == 9
