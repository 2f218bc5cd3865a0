"""Operators 11 to 13 against row-by-row versions."""

import random
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from itertools import permutations
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import filter_audit, funnels, sharding

from .conftest import documents


# 11 sharding

def walk(rows, shards, law, slack):
    """Each row on its own walks clockwise, hop after hop, until a shard has room. rows: (place, cell, id, size, crc)."""
    places, owners = (x.tolist() for x in sharding.ring(shards))
    room = sharding.room(sum(1 if law == "rows" else r[3] for r in rows), shards, law, slack).tolist()
    queue = defaultdict(list)
    for r in rows:
        queue[bisect_left(places, r[0]) % len(places)].append(r)
    routes = {a: list(dict.fromkeys(owners[a:] + owners[:a])) for a in queue}
    out = {}
    for hop in range(shards):
        for a in sorted(queue):
            s, left = routes[a][hop], []
            for r in sorted(queue[a], key=lambda r: (r[1], r[0])):
                if room[s] > 0:
                    room[s] -= 1
                    out[r[2]] = s
                else:
                    left.append(r)
            queue[a] = left
    return out


def random_docs(spark, n, seed=5, ids=None):
    rng = random.Random(seed)
    return documents(spark, ["w" * rng.randrange(0, 900) for _ in range(n)], ids=ids)


def check_shards(rows, shards=sharding.SHARDS):
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return Counter(r.shard for r in rows)


def test_sharding_equals_a_walk_of_each_row(spark):
    docs = random_docs(spark, 3011)
    rows = sharding.shard(docs).collect()
    counts = check_shards(rows)
    assert max(counts.values()) - min(counts.values()) == 1 and len(counts) == 40
    place = F.xxhash64(F.col("doc_id").cast("string"), F.col("size"), F.col("text_crc32"), F.lit(0).cast("long"))
    keyed = spark.createDataFrame(rows, "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int").select(place.alias("p"), F.pmod(F.xxhash64(place), F.lit(sharding.CELLS)), "doc_id", "size", "text_crc32")
    want = walk([tuple(r) for r in keyed.collect()], 40, "rows", 0.0)
    assert {r.doc_id: r.shard for r in rows} == want
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(texts[r.doc_id]) + 16 and r.text_crc32 == crc32(texts[r.doc_id].encode()) and r.law == "rows" for r in rows)


def test_sharding_bounds_moves_and_layouts(spark):
    docs = random_docs(spark, 4000)
    fixed = lambda df: Counter((r.doc_id, r.shard, r.slot) for r in df.collect())
    assert fixed(sharding.shard(docs)) == fixed(sharding.shard(docs.repartition(11)))
    a, b = ({r.doc_id: r.shard for r in sharding.shard(docs, n, slack=0.25).collect()} for n in (10, 11))
    moved = [d for d in a if a[d] != b[d]]
    assert len(moved) < 0.25 * len(a) and max(Counter(b.values()).values()) <= -(-4000 * 1.25 // 11)
    sizes = defaultdict(int)
    rows = sharding.shard(docs, 8, law="bytes").collect()
    check_shards(rows, 8)
    for r in rows:
        sizes[r.shard] += r.size
    total = sum(sizes.values())
    assert all(abs(s - total / 8) < 0.02 * total for s in sizes.values())
    for law, n, slack in (("key", 2, 0), ("rows", 0, 0), ("rows", 2, -1)):
        with pytest.raises(ValueError):
            sharding.shard(docs, n, law, slack)


def test_sharding_odd_and_repeated(spark, odd, empty, monkeypatch):
    rows = sharding.shard(odd).collect()
    assert len(rows) == odd.count() and max(check_shards(rows).values()) == 1
    assert sharding.shard(empty).count() == 0
    monkeypatch.setattr(sharding, "CHUNK", 7)
    same = documents(spark, ["copy"] * 500 + [None] * 300 + [f"t{k}" for k in range(203)], ids=[3] * 500 + [None] * 300 + list(range(203)))
    rows = sharding.shard(same, 10).collect()
    counts = check_shards(rows, 10)
    assert sorted(counts.values()) == [100] * 7 + [101] * 3
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d, len(t or "") + 16) for d, t in same.select("doc_id", "text").collect())


# 12 funnels

def brute_funnels(rows):
    by = defaultdict(lambda: defaultdict(set))
    for client, kind, ts in rows:
        if client is not None and kind is not None and ts is not None:
            by[client][kind].add((ts - datetime(1970, 1, 1)) // timedelta(microseconds=1))
    out = {}
    for name, steps, stop in funnels.FUNNELS:
        for client, kinds in by.items():
            sorted_kinds = {k: sorted(v) for k, v in kinds.items()}
            n, times = [0] * 4, [[], [], []]
            for now in sorted_kinds.get(steps[0], []):
                n[0] += 1
                for k, step in enumerate(steps[1:]):
                    later, ends = sorted_kinds.get(step, []), sorted_kinds.get(stop, [])
                    i, j = bisect_right(later, now), bisect_right(ends, now)
                    if i == len(later) or later[i] - now > funnels.LIMIT or (j < len(ends) and ends[j] <= later[i]):
                        break
                    n[k + 1] += 1
                    times[k].append(later[i] - now)
                    now = later[i]
            if n[0]:
                out[name, client] = (*n, sum(x > 0 for x in n), *(sorted(t)[-(-len(t) // 2) - 1] if t else None for t in times))
    depth = Counter((k[0], v[4]) for k, v in out.items())
    return {k: (*v, depth[k[0], v[4]]) for k, v in out.items()}


def random_clicks(n, seed, broken=True):
    rng = random.Random(seed)
    at, rows = datetime(2024, 3, 9, 20), []
    for _ in range(n):
        at += timedelta(microseconds=rng.choice([0, 1, 250_000_000, 900_000_000, rng.randrange(10**9)]) // rng.choice([1, 4, 30]))
        client = rng.choice([7, 7, 7, 1, 2, 3, 4, 5, None])
        rows.append((client, rng.choice(["view", "click", "view", "click", "purchase", "signup", "error", "other", None]), at if rng.random() > 0.01 else None))
    rows += rng.choices(rows, k=n // 10)
    if broken:
        rows += [(1, "view", datetime(1, 1, 1, 5)), (1, "click", datetime(1, 1, 1, 5, 15)), (2, "view", datetime(9999, 12, 31, 23, 59, 59, 999999)), (9, "click", datetime(1969, 12, 31, 23, 59, 59, 1)), (9, "click", datetime(1970, 1, 1))]
    return rows


SCHEMA = "client_id long, kind string, ts timestamp_ntz"


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize("hot", [False, True])
def test_funnels_equal_brute_force(spark, monkeypatch, hot, zone):
    rows = random_clicks(4000, 8 + hot)
    if hot:
        for name, value in (("LEAST_HOT", 40), ("HOT", 6), ("ROWS", 16)):
            monkeypatch.setattr(funnels, name, value)
    monkeypatch.setattr(funnels, "ROWS", funnels.ROWS if hot else 300)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        clicks = spark.createDataFrame(rows, SCHEMA).withColumns({"at": F.lit("x"), "own": F.lit(1), "width": F.lit(2), "stretch": F.lit(3), "n": F.lit(4)})
        got = funnels.count_funnels(clicks).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {(r.funnel, r.client_id): tuple(r)[2:] for r in got} == brute_funnels(rows)
    assert len({(r.funnel, r.client_id) for r in got}) == len(got)
    assert sum(r.n4 for r in got) > 0


def test_funnels_odd(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert funnels.count_funnels(empty).count() == 0
    assert funnels.count_funnels(spark.createDataFrame([(None, None, None), (1, "error", datetime(2024, 1, 1))], SCHEMA)).count() == 0
    names = spark.createDataFrame([("ann", "click", datetime(2024, 1, 1)), ("ann", "click", datetime(2024, 1, 1, 0, 15))], "client_id string, kind string, ts timestamp_ntz")
    assert [tuple(r) for r in funnels.count_funnels(names).collect()] == [("C", "ann", 2, 1, 0, 0, 2, 900_000_000, None, None, 1)]


# 13 filter audit

def brute_audit(docs, labels):
    least = {}
    for d, _, t in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    rows = []
    for d, s, t in docs:
        t = t or ""
        words = [w for w in t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > least[t]}
        rows.append((s or "", {f for f in fails if fails[f]}, d in good, d in toxic))
    out, total = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            own = [r for r in rows if r[0] == part]
            failing = {f: sum(f in r[1] for r in own) for f in order}
            for k, f in enumerate(order):
                gone, own = [r for r in own if f in r[1]], [r for r in own if f not in r[1]]
                total[part, f] += len(gone)
                out[part, "".join(order), k + 1] = [len(own), len(gone), failing[f] - len(gone), sum(r[0] == part and r[1] == {f} for r in rows), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def check_audit(spark, docs, labels):
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, n int, good int")).collect()
    want = brute_audit([(r.doc_id, r.source, r.text) for r in docs.collect()], labels)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want and len(got) == len(want)


def test_audit_equals_brute_force(spark):
    rng = random.Random(11)
    words = ["red", "blue", "Tin", "OAK", "é", "a#b", "p|q"] + [f"w{k}" for k in range(80)]
    texts = [rng.choice([" ", "\n", "\t "]).join(rng.choices(words[: rng.choice([8, 87])], k=rng.choice([5, 49, 50, 70]))) for _ in range(150)]
    texts += rng.choices(texts, k=60) + [None, "", " ", "A" * 5 + "b" * 95, "A" * 6 + "b" * 94]
    ids = rng.sample(range(1000), len(texts) - 3) + [None, 4, 4]
    sources = [rng.choice(["a", "b", "", None]) for _ in texts]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1]), 0, 0) for d in ids[::2]] + [(ids[0], 1, 1, 0, 0), (None, 1, 1, 0, 0)]
    check_audit(spark, documents(spark, texts, sources=sources, ids=ids), labels)


def test_audit_odd(spark, odd, empty):
    check_audit(spark, odd, [(1, 1, 0, 0, 0), (4, 0, 1, 0, 0), (None, 1, 1, 0, 0)])
    check_audit(spark, odd, [])
    assert filter_audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
