"""Each operator against a brute-force version, and on odd and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gaugeworks.llm import chat_format, decontamination, host_rules, language_id, mixing, quality_classifier, secret_scan, simhash, substring_dedup, toxicity
from gaugeworks.llm.common import table

from .conftest import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# 1 mixing

def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        left = [s for s in order if s not in full]
        if not left:
            return full
        level = (total - sum(full.values())) / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * level > 3 * sizes[s]]
        if not over:
            return full | {s: weight[s] * level for s in left}
        full |= {s: 3 * sizes[s] for s in over}


def test_mixing_targets_and_copies(spark):
    rng = random.Random(3)
    sources = [rng.choice(["a", "b", "c", "d", None]) for _ in range(900)] + ["tiny"] * 2
    texts = [" ".join(["w"] * rng.randrange(1, 60)) for _ in sources]
    docs = documents(spark, texts, sources=sources)
    rows = mixing.mix(docs).collect()
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    sizes = defaultdict(int)
    for s, t in zip(sources, texts):
        sizes[s] += len(t.split())
    want, taken = brute_targets(dict(sizes)), defaultdict(int)
    assert len(rows) == len(texts)
    for r in rows:
        s = sources[r.doc_id]
        assert r.size == len(texts[r.doc_id].split()) and r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        assert abs(r.copies - want[s] / sizes[s]) < 1
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60
    assert sum(again.values()) == pytest.approx(sum(taken.values()), rel=0.02)
    assert {r.doc_id: r.taken for r in mixing.mix(docs).collect()} == {r.doc_id: r.taken for r in rows}


def test_mixing_odd(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(empty).count() == 0


def test_mixing_does_not_depend_on_where_rows_lie(spark):
    rng = random.Random(15)
    ids = [rng.choice([None, 7, *range(1000, 1300)]) for _ in range(1500)] + [7] * 1200
    texts = [" ".join(["w"] * rng.randrange(1, 40)) for _ in ids[:1500]] + ["w w w"] * 1200
    docs = documents(spark, texts, sources=[rng.choice(["a", "b", "c"]) for _ in ids], ids=ids)
    want, *others = (Counter(map(tuple, mixing.mix(d).collect())) for d in (docs, docs.repartition(7), docs.orderBy(F.desc("n_chars"))))
    assert sum(want.values()) == 2700 and all(x == want for x in others)


def test_mixing_keeps_ids_of_any_type(spark):
    rng = random.Random(18)
    rows = [(f"doc-{k % 190}" if k % 50 else None, " ".join(["w"] * rng.randrange(0, 40)), rng.choice([1, 2, None])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source int")
    a, b = (Counter(map(tuple, mixing.mix(d).collect())) for d in (docs, docs.repartition(9)))
    assert a == b and Counter(x[0] for x in a.elements()) == Counter(r[0] for r in rows)


# 2, 3 byte networks

def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality_classifier.classify(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").where("held_out").select("quality", "predicted", "score").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.predicted for r in good) / len(good) > 0.97 and sum(1 - r.predicted for r in bad) / len(bad) > 0.8
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_odd(spark, odd, empty):
    some = labels_of(spark, [(1, 1, 0), (4, 0, 1), (3, None, None), (None, 1, 1), (4, 0, 1), (6, 1, 0), (8, 0, 0)])
    rows = quality_classifier.classify(odd, some).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality_classifier.classify(odd, some.where("false")).collect()} == {0.5}
    assert quality_classifier.classify(empty, some).count() == 0
    kept = quality_classifier.keep_quality(odd, some)
    assert kept.columns == odd.columns


def test_language_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98


def test_language_odd(odd, empty):
    rows = language_id.identify(odd).collect()
    assert len(rows) == odd.count()
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2)} == {"und"}
    assert language_id.identify(empty).count() == 0


# 4 repeated substrings

def brute_repeats(texts, length):
    where = defaultdict(list)
    raws = [(t or "").encode() for t in texts]
    for k, raw in enumerate(raws):
        for p in range(len(raw) - length + 1):
            where[raw[p : p + length]].append((k, p))
    marks = [bytearray(len(r)) for r in raws]
    for spots in where.values():
        if len(spots) > 1:
            for k, p in spots:
                marks[k][p : p + length] = b"\1" * length
    out = []
    for raw, m in zip(raws, marks):
        kept = bytes(b for b, x in zip(raw, m) if not x)
        out.append((len(raw), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_against_brute_force(spark):
    rng = random.Random(7)
    say = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [say(n) for n in (380, 399, 400, 401, 700, 1500)]
    texts = [None, "", "z" * 1200, "ab" * 500, say(399)]
    for k in range(40):
        texts.append("".join(rng.choice([say(rng.randrange(5, 300)), rng.choice(shared), rng.choice(shared)[rng.randrange(200) :]]) for _ in range(4)))
    near = say(2500)
    texts += [near, near, near[:900] + "!" + near[900:], near[:1300] + "?" + near[1301:]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(documents(spark, texts)).collect()}
    want = brute_repeats(texts, substring_dedup.LENGTH)
    assert [got[k] for k in range(len(texts))] == want
    assert sum(w[1] for w in want) > 0


def test_planted_passages_go_by_bytes_not_words(spark):
    """Passages of 51 to 90 words in two documents each: those of 400 bytes are removed, shorter ones stay, other documents keep all."""
    rng = random.Random(51)
    say = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passages = [say(n) for n in range(51, 91)]
    texts = [f"{say(rng.randrange(1, 120))} {p} {say(rng.randrange(1, 120))}" for p in passages for _ in range(2)] + [say(rng.randrange(200)) for _ in range(40)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(documents(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == brute_repeats(texts, substring_dedup.LENGTH)
    sizes = [len(p.encode()) for p in passages for _ in range(2)] + [0] * 40
    assert all(got[k][1] >= n if n >= 400 else got[k][1] == 0 for k, n in enumerate(sizes) if not 390 <= n < 400)
    assert min(sizes[:80]) < 390 and max(sizes) >= 400


def test_repeats_odd(odd, empty):
    rows = substring_dedup.remove_repeats(odd).collect()
    assert len(rows) == odd.count()
    assert {r.n_removed == r.n_bytes for r in rows if r.doc_id in (4, 5)} == {True}
    assert substring_dedup.remove_repeats(empty).count() == 0


# 5 toxicity

@pytest.mark.parametrize("light", [0.0, 0.02, 0.3, 2.0])
def test_block_max_search_is_exact(monkeypatch, light):
    """Whatever counts as light, the neighbours are those of all cosines; ties go to the lower example."""
    monkeypatch.setattr(toxicity, "LIGHT", light)
    rng = random.Random(5)
    vectors = []
    for k in range(700):
        raw = {t: rng.choice([0.01, 0.02, 1.0, rng.random()]) for t in {*rng.sample(range(30), rng.randrange(1, 6)), *([0] if k % 3 else []), 30 + k % 200}}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        vectors.append({t: x / norm for t, x in raw.items()})
    split = lambda v: (np.array(sorted(v)), np.array([v[t] for t in sorted(v)]))
    index = toxicity.BlockMaxIndex([split(v) for v in vectors], 240)
    for q in [*vectors[::17], {235: 1.0}, {3: 0.6, 239: 0.8}]:
        scores = sorted(((-round(sum(w * v.get(t, 0) for t, w in q.items()), 9), k) for k, v in enumerate(vectors) if set(v) & set(q)))[:15]
        found, cosine = index.search(*split(q), 15)
        assert [(-round(c, 9), k) for c, k in zip(cosine.tolist(), found.tolist())] == scores
    assert len(toxicity.BlockMaxIndex([], 3).search(np.array([1]), np.array([1.0]), 15)[0]) == 0


def test_toxicity_scores_whole_texts_as_brute_force_does(spark):
    """Terms, weights, neighbours and calibrated votes against plain dictionaries over all words; one id twice, one label null."""
    rng = random.Random(21)
    words = [f"w{k}" for k in range(120)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) + (" vile" if k % 4 == 0 else "") for k in range(260)]
    rows = [(k, 1, int(k % 4 == 0)) for k in range(240)] + [(250, 1, None)]
    docs, labels = documents(spark, texts), labels_of(spark, rows)
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    learned = toxicity.learn(docs, labels.where(toxicity.bucket_of("doc_id", 3) != 1), "doc_id", "text", "toxic")
    vocabulary, examples, _, (slope, offset), power = learned
    ids = examples.ids
    fold = lambda t: re.findall(r"[0-9a-z]+", t)
    df, y = Counter(w for t in texts for w in set(fold(t))), {k: int(k % 4 == 0) for k in ids}
    assert set(ids) == {r.doc_id for r in labels.where(toxicity.bucket_of("doc_id", 3) != 1).where("toxic is not null").collect()}
    assert vocabulary == sorted({w.encode() for k in ids for w in fold(texts[k])})
    copies = Counter((y[k], min((__import__("zlib").crc32(" ".join(fold(texts[k])[i : i + 5]).encode()) for i in range(max(1, len(fold(texts[k])) - 4))), default=0)) for k in ids)
    share = {k: 1 / copies[y[k], min((__import__("zlib").crc32(" ".join(fold(texts[k])[i : i + 5]).encode()) for i in range(max(1, len(fold(texts[k])) - 4))), default=0)] for k in ids}
    base = (sum(share[k] * y[k] for k in ids) + 0.5) / (sum(share.values()) + 1)
    scale = {}
    for w in (v.decode() for v in vocabulary):
        n, a = sum(share[k] for k in ids if w in fold(texts[k])), sum(share[k] * y[k] for k in ids if w in fold(texts[k]))
        p = (a + base) / (n + 1)
        scale[w] = (math.log((1 + len(texts)) / (1 + df[w])) + 1) * (math.log(p / (1 - p)) - math.log(base / (1 - base))) ** power

    def vector(t):
        v = {w: (1 + math.log(n)) * scale[w] for w, n in Counter(fold(t)).items() if w in scale}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()} if norm else {}

    vectors = {k: vector(texts[k]) for k in ids}
    for k in range(0, 260, 7):
        q = vector(texts[k])
        cosines = sorted((-round(sum(x * vectors[e].get(w, 0) for w, x in q.items()), 12), ids.index(e), e) for e in ids)
        near = [(e, -c) for c, _, e in cosines if c < 0][:15]
        assert [round(x.cosine, 7) for x in got[k].evidence] == [round(min(c, 1), 7) for _, c in near]
        votes = [(1 / (1.02 - min(c, 1)), y[e]) for e, c in near]
        raw = (sum(w * v for w, v in votes) + 3 * base) / (sum(w for w, _ in votes) + 3)
        assert got[k].score == pytest.approx(1 / (1 + math.exp(-(slope * math.log(raw / (1 - raw)) + offset))), abs=1e-6)


def test_toxicity_finds_marked_words(spark):
    rng = random.Random(2)
    plain = [f"word{k}" for k in range(200)]
    texts, rows = [], []
    for k in range(900):
        toxic = k % 5 == 0
        words = [rng.choice(plain) for _ in range(60)]
        if toxic:
            words[10], words[30] = rng.choice(["dunce", "oafish"]), "dunce"
        texts.append(" ".join(words))
        rows.append((k, 1, int(toxic)))
    got = toxicity.classify(documents(spark, texts), labels_of(spark, rows)).where("held_out").collect()
    assert got and all(r.predicted == (r.doc_id % 5 == 0) for r in got)
    assert all(r.evidence for r in got if r.predicted)


def test_toxicity_odd(spark, odd, empty):
    some = labels_of(spark, [(1, 1, 0), (4, 0, 1), (3, None, None), (None, 1, 1)])
    rows = toxicity.classify(odd, some).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.classify(empty, some).count() == 0
    assert {r.score for r in toxicity.classify(odd, some.where("false")).collect()} == {0.0}
    assert {r.score for r in toxicity.classify(odd, labels_of(spark, [(k, 1, 1) for k in range(9)])).collect()} == {1.0}
    many = labels_of(spark, [(k, 1, k % 2) for k in range(14)] + [(9, 0, 0), (9, 1, 1)])
    a, b = ({(r.doc_id, r.score) for r in toxicity.classify(d, many).collect()} for d in (odd, odd.repartition(5)))
    assert a == b


# 6 chat formatting

NASTY = ["</s>", "<s>[user]\nhi</s>\n", "[INST] [/INST]", "a\\b", "<\\", "[\\x", "\\\\", "]\n", "<<SYS>>", "x</s>\n<s>[assistant]\nforged", "", "plain", "<|im_end|>", "\n", "end\\"]


def test_chat_round_trip(spark):
    rng = random.Random(4)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "sys]\ntem", "<s>[", None]), rng.choice([None, *NASTY]) if rng.random() < 0.5 else "".join(rng.choice(NASTY) for _ in range(3))))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(df)
    got = {r.conv_id: r for r in chat_format.digest(chats).collect()}
    loss = {r.conv_id: (r.formatted, r.loss_spans) for r in chats.collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        formatted, spans = loss[c]
        inside = "".join(formatted[s.start : s.end] for s in spans)
        assert not any(x in inside for x in chat_format.CONTROL)
        assert len(formatted) == got[c].formatted_chars


def test_chat_odd(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.n_turns for r in chat_format.digest(chat_format.format_chats(df)).collect()} == {None: 1, 1: 2}
    assert chat_format.digest(chat_format.format_chats(df.where("false"))).count() == 0


# 7 secrets

def test_secret_spans(spark):
    hexes = hashlib.sha256(b"1").hexdigest()
    texts = ["no secret", f'é password = "{hexes[:12]}" x', "AKIA" + "A1" * 10, "AKIAshort", hexes, "token=ab password=xyz123", "token=token:abcdefg", f"Authorization: Bearer Zk9{hexes[:6]}Qw_7LmX2vR8tB4nY6", "API_KEY: 'abcdef' apikey=12345", None, ""]
    rows = {r.doc_id: r for r in secret_scan.scan(documents(spark, texts)).collect()}
    spans = {k: [s.split(":")[0] for s in r.spans.split(",") if s] for k, r in rows.items()}
    assert spans == {0: [], 1: ["assign"], 2: ["access"], 3: [], 4: ["hex"], 5: ["assign"], 6: [], 7: ["novel"], 8: ["assign"], 9: [], 10: []}
    kind, start, end = rows[1].spans.split(":")
    assert texts[1][int(start) : int(end)] == f'password = "{hexes[:12]}'
    assert rows[0].base_sha256 == hashlib.sha256(b"").hexdigest() == rows[7].base_sha256


def brute_base(text):
    """Base spans by walking through the text, one character after the other; None for a kind's failing match."""
    low, found = text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text), []
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    k = 0
    while k < len(text):
        end = None
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(word, k):
                ends = [k + len(word)] + ([k + len(word) + 1] if text[k + len(word) : k + len(word) + 1] in ("'", '"') and k + len(word) < len(text) else [])
                for j in reversed(ends):
                    while text[j : j + 1] == " ":
                        j += 1
                    if text[j : j + 1] and text[j] in ":=":
                        j += 1
                        while text[j : j + 1] == " ":
                            j += 1
                        if text[j : j + 1] and text[j] in "'\"":
                            j += 1
                        lo = j
                        while j < len(text) and text[j] in value:
                            j += 1
                        if j > lo:
                            end = (lo, j)
                            break
            if end:
                break
        if end:
            if end[1] - end[0] >= 6:
                found.append((k, 0, end[1]))
            k = end[1]
        else:
            k += 1
    k = 0
    while k < len(text):
        if text.startswith("AKIA", k):
            j = k + 4
            while j < len(text) and (text[j] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
                j += 1
            if j > k + 4:
                if j - k >= 20:
                    found.append((k, 1, j))
                k = j
                continue
        k += 1
    k = 0
    while k < len(text):
        j = k
        while j < len(text) and text[j] in "0123456789abcdef":
            j += 1
        if j - k >= 24:
            found.append((k, 2, j))
        k = j + 1
    return sorted(found)


def test_base_spans_against_a_walk(spark):
    rng = random.Random(22)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "ſecret", "toKen", '"', "'", " ", "  ", ":", "=", "\n", "\t", "abc123", "x.y=z-", "0123456789abcdef", "deadbeef", "AKIA", "ABCDEFGH12345678", "é", "K", "0" * 24, "="]
    texts = [None, ""] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    rows = {r.doc_id: r for r in secret_scan.scan(documents(spark, texts)).collect()}
    for k, text in enumerate(texts):
        want = brute_base(text or "")
        assert [rows[k].n_assign, rows[k].n_access, rows[k].n_hex] == [sum(x[1] == i for x in want) for i in range(3)], text
        joined = ",".join(f"{('assign', 'access', 'hex')[i]}:{s}:{e}" for s, i, e in want)
        assert rows[k].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text
        spans = rows[k].spans.split(",") if rows[k].spans else []
        assert [x for x in spans if not x.startswith("novel")] == (joined.split(",") if joined else [])


def test_novelty_finds_planted_secrets_and_leaves_clean_texts(spark):
    """Secrets that no base pattern catches, in prose and code, against identifiers, paths, addresses and words in the same places."""
    import base64

    rng = random.Random(23)
    code = lambda n: base64.urlsafe_b64encode(rng.randbytes(n)).decode().rstrip("=")
    prose = lambda n: " ".join(rng.choice("the engine keeps every record of a session in memory until its owner asks to drop them".split()) for _ in range(n))
    planted = [lambda: f"Authorization: Bearer {code(30)}", lambda: f"cookie: sid {code(18)};", lambda: f"auth header is {code(12)}.{code(40)}.{code(32)}", lambda: f"private_key = '{code(48)}'", lambda: f"credentials {rng.randbytes(9).hex().upper()}", lambda: f"access id {code(15)}", lambda: f"key: {code(21)}"]
    clean = [lambda: "session management_interface_configuration", lambda: "key production_database_endpoint_2024", lambda: "access /usr/local/share/applications/index.html", lambda: "auth example.com/documentation/reference", lambda: "cookie monster likes internationalization", lambda: "key = ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", lambda: "private AbstractSingletonProxyFactoryBean", lambda: "signature 1234567890123456"]
    texts = [f"{prose(rng.randrange(5, 60))} {rng.choice(planted)()} {prose(rng.randrange(5, 60))}" for _ in range(300)] + [f"{prose(rng.randrange(5, 60))} {rng.choice(clean)()} {prose(rng.randrange(5, 60))}" for _ in range(300)]
    rows = {r.doc_id: r for r in secret_scan.scan(documents(spark, texts)).collect()}
    caught, false = sum(rows[k].n_novel > 0 for k in range(300)), sum(rows[k].n_novel > 0 for k in range(300, 600))
    print("novel secrets caught", caught, "of 300, false", false, "of 300")
    assert caught >= 285 and false <= 6


def test_redaction_keeps_rows_and_clean_texts(spark, odd, empty):
    docs = documents(spark, ["all clean, no key here", f"my token = {hashlib.sha256(b'2').hexdigest()} end"])
    rows = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert rows[0].text == "all clean, no key here" and rows[1].text == "my [secret] end" and rows[1].n_chars == 15
    assert secret_scan.redact(odd).count() == odd.count() and secret_scan.redact(odd).columns == odd.columns
    assert secret_scan.redact(empty).count() == 0 and secret_scan.scan(empty).count() == 0
    assert secret_scan.scan(odd).count() == odd.count()


# 8 host rules

def brute_rules(text):
    words = WORD.findall(text or "")
    spots = defaultdict(list)
    for k in range(len(words) - 4):
        spots[tuple(words[k : k + 5])].append(k)
    covered = {k + j for ks in spots.values() if len(ks) > 1 for k in ks for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_host_rules_measures(spark, odd):
    rng = random.Random(8)
    texts = ["\n".join(" ".join(rng.choice("a b c dé #x".split()) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    for docs in (documents(spark, texts), odd):
        want = Counter((r.doc_id, *brute_rules(r.text)) for r in docs.select("doc_id", "text").collect())
        got = host_rules.judge(docs).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
        assert not any(r.kept and r.base_failed for r in got)


def test_bad_host_loses_its_documents(spark, empty):
    good = " ".join(f"w{k}" for k in range(40))
    texts = [good] * 30 + ["too short"] * 29 + [good]
    rows = host_rules.judge(documents(spark, texts, sources=["fine"] * 30 + ["bad"] * 30)).collect()
    assert all(r.kept for r in rows if r.doc_id < 30) and not any(r.kept for r in rows if r.doc_id >= 30)
    assert host_rules.judge(empty).count() == 0


# 9 simhash

def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return root


def test_simhash_against_brute_force(spark, odd, empty):
    rng = random.Random(6)
    base = [rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(300)]
    texts = [None, "", "One", "one two", " ".join(base)]
    for k in range(60):
        words = list(base)
        for _ in range(k % 3):
            words[rng.randrange(300)] = "zz"
        texts.append(" ".join(words))
    rows = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    prints = [brute_print(t) for t in texts]
    assert [rows[k].fingerprint for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [rows[k].component_id for k in range(len(texts))] == brute_components(prints)
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("size", "bound"), [(5, 2048), (200, 2048), (200, 64)])
def test_links_of_small_and_large_buckets(spark, monkeypatch, size, bound):
    """All pairs at once, ties of a larger bucket, and hubs beyond the bound: the components are those of all pairs."""
    monkeypatch.setattr(simhash, "BUCKET", bound)
    rng = random.Random(size)
    prints = {0}
    while len(prints) < size:
        x = rng.choice(list(prints))
        for _ in range(rng.choice([1, 2, 3])):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(40)}
    prints = sorted(prints)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(signed)], "id long, __fp long")
    got = {r.id: r.component for r in simhash.group(rows, "id").collect()}
    assert [got[k] for k in range(len(prints))] == brute_components(prints)


def test_keep_one(odd, empty):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[4] == 1 and ids[5] == 0 and ids[9] == 1
    assert simhash.keep_one(empty).count() == 0


# 10 decontamination

def brute_overlap(text, items):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = fold(text), set(), set()
    for key, item in items:
        w = fold(item)
        n = min(13, len(w))
        grams = {tuple(w[k : k + n]) for k in range(max(1, len(w) - 12))} if w else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k : k + n]) in grams:
                hit.update(range(k, k + n))
                found.add(str(key) if key is not None else "")
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def test_overlap_against_brute_force(spark, odd, empty, monkeypatch):
    rng = random.Random(9)
    vocabulary = ["Aa", "b", "c-d", "É", "é", "f9", "g"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30)))) for k in range(12)] + [(50, None), (51, ""), (None, "f9 f9 f9 b"), (3, "g g")]
    texts = [" ".join([rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))] + (rng.choice(items)[1] or "").split() + [rng.choice(vocabulary)]) for _ in range(80)] + [None, ""]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [brute_overlap(t, items) for t in texts]
    for bound in (decontamination.BLOCK_WINDOWS, 5):  # in one block and in several
        monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", bound)
        rows = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.report(documents(spark, texts), bench).collect()}
        assert [rows[k] for k in range(len(texts))] == want
    assert decontamination.keep_clean(odd, bench).columns == odd.columns
    assert decontamination.report(odd, bench.where("false")).where("n_hit > 0").count() == 0
    assert decontamination.report(empty, bench).count() == 0


def test_same_result_whatever_the_partitions(spark, odd):
    few, many = (Counter(map(tuple, host_rules.judge(d).select("doc_id", "kept", "n_repeat_words").collect())) for d in (odd.coalesce(1), odd.repartition(9)))
    assert few == many
    assert F is not None


def test_keep_one_finds_near_copies_and_keeps_clean_texts(spark, monkeypatch):
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [[rng.choice(vocabulary) for _ in range(300)] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for k in range(0, 40, 2):
        for _ in range(4):
            words = list(base[k])
            words[rng.randrange(300)] = "edited"
            texts.append(" ".join(words))
    for crowd in (simhash.CROWD, 2):  # buckets whole, and in blocks
        monkeypatch.setattr(simhash, "CROWD", crowd)
        kept = {r.doc_id for r in simhash.keep_one(documents(spark, texts)).collect()}
        assert set(range(40)) <= kept and len(kept) <= 42


def test_fingerprints_of_hashes_and_texts_agree():
    for text in ("", "one", "a b c d", "a b c d e f g h", " ".join(f"w{k % 70}" for k in range(400))):
        want = simhash.fingerprint(text.encode(), 5)
        assert simhash.print_of(simhash.shingle_hashes(text.encode(), 5)) % 2**64 == want


def test_hot_keys_are_looked_up_the_same(spark, monkeypatch):
    """With the bound for hot keys at its least, broadcast look-ups give what the shuffles give."""
    from gaugeworks.llm import common

    rows = spark.createDataFrame([(k % 7 if k % 3 else None, k) for k in range(300)], "key long, v long")
    keys = rows.where("key in (1, 2, 5)").groupBy("key").agg(F.count("*").alias("n"))
    want = {r.v for r in rows.where("key in (1, 2, 5)").collect()}
    rng = random.Random(20)
    say = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    passage = say(900)
    texts = [say(rng.randrange(300)) + passage + say(rng.randrange(300)) for _ in range(25)] + ["same text here"] * 12
    for least in (200, 1):
        monkeypatch.setattr(common, "LEAST_HOT", least)
        monkeypatch.setattr(simhash, "LEAST_HOT", least)
        assert {r.v for r in common.semi_join(rows, keys, ["key"]).collect()} == want
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(documents(spark, texts)).collect()}
        assert [got[k] for k in range(len(texts))] == brute_repeats(texts, 400)
        found = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, texts)).collect()}
        assert [found[k] for k in range(len(texts))] == brute_components([brute_print(t) for t in texts])


def brute_groups(texts):
    """Components of all pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if root[a] != root[b] and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return root


def test_keep_one_finds_every_isolated_pair(spark):
    """Groups of two at a similarity of 0.75 to 0.95, and odd texts, against brute force."""
    rng = random.Random(14)
    texts = [None, "", " \n", "one", "One", "a b c d e", "a b c d f", "a b c d"]
    for _ in range(60):
        for edits in (3, 6, 8, 10, 12, 13, 14, 16):  # each takes five shingles out and puts five in: at 12 about 0.65 to 0.8
            base = [f"w{rng.randrange(100_000)}" for _ in range(rng.choice([300, 450, 560, 620]))]
            other = list(base)
            for k in rng.sample(range(len(base)), edits):
                other[k] = "edited"
            texts += [" ".join(base), " ".join(other)]
    want = brute_groups(texts[:8]) + [8 + k - (k % 2 and brute_groups(texts[8 + k - 1 : 8 + k + 1]) == [0, 0]) for k in range(len(texts) - 8)]
    kept = {r.doc_id for r in simhash.keep_one(documents(spark, texts)).collect()}
    assert kept == set(want)
    assert 100 < sum(k != w for k, w in enumerate(want)) < 470
