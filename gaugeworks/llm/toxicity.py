"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index, with distance-weighted votes.

1. Examples are a bounded sample of labelled texts: SAMPLE_TEXTS pairs of id and label, the first by hash; of rows of one id the text with the
   least hash counts.
2. Every word of an example is a term. Its document frequency is counted over all documents. A component of a vector is
   (1 + ln count) * idf * association^p, where the association is how far the term's share of toxic examples, shrunk to the base rate, lies
   from that rate, in log-odds; near copies (one min-hash of word windows) share one vote in it. The power p, 0 for plain TF-IDF, is the one of POWERS
   under which examples are best told by models that did not see them: no held-out label has a part in it. No
   term is dropped; words of no example meet no posting.
3. Each document's nearest examples are found exactly: blocks of postings whose upper bound cannot reach the k-th best are skipped.
4. Votes are weighted by distance, shrunk to the base rate, and calibrated by a logistic curve fitted on scores of the examples under models
   that did not see them. The neighbours are the evidence.

A document without any term of an example has no neighbour and is judged by the base rate alone; null and empty texts are such documents.
Equal cosines go to the lower example. Repeated rows are scored each. An empty table gives an empty result; if all examples have one label,
or there is none, every score is the toxic share of the examples, 0 without any.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import bucket_of
from .decontamination import _texts, words_of

THRESHOLD = 0.7
FOLDS, HELD = 3, 1
SAMPLE_TEXTS = 6000
#: Words of a window of the min-hash by which near copies among the examples are told.
COPY_WORDS = 5
NEIGHBOURS = 15
#: Examples of a block of postings, and blocks that are looked into first.
BLOCK, FIRST = 64, 4
#: What frequent terms may add to a cosine together without being looked up.
LIGHT = 0.02
#: The base rate's weight among the votes.
SHRINK = 3.0
#: Models of the calibration, each of which sees the examples of the other parts; the first one also chooses the power.
PARTS = 3
POWERS = (0, 1, 2, 3)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges lo to hi - 1, one after the other."""
    size = hi - lo
    return np.arange(int(size.sum())) + np.repeat(lo - np.cumsum(size) + size, size)


class BlockMaxIndex:
    """Postings (example, weight) by term, in blocks of BLOCK examples with the largest weight of each. Vectors (terms, weights) have length 1."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.n, self.n_blocks, self.n_terms = len(vectors), -(-len(vectors) // BLOCK), n_terms
        sizes = np.array([len(t) for t, _ in vectors], np.int64)
        # by example, for exact cosines of single examples
        self.terms, self.weights = (np.concatenate([np.zeros(0, kind), *x]) for kind, x in ((np.int64, (t for t, _ in vectors)), (float, (w for _, w in vectors))))
        self.of_example = np.concatenate([[0], np.cumsum(sizes)])
        order = np.argsort(self.terms, kind="stable")
        term, self.example, self.weight = self.terms[order], np.repeat(np.arange(self.n), sizes)[order], self.weights[order]
        new = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(self.example // BLOCK, prepend=-1) != 0))
        self.start, self.end, self.block = new, np.append(new[1:], len(term)), self.example[new] // BLOCK
        self.most = np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0)
        self.of_term = np.searchsorted(term[new], np.arange(n_terms + 1))
        self.seen, self.largest = np.bincount(term, minlength=n_terms), np.zeros(n_terms)
        np.maximum.at(self.largest, term, self.weight)
        self.query = np.zeros(n_terms)  # zero between searches

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest positive cosines, largest first, and these; exact.

        Frequent terms whose largest contributions together stay under LIGHT only enter the bounds. Blocks whose bound reaches the k-th best
        partial cosine are looked into; examples that can still reach it get their exact cosine.
        """
        known = self.seen[terms] > 0
        terms, weights = terms[known], weights[known]
        by_length = np.argsort(-self.seen[terms], kind="stable")
        above = np.cumsum((weights * self.largest[terms])[by_length])
        n_light = int(np.searchsorted(above, LIGHT, side="right"))
        light, heavy = (float(above[n_light - 1]) if n_light else 0.0), by_length[n_light:]
        lo, hi = self.of_term[terms[heavy]], self.of_term[terms[heavy] + 1]
        at, w = _ranges(lo, hi), np.repeat(weights[heavy], hi - lo)
        blocks = self.block[at]
        bound = np.bincount(blocks, self.most[at] * w, self.n_blocks)
        partial, wanted = np.zeros(self.n), np.zeros(self.n_blocks, bool)

        def look() -> float:
            inside = wanted[blocks]
            entries = at[inside]
            size = self.end[entries] - self.start[entries]
            p = _ranges(self.start[entries], self.end[entries])
            np.add(partial, np.bincount(self.example[p], self.weight[p] * np.repeat(w[inside], size), self.n), out=partial)
            some = partial[partial > 0]
            return float(np.partition(some, -k)[-k]) if len(some) >= k else 0.0

        first = np.argsort(-bound, kind="stable")[:FIRST]
        wanted[first] = True
        least = look()
        wanted = bound + light >= least - 1e-9
        wanted[first] = False
        if wanted.any():
            least = look()
        near = np.flatnonzero(partial + light >= least - 1e-9)
        lo, hi = self.of_example[near], self.of_example[near + 1]
        frequent = terms[by_length[:n_light]]
        if (hi - lo).sum() <= self.seen[frequent].sum():
            self.query[terms] = weights
            p = _ranges(lo, hi)
            cosine = np.bincount(np.repeat(np.arange(len(near)), hi - lo), self.weights[p] * self.query[self.terms[p]], len(near))
            self.query[terms] = 0
        else:  # many are near: the frequent terms' own postings are the shorter way
            at = self.of_term[frequent], self.of_term[frequent + 1]
            lo, hi = self.start[at[0]], self.end[at[1] - 1]
            p = _ranges(lo, hi)
            cosine = (partial + np.bincount(self.example[p], self.weight[p] * np.repeat(weights[by_length[:n_light]], hi - lo), self.n))[near]
        cosine = np.round(cosine, 12)
        best = np.lexsort((near, -cosine))[:k]
        best = best[cosine[best] > 0]
        return near[best], np.minimum(cosine[best], 1.0)


@dataclass
class Examples:
    """Labelled texts: ids, labels 0 or 1, terms with counts, and each one's share of a vote among its near copies."""

    ids: list
    y: np.ndarray
    terms: list[np.ndarray]
    counts: list[np.ndarray]
    share: np.ndarray


@dataclass
class Model:
    scale: np.ndarray
    index: BlockMaxIndex
    y: np.ndarray
    base: float

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.scale[terms]
        norm = math.sqrt(float((w * w).sum()))
        return (terms[w > 0], w[w > 0] / norm) if norm else (terms[:0], w[:0])

    def votes(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The shrunk share of toxic votes, the neighbours and their cosines."""
        at, q = self.vector(terms, counts)
        found, cosine = self.index.search(at, q, NEIGHBOURS) if len(at) else (np.zeros(0, np.int64), np.zeros(0))
        w = 1 / (1.02 - cosine)
        return float((w @ self.y[found] + SHRINK * self.base) / (w.sum() + SHRINK)), found, cosine


def build(examples: Examples, rows: np.ndarray, idf: np.ndarray, power: int) -> Model:
    """The model of the examples in `rows`."""
    y, share = examples.y[rows], examples.share[rows]
    base = float((share @ y + 0.5) / (share.sum() + 1))
    sizes = [len(examples.terms[r]) for r in rows]
    term = np.concatenate([np.zeros(0, np.int64), *(examples.terms[r] for r in rows)])
    seen = np.bincount(term, np.repeat(share, sizes), len(idf))
    toxic = np.bincount(term, np.repeat(share * y, sizes), len(idf))
    rate = (toxic + base) / (seen + 1)
    association = np.abs(np.log(rate / (1 - rate)) - math.log(base / (1 - base)))
    model = Model(np.where(seen > 0, idf * association**power, 0.0), None, y, base)
    model.index = BlockMaxIndex([model.vector(examples.terms[r], examples.counts[r]) for r in rows], len(idf))
    return model


def _logit(p):
    return np.log(p / (1 - p))


def calibration(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from the log-odds of raw scores to labels, with smoothed targets; the slope is positive."""
    pos, neg = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, theta = np.stack([_logit(raw), np.ones(len(raw))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * (theta - [1.0, 0.0]))
        theta = theta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def _frequencies(docs: DataFrame, text_col: str, vocabulary: list[bytes]) -> np.ndarray:
    """In how many of all documents each term occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(vocabulary))  # the words of SAMPLE_TEXTS texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(pickle.loads(shared.value))}
        known, total = frozenset(number), np.zeros(len(number), np.int64)
        for batch in batches:
            for raw in _texts(batch.column(0)):
                total[[number[w] for w in known.intersection(words_of(raw))]] += 1
        if (seen := np.flatnonzero(total)).size:
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["k", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    found = docs.select(text_col).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # a row per term
    out[found["k"].to_numpy()] = found["n"].to_numpy()
    return out


def _examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[Examples, list[bytes]]:
    """The examples in order (toxic ones first), with the vocabulary: words and counts of SAMPLE_TEXTS texts reach the driver."""
    chosen = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label")).where("__id is not null and __label is not null").distinct().orderBy(F.xxhash64("__id"), "__id", "__label").limit(SAMPLE_TEXTS)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where("__text is not null")
    # SAMPLE_TEXTS rows of an id and a label are broadcast; of the rows of one id, the same text is taken wherever they lie
    sample = texts.join(F.broadcast(chosen), "__id").groupBy("__id", "__label").agg(F.min_by("__text", F.struct(F.xxhash64("__text"), F.col("__text"))).alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, terms, counts = [], [], []
            for raw in _texts(batch.column(2)):
                words = words_of(raw)
                found = Counter(words)
                marks.append(min((zlib.crc32(b" ".join(words[k : k + COPY_WORDS])) for k in range(max(1, len(words) - COPY_WORDS + 1))), default=0))
                terms.append(list(found))
                counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.int64()), pa.array(terms, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int32()))], ["id", "label", "mark", "terms", "counts"])

    kinds = labels.schema
    schema = T.StructType([T.StructField("id", kinds[id_col].dataType), T.StructField("label", kinds[label_col].dataType), T.StructField("mark", T.LongType()), T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    found = sample.mapInArrow(count, schema).toArrow()
    ids, toxic, marks = found["id"].to_pylist(), [int(v == 1) for v in found["label"].to_pylist()], found["mark"].to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (-toxic[k], ids[k]))
    words = found["terms"].combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.binary()))
    words = pa.concat_arrays(words.chunks) if isinstance(words, pa.ChunkedArray) else words
    vocabulary = sorted(words.flatten().unique().to_pylist())
    number = {w: k for k, w in enumerate(vocabulary)}
    copies = Counter(zip(toxic, marks, strict=True))
    terms, counts = [], []
    for k in order:
        t = np.array([number[w] for w in words[k].as_py()], np.int64)
        n = np.array(found["counts"][k].as_py(), np.int64)
        rank = np.argsort(t)
        terms.append(t[rank])
        counts.append(n[rank])
    return Examples([ids[k] for k in order], np.array([toxic[k] for k in order], float), terms, counts, np.array([1 / copies[toxic[k], marks[k]] for k in order])), vocabulary


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str):
    """(vocabulary, examples, idf, slope and offset, power), or the score of every text if the examples have one label."""
    examples, vocabulary = _examples(docs, labels, id_col, text_col, label_col)
    if not vocabulary or examples.y.min() == examples.y.max():
        return float(examples.y.mean()) if len(examples.y) else 0.0
    idf = np.log((1 + docs.count()) / (1 + _frequencies(docs, text_col, vocabulary))) + 1
    part = np.array([zlib.crc32(str(i).encode()) % PARTS for i in examples.ids])

    def unseen(k: int, power: int) -> np.ndarray:
        """Shares of the examples of a part under a model of the others; none where the others have one label."""
        own, others = np.flatnonzero(part == k), np.flatnonzero(part != k)
        if not len(own) or not 0 < examples.y[others].sum() < len(others):
            return np.full(len(own), np.nan)
        model = build(examples, others, idf, power)
        return np.array([model.votes(examples.terms[r], examples.counts[r])[0] for r in own])

    tried = {p: unseen(0, p) for p in POWERS}
    power = min(POWERS, key=lambda p: (round(log_loss(tried[p], examples.y[part == 0]), 6), p))
    raw = np.full(len(part), np.nan)
    for k in range(PARTS):
        raw[part == k] = unseen(k, power) if k else tried[power]
    known = ~np.isnan(raw)
    curve = calibration(raw[known], examples.y[known]) if known.any() and 0 < examples.y[known].sum() < known.sum() else (1.0, 0.0)
    return vocabulary, examples, idf, curve, power


def log_loss(raw: np.ndarray, y: np.ndarray) -> float:
    """Cross-entropy of calibrated shares; 0 where there is nothing to tell apart."""
    if not len(raw) or np.isnan(raw).any() or not 0 < y.sum() < len(y):
        return 0.0
    slope, offset = calibration(raw, y)
    z = slope * _logit(raw) + offset
    return float(np.mean(y * np.logaddexp(0, -z) + (1 - y) * np.logaddexp(0, z)))


def _packed(vocabulary: list[bytes], examples: Examples, idf: np.ndarray, curve: tuple[float, float], power: int) -> bytes:
    """What a worker builds the model from, compressed; the index itself is some ten times larger."""
    sizes = np.array([len(t) for t in examples.terms], np.int64)
    flat = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int32).tobytes() for x in (examples.terms, examples.counts)]
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps((vocabulary, examples.ids, examples.y, examples.share, sizes, *flat, idf, curve, power)))


#: The model of this worker's last task: a worker serves many tasks of one query.
_LAST: dict[int, tuple] = {}


def _unpacked(packed: bytes) -> tuple[dict[bytes, int], Model, list, tuple[float, float]]:
    key = xxhash.xxh3_64_intdigest(packed)
    if key not in _LAST:
        _LAST.clear()
        vocabulary, ids, y, share, sizes, terms, counts, idf, curve, power = pickle.loads(zstandard.ZstdDecompressor().decompress(packed))
        cuts = np.cumsum(sizes)[:-1]
        terms, counts = (np.split(np.frombuffer(x, np.int32).astype(np.int64), cuts) for x in (terms, counts))
        examples = Examples(ids, y, terms, counts, share)
        _LAST[key] = {t: k for k, t in enumerate(vocabulary)}, build(examples, np.arange(len(ids)), idf, power), ids, curve
    return _LAST[key]


def _counted(raw: bytes, number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a text's known words in order, and how often each occurs."""
    found = Counter(words_of(raw))
    known = [w for w in found if w in number]
    terms = np.fromiter(map(number.__getitem__, known), np.int64, len(known))
    counts = np.fromiter(map(found.__getitem__, known), np.int64, len(known))
    order = np.argsort(terms)
    return terms[order], counts[order]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Per document: id, score and its nearest examples."""
    learned = learn(docs, labels.where(bucket_of(id_col, FOLDS) != HELD), id_col, text_col, label_col)
    rows = docs.select(id_col, text_col)
    id_kind = labels.schema[id_col].dataType
    schema = T.StructType([rows.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.StructType([T.StructField("example", id_kind), T.StructField("cosine", T.DoubleType())])))])
    if isinstance(learned, float):
        return rows.select(id_col, F.lit(learned).alias("score"), F.array().cast(schema["evidence"].dataType).alias("evidence"))
    shared = docs.sparkSession.sparkContext.broadcast(_packed(*learned))  # words and counts of SAMPLE_TEXTS examples
    kind = pa.list_(pa.struct([("example", to_arrow_type(id_kind)), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, model, ids, (slope, offset) = _unpacked(shared.value)
        for batch in batches:
            scores, evidence = [], []
            for raw in _texts(batch.column(1)):
                share, near, cosine = model.votes(*_counted(raw, number))
                scores.append(1 / (1 + math.exp(-(slope * _logit(share) + offset))))
                evidence.append([{"example": ids[e], "cosine": c} for e, c in zip(near.tolist(), cosine.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, kind)], [id_col, "score", "evidence"])

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, labels)
    return scored.select("doc_id", (bucket_of("doc_id", FOLDS) == HELD).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "evidence")
