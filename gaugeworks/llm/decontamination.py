"""Benchmark decontamination by a prefix-filtered set join.

Each window of an item, WINDOW consecutive words, must occur in a document whole, so its necessary prefix is one token: its rarest by a
global order of document frequency, counted over all documents. A document's tokens are looked up among these prefix tokens. A token found
gives the only place where the window could lie (positional bound), which must fit into the document (length bound); there the words are
compared exactly.

Items are joined in blocks of BLOCK_WINDOWS windows, so that what is broadcast has a fixed bound; each block is one more pass over a
document's words, and what the passes found travels with the document. Words are runs of letters and digits of the text with A-Z
lower-cased, as bytes of UTF-8.

A null text has no words: nothing is hit. Items without words match nothing; an item shorter than WINDOW is one window. Item ids are
distinct strings; a null id counts as the empty text. Repeated rows are judged each. Empty tables give an empty result or no hits.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_buffer

WINDOW = 13
BLOCK_WINDOWS = 200_000
SHARE = 20

#: Bytes of words to themselves, A-Z to a-z, anything else to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, starts, lengths = text_buffer(column)
    view = memoryview(data)
    for s, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        yield bytes(view[s : s + n])


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of BLOCK_WINDOWS windows at most (or one item), read one partition at a time."""
    block, size = [], 0
    for row in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        if words := words_of(row.t.encode()):
            n = max(1, len(words) - WINDOW + 1)
            if block and size + n > BLOCK_WINDOWS:
                yield block
                block, size = [], 0
            block.append((row.i, words))
            size += n
    if block:
        yield block


def _frequencies(docs: DataFrame, text_col: str, vocabulary: list[bytes]) -> np.ndarray:
    """In how many of all documents each word occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frozenset(shared.value)
        number = {w: k for k, w in enumerate(shared.value)}
        total = np.zeros(len(number), np.int64)
        for batch in batches:
            for raw in _texts(batch.column(0)):
                for w in known.intersection(words_of(raw)):
                    total[number[w]] += 1
        if (seen := np.flatnonzero(total)).size:
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["k", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for row in docs.select(text_col).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # a row per word of the block
        out[row.k] = row.n
    return out


def _index(items: list[tuple[str, list[bytes]]], rank: dict[bytes, int]) -> dict[bytes, list[tuple[int, tuple[bytes, ...], list[str]]]]:
    """Prefix token to (its offset, window, ids of the items that hold the window)."""
    owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, words in items:
        for k in range(max(1, len(words) - WINDOW + 1)):
            owners[tuple(words[k : k + WINDOW])].add(item)
    index = defaultdict(list)
    for window, ids in owners.items():
        at = min(range(len(window)), key=lambda k: (rank[window[k]], window[k], k))
        index[window[at]].append((at, window, sorted(ids)))
    return dict(index)


def _match(batches: Iterator[pa.RecordBatch], index: dict, last: bool, out_names: list[str]) -> Iterator[pa.RecordBatch]:
    keys = frozenset(index)
    for batch in batches:
        hits, items = batch.column("__hits").to_pylist(), batch.column("__items").to_pylist()
        n_words = []
        for k, raw in enumerate(_texts(batch.column("__text"))):
            words = words_of(raw)
            n_words.append(len(words))
            if not keys.isdisjoint(words):
                spans, found = [], set(items[k])
                for pos, w in enumerate(words):
                    if w in keys:
                        for at, window, ids in index[w]:
                            lo = pos - at
                            if lo >= 0 and lo + len(window) <= len(words) and all(words[lo + i] == x for i, x in enumerate(window)):
                                spans += (lo, lo + len(window))
                                found.update(ids)
                hits[k] = [*hits[k], *spans]
                items[k] = sorted(found)
        if not last:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], batch.schema.names)
            continue
        n_hit = []
        for spans in hits:
            total = to = 0
            for lo, hi in sorted(zip(spans[::2], spans[1::2], strict=True)):
                total += max(0, hi - max(lo, to))
                to = max(to, hi)
            n_hit.append(total)
        digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        columns = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *columns], out_names)


def overlap(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", prefix: str = "") -> DataFrame:
    """`docs` with n_words, n_hit, n_items, items_sha256 and contaminated, each name after `prefix`."""
    added = [f"{prefix}{n}" for n in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")]
    if clash := set(added) & set(docs.columns):
        raise ValueError(f"the input has columns {sorted(clash)}; name a prefix")
    kept = list(docs.columns)
    rows = docs.withColumn("__text", F.col(text_col)).withColumn("__hits", F.array().cast("array<bigint>")).withColumn("__items", F.array().cast("array<string>"))
    blocks = _blocks(benchmark, item_col, item_text_col)
    items, last = next(blocks, []), False
    while not last:
        following = next(blocks, None)
        last = following is None
        vocabulary = sorted({w for _, words in items for w in words})
        seen = _frequencies(docs, text_col, vocabulary) if items else []
        rank = {w: int(n) for w, n in zip(vocabulary, seen, strict=True)}
        shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(_index(items, rank)))
        names = [*kept, *added[:4]]
        fields = list(docs.schema.fields)
        if last:
            schema = T.StructType([*fields, *(T.StructField(n, t) for n, t in zip(added, (T.LongType(), T.LongType(), T.LongType(), T.StringType()), strict=False))])
        else:
            schema = rows.schema
        rows = rows.mapInArrow(lambda batches, shared=shared, last=last, names=names: _match(batches, pickle.loads(shared.value), last, names), schema)
        items = following
    hit, n = F.col(added[1]), F.col(added[0])
    return rows.withColumn(added[4], (hit > 0) & (SHARE * hit >= n))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return overlap(docs.select("doc_id", "text"), benchmark).drop("text")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that are not contaminated, with the same columns."""
    return overlap(docs, benchmark, prefix="__decon_").where(~F.col("__decon_contaminated")).select(*docs.columns)
