"""Fitting a byte network on a bounded sample of labelled texts, and scoring whole tables with it."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_cnn import WINDOW, ByteCnn, sample_windows
from .common import text_buffer

#: At most this many labelled texts are learned from, the first by hash of their id, and this many windows of each.
SAMPLE_TEXTS = 4000
SAMPLE_WINDOWS = 3


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_texts: int = SAMPLE_TEXTS, **model) -> tuple[ByteCnn | None, list]:
    """A network and its classes in order, learned from `labels` (id, label; null labels are dropped) joined with `docs`.

    Only the bounded sample reaches the driver: sample_texts rows of SAMPLE_WINDOWS windows of 512 bytes. Without any label, (None, []).
    """
    chosen = (
        labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"))
        .where("__id is not null and __label is not null")
        .distinct()
        .orderBy(F.xxhash64("__id"), "__id", "__label")
        .limit(sample_texts)
    )
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where("__text is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [str(k) for k in batch.column("__id").to_pylist()]
            windows = [sample_windows(text.encode(), SAMPLE_WINDOWS, zlib.crc32(key.encode())) for key, text in zip(keys, batch.column("__text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(windows, pa.list_(pa.binary())), batch.column("__label")], ["k", "w", "y"])

    kind = labels.schema[label_col].dataType
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("w", T.ArrayType(T.BinaryType())), T.StructField("y", kind)])
    # the broadcast side has sample_texts rows of an id and a label at most
    found = texts.join(F.broadcast(chosen), "__id").select("__id", "__text", "__label").mapInArrow(cut, schema)
    # of several texts of one id, the same one counts wherever they lie: sample_texts rows reach the driver
    found = found.groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("w").alias("h"), "w")).alias("x")).select("k", "y", "x.w").collect()
    rows = sorted((r.k, bytes(w), r.y) for r in found for w in r.w)
    classes = sorted({r[2] for r in rows})
    if not rows:
        return None, []
    x = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, WINDOW)
    y = np.searchsorted(np.array(classes), np.array([r[2] for r in rows]))
    return ByteCnn(max(2, len(classes)), **model).fit(x, y), classes


def with_log_probs(docs: DataFrame, model: ByteCnn, text_col: str, out_col: str) -> DataFrame:
    """`docs` with a column of class log-probabilities of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # a few hundred KB, whatever the data
    at = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = pickle.loads(shared.value)
        for batch in batches:
            found = net.text_log_probs(*text_buffer(batch.column(at)))
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * net.classes), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, out_col])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))]))
