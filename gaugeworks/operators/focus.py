"""Uncertainty of keywords that hands itself on along attention."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import sequential

#: Generations of an Arrow batch that are Python objects at once.
ROWS = 64


def focus(generations: DataFrame, key: str, base: str, keyword: str, edges: str, gamma: float = 0.9) -> DataFrame:
    """key and value, one row for each generation: base scores and keyword flags of its tokens, and its attention as an array of structs
    (i, j, a): token i attends to the earlier token j by a. Pairs that are not there count as 0, so a generation costs what its edges cost.
    The value is null without a keyword; null arrays are empty."""
    rows = generations.select(key, base, keyword, edges)
    schema = T.StructType([rows.schema[key], T.StructField("value", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch, values = whole.slice(at, ROWS), []
                for b, w, e in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                    pairs = sorted((x["i"], x["j"], x["a"]) for x in e or ())
                    values.append(sequential.focus(b or [], w or [], pairs, gamma))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)
