"""Shared helpers: table access, written intermediate tables, Arrow text buffers."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the text operators: runs of anything but space and \t to \r.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_OWN: list[str] = []
#: glibc's call that gives free memory back; absent elsewhere.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where that is unset and Spark is local (tests)."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if where := spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None):
        return where.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", master := spark.sparkContext.master):
        raise ValueError(f"spark.checkpoint.dir is unset; executors of {master} would not see each other's files")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="gaugeworks-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return f"file://{_OWN[0]}"


#: Spark's setting by which the shuffle files of a query go at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Written:
    """A DataFrame cut from its lineage by a Parquet table in the shared folder. drop() removes the files.

    The shuffle files of the write go with its end: nothing reads them again.

    slim: rows are far smaller than what they were computed from, so they are gathered into files of the advisory size first.
    """

    def __init__(self, df: DataFrame, label: str, slim: bool = False):
        self.spark = df.sparkSession
        if slim:
            df = df.hint("rebalance")
        self.path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(self.path)
        finally:
            self.spark.conf.set(_CLEANUP, before) if before is not None else self.spark.conf.unset(_CLEANUP)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Scope:
    """Tables written on the way to a result, which go together once that is written."""

    def __init__(self):
        self.tables: list[Written] = []

    def write(self, df: DataFrame, label: str, slim: bool = False) -> DataFrame:
        self.tables.append(Written(df, label, slim))
        return self.tables[-1].df

    def drop(self, *frames: DataFrame) -> None:
        """The tables of the given frames, or all."""
        for t in [t for t in self.tables if not frames or any(t.df is f for f in frames)]:
            t.drop()
            self.tables.remove(t)


#: Rows of one key from which it counts as hot, and how many hot keys there can be at most: their table is broadcast.
LEAST_HOT, HOT = 200, 10_000


def semi_join(rows: DataFrame, keys: DataFrame, columns: list[str], count: str = "n", keep: str | None = None) -> DataFrame:
    """`rows` whose columns are among `keys`, a written table with the number of rows of each key; `keep` names a column for that number.

    A key that holds more than its share of all rows, 1 / HOT, is looked up by broadcast where its rows are; the others meet by a shuffle.
    """
    named = keys.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(columns)), F.col(count).alias("__n"))
    least = max(LEAST_HOT, (keys.agg(F.sum(count)).first()[0] or 0) // HOT)
    on = F.lit(True)
    for i, c in enumerate(columns):
        on = on & (F.col(c) == F.col(f"__k{i}"))
    hot = F.broadcast(named.where(F.col("__n") > least))
    how = "inner" if keep else "left_semi"
    dealt = rows.join(hot, on, "left_anti").join(named.where(F.col("__n") <= least), on, how)
    found = dealt.unionByName(rows.join(hot, on, how))
    return found.drop(*(f"__k{i}" for i in range(len(columns)))).withColumnRenamed("__n", keep) if keep else found


def bucket_of(id_col: str, modulus: int):
    """crc32 of the id as text, mod `modulus`; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


#: Rows taken from an Arrow batch at once where each holds a text or a set: they bound a worker's memory.
ROWS = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of `rows` rows at most. After the last one, what the worker no longer needs goes back to the system: it serves more tasks."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, each text's start, each text's length. Null texts have length 0."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    if column.null_count:
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
    return data, offsets[:-1], lengths
