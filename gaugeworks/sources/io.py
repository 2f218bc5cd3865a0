"""Loading, sharding, archiving and resuming. All paths are read and written by Spark."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import apply_template

ARCHIVE = ("stats", "estimations", "gen_metrics", "metrics")
_OWN: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, spark.checkpoint.dir; where it is unset and Spark is local, in a folder of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset; executors would not see each other's files")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="gaugeworks-io-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
        where = f"file://{_OWN[0]}"
    return f"{where.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt over all cores where its files come in fewer pieces, as a small table in one file does; a table of many pieces stays."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """csv with a header, json lines, or parquet."""
    reader = spark.read
    return reader.csv(path, header=True) if kind == "csv" else reader.json(path) if kind in ("json", "jsonl") else reader.parquet(path)


def load(spark: SparkSession, path: str, kind: str, x: str, y: str | None, template: str | None = None, limit: int | None = None, longest: int | None = None) -> DataFrame:
    """input_text and target_text of a data set; a missing target is empty, texts over `longest` characters go, the first `limit` rows stay."""
    df = read(spark, path, kind)
    text = apply_template(template, F.col(x)) if template else F.col(x)
    df = df.select(F.col(x).alias("__x"), text.alias("input_text"), (F.col(y) if y else F.lit("")).alias("target_text"))
    if longest is not None:
        df = df.where(F.length("__x") <= longest)
    if limit is not None:
        df = df.orderBy("__x").limit(limit)
    return df.drop("__x")


def pick_split(df: DataFrame, split: str | None) -> DataFrame:
    """One split, or all without a name; an unknown name is an error."""
    if split is None:
        return df
    found = df.where(F.col("split") == split)
    if found.isEmpty():
        raise ValueError(f"no split {split}; there are {sorted(r[0] for r in df.select('split').distinct().limit(100).collect())}")
    return found


def load_shards(spark: SparkSession, paths: list[str], order: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (spark.read.parquet(p) for p in paths)).orderBy(order)


def load_many(spark: SparkSession, names: list, seed: int, key: str, casts: dict[str, str] | None = None) -> DataFrame:
    """Data sets by `path` or `path:split`, lists of them nested, in one table in hash order; a label that cannot be cast becomes null."""
    flat: list[str] = []

    def walk(x) -> None:
        if isinstance(x, str):
            flat.append(x)
        else:
            for y in x:
                walk(y)

    walk(names)
    parts = []
    for name in flat:
        head, _, tail = name.rpartition(":")
        path, split = (head, tail) if head and "/" not in tail else (name, None)
        parts.append(pick_split(spark.read.parquet(path), split))
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in (casts or {}).items()}).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def save_archive(tables: dict[str, DataFrame], path: str) -> None:
    """The long tables of one evaluation, those with a level partitioned by it."""
    for name, df in tables.items():
        if name not in ARCHIVE:
            raise ValueError(f"an archive holds {ARCHIVE}, not {name}")
        writer = df.write.mode("overwrite")
        (writer.partitionBy("level") if "level" in df.columns else writer).parquet(f"{path}/{name}")


def load_archive(spark: SparkSession, *paths: str) -> dict[str, DataFrame]:
    """From the first path that holds each table."""
    out: dict[str, DataFrame] = {}
    hadoop = spark._jsc.hadoopConfiguration()
    for path in paths:
        for name in ARCHIVE:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            if name not in out and at.getFileSystem(hadoop).exists(at):
                out[name] = spark.read.parquet(f"{path}/{name}")
    return out


def append_missing(df: DataFrame, score: Callable[[DataFrame], DataFrame], key: str, path: str, schema: str) -> DataFrame:
    """Scores the rows that the table at `path` lacks, appends them, and returns the table. A second run does no work."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        df = df.join(spark.read.schema(schema).parquet(path).select(key), key, "left_anti")
    score(df).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def explode_checked(df: DataFrame, *columns: str) -> DataFrame:
    """One row per element of arrays of one length; other lengths stop the run."""
    same = F.lit(True)
    for c in columns[1:]:
        same = same & (F.size(c) == F.size(columns[0]))
    rest = [c for c in df.columns if c not in columns]
    zipped = F.when(same, F.arrays_zip(*columns)).otherwise(F.raise_error(F.lit("arrays of different lengths")))
    return df.select(*rest, F.explode(zipped).alias("__z")).select(*rest, *(F.col(f"__z.{c}").alias(c) for c in columns))


def save_details(df: DataFrame, path: str) -> None:
    """As CSV, nested columns as JSON."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").csv(path, header=True)


def kind_of(path: str) -> str:
    """By suffix: csv, json lines, or parquet for anything else."""
    low = path.lower().rstrip("/")
    return "csv" if low.endswith(".csv") else "json" if low.endswith((".json", ".jsonl")) else "parquet"


def observed(df: DataFrame, write: Callable[[DataFrame], None], **metrics) -> dict:
    """Writes `df` and returns metrics of the rows that passed, gathered in the same pass."""
    from pyspark.sql import Observation

    watch = Observation()
    write(df.observe(watch, *(c.alias(k) for k, c in metrics.items())))
    return watch.get
