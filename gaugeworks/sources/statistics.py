"""Statistics that are computed once: tables keyed by the version of their input files and by their definition."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import io
from .calls import done, names


def version(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, lengths and times of all files of the inputs. A rewritten, added or removed file gives another one."""
    h = hashlib.sha256()
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
        found = []
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        h.update(repr((path, sorted(found))).encode())
    return h.hexdigest()[:16]


class Statistics:
    """A folder of statistics: `path`/name/definition/version.

    A statistic is built when it is asked for and not there, or was left unfinished; then older versions of it are removed, since their input is
    gone. A DataFrame that still reads an older version must be used before the next `get` of that statistic.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or io.scratch(spark, "statistics")

    def get(self, name: str, definition: str, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
        """`definition` says how the statistic is made, with its parameters: another definition is another statistic."""
        slot = f"{self.path}/{name}/{hashlib.sha256(repr((definition, sorted(inputs))).encode()).hexdigest()[:16]}"
        now = version(self.spark, *inputs)
        if not done(self.spark, f"{slot}/{now}"):
            build().write.mode("overwrite").parquet(f"{slot}/{now}")
            for old in names(self.spark, slot):
                if old != now:
                    self._remove(f"{slot}/{old}")
        return self.spark.read.parquet(f"{slot}/{now}")

    def held(self) -> list[tuple[str, str, str]]:
        """Name, definition and version of all that is there."""
        return [(n, d, v) for n in names(self.spark, self.path) for d in names(self.spark, f"{self.path}/{n}") for v in names(self.spark, f"{self.path}/{n}/{d}") if done(self.spark, f"{self.path}/{n}/{d}/{v}")]

    def drop(self, name: str | None = None) -> None:
        """One statistic in all its definitions, or everything."""
        self._remove(f"{self.path}/{name}" if name else self.path)

    def _remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
