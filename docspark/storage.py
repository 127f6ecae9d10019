"""Shared intermediate tables.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, which the driver and all
executors share, so a lost executor never takes the only copy of an intermediate result along.
Only a ``local`` master without that setting (tests, a laptop) gets a temporary folder; elsewhere the
missing setting is an error. What a run has not deleted itself is deleted when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(CHECKPOINT_DIR, found)
    return found.rstrip("/")


_left: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    context, jvm = spark.sparkContext, spark.sparkContext._jvm
    settings = context._jsc.hadoopConfiguration() if context._jsc is not None else jvm.org.apache.hadoop.conf.Configuration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(settings).delete(place, True)


@atexit.register
def _delete_left() -> None:
    for path, spark in _left.items():
        with contextlib.suppress(Exception):  # the JVM may be gone already
            _delete(spark, path)


class Workspace:
    """A folder of its own below the shared one for the tables of one run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._made = 0
        self._paths: list[tuple[DataFrame | None, str]] = []

    def files(self, rows: int) -> int:
        """How many files a table of about ``rows`` rows has at most."""
        return max(2 * self.spark.sparkContext.defaultParallelism, rows // 250_000)

    def table(self, df: DataFrame, name: str, rows: int | None = None, by: list[str] | None = None) -> DataFrame:
        """Write ``df`` and read it back: its lineage ends at the written files, which lie in a folder for each value of ``by``.

        A table of about ``rows`` rows is written as few files: one a task slot, or one every 250,000 rows.
        """
        if rows is not None:
            df = df.coalesce(self.files(rows))
        return self.read(self.write(df, name, by), df)

    def write(self, df: DataFrame, name: str, by: list[str] | None = None) -> str:
        self._made += 1
        path = f"{self.path}/{self._made:03d}-{name}"
        _left[path] = self.spark
        df.write.partitionBy(*by or []).parquet(path)
        self._paths.append((None, path))
        return path

    def folder(self, name: str) -> str:
        """A new folder for files that something else writes; deleted like the tables."""
        self._made += 1
        path = f"{self.path}/{self._made:03d}-{name}"
        _left[path] = self.spark
        return path

    def read(self, path: str, like: DataFrame) -> DataFrame:
        found = self.spark.read.schema(like.schema).parquet(path)
        self._paths = [(found if p == path else d, p) for d, p in self._paths]
        return found

    def drop(self, table: DataFrame | str) -> None:
        """Delete a table that a later one has replaced."""
        for held, path in self._paths:
            if held is table or path == table:
                self._delete(path)
        self._paths = [x for x in self._paths if x[0] is not table and x[1] != table]

    def finish(self, df: DataFrame, name: str) -> DataFrame:
        """Write the result and delete every other table."""
        before = [path for _, path in self._paths]
        out = self.table(df, name)
        for path in before:
            self.drop(path)
        return out

    def close(self) -> None:
        """Delete all tables; nothing may read them any more."""
        self._delete(self.path)
        self._paths = []

    def _delete(self, path: str) -> None:
        _delete(self.spark, path)
        for held in [x for x in _left if x.startswith(path)]:
            del _left[held]
