"""Shared folder for the tables a query writes between its steps.

A loop over a growing plan has to cut its lineage. Every step here is written as a
parquet table to the folder named by ``spark.checkpoint.dir``, so the loss of an
executor costs the tasks that were running and nothing else, and the next step is
planned with the real size of its input.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

_LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables, as the session names it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _LOCAL_ROOTS[app]


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Make a folder that the file system removes when the application ends."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(folder)
    system.deleteOnExit(folder)


#: Who holds a setting at a value: what it was before, and how many.
_HELD: dict[tuple[SparkSession, str, str], tuple[str, int]] = {}
_HOLDING = threading.Lock()


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session while something runs. What runs side by side may hold it at the same value; the first sets it, the last sets it back."""
    held = (spark, key, value)
    with _HOLDING:
        before, users = _HELD.get(held) or (spark.conf.get(key), 0)
        _HELD[held] = (before, users + 1)
        spark.conf.set(key, value)
    try:
        yield
    finally:
        with _HOLDING:
            before, users = _HELD.pop(held)
            if users > 1:
                _HELD[held] = (before, users - 1)
            else:
                spark.conf.set(key, before)


def shuffles_removed(spark: SparkSession):
    """Statements run inside drop their shuffle files once they have ended: what they wrote is all that is read later."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


#: Files of a log that a task writes side by side; after a reduce it writes one, and need not sort for that.
WRITERS = "16"


class Workspace:
    """One folder per run, under the shared root; gone when the application ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/tierwalk-{label}-{uuid.uuid4().hex}"
        delete_at_exit(spark, self.path)

    def write(self, df: DataFrame, name: str) -> int:
        """Write a table and return its row count, both in one job."""
        seen = Observation()
        with shuffles_removed(self.spark):
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/{name}")
        return seen.get["n"]

    def save(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """Write a table and return it read back, with its row count."""
        rows = self.write(df, name)
        return self.read(df.schema, name), rows

    def save_counting(self, df: DataFrame, name: str, counted: Column) -> tuple[DataFrame, int, int]:
        """As ``save``, with the number of rows for which ``counted`` holds, in the same job."""
        seen = Observation()
        watched = df.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(counted).alias("counted"))
        with shuffles_removed(self.spark):
            watched.write.parquet(f"{self.path}/{name}")
        return self.read(df.schema, name), seen.get["n"], seen.get["counted"]

    def drop(self, name: str) -> None:
        """Remove a table that nothing reads any more."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def read(self, schema: StructType, *names: str) -> DataFrame:
        paths = [f"{self.path}/{name}" for name in names]
        base = paths[0].rsplit("/", 1)[0]
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths)


#: Rows up to which a log stays plain: they are broadcast where they meet anything, and buckets would only cost.
SMALL = 200_000


class Log:
    """Append-only table of a loop: an append or a few per hop, kept in buckets of ``keys``.

    There are as many buckets as a shuffle has partitions, and a reduce on these keys leaves its rows dealt in the
    same way. So what a hop reduced meets everything logged before without moving it, and an append writes each bucket
    from one task. Up to ``SMALL`` rows are plain files; what outgrows that is dealt into buckets once, when it is next read.
    """

    def __init__(self, ws: Workspace, name: str, schema: StructType, keys: list[str], hop: str = "hop"):
        self.spark, self.keys, self.hop = ws.spark, keys, hop
        self.schema = StructType([*schema.fields, StructField(hop, IntegerType())])
        self.path = f"{ws.path}/{name}"
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"tierwalk_log_{uuid.uuid4().hex}"
        self.plain: list[int] | None = []  # hops in plain files; None once there are buckets
        self.total = 0

    def append(self, df: DataFrame, hop: int, **counted: Column) -> tuple[int, ...]:
        """Write rows of a hop; returns their number, and those for which each of ``counted`` holds."""
        if self.total > SMALL:
            self._deal()
        seen = Observation()
        counts = [F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(n) for n, c in counted.items())]
        rows = df.observe(seen, *counts).select(*self.schema.names[:-1])
        if self.plain is None:
            self._write(rows.withColumn(self.hop, F.lit(hop)))
        else:
            with shuffles_removed(self.spark):
                rows.write.mode("append").parquet(f"{self.path}-plain/{self.hop}={hop}")
            if hop not in self.plain:
                self.plain.append(hop)
        found = seen.get
        self.total += found["n"]
        return tuple(found[n] for n in ("n", *counted))

    def _write(self, rows: DataFrame) -> None:
        with shuffles_removed(self.spark), setting(self.spark, "spark.sql.maxConcurrentOutputFileWriters", WRITERS):
            writer = rows.write.format("parquet").mode("append").partitionBy(self.hop)
            writer.bucketBy(self.buckets, *self.keys).option("path", self.path).saveAsTable(self.table)

    def _deal(self) -> None:
        if self.plain is None:
            return
        rows, self.plain = self._read(self.plain), None
        self._write(rows.repartition(self.buckets, *self.keys))

    def _read(self, hops: list[int]) -> DataFrame:
        if not hops:
            return self.spark.createDataFrame([], self.schema)
        base = f"{self.path}-plain"
        return self.spark.read.schema(self.schema).option("basePath", base).parquet(*(f"{base}/{self.hop}={h}" for h in hops))

    def upto(self, last: int, first: int = 0) -> DataFrame:
        """The rows of some hops; the others are not read."""
        if first < last and self.total > SMALL:
            self._deal()
        if self.plain is None:
            return self.spark.table(self.table).where(F.col(self.hop).between(first, last))
        return self._read([h for h in self.plain if first <= h <= last])

    def close(self) -> None:
        """Forget the catalog entry; the rows stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def rows(self) -> DataFrame:
        """All rows as a plain table, also when the log is closed."""
        return self.spark.read.schema(self.schema).parquet(self.path) if self.plain is None else self._read(self.plain)
