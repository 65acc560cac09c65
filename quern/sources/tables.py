"""Tables that plans write and read again: intermediate ones, and a versioned set that is replaced as a whole."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import StoreError


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and all runs on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise StoreError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        fs, target = _file_system(spark, path)
        fs.delete(target, True)


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read back: it is computed once, and its lineage ends there. Deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows in an Arrow batch where texts go through Python.
BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the rows of a batch where they are at Spark's default, so that a worker's memory does not follow the texts of 10,000 rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


#: Rows that may be broadcast.
BROADCAST_ROWS = 100_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint behind a count of the rows; more are joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


class Versions:
    """A set of tables under ``root`` of which readers see one version at a time.

    A version is a folder ``v-<n>``, complete once its marker stands in ``root``; the marker is a
    file made in one step. A writer that dies leaves a folder without a marker, which nobody reads and the next
    writer overwrites. The version before the current one stays for plans that still read it. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _marked(self) -> list[int]:
        fs, root = _file_system(self.spark, self.root)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[len("ready-") :]) for n in names if n.startswith("ready-"))

    def current(self) -> int:
        """The number of the version that readers see; 0 for none."""
        return max(self._marked(), default=0)

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        n = self.current() if version is None else version
        return self.spark.read.parquet(f"{self.root}/v-{n}/{name}") if n else None

    def write(self, tables: dict[str, DataFrame]) -> int:
        """A new version with these tables, which may be computed from the current one."""
        n = self.current() + 1
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{self.root}/v-{n}/{name}")
        fs, marker = _file_system(self.spark, f"{self.root}/ready-{n}")
        fs.create(marker, False).close()
        for old in self._marked():
            if old < n - 1:
                _delete(self.spark, f"{self.root}/ready-{old}")
                _delete(self.spark, f"{self.root}/v-{old}")
        return n

    def clear(self) -> None:
        _delete(self.spark, self.root)
