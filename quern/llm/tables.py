"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows to an Arrow batch where the session has Spark's default of 10,000: whole texts are long,
#: and a batch is held by the JVM and the Python worker at once.
BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and all runs on one machine (tests)."""
    bounded_batches(spark)
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Makes Spark delete a query's shuffle files when it ends, not when the driver's garbage is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends there.

    Its shuffle files go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores in front, so that no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def told_apart(docs: DataFrame) -> DataFrame | None:
    """``docs`` with doc_id replaced by a number for each doc_id and text, and ``own`` in front, the old doc_id; null ids last.

    None if every doc_id is there and its own already. Rows equal in doc_id and text become one;
    numbers keep the order of doc_id, and texts that share one are ordered by hash.
    """
    text = F.xxhash64(F.col("text").cast("string"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("h"))
    if named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1").isEmpty():
        return None
    own = fresh(docs, "own")
    keys = [F.col(own).asc_nulls_last(), text]
    rows = docs.dropDuplicates(["doc_id", "text"]).withColumnRenamed("doc_id", own).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return keep(rows.select(F.col(own), F.monotonically_increasing_id().alias("doc_id"), *(c for c in rows.columns if c != own)), "numbered")


def drop(df: DataFrame) -> None:
    """Delete a kept table that no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _drop(df.sparkSession, path)


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Ids that may be broadcast; 16 bytes each in the hashed relation, so 32 MB at most.
BROADCAST_IDS = 1_000_000


def small(df: DataFrame, rows: int, most: int = BROADCAST_IDS) -> DataFrame:
    """``df`` with a broadcast hint while its counted rows stay under ``most``; else a shuffle join."""
    return F.broadcast(df) if rows <= most else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
