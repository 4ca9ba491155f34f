"""What several operators need: shared folders, fresh column names, small row helpers and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: blank and bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, only a local session, as in tests, gets one of its own."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tidemark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path.rstrip("/")


_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; clear_scratch() removes what lies there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Removes all files that operators of this session wrote for results read since; DataFrames over them can't be read any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _MADE:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(conf).delete(path, True)


def saved(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, which Spark removes once nothing refers to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names like the given ones that clash with none of those taken, whatever their case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        n = name
        while n.lower() in used:
            n = f"_{n}"
        used.add(n.lower())
        out.append(n)
    return out


#: Rows that Spark hands to a Python function at a time.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows, the same for all operators of this package, and never raises them. Results don't depend on it; it bounds what JVM and Python hold of long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def located(name: str) -> str:
    """The place of a tokenizer's file, asked where it is read: a path, or the name of a public tokenizer's file."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def crc32_of(col: str) -> F.Column:
    """crc32 of a column as text; null counts as empty."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component): the least id reachable, for every id on an edge.

    Alternating large-star and small-star steps: each replaces a node's links by links to its least neighbour, found
    by a partial aggregate and an equi-join, so no neighbourhood is ever collected. Each round ends in a checkpoint;
    only a count and a checksum of the links reach the driver. Rounds grow with the logarithm of the longest path.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    links = saved(edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        links = saved(small.distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle")
    found = links.groupBy("u").agg(F.min("v").alias("component"))
    roots = found.select(F.col("component").alias("id"), "component").distinct()
    return found.select(F.col("u").alias("id"), "component").unionByName(roots)


#: Bytes that Spark hands to a Python function at a time, but for a single longer row.
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """small_batches, and a bound in bytes too: many long texts never stand in one Arrow batch. A session with a lower bound keeps it."""
    small_batches(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)
