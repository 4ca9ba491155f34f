"""Restatement of daily totals for rows that come too late for a watermark.

Every batch of the feed is kept as it came, by month and batch, and the months that it touches are totalled anew from all
their rows and replaced. Both writes replace whole partitions, so a batch that is run again, after a failure or by replay,
leaves the same files' rows behind; its number is recorded when it is done and then passed over. A row told twice, in one
batch or in two, counts once (by transaction_id, the row of the latest batch). Work follows the months touched, not the
history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

FEED = "transaction_id long, business_id long, ts timestamp, direction string, cents long"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def totals(rows: DataFrame) -> DataFrame:
    """(business_id, date, inflow, outflow, n) of feed rows."""
    by = rows.groupBy("business_id", F.to_date("ts").alias("date"))
    return by.agg(F.expr("sum(if(direction = 'in', cents, 0))").alias("inflow"), F.expr("sum(if(direction = 'out', cents, 0))").alias("outflow"), F.count("*").alias("n"))


def recorded(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, months) of the batches that are done."""
    path = f"{folder}/batches"
    return spark.read.schema("months array<string>, batch long").parquet(path) if _exists(spark, path) else spark.createDataFrame([], "months array<string>, batch long")


def upsert(batch: DataFrame, number: int, folder: str) -> None:
    """One batch: kept, its months totalled and replaced, its number recorded."""
    spark = batch.sparkSession
    if _exists(spark, f"{folder}/batches/batch={number}"):
        return
    rows = batch.withColumn("month", F.date_format("ts", "yyyy-MM")).withColumn("batch", F.lit(number).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(f"{folder}/rows")
    kept = spark.read.schema(f"{FEED}, month string, batch long").parquet(f"{folder}/rows")
    months = [r["month"] for r in kept.where(F.col("batch") == number).select("month").distinct().collect()]  # months of one batch
    latest = F.expr("max_by(struct(business_id, ts, direction, cents, month), batch)")
    once = kept.where(F.col("month").isin(months)).groupBy("transaction_id").agg(latest.alias("r")).select("transaction_id", "r.*")
    total = totals(once).withColumn("month", F.date_format("date", "yyyy-MM"))
    total.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{folder}/totals")
    spark.createDataFrame([(months,)], "months array<string>").write.mode("overwrite").parquet(f"{folder}/batches/batch={number}")


def restated(feed: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer that keeps folder/totals equal to the totals of all rows that have come, however late."""
    return feed.writeStream.foreachBatch(lambda batch, number: upsert(batch, number, folder)).option("checkpointLocation", checkpoint)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The totals as they stand."""
    return spark.read.schema("business_id long, date date, inflow long, outflow long, n long, month string").parquet(f"{folder}/totals").drop("month")
