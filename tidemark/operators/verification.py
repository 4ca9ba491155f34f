"""Saved decisions that can be checked later: their receipts, and digests of the inputs that they came from.

seal() writes decisions, each with the receipt of its own row, and the digest trees (compare.py) of every input table.
audit() reads both and names what is wrong: a saved row that no longer matches its receipt, a decision that the inputs give
otherwise now, one that is missing or new, and each column of each input that has changed since, with the range of keys in
which it did. Only trees are kept of inputs, bounded whatever their size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compare
from .adapter import receipt

Inputs = dict[str, tuple[DataFrame, str]]


def _forest(inputs: Inputs, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    trees = [compare.digest_tree(df, key, bounds[n]).select(F.lit(n).alias("table_name"), F.lit(bounds[n][0]).cast("long").alias("least"), F.lit(bounds[n][1]).cast("long").alias("width"), "*") for n, (df, key) in inputs.items()]
    return reduce(DataFrame.unionByName, trees)


def seal(decisions: DataFrame, key: str, names: list[str], inputs: Inputs, folder: str) -> None:
    """decisions' columns names (key among them) with receipts, and the trees of inputs (table: frame and SQL of its whole-number key), below folder."""
    decisions.select(*names).join(receipt(decisions, key, names), key).write.parquet(f"{folder}/decisions")
    _forest(inputs, {n: compare.key_bounds(k, df) for n, (df, k) in inputs.items()}).write.parquet(f"{folder}/inputs")


def audit(spark: SparkSession, folder: str, key: str, names: list[str], again: DataFrame, inputs: Inputs) -> DataFrame:
    """(finding, table_name, column_name, first_key, last_key): damaged row, not reproduced, missing, new, and changed input. Without findings, no rows."""
    held = spark.read.parquet(f"{folder}/decisions")
    own = receipt(held, key, names).withColumnRenamed("receipt", "of_saved")
    now = receipt(again, key, names).withColumnRenamed("receipt", "of_now")
    both = held.select(key, "receipt").join(own, key).join(now, key, "full")
    finding = F.expr("case when receipt is null then 'new' when of_now is null then 'missing' when receipt <> of_saved then 'damaged row' when receipt <> of_now then 'not reproduced' end")
    rows = both.select(finding.alias("finding"), F.lit("decisions").alias("table_name"), F.lit(None).cast("string").alias("column_name"), F.col(key).cast("long").alias("first_key"), F.col(key).cast("long").alias("last_key")).where("finding is not null")
    kept = spark.read.parquet(f"{folder}/inputs")
    bounds = {r["table_name"]: (r["least"], r["width"]) for r in kept.select("table_name", "least", "width").distinct().collect()}  # a row a table
    for name, (df, k) in inputs.items():
        before = kept.where(F.col("table_name") == name).drop("table_name", "least", "width")
        leaves = compare.ranges(compare.differing(before, compare.saved(compare.digest_tree(df, k, bounds[name]))), bounds[name])
        rows = rows.unionByName(leaves.select(F.lit("changed input").alias("finding"), F.lit(name).alias("table_name"), F.col("column").alias("column_name"), "first_key", "last_key"))
    return rows


def reference(key: Column, receipt: Column) -> Column:
    """M-{key}-{first eight digits of the receipt, large letters}: names a result, and proves nothing."""
    return F.concat(F.lit("M-"), key.cast("string"), F.lit("-"), F.upper(F.substring(receipt, 1, 8)))


def matched_reference(df: DataFrame, typed: str, key: str, receipt: str) -> DataFrame:
    """df with matches: whether a reference as typed, in any case and with blanks around it, names the row's key and the start of its receipt; false for what is no reference, or null."""
    text, form = F.upper(F.trim(typed)), r"^M-(\d+)-([0-9A-F]{8})$"
    same = (F.regexp_extract(text, form, 1) == F.col(key).cast("string")) & F.startswith(F.upper(F.col(receipt)), F.regexp_extract(text, form, 2))
    return df.withColumn("matches", F.coalesce(text.rlike(form) & same, F.lit(False)))
