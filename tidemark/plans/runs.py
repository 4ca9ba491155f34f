"""Two writings of the ledger compared column by column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import new_path
from ..operators import compare as C
from ..sources import ledger as L
from .profiles import register

#: table: the whole-number key, the damaged column, which row the second writing has damaged (the largest or the least key), and how.
DAMAGE = {
    "transactions": ("transaction_id", "cents", "max", "cents + 1"), "obligations": ("obligation_id", "frequency", "min", "concat(frequency, '?')"),
    "facilities": ("business_id", "drawn_cents", "max", "cast(null as bigint)"), "balance_sheets": ("business_id * 100000 + months_between(month_end, date'1990-01-31')", None, None, None),
}


def writings(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    """A ledger table written twice, the second time in other partitions and with one cell damaged."""
    key, column, row, change = DAMAGE[name]
    df, paths = getattr(L, name)(spark, sf_dir), (new_path(spark, f"{name}-a"), new_path(spark, f"{name}-b"))
    df.write.parquet(paths[0])
    first = spark.read.parquet(paths[0])
    other = first.repartition(*first.columns[:2])  # no fixed number: a task's share would grow with the table
    if column:
        hit = first.agg(F.expr(f"{row}({key}) as k"))
        other = other.crossJoin(F.broadcast(hit)).withColumn(column, F.expr(f"if({key} = k, {change}, {column})")).drop("k")  # one row
    other.write.parquet(paths[1])
    return first, spark.read.parquet(paths[1])


def _sql() -> str:
    """Each table's cells compared by joins on the key, and the range by arithmetic."""
    src = {"transactions": "tx", "obligations": "obl", "facilities": "fac"}
    leaf = f"greatest(1, CAST(ceil((hi - lo + 1) / {1 << C.DEPTH}.0::DOUBLE) AS BIGINT))"
    parts = []
    for name, (key, column, row, change) in DAMAGE.items():
        if column:
            new = {"cents": "CAST(cents + 1 AS VARCHAR)", "frequency": "frequency || '?'", "drawn_cents": "NULL"}[column]
            parts.append(f"SELECT '{name}' AS table_name, '{column}' AS column_name, lo + (k - lo) // w * w AS first_key, lo + (k - lo) // w * w + w - 1 AS last_key, k AS key, CAST({column} AS VARCHAR) AS before, {new} AS after "
                         f"FROM (SELECT {row}({key}) AS k, min({key}) AS lo, {leaf.replace('hi', f'max({key})').replace('lo', f'min({key})')} AS w FROM {src[name]}) m JOIN {src[name]} t ON t.{key} = m.k")
    return "\nUNION ALL ".join(parts)


@register("z0 AS (SELECT 1)\n" + _sql())
def two_run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tables of the ledger, each written twice: the table, column, key range and cell that differ. Three have one damaged cell; the fourth only other files."""
    found = [C.compare(*writings(spark, sf_dir, name), DAMAGE[name][0]).select(F.lit(name).alias("table_name"), F.col("column").alias("column_name"), "first_key", "last_key", "key", "before", "after") for name in DAMAGE]
    return reduce(DataFrame.unionByName, found)
