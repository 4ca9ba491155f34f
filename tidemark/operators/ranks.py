"""Ranks inside groups of any size: range partitions, totals a partition, prefix sums over partitions, ranks inside.

Rows are dealt by Spark's range partitioner on (group, value), so partitions lie one after the other in that order and rows
alike stay together. What comes before a partition's first row of a group is a prefix sum over totals, of which there is one
a partition and group; what comes before a row inside its partition is a window over that partition alone. No task holds a
group: a single group of all rows is dealt like many small ones. Null groups are groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import saved

PID, BELOW, TOTAL, SIZE = "_pid", "_below", "_total", "_m"
#: The mean rank, from 1, of a row of ranked_values.
MEAN_RANK = f"({BELOW} + ({SIZE} + 1) / 2.0D)"


def _list(names) -> str:
    return ", ".join(f"`{n}`" for n in names)


def matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on which nulls meet nulls, with the columns of left and the others of right."""
    r = right.select(*(F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns))
    return left.join(r, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on)), how).drop(*(f"_r_{c}" for c in on))


def positions(df: DataFrame, by: list[str], order: list[str], weight: str) -> DataFrame:
    """df with _below, the weight of the rows of its group before each row (rows alike in by and order come one after the other), and _total, the group's. df is dealt by range once and kept."""
    dealt = saved(df.repartitionByRange(*by, *order).withColumn(PID, F.spark_partition_id()))
    part = f"partition by {_list(by)}" if by else ""
    totals = dealt.groupBy(*by, PID).agg(F.sum(weight).alias("_w"))  # a row for each partition that a group meets
    before = totals.select(*by, PID, F.expr(f"sum(_w) over ({part} order by {PID}) - _w").alias("_before"), F.expr(f"sum(_w) over ({part})").alias(TOTAL))
    inside = dealt.withColumn("_inside", F.expr(f"sum({weight}) over (partition by {_list([PID, *by])} order by {_list(order)} rows unbounded preceding) - {weight}"))
    return matched(inside, before, [*by, PID]).withColumn(BELOW, F.expr("_before + _inside")).drop("_before", "_inside", PID)


def ranked_values(df: DataFrame, by: list[str], value: str, *more) -> DataFrame:
    """One row for each group and distinct value that isn't null: _m rows have it, _below rows lie under it, _total are in the group; and further aggregates. Ties are counted before anything is ranked, so a value that most rows have costs one row."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias(SIZE), *more)
    return positions(counted, by, [value], SIZE)


def row_numbers(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with _below: how many rows of the group come before each."""
    return positions(df.withColumn(SIZE, F.lit(1)), by, order, SIZE).drop(SIZE, TOTAL)


def medians(df: DataFrame, by: list[str], value: str, out: str = "median") -> DataFrame:
    """(by, out): exact medians of the values that aren't null, the mean of the two middle ones; found at their places in the ranges, so no task holds a group."""
    low, high = f"({TOTAL} - 1) div 2", f"{TOTAL} div 2"
    middle = ranked_values(df, by, value).where(" or ".join(f"({BELOW} <= {at} and {at} < {BELOW} + {SIZE})" for at in (low, high)))
    return middle.groupBy(*by).agg(((F.min(value) + F.max(value)) / 2).alias(out))
