"""Calibration of scores by group: mergeable bins, a monotone fit over them, expected calibration error.

Scores fall into equal bins, whose counts, positives and score sums add up from anywhere; a group is never more than BINS rows
after that, so the pool-adjacent-violators fit is a fold over one small array: a block is pushed, and while it lies below
the block before it, both become one.

Scores outside 0 to 1, NaN, and null scores, labels or groups of one: null scores and labels are left out, scores are
clipped to 0 and 1; empty bins aren't rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 20


def bins(df: DataFrame, score: str, label: str, by: list[str], n_bins: int = BINS) -> DataFrame:
    """(by, bin, n, positives, mean_score, rate)."""
    d = df.where(f"{score} is not null and not isnan({score}) and {label} is not null").withColumn("_s", F.expr(f"greatest(0.0D, least(1.0D, cast({score} as double)))"))
    g = d.groupBy(*by, F.expr(f"least(cast(floor(_s * {n_bins}) as int), {n_bins - 1})").alias("bin")).agg(F.count("*").alias("n"), F.expr(f"count_if({label} = 1)").alias("positives"), F.avg("_s").alias("mean_score"))
    return g.withColumn("rate", F.expr("positives / n"))


def monotone(binned: DataFrame, by: list[str]) -> DataFrame:
    """binned with fitted, the least-squares rising curve over the bins of a group."""
    block = "named_struct('n', {n}, 'p', {p}, 'last', {b})"
    # a stack of blocks, the last one first; merging goes on while a block's rate is not above the one before
    push = f"concat(array({block.format(n='x.n', p='x.positives', b='x.bin')}), a)"
    joined = f"concat(array({block.format(n='s[0].n + s[1].n', p='s[0].p + s[1].p', b='s[0].last')}), slice(s, 3, size(s)))"
    settle = f"aggregate(a, {push}, (s, unused) -> if(size(s) > 1 and s[0].p * s[1].n <= s[1].p * s[0].n, {joined}, s))"
    empty = "cast(array() as array<struct<n: bigint, p: bigint, last: int>>)"
    held = binned.groupBy(*by).agg(F.expr("array_sort(collect_list(struct(bin, n, positives, mean_score, rate)))").alias("rows"))  # at most n_bins a group
    fit = held.withColumn("blocks", F.expr(f"reverse(aggregate(rows, {empty}, (a, x) -> {settle}))"))
    out = fit.select(*by, "blocks", F.inline("rows"))
    return out.withColumn("fitted", F.expr("aggregate(filter(blocks, k -> k.last >= bin), cast(null as double), (a, k) -> coalesce(a, k.p / k.n))")).drop("blocks")


def error(binned: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, ece, worst): the mean distance of mean score and rate, weighted by rows, and the largest."""
    return binned.groupBy(*by).agg(F.sum("n").alias("n"), F.expr("sum(n * abs(mean_score - rate)) / sum(n)").alias("ece"), F.expr("max(abs(mean_score - rate))").alias("worst"))
