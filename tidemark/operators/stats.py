"""Evaluation statistics over ranks and aggregates: AUC, rank correlation, distances, folds and detector scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import saved
from .ranks import BELOW, MEAN_RANK, SIZE, TOTAL, matched, positions, ranked_values, row_numbers


def auc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """(by, auc, n, n_pos): the rank statistic with mean ranks for ties. Scores are counted before they are ranked, so tied rows cost one."""
    c = ranked_values(df.where(f"{label} is not null"), by, score, F.expr(f"count_if({label} = 1)").alias("p"))
    a = c.groupBy(*by).agg(F.expr(f"sum({MEAN_RANK} * p)").alias("s"), F.sum("p").alias("n_pos"), F.sum(SIZE).alias("n"))
    return a.select(*by, F.expr("try_divide(s - n_pos * (n_pos + 1) / 2.0D, n_pos * (n - n_pos))").alias("auc"), "n", "n_pos")


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, rho): Pearson's correlation of mean ranks; null without variation. Pairs are counted before they meet their ranks, so rows alike cost one."""
    pairs = saved(df.where(f"{x} is not null and {y} is not null").groupBy(*by, x, y).agg(F.count("*").alias("_n")))
    for value, out in ((x, "_rx"), (y, "_ry")):
        counted = pairs.groupBy(*by, value).agg(F.sum("_n").alias(SIZE))
        ranks = positions(counted, by, [value], SIZE).select(*by, value, F.expr(f"{MEAN_RANK} - ({TOTAL} + 1) / 2.0D").alias(out))
        pairs = matched(pairs, ranks, [*by, value])
    sums = pairs.groupBy(*by).agg(*(F.expr(f"sum(_n * {a} * {b})").alias(n) for n, a, b in (("xy", "_rx", "_ry"), ("xx", "_rx", "_rx"), ("yy", "_ry", "_ry"))))
    return sums.select(*by, F.expr("try_divide(xy, sqrt(xx) * sqrt(yy))").alias("rho"))


def folds(df: DataFrame, key: str, label: str, k: int, seed: str) -> DataFrame:
    """df with a fold 0 to k-1, stratified by label: the rank of a hash inside the label's rows, mod k."""
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary"))
    return row_numbers(df.withColumn("_h", h), [label], ["_h", key]).withColumn("fold", F.col(BELOW) % k).drop("_h", BELOW)


def distances(df: DataFrame, category: str, a: str, b: str, by: list[str]) -> DataFrame:
    """(by, tv, ks): total variation of two count columns, and Kolmogorov-Smirnov in the categories' order."""
    part = ", ".join(by)
    d = df.withColumn("p", F.expr(f"{a} / double(sum({a}) over (partition by {part}))")).withColumn("q", F.expr(f"{b} / double(sum({b}) over (partition by {part}))"))
    d = d.withColumn("g", F.expr(f"abs(sum(p - q) over (partition by {part} order by {category}))"))
    return d.groupBy(*by).agg((0.5 * F.sum(F.abs(F.col("p") - F.col("q")))).alias("tv"), F.max("g").alias("ks"))


def rounded_shares(df: DataFrame, category: str, count: str, by: list[str], digits: int = 3) -> DataFrame:
    """Shares rounded, the residue on the largest so that they sum to 1."""
    part = ", ".join(by)
    d = df.withColumn("share", F.expr(f"round({count} / double(sum({count}) over (partition by {part})), {digits})")).withColumn("_r", F.expr(f"row_number() over (partition by {part} order by {count} desc, {category})"))
    return d.withColumn("share", F.expr(f"round(if(_r = 1, share + 1 - sum(share) over (partition by {part}), share), {digits})")).drop("_r")


def detector_scores(truth: DataFrame, flags: DataFrame, k: int) -> DataFrame:
    """(anomaly_type, recall_at_k, precision_at_k, ceiling, mean_rank): truth (business_id, transaction_id, anomaly_type) against ranked flags."""
    hit = truth.join(flags.where(F.col("rank") <= k).select("business_id", "transaction_id", "rank"), ["business_id", "transaction_id"], "left")
    shown = flags.where(F.col("rank") <= k).join(truth.select("business_id", "anomaly_type").distinct(), "business_id").groupBy("anomaly_type").agg(F.count("*").alias("shown"))
    per = hit.groupBy("anomaly_type").agg(F.count("*").alias("planted"), F.count("rank").alias("found"), F.avg("rank").alias("mean_rank")).join(shown, "anomaly_type", "left")
    return per.select("anomaly_type", F.expr("found / planted").alias("recall_at_k"), F.expr("try_divide(found, shown)").alias("precision_at_k"), F.expr("try_divide(least(planted, shown), shown)").alias("ceiling"), "mean_rank")
