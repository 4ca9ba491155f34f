"""How a thinned ledger bends counterparty features: sampled rows, weighted rows and windows totalled before, against the whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import saved
from . import adapter
from .ranks import medians

FEATURES = ("largest_single_source_ratio", "unique_counterparties_count", "counterparty_concentration_index", "new_counterparty_ratio_30d", "counterparty_persistence_ratio")


def counterparty_shares(rows: DataFrame) -> DataFrame:
    """The five features of (business_id, counterparty_id, direction, dbe, cents): one aggregate by counterparty, one by business."""
    by = rows.where("counterparty_id is not null").groupBy("business_id", "counterparty_id").agg(*(F.expr(e).alias(k) for k, e in {
        "cur": "sum(if(dbe < 90, cents, 0))", "n": "count_if(dbe < 90)", "cin": "sum(if(dbe < 90 and direction = 'in', cents, 0))", "last30": "sum(if(dbe < 30, cents, 0))",
        "known": "bool_or(dbe >= 30)", "before": "bool_or(dbe between 90 and 179 and direction = 'in')",
    }.items()))
    return by.groupBy("business_id").agg(*(F.expr(e).alias(k) for k, e in zip(FEATURES, (
        "double(try_divide(max(cin), sum(cin)))", "double(count_if(n > 0))", "try_divide(sum(pow(double(cur), 2)), pow(double(sum(cur)), 2))",
        "double(try_divide(sum(if(not known, last30, 0)), sum(last30)))", "double(try_divide(sum(if(before, cin, 0)), sum(cin)))",
    ))))


def variants(clipped: DataFrame, keep_one_in: int) -> dict[str, DataFrame]:
    """The whole ledger and three ways to read its features from a thinned one."""
    thin = adapter.thinned(clipped, keep_one_in)
    return {"whole": clipped, "sampled": thin, "weighted": thin.withColumn("cents", F.expr("cast(cents * sample_weight as bigint)")), "windows": adapter.windows_as_rows(adapter.counterparty_windows(clipped))}


def bias(clipped: DataFrame, keep_one_in: int) -> DataFrame:
    """(feature, variant, businesses, median_error, median_ratio): each variant's features against the whole ledger's, a business where both have one; ratios where the whole's isn't zero."""
    long = [counterparty_shares(df).unpivot(["business_id"], list(FEATURES), "feature", "value").withColumn("variant", F.lit(name)) for name, df in variants(clipped, keep_one_in).items()]
    held = saved(reduce(DataFrame.unionByName, long))
    true = held.where("variant = 'whole'").select("business_id", "feature", F.col("value").alias("whole"))
    d = saved(held.where("variant <> 'whole'").join(true, ["business_id", "feature"]).where("value is not null and whole is not null").select("feature", "variant", F.round(F.abs(F.expr("value - whole")), 9).alias("error"), F.expr("round(try_divide(value, whole), 9)").alias("ratio")))
    by = ["feature", "variant"]
    return d.groupBy(*by).agg(F.count("*").alias("businesses")).join(medians(d, by, "error", "median_error"), by).join(medians(d, by, "ratio", "median_ratio"), by, "left")
