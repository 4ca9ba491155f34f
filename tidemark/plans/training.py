"""Registered queries of the credit model's training: its inputs with SQL, the model and its check, and the comparison with a boosted baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import saved
from ..operators import credit as T
from ..operators import profile as P
from ..operators import rules as R
from ..sources import ledger as L
from .profiles import _DAILY_SQL, QUERIES, register, rounded

NAMES, AHEAD = list(P.DAILY), 30


def labelled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as they were 30 days before each as-of date, and the label: a negative balance since. Businesses without enough data are left out."""
    d = L.daily(spark, sf_dir)
    before = d.where(f"dbe >= {AHEAD}").withColumn("window_end", F.date_sub("window_end", AHEAD)).withColumn("dbe", F.col("dbe") - AHEAD)
    label = d.groupBy("business_id").agg(F.expr(f"if(min(if(dbe < {AHEAD}, eod, null)) < 0, 1, 0)").alias("label"))
    return P.daily_features(before).where("status <> 'insufficient_data'").join(label, "business_id").select("business_id", "label", *NAMES)


_LOG = {c: f"sign({c}) * ln(1 + abs({c}))" if c in T.CURRENCY else c for c in NAMES}
_INPUT_SQL = "dl2 AS (SELECT business_id, window_end - 30 AS window_end, data_source, opening_cents, date, inflow, inflow_count, outflow, outflow_count, recurring, net, dbe - 30 AS dbe, eod FROM dly WHERE dbe >= 30),\n" + _DAILY_SQL.replace("FROM dly WINDOW", "FROM dl2 WINDOW") + """,
tv AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({e} AS DOUBLE) AS v FROM f WHERE status <> 'insufficient_data'" for c, e in _LOG.items()) + """),
tm AS (SELECT feature, count(v) AS present, min(v) AS low, max(v) AS high, median(v) AS median FROM tv GROUP BY 1),
ts AS (SELECT feature, avg(coalesce(v, median)) AS mean, stddev_pop(coalesce(v, median)) AS scale FROM tv JOIN tm USING (feature) WHERE low < high GROUP BY 1)
SELECT feature, present, round(median, 6) AS median, round(mean, 6) AS mean, round(scale, 6) AS scale FROM tm LEFT JOIN ts USING (feature)"""


@register(_INPUT_SQL)
def credit_training_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What training learns of each input before it fits; mean and scale are null where an input is left out."""
    x = T.transformed(labelled_features(spark, sf_dir), NAMES)
    seen = saved(T.inputs(x, NAMES))
    medians = {r.feature: r.median for r in seen.where("low < high").collect()}
    return rounded(seen.select("feature", "present", "median").join(T.moments(x, medians), "feature", "left"))


@register()
def credit_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trained model's artifact, the intercept as a feature of its own."""
    artifact, intercept = T.train(labelled_features(spark, sf_dir), NAMES, "label")
    rows = [*artifact, ("(intercept)", intercept, 0.0, 1.0, 1.0, False)]
    return spark.createDataFrame(rows, "feature string, coef double, mean double, scale double, median double, log_transform boolean")


@register()
def credit_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each business's probability by the exported artifact alone."""
    d = saved(labelled_features(spark, sf_dir))
    artifact, intercept = T.train(d, NAMES, "label")
    s = R.contributions(d, artifact).groupBy("business_id").agg((F.sum("contribution") + intercept).alias("logit"))
    return s.select("business_id", "logit", F.expr("1 / (1 + exp(-logit))").alias("pd"))


@register()
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold AUC of the linear model and of boosted trees."""
    return T.compared(saved(labelled_features(spark, sf_dir)), NAMES, "business_id", "label")


__all__ = ["QUERIES"]
