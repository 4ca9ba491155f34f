"""Training of the linear credit model with exact exports, and a boosted baseline, with Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import saved
from . import stats as S
from .ranks import medians

#: Inputs in currency, taken as signed logarithms.
CURRENCY = frozenset(("avg_monthly_inflow", "avg_monthly_outflow", "cash_flow_volatility", "avg_daily_balance", "min_daily_balance", "runway_days_average_balance", "liquidity_trend_slope", "installment_capacity", "downside_semideviation_90d", "upside_semideviation_90d"))


def number(df: DataFrame, c: str) -> Column:
    """A column as a finite double: booleans and the texts true, false, yes and no count 1 and 0, blank or other texts, NaN and infinities are null."""
    kind, x = dict(df.dtypes)[c], F.col(f"`{c}`")
    if kind == "string":
        t = F.lower(F.trim(x))
        x = F.when(t.isin("true", "yes"), 1.0).when(t.isin("false", "no"), 0.0).otherwise(t.try_cast("double"))
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def transformed(df: DataFrame, names: list[str], currency: frozenset = CURRENCY) -> DataFrame:
    """df with its inputs as finite doubles or null, and currency as sign(x) ln(1 + |x|)."""
    own = {c: number(df, c) for c in names}
    return df.withColumns({c: F.signum(x) * F.log1p(F.abs(x)) if c in currency else x for c, x in own.items()})


def inputs(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, present, low, high, median) of transformed inputs. Medians are the values at the middle places of ranges dealt over tasks, so no task holds a feature."""
    long = saved(df.select(*names).unpivot([], names, "feature", "value"))
    bounds = long.groupBy("feature").agg(F.count("value").alias("present"), F.min("value").alias("low"), F.max("value").alias("high"))
    return bounds.join(medians(long, ["feature"], "value"), "feature", "left")


def moments(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """(feature, mean, scale) of inputs with nulls at their medians."""
    full = {c: F.coalesce(c, F.lit(m)) for c, m in medians.items()}
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("scale")) for c, x in full.items()))
    return df.agg(rows.alias("r")).select(F.inline("r"))


def train(df: DataFrame, names: list[str], label: str, c: float = 1.0) -> tuple[list[tuple], float]:
    """(artifact, intercept) of an L2 logistic regression on df's transformed inputs: median imputation, standardised by population moments, a penalty of 1 / (c n).

    Inputs that are constant or all null are left out. The artifact lists (feature, coef, mean, scale, median, signed
    logarithm), all that scoring needs; only a row for each feature reaches the driver.
    """
    x = transformed(df.where(F.col(label).isNotNull()), names)
    found = {r.feature: r for r in inputs(x, names).collect()}
    medians = {k: found[k].median for k in names if k in found and found[k].present and found[k].low < found[k].high}
    scale = {r.feature: (r.mean, r.scale) for r in moments(x, medians).collect()}
    kept = list(medians)
    z = x.select(F.col(label).cast("double").alias("label"), *((F.coalesce(k, F.lit(medians[k])) - scale[k][0]) / scale[k][1] for k in kept)).toDF("label", *kept)
    data = VectorAssembler(inputCols=kept, outputCol="features").transform(z).select("label", "features")
    n = data.count()
    model = LogisticRegression(regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-12).fit(data)
    return [(k, float(w), *scale[k], medians[k], k in CURRENCY) for k, w in zip(kept, model.coefficients)], float(model.intercept)


def boosted(train_df: DataFrame, test_df: DataFrame, names: list[str], label: str, rounds: int = 10, depth: int = 3) -> DataFrame:
    """test_df's key, label and score from boosted trees on inputs with nulls at a value below all others."""
    def data(df: DataFrame) -> DataFrame:
        d = transformed(df, names).withColumns({c: F.coalesce(c, F.lit(-1e9)) for c in names}).withColumn("_y", F.col(label).cast("double"))
        return VectorAssembler(inputCols=names, outputCol="_x").transform(d)

    model = GBTClassifier(labelCol="_y", featuresCol="_x", maxIter=rounds, maxDepth=depth, seed=0).fit(data(train_df).select("_y", "_x"))
    return model.transform(data(test_df)).withColumn("score", vector_to_array("probability")[1])


def compared(df: DataFrame, names: list[str], key: str, label: str, folds: int = 3, repeats: int = 1) -> DataFrame:
    """(model, repeat, auc, n, n_pos): both models scored out of fold, repeated over stratified folds."""
    from .rules import contributions

    out = None
    for r in range(repeats):
        d = S.folds(df.where(F.col(label).isNotNull()), key, label, folds, f"cv{r}")
        for k in range(folds):
            own, rest = d.where(F.col("fold") == k), d.where(F.col("fold") != k)
            artifact, intercept = train(rest, names, label)
            linear = contributions(own, artifact, key).groupBy(key).agg((F.sum("contribution") + intercept).alias("score")).join(own.select(key, label), key)
            for name, scored in (("linear", linear), ("boosted", boosted(rest, own, names, label))):
                rows = scored.select(F.lit(name).alias("model"), F.lit(r).alias("repeat"), F.col(label).cast("int").alias("label"), F.round("score", 12).alias("score"))
                out = rows if out is None else out.unionByName(rows)
    return S.auc(out, "score", "label", ["model", "repeat"])
