"""Rule engines: the compliance screen, zakat, and linear credit scoring with exact additive contributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the screen: merchant category codes by severity, and the fallback by sector.
HARD_MCC = (5813, 5921, 7995, 7800, 7801, 7802, 7273)
SOFT_MCC = (5999, 5399, 5993, 6012, 6051, 7929, 8999)
SECTOR_STATUS = {"construction": "compliant", "professional_services": "compliant", "food_beverage": "compliant", "retail_trade": "soft_flag_review"}
INCOME_SHARE = 0.05
# Fixed values of zakat: rate, lunar year, grams of gold.
RATE, LUNAR_DAYS, GRAMS = 0.025, 354, 85
# Fixed values of the credit decision: tiers (name, PD below, markup), decline, affordability.
TIERS, DECLINE, ALPHA, MONTHS, STEP, LEAST, MOST = (("A", 0.03, 5.0), ("B", 0.06, 6.5), ("C", 0.10, 8.0)), 0.10, 0.40, 12, 1000, 5000, 500000


def rule_table(spark: SparkSession) -> DataFrame:
    """(mcc, severity): a small dimension; its size is fixed here."""
    rows = [(m, "hard_flag") for m in HARD_MCC] + [(m, "soft_flag_review") for m in SOFT_MCC]
    return spark.createDataFrame(rows, "mcc int, rule_severity string")


def screen(biz: DataFrame, clipped: DataFrame, rules: DataFrame, share: float = INCOME_SHARE) -> DataFrame:
    """(business_id, status, evidence_basis, mcc, fi_share, rules_triggered, existing_financing): activity by code or sector, income by financial-institution inflow; hard over soft over compliant."""
    income = clipped.groupBy("business_id").agg(
        F.expr("sum(if(direction = 'in', cents * sample_weight, 0))").alias("inflow"), F.expr("sum(if(direction = 'in' and counterparty_type = 'financial_institution', cents * sample_weight, 0))").alias("fi_in"),
        F.expr("bool_or(direction = 'out' and counterparty_type = 'financial_institution')").alias("existing_financing"),
    )
    b = biz.withColumn("mcc", F.expr("if(trim(declared_mcc) rlike '^[0-9]{4}$', cast(trim(declared_mcc) as int), null)")).join(F.broadcast(rules), "mcc", "left").join(income, "business_id", "left")
    sector = "case sector " + " ".join(f"when '{k}' then '{v}'" for k, v in SECTOR_STATUS.items()) + " else 'soft_flag_review' end"
    b = b.withColumn("activity", F.expr(f"if(mcc is not null, coalesce(rule_severity, 'compliant'), {sector})")).withColumn("fi_share", F.expr("if(inflow > 0, fi_in / inflow, 0.0D)"))
    soft_income = F.expr(f"coalesce(fi_share >= {share}D, false)")
    hits = F.array_compact(F.array(
        F.expr("case when mcc is not null and activity = 'hard_flag' then concat('ACT-HARD-', mcc) when mcc is not null and activity = 'soft_flag_review' then concat('ACT-SOFT-', mcc) when mcc is null and activity <> 'compliant' then concat('ACT-NOMCC-', sector) end"),
        F.when(soft_income, F.lit("INC-FI-SHARE")),
    ))
    status = F.when(F.col("activity") == "hard_flag", "hard_flag").when((F.col("activity") == "soft_flag_review") | soft_income, "soft_flag_review").otherwise("compliant")
    return b.select("business_id", status.alias("screen_status"), F.expr("if(mcc is null, 'registered_sector', 'declared_mcc')").alias("evidence_basis"), "mcc", F.coalesce("fi_share", F.lit(0.0)).alias("fi_share"), F.array_join(hits, ",").alias("rules_triggered"), F.coalesce("existing_financing", F.lit(False)).alias("existing_financing"))


def zakat(spine: DataFrame, sheet_rows: DataFrame, prices: DataFrame) -> DataFrame:
    """spine (business_id, window_end, hawl_start, opening_cents) judged on its balance-sheet row and the price per gram of its as-of month."""
    z = spine.join(sheet_rows, "business_id", "left").withColumn("month", F.date_format("window_end", "yyyy-MM")).join(prices, "month", "left")
    z = z.withColumn("base", F.expr("(cash + inventory + receivables - payables - short_term) / 100.0D")).withColumn("nisab", F.expr(f"{GRAMS} * price_per_gram")).withColumn("hawl_completion", F.expr(f"date_add(hawl_start, {LUNAR_DAYS})"))
    reason = F.expr("case when month_end is null then 'no_balance_sheet_snapshot' when nisab is null then 'no_price' when base < nisab then 'below_nisab' when window_end < hawl_completion then 'hawl_incomplete' when opening_cents is null then 'hawl_incomplete' when opening_cents / 100.0D < nisab then 'below_nisab' end")
    z = z.withColumn("reason", reason).withColumn("zakat_status", F.expr("case when reason in ('no_balance_sheet_snapshot', 'no_price') then 'not_computed' when reason is not null then 'zero_liability' else 'computed' end"))
    return z.select("business_id", "zakat_status", "reason", F.round("base", 2).alias("zakat_base"), F.round("nisab", 2).alias("nisab_value"), "hawl_completion", F.expr(f"round(if(reason is null, base * {RATE}D, 0.0D), 2)").alias("liability"))


def contributions(features: DataFrame, artifact: list[tuple], key: str = "business_id") -> DataFrame:
    """(key, feature, contribution, imputed, rank): coef times z of each feature, medians for nulls, signed logarithms where the artifact, a list of (feature, coef, mean, scale, median, log_transform), says so."""
    names = [a[0] for a in artifact]
    artifact = features.sparkSession.createDataFrame(artifact, "feature string, coef double, mean double, scale double, median double, log_transform boolean")
    long = features.select(key, *(F.col(c).cast("double") for c in names)).unpivot([key], names, "feature", "value").join(F.broadcast(artifact), "feature")
    x = F.expr("case when value is null or isnan(value) then median when log_transform then signum(value) * ln(1 + abs(value)) else value end")
    long = long.withColumn("contribution", F.when(F.col("scale") != 0, F.col("coef") * (x - F.col("mean")) / F.col("scale")).otherwise(0.0))
    rank = F.expr(f"row_number() over (partition by {key} order by abs(round(contribution, 9)) desc, feature)")
    return long.select(key, "feature", "contribution", F.expr("value is null or isnan(value)").alias("imputed"), rank.alias("rank"))


def explain(contributions: DataFrame, top: int = 3, strong: float = 0.3, moderate: float = 0.1) -> DataFrame:
    """The largest contributions with their magnitude and direction."""
    c = contributions.where(F.col("rank") <= top)
    c = c.withColumn("magnitude", F.expr(f"case when abs(contribution) > {strong}D then 'strongly' when abs(contribution) >= {moderate}D then 'moderately' else 'marginally' end"))
    return c.withColumn("side", F.expr("case when magnitude = 'marginally' then 'either' when contribution > 0 then 'against' else 'supports' end"))


def decide(contributions: DataFrame, intercept: float, capacity: DataFrame, screens: DataFrame, key: str = "business_id") -> DataFrame:
    """(key, pd, decision, tier, amount, markup, decline_reason, decline_origin, offer_status): tiers by PD, affordability, then the compliance gate."""
    d = contributions.groupBy(key).agg((F.sum("contribution") + intercept).alias("logit")).withColumn("pd", F.expr("1 / (1 + exp(-logit))")).join(capacity, key, "left").join(screens, key, "left")
    tier = F.expr("case " + " ".join(f"when pd < {b}D then '{n}'" for n, b, _ in TIERS) + " end")
    markup = F.expr("case " + " ".join(f"when pd < {b}D then {m}D" for _, b, m in TIERS) + " end")
    d = d.withColumn("tier", tier).withColumn("markup", markup).withColumn("amount", F.expr(f"least(floor({ALPHA}D * capacity * {MONTHS} / (1 + markup / 100 * {MONTHS} / 12.0D) / {STEP}) * {STEP}, {MOST})"))
    d = d.withColumn("decline_reason", F.expr(f"case when screen_status = 'hard_flag' then 'hard_flag' when pd >= {DECLINE}D or tier is null then 'risk_model' when capacity is null or capacity <= 0 then 'affordability_no_installment_capacity' when amount < {LEAST} then 'affordability_below_minimum_amount' end"))
    ok = F.col("decline_reason").isNull()
    origin = F.expr("case when decline_reason is null then null when decline_reason = 'hard_flag' then 'compliance' when decline_reason = 'risk_model' then 'risk_model' else 'affordability' end")
    offer = F.when(ok, F.when(F.col("screen_status") == "soft_flag_review", "conditional").otherwise("unconditional"))
    return d.select(key, "pd", F.when(ok, "approved").otherwise("declined").alias("decision"), F.when(ok, F.col("tier")).alias("tier"), F.when(ok, F.col("amount").cast("long")).alias("amount"), F.when(ok, F.col("markup")).alias("markup"), "decline_reason", origin.alias("decline_origin"), offer.alias("offer_status"))
