"""Registered queries over the feature vector, each with the same result in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import saved
from ..operators import profile as P
from ..sources import ledger as L

QUERIES, SQL = {}, {}
Z_BASES = ["inflow_regularity_score", "cash_flow_volatility", "days_negative_balance_90d", "avg_daily_balance", "counterparty_concentration_index"]


def register(sql: str | None = None):
    """Registers a query under its function's name, with its SQL behind the ledger's table expressions."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE {L.SQL.strip()},\n{sql.strip()}" if not sql.lstrip().upper().startswith("SELECT") else f"WITH {L.SQL.strip()}\n{sql.strip()}"
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded, so that another engine's sums compare equal."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@register("""SELECT business_id, date, inflow, inflow_count, outflow, outflow_count, recurring, net, eod FROM dly""")
def daily_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.daily(spark, sf_dir).select("business_id", "date", "inflow", "inflow_count", "outflow", "outflow_count", "recurring", "net", "eod")


_STATS = """
w AS (SELECT *, row_number() OVER o AS pos, dbe < 90 AS cur, CASE WHEN data_source = 'external_real' THEN isodow(date) IN (6, 7) ELSE isodow(date) IN (5, 6) END AS weekend,
  CASE WHEN dbe < 83 THEN lag(net, 7) OVER o END AS net7, lag(eod) OVER o AS eod1 FROM dly WINDOW o AS (PARTITION BY business_id ORDER BY date)),
g AS (SELECT business_id, avg(gap) AS gap_mean, stddev_pop(gap) AS gap_sd FROM (SELECT business_id, pos - lag(pos) OVER (PARTITION BY business_id ORDER BY date) AS gap FROM w WHERE cur AND inflow_count > 0) GROUP BY 1),
r AS (SELECT business_id, max(k) AS longest FROM (SELECT business_id, CASE WHEN neg THEN count(*) ELSE 0 END AS k FROM (
  SELECT business_id, eod < 0 AS neg, pos - row_number() OVER (PARTITION BY business_id, eod < 0 ORDER BY date) AS island FROM w WHERE cur) GROUP BY business_id, neg, island) GROUP BY 1),
b AS (SELECT business_id, window_end, data_source, count(*) AS history_days, count(*) FILTER (cur) AS n, count(*) FILTER (dbe BETWEEN 90 AND 179) AS n_prior,
  count(*) FILTER (cur AND inflow_count + outflow_count > 0) AS coverage_days_90d, sum(inflow) FILTER (cur) AS sum_in, sum(outflow) FILTER (cur) AS sum_out, sum(recurring) FILTER (cur) AS sum_rec,
  sum(inflow_count) FILTER (cur) AS cnt_in, sum(outflow_count) FILTER (cur) AS cnt_out, sum(inflow) FILTER (dbe BETWEEN 90 AND 179) AS prior_in, sum(outflow) FILTER (dbe BETWEEN 90 AND 179) AS prior_out,
  avg(inflow) FILTER (dbe BETWEEN 90 AND 179) AS prior_mean, stddev_pop(inflow) FILTER (dbe BETWEEN 90 AND 179) AS prior_sd, count(*) FILTER (cur AND inflow_count > 0) AS in_days,
  stddev_pop(net) FILTER (cur) AS net_sd, count(*) FILTER (cur AND eod < 0) AS negative, count(*) FILTER (cur AND eod < 0 AND (dbe = 89 OR eod1 IS NULL OR eod1 >= 0)) AS islands,
  avg(eod) FILTER (cur) AS eod_mean, min(eod) FILTER (cur) AS eod_min, max_by(eod, date) AS eod_last, avg(net) FILTER (dbe < 30) AS net30, regr_slope(eod, pos) FILTER (dbe < 30) AS slope,
  count(*) FILTER (cur AND NOT weekend) AS n_op, count(*) FILTER (cur AND NOT weekend AND inflow_count + outflow_count = 0) AS gaps_op, corr(net, net7) FILTER (net7 IS NOT NULL) AS autocorr,
  coalesce(sum((net / 100.0::DOUBLE) ** 2) FILTER (cur AND net < 0), 0) AS down2, coalesce(sum((net / 100.0::DOUBLE) ** 2) FILTER (cur AND net > 0), 0) AS up2,
  list(inflow ORDER BY date) FILTER (cur) AS ins, list(inflow - outflow + recurring ORDER BY date) FILTER (cur) AS var, list(recurring ORDER BY date) FILTER (cur) AS recs, min_by(eod - net, date) FILTER (cur) AS b0
  FROM w GROUP BY ALL),
cus(business_id, t, p, q, last) AS (SELECT business_id, 0, 0.0::DOUBLE, 0.0::DOUBLE, -1 FROM b WHERE prior_sd > 0 UNION ALL
  SELECT business_id, t + 1, CASE WHEN u > 5 OR d > 5 THEN 0 ELSE u END, CASE WHEN u > 5 OR d > 5 THEN 0 ELSE d END, CASE WHEN u > 5 OR d > 5 THEN t ELSE last END FROM (
    SELECT c.business_id, t, last, greatest(0, p + (ins[t + 1] - prior_mean) / prior_sd - 0.5) AS u, greatest(0, q - (ins[t + 1] - prior_mean) / prior_sd - 0.5) AS d FROM cus c JOIN b USING (business_id) WHERE t < n)),
cu AS (SELECT business_id, CASE WHEN last >= 0 THEN CAST(n - 1 - last AS DOUBLE) END AS cusum FROM cus JOIN b USING (business_id) WHERE t = n),
path AS (SELECT business_id, b0, list_transform(range(1, n + 1), lambda i: list_sum(list_slice(var, 1, i))) AS a, list_transform(range(1, n + 1), lambda i: list_sum(list_slice(recs, 1, i))) AS k FROM b),
bis(business_id, i, lo, hi) AS (SELECT business_id, 0, 0.0::DOUBLE, 1.0::DOUBLE FROM path UNION ALL
  SELECT business_id, i + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END FROM (
    SELECT s.business_id, i, lo, hi, list_min(list_transform(range(1, len(a) + 1), lambda j: b0 + (1 - (lo + hi) / 2) * a[j] - k[j])) >= 0 AS ok FROM bis s JOIN path USING (business_id) WHERE i < 20)),
sh AS (SELECT p.business_id, CASE WHEN list_min(list_transform(range(1, len(a) + 1), lambda j: b0 + a[j] - k[j])) < 0 THEN 0 WHEN list_min(list_transform(range(1, len(a) + 1), lambda j: b0 - k[j])) >= 0 THEN 1 ELSE lo END AS shock
  FROM path p JOIN bis ON p.business_id = bis.business_id AND i = 20),
x AS (SELECT b.*, gap_mean, gap_sd, coalesce(longest, 0) AS longest, cusum, shock, sum_in / 100.0::DOUBLE / (n / 30.0::DOUBLE) AS m_in, sum_out / 100.0::DOUBLE / (n / 30.0::DOUBLE) AS m_out,
  CASE WHEN n_prior > 0 THEN prior_in / 100.0::DOUBLE / (n_prior / 30.0::DOUBLE) ELSE 0 END AS p_in, CASE WHEN n_prior > 0 THEN prior_out / 100.0::DOUBLE / (n_prior / 30.0::DOUBLE) ELSE 0 END AS p_out,
  sqrt(down2 / greatest(n - 1, 1)) AS down, sqrt(up2 / greatest(n - 1, 1)) AS up, sqrt(down2 / greatest(n - 1, 1)) / greatest(sqrt(up2 / greatest(n - 1, 1)), 500 / 30.0::DOUBLE) AS asym, greatest(-net30 / 100, 500 / 30.0::DOUBLE) AS burn_floor,
  CASE WHEN coverage_days_90d < 10 THEN 'insufficient_data' WHEN history_days < 180 THEN 'partial_profile' ELSE 'scored' END AS status
  FROM b LEFT JOIN g USING (business_id) LEFT JOIN r USING (business_id) LEFT JOIN cu USING (business_id) LEFT JOIN sh USING (business_id))
"""
_VALUES = {
    "avg_monthly_inflow": "m_in", "avg_monthly_outflow": "m_out", "inflow_count_per_month": "cnt_in * 30.0::DOUBLE / n", "outflow_count_per_month": "cnt_out * 30.0::DOUBLE / n",
    "inflow_regularity_score": "greatest(0, least(1, 1 - gap_sd / greatest(gap_mean, 1e-9)))", "revenue_growth_90d": "greatest(-300, least(300, (m_in - p_in) / p_in * 100))", "expense_growth_90d": "greatest(-300, least(300, (m_out - p_out) / p_out * 100))",
    "recurring_expense_ratio": "sum_rec / sum_out::DOUBLE", "cash_flow_volatility": "net_sd / 100", "inflow_outflow_ratio": "m_in / greatest(m_out, 500)", "days_negative_balance_90d": "negative", "overdraft_events_90d": "islands",
    "max_consecutive_overdraft_days": "longest", "volatility_index": "25 * (net_sd / 100 / (net_sd / 100 + greatest((m_in + m_out) / 30, 500 / 30.0::DOUBLE)) + greatest(0, least(1, 1 - m_in / greatest(m_out, 500))) + negative / n + least(1, islands / 5.0::DOUBLE))",
    "avg_daily_balance": "eod_mean / 100", "min_daily_balance": "eod_min / 100.0::DOUBLE", "runway_days_current_balance": "greatest(eod_last, 0) / 100.0::DOUBLE / burn_floor", "runway_days_average_balance": "greatest(eod_mean, 0) / 100 / burn_floor",
    "liquidity_trend_slope": "coalesce(slope, 0) / 100", "data_gap_ratio": "CASE WHEN n_op > 0 THEN gaps_op / n_op ELSE 0 END", "inflow_break_recency_days": "cusum", "net_flow_autocorr_lag7": "autocorr",
    "downside_semideviation_90d": "down", "upside_semideviation_90d": "up", "flow_asymmetry_ratio": "asym", "installment_capacity": "greatest(0, m_in - m_out) * (1 - least(0.15 * asym, 0.5))", "revenue_shock_absorption_pct": "shock",
    "fixed_obligation_coverage_months": "least(eod_mean / 100 / (sum_rec / sum_out::DOUBLE * m_out), 24)",
}
_REASONS = {
    "inflow_regularity_score": "WHEN in_days < 3 THEN 'insufficient_events'", "revenue_growth_90d": "WHEN history_days < 180 OR n_prior < 90 THEN 'insufficient_history' WHEN p_in < 500 THEN 'near_zero_denominator'",
    "expense_growth_90d": "WHEN history_days < 180 OR n_prior < 90 THEN 'insufficient_history' WHEN p_out < 500 THEN 'near_zero_denominator'", "recurring_expense_ratio": "WHEN sum_out < 50000 THEN 'near_zero_denominator'",
    "runway_days_current_balance": "WHEN net30 >= 0 THEN 'not_applicable'", "runway_days_average_balance": "WHEN net30 >= 0 THEN 'not_applicable'",
    "inflow_break_recency_days": "WHEN history_days < 180 OR n_prior < 90 THEN 'insufficient_history' WHEN cusum IS NULL THEN 'no_break_detected'", "net_flow_autocorr_lag7": "WHEN n <= 9 OR autocorr IS NULL OR isnan(autocorr) THEN 'insufficient_events'",
    "fixed_obligation_coverage_months": "WHEN sum_out < 50000 OR sum_rec / sum_out::DOUBLE * m_out < 500 THEN 'near_zero_denominator'",
}
_INTS = {"days_negative_balance_90d", "overdraft_events_90d", "max_consecutive_overdraft_days"}
_REASON_SQL = {k: f"CASE WHEN status = 'insufficient_data' THEN 'insufficient_data' {_REASONS.get(k, '')} END" for k in _VALUES}
_VALUE_SQL = {k: f"CASE WHEN {_REASON_SQL[k]} IS NULL THEN {v} END" for k, v in _VALUES.items()}
_DAILY_SQL = _STATS.strip() + ",\nf AS (SELECT business_id, window_end, data_source, status, coverage_days_90d, history_days, m_in, m_out, net30, sum_rec,\n  " + ",\n  ".join(f"{_VALUE_SQL[k]} AS {k}, {_REASON_SQL[k]} AS {k}__reason" for k in _VALUES) + " FROM x)"


@register(_DAILY_SQL + "\nSELECT business_id, status, coverage_days_90d, history_days, " + ", ".join(f"CAST({k} AS BIGINT) AS {k}" if k in _INTS else f"round(CAST({k} AS DOUBLE), 6) AS {k}" for k in _VALUES) + " FROM f")
def profile_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = P.daily_features(L.daily(spark, sf_dir)).select("business_id", "status", "coverage_days_90d", "history_days", *P.DAILY)
    return rounded(f.withColumns({c: F.col(c).cast("long") for c in _INTS}))


@register(_DAILY_SQL + ",\nu AS (" + " UNION ALL ".join(f"SELECT business_id, '{k}' AS feature, {k}__reason AS reason FROM f" for k in _VALUES) + ")\nSELECT business_id, feature, reason FROM u WHERE reason IS NOT NULL")
def profile_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each null feature, with its reason."""
    names = [f"{k}__reason" for k in P.DAILY]
    f = P.daily_features(L.daily(spark, sf_dir)).select("business_id", *names)
    return f.unpivot(["business_id"], names, "feature", "reason").where("reason is not null").withColumn("feature", F.expr("replace(feature, '__reason', '')"))


_CP_SQL = """
k AS (SELECT business_id, counterparty_id, sum(CASE WHEN dbe < 90 THEN cents ELSE 0 END) AS cur, count(*) FILTER (dbe < 90) AS cur_n, sum(CASE WHEN dbe < 90 AND direction = 'in' THEN cents ELSE 0 END) AS cin,
  sum(CASE WHEN dbe < 90 AND direction = 'out' THEN cents ELSE 0 END) AS cout, sum(CASE WHEN dbe < 30 THEN cents ELSE 0 END) AS last30, bool_or(dbe >= 30) AS known, bool_or(dbe BETWEEN 90 AND 179 AND direction = 'in') AS prior_in FROM ct GROUP BY ALL),
kt AS (SELECT business_id, sum(cur) AS total FROM k GROUP BY 1),
kn AS (SELECT k.*, total FROM k JOIN kt USING (business_id) WHERE counterparty_id IS NOT NULL),
kf AS (SELECT business_id, max(cin) / nullif(sum(cin), 0)::DOUBLE AS largest_single_source_ratio, count(*) FILTER (cur_n > 0) AS unique_counterparties_count, sum(cur::DOUBLE ** 2) / nullif(sum(cur), 0)::DOUBLE ** 2 AS counterparty_concentration_index,
  sum(CASE WHEN NOT known THEN last30 ELSE 0 END) / nullif(sum(last30), 0)::DOUBLE AS new_counterparty_ratio_30d, sum(CASE WHEN prior_in THEN cin ELSE 0 END) / nullif(sum(cin), 0)::DOUBLE AS counterparty_persistence_ratio,
  count(*) FILTER (cin > greatest(0.005 * total, 50000) AND cout > greatest(0.005 * total, 50000)) AS circular_counterparty_count, sum(cur) / nullif(min(total), 0)::DOUBLE AS cp_coverage_share FROM kn GROUP BY 1),
ko AS (SELECT business_id, sum(CASE WHEN counterparty_type = 'financial_institution' THEN cents ELSE 0 END) AS fi_outflow_90, sum(CASE WHEN subfamily = 'LOAN' THEN cents ELSE 0 END) AS loan_outflow_90 FROM ct WHERE dbe < 90 AND direction = 'out' GROUP BY 1),
kc AS (SELECT business_id, max(c) / sum(c)::DOUBLE AS top_expense_category_share FROM (SELECT business_id, category, sum(cents) AS c FROM ct WHERE dbe < 90 AND direction = 'out' GROUP BY ALL) GROUP BY 1),
kp AS (SELECT business_id, count(DISTINCT date) AS prior_tx_days FROM ct WHERE dbe BETWEEN 90 AND 179 GROUP BY 1)
"""


@register(_CP_SQL + """SELECT kt.business_id, round(coalesce(cp_coverage_share, CASE WHEN total > 0 THEN 0 END), 6) AS cp_coverage_share, round(largest_single_source_ratio, 6) AS largest_single_source_ratio, coalesce(unique_counterparties_count, 0) AS unique_counterparties_count,
  round(counterparty_concentration_index, 6) AS counterparty_concentration_index, round(new_counterparty_ratio_30d, 6) AS new_counterparty_ratio_30d, round(counterparty_persistence_ratio, 6) AS counterparty_persistence_ratio,
  coalesce(circular_counterparty_count, 0) AS circular_counterparty_count, CAST(coalesce(fi_outflow_90, 0) AS BIGINT) AS fi_outflow_90, CAST(coalesce(loan_outflow_90, 0) AS BIGINT) AS loan_outflow_90, round(top_expense_category_share, 6) AS top_expense_category_share, prior_tx_days
  FROM kt LEFT JOIN kf USING (business_id) LEFT JOIN ko USING (business_id) LEFT JOIN kc USING (business_id) LEFT JOIN kp USING (business_id)""")
def profile_counterparties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.counterparty_features(L.clipped(L.transactions(spark, sf_dir), L.businesses(spark, sf_dir))))


@register("""o AS (SELECT obl.*, window_end, CASE frequency WHEN 'monthly' THEN 1.0::DOUBLE WHEN 'weekly' THEN 52.0::DOUBLE / 12 WHEN 'quarterly' THEN 1.0::DOUBLE / 3 WHEN 'one_off' THEN 0.0::DOUBLE END AS rate,
  status = 'active' AND (final_date IS NULL OR final_date > window_end) AS active FROM obl JOIN biz USING (business_id))
SELECT business_id, round(coalesce(sum(cents * rate / 100) FILTER (active), 0), 4) AS committed_monthly_outflow, round(coalesce(sum(cents * rate / 100) FILTER (active AND (final_date IS NULL OR final_date > window_end + 90)), 0), 4) AS committed_in_90d,
  round(coalesce(sum(cents * rate / 100) FILTER (active AND (final_date IS NULL OR final_date > window_end + 180)), 0), 4) AS committed_in_180d, round(max(final_date - window_end) FILTER (active) / 30.0::DOUBLE, 4) AS obligation_horizon_months,
  bool_or(final_date IS NOT NULL) AS any_final_known, count(*) FILTER (status = 'inactive' AND status_change_date <= window_end AND status_change_date > window_end - 90) AS mandate_cancellation_count_90d,
  round(coalesce(sum(greatest(final_cents - cents, 0)) FILTER (active AND final_cents IS NOT NULL), 0) / 100.0::DOUBLE, 4) AS balloon_exposure, round(sum(CASE WHEN rate IS NOT NULL THEN cents ELSE 0 END) FILTER (active) / sum(cents) FILTER (active)::DOUBLE, 4) AS obligation_frequency_coverage
  FROM o GROUP BY business_id""")
def profile_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.obligation_features(L.obligations(spark, sf_dir), L.businesses(spark, sf_dir)), 4)


@register(_DAILY_SQL + """,
s AS (SELECT business_id, max_by({'m': month_end, 'c': cash, 'i': inventory, 'r': receivables, 'p': payables, 's': short_term}, month_end) AS s FROM sheet JOIN biz USING (business_id) WHERE month_end <= window_end GROUP BY 1)
SELECT f.business_id, round(s.s.c / 100.0::DOUBLE, 2) AS cash_eom, round(s.s.i / 100.0::DOUBLE, 2) AS inventory_eom, round(s.s.r / 100.0::DOUBLE, 2) AS receivables_eom, round(s.s.p / 100.0::DOUBLE, 2) AS payables_eom, round(s.s.s / 100.0::DOUBLE, 2) AS short_term_liabilities_eom,
  round(s.s.r / 100.0::DOUBLE / greatest(m_in, 500) * 30, 4) AS days_sales_outstanding, round(s.s.i / 100.0::DOUBLE / greatest(m_out, 500) * 30, 4) AS days_inventory_outstanding, round(s.s.p / 100.0::DOUBLE / greatest(m_out, 500) * 30, 4) AS days_payables_outstanding,
  round(s.s.r / 100.0::DOUBLE / greatest(m_in, 500) * 30 + (s.s.i - s.s.p) / 100.0::DOUBLE / greatest(m_out, 500) * 30, 4) AS cash_conversion_cycle,
  CASE WHEN status = 'insufficient_data' THEN status WHEN s.s IS NULL THEN CASE WHEN data_source = 'external_real' THEN 'not_available_in_source' ELSE 'insufficient_history' END END AS reason FROM f LEFT JOIN s USING (business_id)""")
def profile_balance_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = P.daily_features(L.daily(spark, sf_dir)).select("business_id", "status", "data_source", "m_in", "m_out")
    s = f.join(P.balance_sheet_row(L.balance_sheets(spark, sf_dir), L.businesses(spark, sf_dir)), "business_id", "left")
    value = {"cash_eom": "cash / 100.0D", "inventory_eom": "inventory / 100.0D", "receivables_eom": "receivables / 100.0D", "payables_eom": "payables / 100.0D", "short_term_liabilities_eom": "short_term / 100.0D"}
    ratio = {"days_sales_outstanding": "receivables / 100.0D / greatest(m_in, 500.0D) * 30", "days_inventory_outstanding": "inventory / 100.0D / greatest(m_out, 500.0D) * 30", "days_payables_outstanding": "payables / 100.0D / greatest(m_out, 500.0D) * 30"}
    ratio["cash_conversion_cycle"] = f"{ratio['days_sales_outstanding']} + (inventory - payables) / 100.0D / greatest(m_out, 500.0D) * 30"
    reason = F.expr("case when status = 'insufficient_data' then status when month_end is null then if(data_source = 'external_real', 'not_available_in_source', 'insufficient_history') end")
    return s.select("business_id", *(F.round(F.expr(v), 2).alias(k) for k, v in value.items()), *(F.round(F.expr(v), 4).alias(k) for k, v in ratio.items()), reason.alias("reason"))


@register(_DAILY_SQL + """
SELECT f.business_id, CASE WHEN why IS NULL THEN round(drawn_cents / limit_cents::DOUBLE, 6) END AS facility_utilisation, CASE WHEN why IS NULL AND net30 < 0 THEN round(greatest(headroom_cents, 0) / 100.0::DOUBLE / greatest(-net30 / 100, 500 / 30.0::DOUBLE), 6) END AS headroom_days_of_burn,
  CASE WHEN why IS NULL THEN facility_type IN ('emergency', 'temporary') WHEN why = 'none' THEN FALSE END AS emergency_line_present, CASE WHEN why = 'none' THEN 'not_applicable' ELSE why END AS reason
  FROM (SELECT f.*, fac.* EXCLUDE (business_id), CASE WHEN status = 'insufficient_data' THEN status WHEN data_source = 'external_real' THEN 'not_available_in_source' WHEN facility_type IS NULL THEN 'not_applicable' WHEN facility_type = 'none' OR limit_cents <= 0 THEN 'none' END AS why
    FROM f LEFT JOIN fac USING (business_id)) f""")
def profile_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = P.daily_features(L.daily(spark, sf_dir)).select("business_id", "status", "data_source", "net30").join(L.facilities(spark, sf_dir), "business_id", "left")
    f = f.withColumn("why", F.expr("case when status = 'insufficient_data' then status when data_source = 'external_real' then 'not_available_in_source' when facility_type is null then 'not_applicable' when facility_type = 'none' or limit_cents <= 0 then 'none' end"))
    return f.select(
        "business_id", F.expr("if(why is null, round(drawn_cents / limit_cents, 6), null)").alias("facility_utilisation"), F.expr("if(why is null and net30 < 0, round(greatest(headroom_cents, 0) / 100.0D / greatest(-net30 / 100, 500.0D / 30), 6), null)").alias("headroom_days_of_burn"),
        F.expr("case when why is null then facility_type in ('emergency', 'temporary') when why = 'none' then false end").alias("emergency_line_present"), F.expr("if(why = 'none', 'not_applicable', why)").alias("reason"),
    )


def base_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily features with their reasons and arrays, joined with counterparty features (c_): computed once for all that reads them."""
    f = P.daily_features(L.daily(spark, sf_dir), arrays=True)
    c = P.counterparty_features(L.clipped(L.transactions(spark, sf_dir), L.businesses(spark, sf_dir))).withColumn("seen", F.lit(True))
    return saved(f.join(c.select("business_id", *(F.col(x).alias(f"c_{x}") for x in c.columns if x != "business_id")), "business_id", "left"))


def with_counterparties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily features and the concentration of counterparties with their reasons, a row for each business."""
    gate = ("status = 'insufficient_data'", "insufficient_data")
    return P.with_features(base_features(spark, sf_dir), {"counterparty_concentration_index": ("c_counterparty_concentration_index", gate, ("c_counterparty_concentration_index is null", "insufficient_events"))})


_Z_SQL = _DAILY_SQL + "," + _CP_SQL.strip() + """,
zf AS (SELECT f.*, CASE WHEN status <> 'insufficient_data' THEN kf.counterparty_concentration_index END AS counterparty_concentration_index,
  CASE WHEN status = 'insufficient_data' THEN status WHEN kf.counterparty_concentration_index IS NULL THEN 'insufficient_events' END AS counterparty_concentration_index__reason FROM f LEFT JOIN kf USING (business_id)),
zv AS (""" + " UNION ALL ".join(f"SELECT business_id, '{k}' AS feature, CAST({k} AS DOUBLE) AS value, {k}__reason AS base_reason FROM zf" for k in Z_BASES) + """),
zs AS (SELECT sector, feature, avg(value) AS mean, stddev_pop(value) AS std, count(value) AS n FROM zv JOIN biz USING (business_id) WHERE population = 'research' GROUP BY ALL)
"""


@register(_Z_SQL + "SELECT sector, feature, round(mean, 6) AS mean, round(std, 6) AS std, n FROM zs")
def reference_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.reference_stats(with_counterparties(spark, sf_dir), L.businesses(spark, sf_dir), Z_BASES))


@register(_Z_SQL + """, zr AS (SELECT business_id, feature, value, mean, std, CASE WHEN base_reason = 'insufficient_data' THEN base_reason WHEN sector = 'not_available_in_source' THEN sector WHEN coalesce(n, 0) = 0 THEN 'reference_stats_missing' WHEN value IS NULL THEN base_reason END AS reason
  FROM zv JOIN biz USING (business_id) LEFT JOIN zs USING (sector, feature))
SELECT business_id, feature, CASE WHEN reason IS NULL THEN round(greatest(-3, least(3, (value - mean) / greatest(std, 1e-9))), 6) END AS z, reason FROM zr""")
def sector_z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, biz = with_counterparties(spark, sf_dir), L.businesses(spark, sf_dir)
    return rounded(P.z_scores(f, biz, P.reference_stats(f, biz, Z_BASES), Z_BASES))
