"""The shared feature vector: daily, counterparty, obligation, balance sheet and facility features with their null reasons.

Inputs are ledger tables in cents; outputs are in currency units. Each feature is a value column named as in FEATURES and,
where it may be null, a reason column `<name>__reason`. The daily features take one exchange on business_id: windows,
then one aggregate whose ordered array of the trailing window serves the recursive ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extensions import Registry

EPS, CAP, MIN_HISTORY, MIN_COVERAGE = 500.0, 300.0, 180, 10
CUSUM_K, CUSUM_H = 0.5, 5.0


def _reason(value: str, *rules: tuple[str, str]) -> tuple[Column, Column]:
    """A value and its reason: the first rule that holds nulls the value and names why."""
    reason = F.expr("case " + " ".join(f"when {c} then '{r}'" for c, r in rules) + " end") if rules else F.lit(None).cast("string")
    return F.when(reason.isNull(), F.expr(value)), reason


def with_features(df: DataFrame, features: dict[str, tuple]) -> DataFrame:
    """df with a value and a reason column for each name -> (value, rules...)."""
    made = {}
    for name, (value, *rules) in features.items():
        made[name], made[f"{name}__reason"] = _reason(value, *rules)
    return df.withColumns(made)


#: What the one aggregate of a trailing window offers.
STATISTICS = {
    "history_days": "count(*)", "n": "count_if(cur)", "n_prior": "count_if(dbe between 90 and 179)", "coverage_days_90d": "count_if(cur and inflow_count + outflow_count > 0)",
    "sum_in": "sum(if(cur, inflow, 0))", "sum_out": "sum(if(cur, outflow, 0))", "sum_rec": "sum(if(cur, recurring, 0))", "cnt_in": "sum(if(cur, inflow_count, 0))", "cnt_out": "sum(if(cur, outflow_count, 0))",
    "prior_in": "sum(if(dbe between 90 and 179, inflow, 0))", "prior_out": "sum(if(dbe between 90 and 179, outflow, 0))",
    "prior_mean": "avg(if(dbe between 90 and 179, inflow, null))", "prior_sd": "stddev_pop(if(dbe between 90 and 179, inflow, null))",
    "in_days": "count_if(cur and inflow_count > 0)", "gap_mean": "avg(gap)", "gap_sd": "stddev_pop(gap)", "net_sd": "stddev_pop(if(cur, net, null))", "negative": "count_if(cur and eod < 0)", "islands": "count_if(opens)",
    "eod_mean": "avg(if(cur, eod, null))", "eod_min": "min(if(cur, eod, null))", "eod_last": "max_by(eod, date)", "net30": "avg(if(dbe < 30, net, null))",
    "slope": "regr_slope(if(dbe < 30, eod, null), if(dbe < 30, pos, null))", "n_op": "count_if(cur and not weekend)", "gaps_op": "count_if(cur and not weekend and inflow_count + outflow_count = 0)",
    "autocorr": "try_divide(covar_pop(net, net7), stddev_pop(if(net7 is null, null, net)) * stddev_pop(net7))", "pairs7": "count(net7)", "down2": "sum(if(cur and net < 0, pow(net / 100.0D, 2), 0.0D))", "up2": "sum(if(cur and net > 0, pow(net / 100.0D, 2), 0.0D))",
    "days": "array_sort(collect_list(if(cur, struct(date, inflow, outflow, recurring, net, eod), null)))",
}


def daily_stats(daily: DataFrame, names: set[str] | None = None) -> DataFrame:
    """A row for each business: sums over its trailing and prior 90 days and the ordered trailing window, or those named only."""
    over = "over (partition by business_id order by date"
    d = daily.withColumn("pos", F.expr(f"row_number() {over})")).withColumn("cur", F.expr("dbe < 90"))
    d = d.withColumn("seen", F.expr(f"last(if(cur and inflow_count > 0, pos, null), true) {over} rows between unbounded preceding and 1 preceding)"))
    d = d.withColumn("gap", F.expr("if(cur and inflow_count > 0, pos - seen, null)"))
    d = d.withColumn("net7", F.expr(f"if(dbe < 83, lag(net, 7) {over}), null)")).withColumn("opens", F.expr(f"cur and eod < 0 and not coalesce(if(dbe < 89, lag(eod) {over}) < 0, false), false)"))
    d = d.withColumn("weekend", F.expr("if(data_source = 'external_real', weekday(date) in (5, 6), weekday(date) in (4, 5))"))
    return d.groupBy("business_id", "window_end", "data_source").agg(*(F.expr(e).alias(k) for k, e in STATISTICS.items() if names is None or k in names))


def longest_run() -> Column:
    """The longest run of days with a negative balance, folded over the ordered window."""
    step = "(a, x) -> named_struct('run', if(x.eod < 0, a.run + 1, 0), 'best', greatest(a.best, if(x.eod < 0, a.run + 1, 0)))"
    return F.expr(f"aggregate(days, named_struct('run', 0, 'best', 0), {step}, a -> a.best)")


def cusum_recency() -> Column:
    """Days since the last two-sided CUSUM signal of inflow against the prior window's mean and deviation; null without one."""
    z = "try_divide(x.inflow - prior_mean, prior_sd)"
    up, down = f"greatest(0.0D, a.p + {z} - {CUSUM_K}D)", f"greatest(0.0D, a.q - {z} - {CUSUM_K}D)"
    hit = f"({up} > {CUSUM_H}D or {down} > {CUSUM_H}D)"
    step = f"(a, x) -> named_struct('p', if({hit}, 0.0D, {up}), 'q', if({hit}, 0.0D, {down}), 't', a.t + 1, 'last', if({hit}, a.t, a.last))"
    return F.expr(f"if(prior_sd > 0, aggregate(days, named_struct('p', 0.0D, 'q', 0.0D, 't', 0, 'last', -1), {step}, a -> if(a.last < 0, null, cast(size(days) - 1 - a.last as double))), null)")


def shock_absorption() -> Column:
    """The largest share of inflow and variable outflow that can go before the balance path turns negative, by twenty halvings."""
    path = lambda t: f"aggregate(days, named_struct('b', cast(days[0].eod - days[0].net as double), 'm', double('infinity')), (p, x) -> named_struct('b', p.b + (1 - {t}) * (x.inflow - x.outflow + x.recurring) - x.recurring, 'm', least(p.m, p.b + (1 - {t}) * (x.inflow - x.outflow + x.recurring) - x.recurring)), p -> p.m)"
    mid = "((s.lo + s.hi) / 2)"
    halve = f"aggregate(sequence(1, 20), named_struct('lo', 0.0D, 'hi', 1.0D), (s, i) -> if({path(mid)} >= 0, named_struct('lo', {mid}, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {mid})), s -> s.lo)"
    return F.expr(f"case when {path('0.0D')} < 0 then 0.0D when {path('1.0D')} >= 0 then 1.0D else {halve} end")


DAILY: dict[str, tuple] = {
    "avg_monthly_inflow": ("m_in",), "avg_monthly_outflow": ("m_out",),
    "inflow_count_per_month": ("cnt_in * 30.0D / n",), "outflow_count_per_month": ("cnt_out * 30.0D / n",),
    "inflow_regularity_score": ("greatest(0.0D, least(1.0D, 1 - gap_sd / greatest(gap_mean, 1e-9D)))", ("in_days < 3", "insufficient_events")),
    "revenue_growth_90d": (f"greatest(-{CAP}D, least({CAP}D, (m_in - p_in) / p_in * 100))", (f"history_days < {MIN_HISTORY} or n_prior < 90", "insufficient_history"), (f"p_in < {EPS}D", "near_zero_denominator")),
    "expense_growth_90d": (f"greatest(-{CAP}D, least({CAP}D, (m_out - p_out) / p_out * 100))", (f"history_days < {MIN_HISTORY} or n_prior < 90", "insufficient_history"), (f"p_out < {EPS}D", "near_zero_denominator")),
    "recurring_expense_ratio": ("sum_rec / sum_out", (f"sum_out < {EPS}D * 100", "near_zero_denominator")),
    "cash_flow_volatility": ("net_sd / 100",), "inflow_outflow_ratio": (f"m_in / greatest(m_out, {EPS}D)",),
    "days_negative_balance_90d": ("negative",), "overdraft_events_90d": ("islands",), "max_consecutive_overdraft_days": ("longest",),
    "volatility_index": (f"25 * (net_sd / 100 / (net_sd / 100 + greatest((m_in + m_out) / 30, {EPS}D / 30)) + greatest(0.0D, least(1.0D, 1 - m_in / greatest(m_out, {EPS}D))) + negative / n + least(1.0D, islands / 5.0D))",),
    "avg_daily_balance": ("eod_mean / 100",), "min_daily_balance": ("eod_min / 100.0D",),
    "runway_days_current_balance": ("greatest(eod_last, 0) / 100.0D / burn_floor", ("net30 >= 0", "not_applicable")),
    "runway_days_average_balance": ("greatest(eod_mean, 0.0D) / 100 / burn_floor", ("net30 >= 0", "not_applicable")),
    "liquidity_trend_slope": ("coalesce(slope, 0.0D) / 100",), "data_gap_ratio": ("if(n_op > 0, gaps_op / n_op, 0.0D)",),
    "inflow_break_recency_days": ("cusum", (f"history_days < {MIN_HISTORY} or n_prior < 90", "insufficient_history"), ("cusum is null", "no_break_detected")),
    "net_flow_autocorr_lag7": ("autocorr", ("n <= 9 or autocorr is null or isnan(autocorr)", "insufficient_events")),
    "downside_semideviation_90d": ("down",), "upside_semideviation_90d": ("up",), "flow_asymmetry_ratio": ("asym",),
    "installment_capacity": ("greatest(0.0D, m_in - m_out) * (1 - least(0.15D * asym, 0.5D))",), "revenue_shock_absorption_pct": ("shock",),
    "fixed_obligation_coverage_months": ("least(eod_mean / 100 / (sum_rec / sum_out * m_out), 24.0D)", (f"sum_out < {EPS}D * 100 or sum_rec / sum_out * m_out < {EPS}D", "near_zero_denominator")),
}


#: Columns made of statistics: what they read, and how.
DERIVED: dict[str, tuple] = {
    "longest": (("days",), longest_run), "cusum": (("days", "prior_mean", "prior_sd"), cusum_recency), "shock": (("days",), shock_absorption),
    "m_in": (("sum_in", "n"), "sum_in / 100.0D / (n / 30.0D)"), "m_out": (("sum_out", "n"), "sum_out / 100.0D / (n / 30.0D)"),
    "p_in": (("prior_in", "n_prior"), "if(n_prior > 0, prior_in / 100.0D / (n_prior / 30.0D), 0.0D)"), "p_out": (("prior_out", "n_prior"), "if(n_prior > 0, prior_out / 100.0D / (n_prior / 30.0D), 0.0D)"),
    "down": (("down2", "n"), "sqrt(down2 / greatest(n - 1, 1))"), "up": (("up2", "n"), "sqrt(up2 / greatest(n - 1, 1))"), "asym": (("down", "up"), f"down / greatest(up, {EPS}D / 30)"),
    "burn_floor": (("net30",), f"greatest(-net30 / 100, {EPS}D / 30)"),
}
#: Every daily feature; add() puts one beside them for all that computes or lists DAILY.
FEATURES = Registry(DAILY, lambda: {*STATISTICS, *DERIVED})
_ALWAYS = ("m_in", "m_out", "net30", "sum_rec", "coverage_days_90d", "history_days")


def _closed(names: set[str]) -> set[str]:
    """names and what derived columns among them read."""
    todo, out = list(names), set()
    while todo:
        name = todo.pop()
        if name not in out:
            out.add(name)
            todo += DERIVED.get(name, ((),))[0]
    return out


def daily_features(daily: DataFrame, min_coverage: int = MIN_COVERAGE, arrays: bool = False, names: list[str] | None = None) -> DataFrame:
    """business_id, status, coverage and history days, and the daily features; a business below the coverage gate has only its coverage. arrays: also the last net flows in order and the balance, for hazards. names: these features only, from a plan that gathers nothing else."""
    needed = None if names is None else _closed({*FEATURES.needs(names), *_ALWAYS, *(("days", "eod_last") if arrays else ())})
    return features_of(daily_stats(daily, needed), min_coverage, arrays, names)


def features_of(stats: DataFrame, min_coverage: int = MIN_COVERAGE, arrays: bool = False, names: list[str] | None = None) -> DataFrame:
    """The daily features from the statistics of a trailing window, however they were gathered."""
    needed = _closed({*FEATURES.needs(names), *_ALWAYS})
    s = stats
    for name, (_, made) in DERIVED.items():
        if name in needed and name not in stats.columns:
            s = s.withColumn(name, F.expr(made) if isinstance(made, str) else made())
    s = s.withColumn("status", F.expr(f"case when coverage_days_90d < {min_coverage} then 'insufficient_data' when history_days < {MIN_HISTORY} then 'partial_profile' else 'scored' end"))
    gate = ("status = 'insufficient_data'", "insufficient_data")
    for level in FEATURES.levels(names):
        s = with_features(s, {k: (DAILY[k][0], gate, *DAILY[k][1:]) for k in level})
    own = list(DAILY) if names is None else list(names)
    more = [F.expr("transform(days, x -> x.net)").alias("nets"), F.col("eod_last").alias("balance")] if arrays else []
    return s.select("business_id", "window_end", "data_source", "status", "coverage_days_90d", "history_days", "m_in", "m_out", "net30", "sum_rec", *own, *(f"{k}__reason" for k in own), *more)


def counterparty_features(clipped: DataFrame) -> DataFrame:
    """Concentration, novelty, persistence and circularity of counterparties, financing outflows, and the share of value with a counterparty. One aggregate by business and counterparty carries them all."""
    t = clipped
    by = t.groupBy("business_id", "counterparty_id").agg(*(F.expr(e).alias(k) for k, e in {
        "cur": "sum(if(dbe < 90, cents, 0))", "cur_n": "count_if(dbe < 90)", "cin": "sum(if(dbe < 90 and direction = 'in', cents, 0))", "cout": "sum(if(dbe < 90 and direction = 'out', cents, 0))",
        "last30": "sum(if(dbe < 30, cents, 0))", "known": "bool_or(dbe >= 30)", "prior_in": "bool_or(dbe between 90 and 179 and direction = 'in')",
        "fi": "sum(if(dbe < 90 and direction = 'out' and counterparty_type = 'financial_institution', cents, 0))", "loan": "sum(if(dbe < 90 and direction = 'out' and subfamily = 'LOAN', cents, 0))",
    }.items()))
    by = by.withColumn("total", F.expr("sum(cur) over (partition by business_id)")).withColumn("named", F.expr("counterparty_id is not null"))
    out = by.groupBy("business_id").agg(*(F.expr(e).alias(k) for k, e in {
        "cp_coverage_share": "try_divide(sum(if(named, cur, 0)), sum(cur))", "largest_single_source_ratio": "try_divide(max(if(named, cin, null)), sum(if(named, cin, 0)))", "unique_counterparties_count": "count_if(named and cur_n > 0)",
        "counterparty_concentration_index": "try_divide(sum(if(named, pow(double(cur), 2), 0.0D)), pow(double(sum(if(named, cur, 0))), 2))",
        "new_counterparty_ratio_30d": "try_divide(sum(if(named and not known, last30, 0)), sum(if(named, last30, 0)))", "counterparty_persistence_ratio": "try_divide(sum(if(named and prior_in, cin, 0)), sum(if(named, cin, 0)))",
        "circular_counterparty_count": "count_if(named and cin > greatest(0.005D * total, 50000) and cout > greatest(0.005D * total, 50000))", "fi_outflow_90": "sum(fi)", "loan_outflow_90": "sum(loan)",
    }.items()))
    days = t.where("dbe between 90 and 179").groupBy("business_id").agg(F.countDistinct("date").alias("prior_tx_days"))
    top = t.where("dbe < 90 and direction <> 'in'").groupBy("business_id", "category").agg(F.sum("cents").alias("c")).groupBy("business_id").agg((F.max("c") / F.sum("c")).alias("top_expense_category_share"))
    return out.join(top, "business_id", "left").join(days, "business_id", "left")


def obligation_features(obl: DataFrame, biz: DataFrame) -> DataFrame:
    """Committed outflow now and in 90 and 180 days, horizon, cancellations and balloons, for each business with obligations."""
    o = obl.join(biz.select("business_id", "window_end"), "business_id")
    o = o.withColumn("rate", F.expr("case frequency when 'monthly' then 1.0D when 'weekly' then 52.0D / 12 when 'quarterly' then 1.0D / 3 when 'one_off' then 0.0D end"))
    o = o.withColumn("active", F.expr("status = 'active' and (final_date is null or final_date > window_end)")).withColumn("monthly", F.expr("if(active, cents * rate / 100, null)"))
    return o.groupBy("business_id").agg(*(F.expr(e).alias(k) for k, e in {
        "committed_monthly_outflow": "coalesce(sum(monthly), 0.0D)", "committed_in_90d": "coalesce(sum(if(final_date is null or final_date > date_add(window_end, 90), monthly, null)), 0.0D)",
        "committed_in_180d": "coalesce(sum(if(final_date is null or final_date > date_add(window_end, 180), monthly, null)), 0.0D)",
        "obligation_horizon_months": "max(if(active, datediff(final_date, window_end), null)) / 30.0D", "any_final_known": "bool_or(final_date is not null)",
        "mandate_cancellation_count_90d": "count_if(status = 'inactive' and status_change_date <= window_end and status_change_date > date_sub(window_end, 90))",
        "balloon_exposure": "coalesce(sum(if(active and final_cents is not null, greatest(final_cents - cents, 0), 0)), 0) / 100.0D",
        "obligation_frequency_coverage": "try_divide(sum(if(active and rate is not null, cents, 0)), sum(if(active, cents, null)))",
    }.items()))


def balance_sheet_row(sheets: DataFrame, biz: DataFrame) -> DataFrame:
    """Each business's latest month end on or before its as-of date: an as-of join as one ordered maximum."""
    s = sheets.join(biz.select("business_id", "window_end"), "business_id").where("month_end <= window_end")
    return s.groupBy("business_id").agg(F.expr("max_by(struct(month_end, cash, inventory, receivables, payables, short_term), month_end)").alias("s")).select("business_id", "s.*")


def reference_stats(features: DataFrame, biz: DataFrame, names: list[str], population: str = "research") -> DataFrame:
    """(sector, feature, mean, std, n) over a population."""
    own = features.join(biz.where(F.col("population") == population).select("business_id", "sector"), "business_id")
    long = own.select("sector", *(F.col(c).cast("double") for c in names)).unpivot(["sector"], names, "feature", "value")
    return long.groupBy("sector", "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))


def z_scores(features: DataFrame, biz: DataFrame, stats: DataFrame, names: list[str], clip: float = 3.0) -> DataFrame:
    """(business_id, feature, z, reason): each value against its sector's pinned statistics, clipped."""
    own = features.join(biz.select("business_id", "sector"), "business_id").select("business_id", "sector", *(F.col(c).cast("double") for c in names), *(F.col(f"{c}__reason") for c in names))
    v = own.unpivot(["business_id", "sector"], names, "feature", "value")
    r = own.unpivot(["business_id"], [f"{c}__reason" for c in names], "feature", "base_reason").withColumn("feature", F.expr("replace(feature, '__reason', '')"))
    z = v.join(r, ["business_id", "feature"]).join(stats, ["sector", "feature"], "left")
    reason = F.expr("case when base_reason = 'insufficient_data' then base_reason when sector = 'not_available_in_source' then sector when coalesce(n, 0) = 0 then 'reference_stats_missing' when value is null then base_reason end")
    score = F.expr(f"greatest(-{clip}D, least({clip}D, (value - mean) / greatest(std, 1e-9D)))")
    return z.select("business_id", "feature", F.when(reason.isNull(), score).alias("z"), reason.alias("reason"))


REAL, SOURCE = "data_source = 'external_real'", "not_available_in_source"
_EVENTS = ("c_seen is null", "insufficient_events")
_UNBUILT = ((REAL, SOURCE), ("true", "not_implemented"))
_SHEET = ((f"s_month_end is null and {REAL}", SOURCE), ("s_month_end is null", "insufficient_history"))
_NO_OBLIGATIONS = ("o_seen is null", "not_applicable")
_FACILITY = ((REAL, SOURCE), ("k_facility_type is null", "not_applicable"), ("k_facility_type = 'none' or k_limit_cents <= 0", "not_applicable"))
_DSO, _DIO, _DPO = "s_receivables / 100.0D / greatest(m_in, 500.0D) * 30", "s_inventory / 100.0D / greatest(m_out, 500.0D) * 30", "s_payables / 100.0D / greatest(m_out, 500.0D) * 30"
#: What joins add to the daily features: value, then the rules that null it. c_ counterparties, o_ obligations, s_ balance sheet, k_ facility.
JOINED: dict[str, tuple] = {
    **{k: (f"c_{k}", _EVENTS, (f"c_{k} is null", "insufficient_events")) for k in ("largest_single_source_ratio", "top_expense_category_share", "unique_counterparties_count", "counterparty_concentration_index", "new_counterparty_ratio_30d", "circular_counterparty_count")},
    "counterparty_persistence_ratio": ("c_counterparty_persistence_ratio", _EVENTS, (f"history_days < {MIN_HISTORY} or coalesce(c_prior_tx_days, 0) < 1", "insufficient_history"), ("c_counterparty_persistence_ratio is null", "insufficient_events")),
    "financing_outflow_ratio": ("least(c_fi_outflow_90 / sum_rec, 1.0D)", _EVENTS, (f"sum_rec < {EPS}D * 100", "near_zero_denominator")),
    "financing_outflow_ratio_code": ("least(c_loan_outflow_90 / sum_rec, 1.0D)", _EVENTS, (f"sum_rec < {EPS}D * 100", "near_zero_denominator")),
    "declared_mcc_code": ("mcc", ("mcc is null", SOURCE)),
    "compliance_screen_status": ("screen_status",),
    "esg_proxy_score": ("cast(null as double)", *_UNBUILT), "governance_transparency_score": ("cast(null as double)", ("true", "not_implemented")),
    "nisab_threshold_met": ("cast(null as boolean)", *_UNBUILT), "hawl_completion_date": ("cast(null as date)", *_UNBUILT),
    **{f"{k}_eom": (f"s_{c} / 100.0D", *_SHEET) for k, c in (("cash", "cash"), ("inventory", "inventory"), ("receivables", "receivables"), ("payables", "payables"), ("short_term_liabilities", "short_term"))},
    "days_sales_outstanding": (_DSO, *_SHEET), "days_inventory_outstanding": (_DIO, *_SHEET), "days_payables_outstanding": (_DPO, *_SHEET), "cash_conversion_cycle": (f"{_DSO} + {_DIO} - {_DPO}", *_SHEET),
    "committed_monthly_outflow": ("coalesce(o_committed_monthly_outflow, 0.0D)",),
    "obligation_coverage_ratio": ("m_in / o_committed_monthly_outflow", _NO_OBLIGATIONS, (f"o_committed_monthly_outflow < {EPS}D", "near_zero_denominator")),
    "forward_coverage_ratio_3m": ("m_in / o_committed_in_90d", _NO_OBLIGATIONS, (f"o_committed_in_90d < {EPS}D", "near_zero_denominator")),
    "forward_coverage_ratio_6m": ("m_in / o_committed_in_180d", _NO_OBLIGATIONS, (f"o_committed_in_180d < {EPS}D", "near_zero_denominator")),
    "obligation_horizon_months": ("o_obligation_horizon_months", (f"(o_seen is null or not o_any_final_known) and {REAL}", SOURCE), ("o_obligation_horizon_months is null", "not_applicable")),
    "mandate_cancellation_count_90d": ("coalesce(o_mandate_cancellation_count_90d, 0)", (REAL, SOURCE)), "balloon_exposure": ("coalesce(o_balloon_exposure, 0.0D)", (REAL, SOURCE)),
    "facility_utilisation": ("k_drawn_cents / k_limit_cents", *_FACILITY), "headroom_days_of_burn": ("greatest(k_headroom_cents, 0) / 100.0D / greatest(-net30 / 100, 500.0D / 30)", *_FACILITY, ("net30 >= 0", "not_applicable")),
    "emergency_line_present": ("k_facility_type in ('emergency', 'temporary') and k_limit_cents > 0", *_FACILITY[:2]),
    **{f"liquidity_hazard_{h}d": (f"hazard_{h}d",) for h in (30, 60, 90)},
}


def season_rule(seasons: list[tuple[str, str]]) -> tuple:
    """The feature season_adjusted: whether the trailing window meets a season; null where the table has none of the year."""
    years = ", ".join(sorted({d[:4] for pair in seasons for d in pair}))
    met = " or ".join(f"(date'{a}' <= window_end and date'{b}' >= date_sub(window_end, 89))" for a, b in seasons)
    return met, (REAL, SOURCE), (f"year(window_end) not in ({years})", SOURCE)


def registry(base: DataFrame, biz: DataFrame, obligations: DataFrame, sheets: DataFrame, facilities: DataFrame, screens: DataFrame, hazards: DataFrame, stats: DataFrame, z_bases: list[str], seasons: list[tuple[str, str]]) -> DataFrame:
    """The whole vector, a value and a reason for each feature. base: daily features joined with counterparty features (c_); the others are keyed by business, stats by sector."""
    prefixed = lambda df, p: df.select("business_id", *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "business_id"))
    o = prefixed(obligations.withColumn("seen", F.lit(True)), "o")
    d = base.join(biz.select("business_id", "sector"), "business_id")
    for other in (o, prefixed(sheets, "s"), prefixed(facilities, "k"), screens.select("business_id", "mcc", "screen_status"), hazards):
        d = d.join(other, "business_id", "left")
    gate = ("status = 'insufficient_data'", "insufficient_data")
    d = with_features(d, {k: (v, gate, *rules) for k, (v, *rules) in {**JOINED, "season_adjusted": season_rule(seasons)}.items()})
    wide = stats.groupBy("sector").pivot("feature", z_bases).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))
    d = d.join(F.broadcast(wide), "sector", "left")  # a row for each sector
    z = {}
    for k in z_bases:
        reason = F.expr(f"case when {gate[0]} then '{gate[1]}' when sector = '{SOURCE}' then sector when {k}_mean is null then 'reference_stats_missing' when {k} is null then {k}__reason end")
        z[f"sector_relative_{k}_z"] = F.when(reason.isNull(), F.expr(f"greatest(-3.0D, least(3.0D, ({k} - {k}_mean) / greatest({k}_std, 1e-9D)))"))
        z[f"sector_relative_{k}_z__reason"] = reason
    d = d.withColumns(z)
    names = [*DAILY, *JOINED, "season_adjusted", *(f"sector_relative_{k}_z" for k in z_bases)]
    return d.select("business_id", "window_end", "status", "coverage_days_90d", "history_days", *(c for n in names for c in (n, f"{n}__reason")))
