"""The flagship query: every feature of the registry with its reason, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import forecast as C
from ..operators import profile as P
from ..sources import ledger as L
from .lenses import _HAZARD_SQL, _SCREEN_SQL, screens
from .profiles import _CP_SQL, _REASON_SQL, _VALUES, _Z_SQL, QUERIES, Z_BASES, register, rounded, with_counterparties

#: Seasons by the calendar; a year without one in the table gives no answer.
SEASON_TABLE = [("2000-11-27", "2000-12-29")]

_REAL = "p.data_source = 'external_real'"
_SRC = "'not_available_in_source'"
_NOTX = "WHEN kt.business_id IS NULL THEN 'insufficient_events'"
_SHEET = f"WHEN s.s IS NULL THEN CASE WHEN {_REAL} THEN {_SRC} ELSE 'insufficient_history' END"
_UNBUILT = f"WHEN {_REAL} THEN {_SRC} ELSE 'not_implemented'"
_NOOBL = "WHEN o.business_id IS NULL THEN 'not_applicable'"
_FAC = f"WHEN {_REAL} THEN {_SRC} WHEN fac.facility_type IS NULL OR fac.facility_type = 'none' OR fac.limit_cents <= 0 THEN 'not_applicable'"
_IN, _OUT = "greatest(p.m_in, 500)", "greatest(p.m_out, 500)"
#: name: (value, reasons after the coverage gate), over p daily features, kf/ko/kc/kp counterparties, o obligations, s balance sheet, fac facility, scr screen, hz hazards.
_MORE = {
    "largest_single_source_ratio": ("kf.largest_single_source_ratio", f"{_NOTX} WHEN kf.largest_single_source_ratio IS NULL THEN 'insufficient_events'"),
    "top_expense_category_share": ("kc.top_expense_category_share", f"{_NOTX} WHEN kc.top_expense_category_share IS NULL THEN 'insufficient_events'"),
    "unique_counterparties_count": ("coalesce(kf.unique_counterparties_count, 0)", _NOTX),
    "counterparty_concentration_index": ("kf.counterparty_concentration_index", f"{_NOTX} WHEN kf.counterparty_concentration_index IS NULL THEN 'insufficient_events'"),
    "new_counterparty_ratio_30d": ("kf.new_counterparty_ratio_30d", f"{_NOTX} WHEN kf.new_counterparty_ratio_30d IS NULL THEN 'insufficient_events'"),
    "circular_counterparty_count": ("coalesce(kf.circular_counterparty_count, 0)", _NOTX),
    "counterparty_persistence_ratio": ("kf.counterparty_persistence_ratio", f"{_NOTX} WHEN p.history_days < 180 OR kp.prior_tx_days IS NULL THEN 'insufficient_history' WHEN kf.counterparty_persistence_ratio IS NULL THEN 'insufficient_events'"),
    "financing_outflow_ratio": ("least(coalesce(ko.fi_outflow_90, 0) / p.sum_rec::DOUBLE, 1)", f"{_NOTX} WHEN p.sum_rec < 50000 THEN 'near_zero_denominator'"),
    "financing_outflow_ratio_code": ("least(coalesce(ko.loan_outflow_90, 0) / p.sum_rec::DOUBLE, 1)", f"{_NOTX} WHEN p.sum_rec < 50000 THEN 'near_zero_denominator'"),
    "declared_mcc_code": ("scr.mcc", f"WHEN scr.mcc IS NULL THEN {_SRC}"), "compliance_screen_status": ("scr.screen_status", ""),
    "esg_proxy_score": ("NULL::DOUBLE", _UNBUILT), "governance_transparency_score": ("NULL::DOUBLE", "ELSE 'not_implemented'"), "nisab_threshold_met": ("NULL::BOOLEAN", _UNBUILT), "hawl_completion_date": ("NULL::DATE", _UNBUILT),
    "cash_eom": ("s.s.c / 100.0::DOUBLE", _SHEET), "inventory_eom": ("s.s.i / 100.0::DOUBLE", _SHEET), "receivables_eom": ("s.s.r / 100.0::DOUBLE", _SHEET), "payables_eom": ("s.s.p / 100.0::DOUBLE", _SHEET), "short_term_liabilities_eom": ("s.s.s / 100.0::DOUBLE", _SHEET),
    "days_sales_outstanding": (f"s.s.r / 100.0::DOUBLE / {_IN} * 30", _SHEET), "days_inventory_outstanding": (f"s.s.i / 100.0::DOUBLE / {_OUT} * 30", _SHEET), "days_payables_outstanding": (f"s.s.p / 100.0::DOUBLE / {_OUT} * 30", _SHEET),
    "cash_conversion_cycle": (f"s.s.r / 100.0::DOUBLE / {_IN} * 30 + (s.s.i - s.s.p) / 100.0::DOUBLE / {_OUT} * 30", _SHEET),
    "committed_monthly_outflow": ("coalesce(o.now, 0)", ""), "obligation_coverage_ratio": ("p.m_in / o.now", f"{_NOOBL} WHEN o.now < 500 THEN 'near_zero_denominator'"),
    "forward_coverage_ratio_3m": ("p.m_in / o.in90", f"{_NOOBL} WHEN o.in90 < 500 THEN 'near_zero_denominator'"), "forward_coverage_ratio_6m": ("p.m_in / o.in180", f"{_NOOBL} WHEN o.in180 < 500 THEN 'near_zero_denominator'"),
    "obligation_horizon_months": ("o.horizon", f"WHEN o.business_id IS NULL OR NOT o.known THEN CASE WHEN {_REAL} THEN {_SRC} ELSE 'not_applicable' END WHEN o.horizon IS NULL THEN 'not_applicable'"),
    "mandate_cancellation_count_90d": ("coalesce(o.cancelled, 0)", f"WHEN {_REAL} THEN {_SRC}"), "balloon_exposure": ("coalesce(o.balloon, 0)", f"WHEN {_REAL} THEN {_SRC}"),
    "facility_utilisation": ("fac.drawn_cents / fac.limit_cents::DOUBLE", _FAC), "headroom_days_of_burn": ("greatest(fac.headroom_cents, 0) / 100.0::DOUBLE / greatest(-p.net30 / 100, 500 / 30.0::DOUBLE)", f"{_FAC} WHEN p.net30 >= 0 THEN 'not_applicable'"),
    "emergency_line_present": ("fac.facility_type IN ('emergency', 'temporary') AND fac.limit_cents > 0", f"WHEN {_REAL} THEN {_SRC} WHEN fac.facility_type IS NULL THEN 'not_applicable'"),
    "liquidity_hazard_30d": ("hz.hazard_30d", ""), "liquidity_hazard_60d": ("hz.hazard_60d", ""), "liquidity_hazard_90d": ("hz.hazard_90d", ""),
    "season_adjusted": ("DATE '2000-11-27' <= p.window_end AND DATE '2000-12-29' >= p.window_end - 89", f"WHEN {_REAL} OR year(p.window_end) <> 2000 THEN {_SRC}"),
}
_WHOLE = {"unique_counterparties_count", "circular_counterparty_count", "mandate_cancellation_count_90d", "days_negative_balance_90d", "overdraft_events_90d", "max_consecutive_overdraft_days"}
_PLAIN = {"declared_mcc_code", "compliance_screen_status", "nisab_threshold_met", "hawl_completion_date", "emergency_line_present", "season_adjusted"}


def _column(name: str, value: str, reason: str) -> str:
    kept = f"CASE WHEN ({reason}) IS NULL THEN {value} END"
    kept = f"CAST({kept} AS BIGINT)" if name in _WHOLE else kept if name in _PLAIN else f"round(CAST({kept} AS DOUBLE), 5)"
    return f"{kept} AS {name}, {reason} AS {name}__reason"


_GATE = "CASE WHEN p.status = 'insufficient_data' THEN 'insufficient_data' {} END"
_COLUMNS = [_column(k, f"p.{k}", f"p.{k}__reason") for k in _VALUES] + [_column(k, v, _GATE.format(r)) for k, (v, r) in _MORE.items()]
for _k in Z_BASES:
    _COLUMNS.append(_column(f"sector_relative_{_k}_z", f"greatest(-3, least(3, (zb.{_k} - z_{_k}.mean) / greatest(z_{_k}.std, 1e-9)))", _GATE.format(f"WHEN biz.sector = {_SRC} THEN {_SRC} WHEN coalesce(z_{_k}.n, 0) = 0 THEN 'reference_stats_missing' WHEN zb.{_k} IS NULL THEN zb.{_k}__reason")))
_PROFILE_SQL = _Z_SQL.strip() + "," + _SCREEN_SQL.strip() + "," + _HAZARD_SQL.strip() + """,
ox AS (SELECT obl.*, window_end, CASE frequency WHEN 'monthly' THEN 1.0::DOUBLE WHEN 'weekly' THEN 52.0::DOUBLE / 12 WHEN 'quarterly' THEN 1.0::DOUBLE / 3 WHEN 'one_off' THEN 0.0::DOUBLE END AS rate, status = 'active' AND (final_date IS NULL OR final_date > window_end) AS active FROM obl JOIN biz USING (business_id)),
o AS (SELECT business_id, coalesce(sum(cents * rate / 100) FILTER (active), 0) AS now, coalesce(sum(cents * rate / 100) FILTER (active AND (final_date IS NULL OR final_date > window_end + 90)), 0) AS in90, coalesce(sum(cents * rate / 100) FILTER (active AND (final_date IS NULL OR final_date > window_end + 180)), 0) AS in180,
  max(final_date - window_end) FILTER (active) / 30.0::DOUBLE AS horizon, bool_or(final_date IS NOT NULL) AS known, count(*) FILTER (status = 'inactive' AND status_change_date <= window_end AND status_change_date > window_end - 90) AS cancelled,
  coalesce(sum(greatest(final_cents - cents, 0)) FILTER (active AND final_cents IS NOT NULL), 0) / 100.0::DOUBLE AS balloon FROM ox GROUP BY business_id),
s AS (SELECT business_id, max_by({'m': month_end, 'c': cash, 'i': inventory, 'r': receivables, 'p': payables, 's': short_term}, month_end) AS s FROM sheet JOIN biz USING (business_id) WHERE month_end <= window_end GROUP BY 1)
SELECT p.business_id, p.window_end, p.status, p.coverage_days_90d, p.history_days, """ + ", ".join(_COLUMNS) + """
FROM f p JOIN biz ON p.business_id = biz.business_id JOIN zf zb ON p.business_id = zb.business_id LEFT JOIN kt ON p.business_id = kt.business_id LEFT JOIN kf ON p.business_id = kf.business_id LEFT JOIN ko ON p.business_id = ko.business_id LEFT JOIN kc ON p.business_id = kc.business_id
LEFT JOIN kp ON p.business_id = kp.business_id LEFT JOIN o ON p.business_id = o.business_id LEFT JOIN s ON p.business_id = s.business_id LEFT JOIN fac ON p.business_id = fac.business_id LEFT JOIN scr ON p.business_id = scr.business_id LEFT JOIN hz ON p.business_id = hz.business_id
""" + "\n".join(f"LEFT JOIN (SELECT * FROM zs WHERE feature = '{k}') z_{k} ON biz.sector = z_{k}.sector" for k in Z_BASES)


@register(_PROFILE_SQL)
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole feature vector, a value and a reason for each feature, a row for each business."""
    biz, f = L.businesses(spark, sf_dir), with_counterparties(spark, sf_dir)
    base = f.drop("counterparty_concentration_index", "counterparty_concentration_index__reason")
    return rounded(P.registry(
        base, biz, P.obligation_features(L.obligations(spark, sf_dir), biz), P.balance_sheet_row(L.balance_sheets(spark, sf_dir), biz), L.facilities(spark, sf_dir), screens(spark, sf_dir),
        C.hazard_of(base.select("business_id", "nets", "balance")), P.reference_stats(f, biz, Z_BASES), Z_BASES, SEASON_TABLE), 5)


__all__ = ["QUERIES"]
