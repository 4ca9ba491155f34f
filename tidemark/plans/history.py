"""The profile as of twelve dates and its SQL, which recomputes every date by itself from the days up to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import history as H
from ..operators.profile import DAILY
from ..sources import ledger as L
from .profiles import _DAILY_SQL, _INTS, _VALUES, QUERIES, SQL, rounded

#: Operating periods start so much earlier here that twelve windows of 90 days, 30 apart, and the 90 before the oldest are in the ledger of most businesses.
MORE_DAYS = 330

_POINTS = f"""
dp AS (SELECT business_id * 100 + k AS business_id, CAST(window_end - CAST(30 * k AS INTEGER) AS DATE) AS window_end, data_source, date, inflow, inflow_count, outflow, outflow_count, recurring, net, eod, dbe - CAST(30 * k AS INTEGER) AS dbe
  FROM dly, (SELECT unnest(range(0, {H.POINTS})) AS k) WHERE dbe >= 30 * k)"""
_COLUMNS = ", ".join(f"CAST({k} AS BIGINT) AS {k}" if k in _INTS else f"round(CAST({k} AS DOUBLE), 5) AS {k}" for k in _VALUES)


def history_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every daily feature and its reason, as of each business's last day and every 30 days before it, twelve points at most."""
    h = H.history(L.daily(spark, sf_dir, MORE_DAYS))
    casts = {c: h[c].cast("long") for c in _INTS}
    return rounded(h.withColumns(casts).select("business_id", "as_of", "status", "coverage_days_90d", "history_days", *DAILY, *(f"{k}__reason" for k in DAILY)), 5)


QUERIES["history_profile"] = history_profile
SQL["history_profile"] = f"""WITH RECURSIVE {L.sql(MORE_DAYS).strip()},
{_POINTS.strip()},
{_DAILY_SQL.replace("FROM dly", "FROM dp")}
SELECT CAST(business_id // 100 AS BIGINT) AS business_id, window_end AS as_of, status, coverage_days_90d, history_days, {_COLUMNS}, {", ".join(f"{k}__reason" for k in _VALUES)}
FROM f JOIN (SELECT business_id, n FROM b) USING (business_id) WHERE n = 90 AND status <> 'insufficient_data'"""
