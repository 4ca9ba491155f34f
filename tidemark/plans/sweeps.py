"""The sensitivity of four features to the constants in their formulas, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sweeps as W
from ..sources import ledger as L
from .profiles import register, rounded

#: Low, central and high settings.
PARAMETERS = {
    "ratio_floor": ([100, 500, 2500], "m_in / greatest(m_out, {v})"),
    "capacity_discount": ([0.05, 0.15, 0.3], "greatest(0.0D, m_in - m_out) * (1 - least({v} * down / greatest(up, 1.0D), 0.5D))"),
    "coverage_cap": ([2, 6, 24], "least(eod_mean / greatest(m_rec, 500.0D), {v})"),
    "burn_floor": ([100, 500, 2500], "greatest(eod_last, 0.0D) / greatest(-daily_net, {v} / 30)"),
}
_W = "dbe between 30 and 119"
_BASE = {
    "m_in": f"sum(if({_W}, inflow, 0)) / 300.0D", "m_out": f"sum(if({_W}, outflow, 0)) / 300.0D", "m_rec": f"sum(if({_W}, recurring, 0)) / 300.0D", "daily_net": f"avg(if({_W}, net, null)) / 100", "eod_mean": f"avg(if({_W}, eod, null)) / 100",
    "eod_last": "max(if(dbe = 30, eod, null)) / 100.0D", "down": f"sqrt(avg(if({_W}, pow(least(net, 0) / 100.0D, 2), null)))", "up": f"sqrt(avg(if({_W}, pow(greatest(net, 0) / 100.0D, 2), null)))",
    "label": "if(min(if(dbe < 30, eod, null)) < 0, 1, 0)", "pressure": f"round(-avg(if({_W}, eod, null)) / 100, 2)",
}


def _sql() -> str:
    base = {k: e.replace("D", "") for k, e in _BASE.items()}
    base = {k: e.replace("if(", "IF(").replace(" / 300.0", " / 300.0::DOUBLE").replace("/ 100.0", "/ 100.0::DOUBLE") for k, e in base.items()}
    values = [f"SELECT '{p}' AS parameter, {float(v)}::DOUBLE AS setting, label, pressure, round({f.replace('{v}', f'{float(v)}::DOUBLE').replace('0D', '0::DOUBLE').replace('5D', '5::DOUBLE')}, 6) AS value FROM sb" for p, (levels, f) in PARAMETERS.items() for v in levels]
    return f"""sb AS (SELECT business_id, {", ".join(f"{e} AS {k}" for k, e in base.items())} FROM dly GROUP BY 1),
sv AS ({" UNION ALL ".join(values)}),
rk AS (SELECT *, rank() OVER (PARTITION BY parameter, setting ORDER BY value) + (count(*) OVER (PARTITION BY parameter, setting, value) - 1) / 2.0::DOUBLE AS r FROM sv WHERE value IS NOT NULL),
rp AS (SELECT parameter, setting, rank() OVER (PARTITION BY parameter, setting ORDER BY value) + (count(*) OVER (PARTITION BY parameter, setting, value) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY parameter, setting ORDER BY pressure) + (count(*) OVER (PARTITION BY parameter, setting, pressure) - 1) / 2.0::DOUBLE AS b FROM sv WHERE value IS NOT NULL AND pressure IS NOT NULL),
rh AS (SELECT parameter, setting, corr(a, b) AS rho FROM rp GROUP BY ALL)
SELECT parameter, setting, count(*) AS n, round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / nullif(sum(label) * (count(*) - sum(label)), 0), 6) AS auc, round(any_value(rho), 6) AS rho, round(count(*) FILTER (value <> 0) / count(*)::DOUBLE, 6) AS nonzero_share FROM rk LEFT JOIN rh USING (parameter, setting) GROUP BY parameter, setting"""


@register(_sql())
def sensitivity_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three settings of four constants: how well the feature tells businesses that run short in the next 30 days, how it ranks with their pressure, and how often it isn't zero. The ledger is read once for all twelve."""
    base = L.daily(spark, sf_dir).groupBy("business_id").agg(*(F.expr(e).alias(k) for k, e in _BASE.items()))
    return rounded(W.sweep(base, PARAMETERS, "label", "pressure"))
