"""Registered queries of the generator and its scenarios, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import generator as G
from ..sources import ledger as L
from .profiles import QUERIES, SQL, rounded


def _u(what: str, *keys: str) -> str:
    text = " || '|' || ".join((f"'{G.SEED}|{what}'", *keys))
    return f"((CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE)"


def _n(what: str, *keys: str) -> str:
    return f"(sqrt(-2 * ln({_u(what + '1', *keys)})) * cos(6.283185307179586 * {_u(what + '2', *keys)}))"


def _trait(t: str) -> str:
    return "list_sort([" + ", ".join(_u(f"{t}{k}", "business_id") for k in range(6)) + "])[2]"


_Z = f"({{t}} - {G.TRAIT_MEAN!r}) / {G.TRAIT_SD!r}"
_BAND = "(" + " + ".join(f"CASE WHEN {{x}} > {c} THEN 1 ELSE 0 END" for c in G.BANDS) + ")"
_SEEN = lambda t: f"({G.RHO} * {_Z.format(t=t)} + {(1 - G.RHO * G.RHO) ** 0.5!r} * {_n(t + '_seen', 'business_id')})"
_BIZ_SQL = f"""
g0 AS (SELECT s_suppkey AS business_id FROM supplier),
g1 AS (SELECT business_id, {_u('sector', 'business_id')} AS us, {_u('size', 'business_id')} AS uz, CAST(60 + floor(1940 * {_u('age', 'business_id')}) AS INTEGER) AS age_days, {_trait('resilience')} AS resilience, {_trait('discipline')} AS discipline FROM g0),
g2 AS (SELECT business_id, CASE WHEN us <= 0.3 THEN 'construction' WHEN us <= 0.5 THEN 'professional_services' WHEN us <= 0.75 THEN 'food_beverage' ELSE 'retail_trade' END AS sector, CASE WHEN uz <= 0.6 THEN 'small' WHEN uz <= 0.9 THEN 'medium' ELSE 'large' END AS size,
  CASE WHEN uz <= 0.6 THEN 1.0 WHEN uz <= 0.9 THEN 2.0 ELSE 4.0 END::DOUBLE AS rate, age_days, resilience, discipline, 1 / (1 + exp(2.0 + 1.2 * {_Z.format(t='resilience')} + 0.8 * {_Z.format(t='discipline')})) AS pd FROM g1),
gb AS (SELECT *, CASE WHEN {_u('label', 'business_id')} < pd THEN 1 ELSE 0 END AS label, {_BAND.format(x=_SEEN('resilience'))} AS resilience_band, {_BAND.format(x=_SEEN('discipline'))} AS discipline_band FROM g2)"""
_KEYS = ("scenario", "rate", "cost", "shock", "shock_from", "shock_days")
_RUN_SQL = _BIZ_SQL + """,
sn AS (SELECT * FROM (VALUES """ + ", ".join("(" + ", ".join(f"'{s[k]}'" if k == "scenario" else f"{s[k]}::DOUBLE" if k in ("rate", "cost", "shock") else str(s[k]) for k in _KEYS) + ")" for s in G.overlays()) + f""") t(scenario, srate, cost, shock, shock_from, shock_days)),
gd AS (SELECT business_id, rate, day, DATE '{G.START}' + CAST(day AS INTEGER) AS date, {G.SIGMA} * {_n('drift', 'business_id', 'day')} * {G.PHI}::DOUBLE ** (-day) AS e FROM gb, (SELECT unnest(range(0, {G.DAYS})) AS day)),
gx AS (SELECT *, sum(e) OVER (PARTITION BY business_id ORDER BY day ROWS UNBOUNDED PRECEDING) * {G.PHI}::DOUBLE ** day AS x FROM gd),
gl AS (SELECT scenario, cost, business_id, rate, day, date, rate * 1.5 * exp(x) * CASE WHEN isodow(date) IN (5, 6) THEN 0.6 ELSE 1 END * srate * CASE WHEN day >= shock_from AND day < shock_from + shock_days THEN shock ELSE 1 END AS lam, {_u('count', 'business_id', 'day')} AS u FROM gx, sn WHERE {{which}}),
gr AS (SELECT *, len(list_filter(range(0, {G.MOST} + 1), lambda k: u > list_sum(list_transform(range(0, k + 1), lambda j: exp(-lam + j * ln(lam) - lgamma(j + 1)))))) AS n FROM gl),
gk AS (SELECT scenario, business_id, day, k FROM gr, (SELECT unnest(range(1, {G.MOST} + 1)) AS k) WHERE k <= n),
gw AS (SELECT business_id, c, sum(w) OVER (PARTITION BY business_id ORDER BY c) AS cum, sum(w) OVER (PARTITION BY business_id) AS whole FROM (SELECT business_id, c, -ln({_u('share', 'business_id', 'c')}) AS w FROM g0, (SELECT unnest(range(1, {G.CUSTOMERS} + 1)) AS c))),
gt AS (SELECT scenario, gk.business_id, day, k, CAST(round(exp(4.0 + 0.5 * {_n('amount', 'gk.business_id', 'day', 'k')})) AS BIGINT) AS amount, 1 + (SELECT count(*) FROM gw WHERE gw.business_id = gk.business_id AND cum < {_u('customer', 'gk.business_id', 'day', 'k')} * whole) AS customer FROM gk),
gp AS (SELECT scenario, business_id, day, CASE day(date) WHEN 1 THEN 600 WHEN 27 THEN 900 WHEN 5 THEN 300 ELSE 0 END * rate AS recurring, round(cost * 55 * rate * (0.5 + {_u('costs', 'business_id', 'day')})) AS varying FROM gr)"""
_DAY_SQL = _RUN_SQL + """,
gi AS (SELECT scenario, business_id, day, sum(amount) AS inflow FROM gt GROUP BY ALL),
gn AS (SELECT gp.scenario, gp.business_id, gp.day, coalesce(inflow, 0) AS inflow, varying + recurring AS outflow, recurring, coalesce(inflow, 0) - varying - recurring AS net FROM gp LEFT JOIN gi ON gp.scenario = gi.scenario AND gp.business_id = gi.business_id AND gp.day = gi.day)"""


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("business_id"))


def generated_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated business for each supplier's id, with its latent traits, label and observables."""
    return rounded(G.businesses(_ids(spark, sf_dir)), 9)


SQL["generated_registry"] = "WITH " + _BIZ_SQL.strip() + " SELECT business_id, sector, size, rate, age_days, round(resilience, 9) AS resilience, round(discipline, 9) AS discipline, round(pd, 9) AS pd, label, resilience_band, discipline_band FROM gb"


def generated_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated ledgers, summed by business."""
    r = G.rates(G.businesses(_ids(spark, sf_dir)), G.overlays({"baseline": {}}))
    t = G.receipts(r).groupBy("business_id").agg(F.count("*").alias("sales"), F.sum("amount").alias("inflow"), F.countDistinct("customer").alias("customers"))
    p = G.payments(r).groupBy("business_id").agg(F.sum("amount").alias("outflow"), F.sum("recurring").alias("recurring"))
    return p.join(t, "business_id", "left").fillna(0)


SQL["generated_ledger"] = "WITH " + _RUN_SQL.replace("{which}", "scenario = 'baseline'").strip() + """ SELECT p.business_id, coalesce(sales, 0) AS sales, coalesce(inflow, 0) AS inflow, coalesce(customers, 0) AS customers, outflow, recurring FROM (SELECT business_id, CAST(sum(varying + recurring) AS BIGINT) AS outflow, CAST(sum(recurring) AS BIGINT) AS recurring FROM gp GROUP BY 1) p
LEFT JOIN (SELECT business_id, count(*) AS sales, CAST(sum(amount) AS BIGINT) AS inflow, count(DISTINCT customer) AS customers FROM gt GROUP BY 1) t USING (business_id)"""


def scenario_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scenario's flows, lowest cumulative balance and days below zero, by business."""
    d = G.daily(G.rates(G.businesses(_ids(spark, sf_dir)), G.overlays()))
    d = d.withColumn("at", F.expr("2000 + sum(net) over (partition by scenario, business_id order by day rows unbounded preceding)"))
    return d.groupBy("scenario", "business_id").agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"), F.min("at").alias("low"), F.expr("count_if(at < 0)").alias("days_below"))


SQL["scenario_runs"] = "WITH " + _DAY_SQL.replace("{which}", "TRUE").strip() + ", ga AS (SELECT *, 2000 + sum(net) OVER (PARTITION BY scenario, business_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS bal FROM gn) SELECT scenario, business_id, CAST(sum(inflow) AS BIGINT) AS inflow, CAST(sum(outflow) AS BIGINT) AS outflow, CAST(min(bal) AS BIGINT) AS low, count(*) FILTER (bal < 0) AS days_below FROM ga GROUP BY ALL"
QUERIES.update(generated_registry=generated_registry, generated_ledger=generated_ledger, scenario_runs=scenario_runs)

__all__ = ["QUERIES"]
