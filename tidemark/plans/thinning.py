"""The bias of a thinned ledger, a year left out of seasonality, reference numbers: with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adapter as D
from ..operators import thinning as T
from ..operators import verification as V
from ..sources import files
from ..sources import ledger as L
from .lenses import _DECIDE_SQL, decisions
from .measures import _NAMES, _RECEIPT
from .profiles import register, rounded

KEEP_ONE_IN = 4
_PICK = f"(direction = 'out' OR CAST('0x' || substr(md5(CAST(transaction_id AS VARCHAR)), 1, 4) AS INTEGER) % {KEEP_ONE_IN} = 0)"
_EDGE = "CASE WHEN dbe < 30 THEN 0 WHEN dbe < 90 THEN 30 ELSE 90 END"
_ROWS = {
    "whole": "SELECT business_id, counterparty_id, direction, dbe, cents FROM ct", "sampled": f"SELECT business_id, counterparty_id, direction, dbe, cents FROM ct WHERE {_PICK}",
    "weighted": f"SELECT business_id, counterparty_id, direction, dbe, CASE direction WHEN 'in' THEN {KEEP_ONE_IN} * cents ELSE cents END AS cents FROM ct WHERE {_PICK}",
    "windows": f"SELECT business_id, counterparty_id, direction, {_EDGE} AS dbe, sum(cents) AS cents FROM ct WHERE dbe < 180 GROUP BY ALL HAVING sum(cents) > 0",
}


def _features(name: str) -> str:
    return f"""SELECT '{name}' AS variant, business_id, max(cin) / nullif(sum(cin), 0)::DOUBLE AS largest_single_source_ratio, count(*) FILTER (n > 0)::DOUBLE AS unique_counterparties_count, sum(cur::DOUBLE ** 2) / nullif(sum(cur)::DOUBLE ** 2, 0) AS counterparty_concentration_index,
  sum(CASE WHEN NOT known THEN last30 ELSE 0 END) / nullif(sum(last30), 0)::DOUBLE AS new_counterparty_ratio_30d, sum(CASE WHEN before THEN cin ELSE 0 END) / nullif(sum(cin), 0)::DOUBLE AS counterparty_persistence_ratio
  FROM (SELECT business_id, counterparty_id, sum(CASE WHEN dbe < 90 THEN cents ELSE 0 END) AS cur, count(*) FILTER (dbe < 90) AS n, sum(CASE WHEN dbe < 90 AND direction = 'in' THEN cents ELSE 0 END) AS cin, sum(CASE WHEN dbe < 30 THEN cents ELSE 0 END) AS last30,
    bool_or(dbe >= 30) AS known, bool_or(dbe BETWEEN 90 AND 179 AND direction = 'in') AS before FROM ({_ROWS[name]}) WHERE counterparty_id IS NOT NULL GROUP BY ALL) GROUP BY business_id"""


@register("va AS (" + " UNION ALL ".join(map(_features, _ROWS)) + "),\nlo AS (" + " UNION ALL ".join(f"SELECT variant, business_id, '{f}' AS feature, {f} AS value FROM va" for f in T.FEATURES) + """),
er AS (SELECT a.feature, a.variant, round(abs(a.value - b.value), 9) AS error, round(a.value / nullif(b.value, 0), 9) AS ratio FROM lo a JOIN lo b ON a.business_id = b.business_id AND a.feature = b.feature AND b.variant = 'whole' WHERE a.variant <> 'whole' AND a.value IS NOT NULL AND b.value IS NOT NULL)
SELECT feature, variant, count(*) AS businesses, round(median(error), 6) AS median_error, round(median(ratio), 6) AS median_ratio FROM er GROUP BY ALL""")
def thinning_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five counterparty features from a quarter of the inflows, read as they are, weighted, or from windows totalled before thinning: median error and ratio against the whole ledger."""
    return rounded(T.bias(L.clipped(L.transactions(spark, sf_dir), L.businesses(spark, sf_dir)), KEEP_ONE_IN))


@register("""m AS (SELECT sector, month(date) AS month, sum(cents) AS cents FROM tx JOIN biz USING (business_id) WHERE direction = 'in' AND year(date) <> 1998 GROUP BY ALL)
SELECT sector, CAST(month AS INTEGER) AS month, round(cents / (sum(cents) OVER (PARTITION BY sector))::DOUBLE, 6) AS share FROM m""")
def monthly_shares_without_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months' shares of each sector's inflow, a year that isn't typical left out."""
    t = files.without_year(L.transactions(spark, sf_dir).where("direction = 'in'"), "date", 1998)
    m = t.join(L.businesses(spark, sf_dir).select("business_id", "sector"), "business_id").groupBy("sector", F.month("date").alias("month")).agg(F.sum("cents").alias("cents"))
    return rounded(m.select("sector", "month", F.expr("cents / double(sum(cents) over (partition by sector))").alias("share")))  # twelve rows a sector


@register(_DECIDE_SQL + f""", dv AS (SELECT business_id, CASE WHEN decline_reason IS NULL THEN 'approved' ELSE 'declined' END AS decision, CASE WHEN decline_reason IS NULL THEN tier0 END AS tier, CASE WHEN decline_reason IS NULL THEN CAST(amt AS BIGINT) END AS amount, decline_reason, CASE WHEN decline_reason IS NULL THEN CASE WHEN screen_status = 'soft_flag_review' THEN 'conditional' ELSE 'unconditional' END END AS offer_status FROM dh),
rc AS (SELECT business_id, {_RECEIPT} AS receipt FROM dv)
SELECT business_id, 'M-' || business_id || '-' || upper(substr(receipt, 1, 8)) AS reference, business_id % 3 <> 0 AS matches FROM rc""")
def reference_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number by which an owner quotes a decision, and whether one as typed (blanks, small letters; every third mistyped) names a decision that stands."""
    r = D.receipt(decisions(spark, sf_dir), "business_id", _NAMES)
    r = r.withColumn("reference", V.reference(F.col("business_id"), F.col("receipt")))
    typed = F.expr("concat(' ', lower(if(business_id % 3 = 0, concat(reference, '0'), reference)), ' ')")
    return V.matched_reference(r.withColumn("typed", typed), "typed", "business_id", "receipt").select("business_id", "reference", "matches")
