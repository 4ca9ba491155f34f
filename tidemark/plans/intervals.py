"""Bootstrap intervals of rank correlations and of paired lead times, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import saved
from ..operators import resampling as B
from ..operators import stats as S
from ..sources import ledger as L
from .lenses import _LABEL_SQL, labelled
from .profiles import register, rounded

#: Weights of a table t's rows in each of 1,000 draws, as resampling.weights() reads them; {} is the seed.
_DRAWS = """cut AS (SELECT unnest([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]) AS c),
u AS (SELECT business_id, draw, CAST('0x' || substr(md5('{seed}|' || draw || '|' || business_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM (SELECT DISTINCT business_id FROM {rows}), (SELECT unnest(range(0, 1000)) AS draw)),
wt AS (SELECT business_id, draw, (SELECT count(*) FROM cut WHERE u >= c) AS w FROM u)"""


@register(_LABEL_SQL + ", sl AS (SELECT ll.*, sector FROM ll JOIN biz USING (business_id) WHERE score IS NOT NULL), " + _DRAWS.format(seed="rho", rows="sl") + """,
rr AS (SELECT sector, feature, draw, w, score, label, sum(w) OVER (PARTITION BY sector, feature, draw) AS total, sum(w) OVER (PARTITION BY sector, feature, draw ORDER BY score) - (sum(w) OVER (PARTITION BY sector, feature, draw, score) - 1) / 2.0::DOUBLE AS rx,
  sum(w) OVER (PARTITION BY sector, feature, draw ORDER BY label) - (sum(w) OVER (PARTITION BY sector, feature, draw, label) - 1) / 2.0::DOUBLE AS ry FROM sl JOIN wt USING (business_id) WHERE w > 0),
rz AS (SELECT sector, feature, draw, sum(w * (rx - (total + 1) / 2.0::DOUBLE) * (ry - (total + 1) / 2.0::DOUBLE)) / nullif(sqrt(sum(w * (rx - (total + 1) / 2.0::DOUBLE) ** 2) * sum(w * (ry - (total + 1) / 2.0::DOUBLE) ** 2)), 0) AS rho FROM rr GROUP BY ALL),
ro AS (SELECT sector, feature, quantile_cont(rho, 0.025) AS low, median(rho) AS mid, quantile_cont(rho, 0.975) AS high FROM rz WHERE rho IS NOT NULL GROUP BY ALL),
rk AS (SELECT sector, feature, rank() OVER (PARTITION BY sector, feature ORDER BY score) + (count(*) OVER (PARTITION BY sector, feature, score) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY sector, feature ORDER BY label) + (count(*) OVER (PARTITION BY sector, feature, label) - 1) / 2.0::DOUBLE AS b FROM sl),
rh AS (SELECT sector, feature, corr(a, b) AS rho, stddev_pop(a) * stddev_pop(b) AS spread FROM rk GROUP BY ALL)
SELECT sector, feature, CASE WHEN spread > 0 THEN round(rho, 6) END AS rho, round(low, 6) AS low, round(mid, 6) AS mid, round(high, 6) AS high FROM rh LEFT JOIN ro USING (sector, feature)""")
def feature_label_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inside each sector, the rank correlation of three features with the label and its bootstrap interval over businesses."""
    d = saved(labelled(spark, sf_dir).join(L.businesses(spark, sf_dir).select("business_id", "sector"), "business_id"))
    by = ["sector", "feature"]
    return rounded(S.spearman(d, "score", "label", by).join(B.spearman_interval(d, "score", "label", "business_id", by), by, "left"))


@register("""r AS (SELECT business_id, date, eod, avg(net) OVER (w ROWS 89 PRECEDING) AS r90, avg(net) OVER (w ROWS 29 PRECEDING) AS r30, count(*) OVER (w ROWS 89 PRECEDING) AS n, min(CASE WHEN eod < 0 THEN date END) OVER (PARTITION BY business_id) AS event FROM dly WINDOW w AS (PARTITION BY business_id ORDER BY date)),
e AS (SELECT business_id, event, min(date) FILTER (n = 90 AND date < event AND (eod + r90 < 0 OR eod + 30 * r90 < 0)) AS d90, min(date) FILTER (n = 90 AND date < event AND (eod + r30 < 0 OR eod + 30 * r30 < 0)) AS d30 FROM r WHERE event IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (n = 90 AND date <= event) > 0),
lt AS (SELECT business_id, population, (coalesce(event - d90, 0) - coalesce(event - d30, 0))::DOUBLE AS diff FROM e JOIN biz USING (business_id)), """ + _DRAWS.format(seed="lead", rows="lt") + """,
cw AS (SELECT population, draw, diff, sum(w) OVER (PARTITION BY population, draw ORDER BY diff) AS upto, sum(w) OVER (PARTITION BY population, draw) AS total FROM lt JOIN wt USING (business_id) WHERE w > 0),
md AS (SELECT population, draw, (min(diff) FILTER (upto > (total - 1) // 2) + min(diff) FILTER (upto > total // 2)) / 2 AS v FROM cw GROUP BY ALL),
iv AS (SELECT population, quantile_cont(v, 0.025) AS low, median(v) AS mid, quantile_cont(v, 0.975) AS high FROM md GROUP BY 1)
SELECT population, count(*) AS businesses, count(*) FILTER (diff > 0) AS earlier, count(*) FILTER (diff = 0) AS same_day, count(*) FILTER (diff < 0) AS later, median(diff) AS difference, low, mid, high FROM lt JOIN iv USING (population) GROUP BY population, low, mid, high""")
def lead_time_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many days earlier a projection of the 90-day rate than one of the 30-day rate sees the first negative balance coming (0 where one never does): paired by business, with the interval of the median difference."""
    own = "over (partition by business_id order by date rows"
    d = L.daily(spark, sf_dir).select(
        "business_id", "date", "eod", F.expr(f"avg(net) {own} 89 preceding)").alias("r90"), F.expr(f"avg(net) {own} 29 preceding)").alias("r30"), F.expr(f"count(*) {own} 89 preceding)").alias("n"), F.expr("min(if(eod < 0, date, null)) over (partition by business_id)").alias("event")).where("event is not null")
    seen = lambda r: F.expr(f"min(if(n = 90 and date < event and (eod + {r} < 0 or eod + 30 * {r} < 0), date, null))")
    e = d.groupBy("business_id", "event").agg(seen("r90").alias("d90"), seen("r30").alias("d30"), F.expr("count_if(n = 90 and date <= event)").alias("days")).where("days > 0")
    e = e.join(L.businesses(spark, sf_dir).select("business_id", "population"), "business_id")
    e = saved(e.withColumn("diff", F.expr("cast(coalesce(datediff(event, d90), 0) - coalesce(datediff(event, d30), 0) as double)")))
    g = e.groupBy("population").agg(F.count("*").alias("businesses"), F.expr("count_if(diff > 0)").alias("earlier"), F.expr("count_if(diff = 0)").alias("same_day"), F.expr("count_if(diff < 0)").alias("later"), F.expr("median(diff)").alias("difference"))
    return g.join(B.median_interval(e, "diff", "business_id", ["population"], seed="lead"), "population")
