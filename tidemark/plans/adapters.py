"""Registered queries of the adapter, the generator and the reports, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import adapter as D
from ..operators import profile as P
from ..sources import ledger as L
from .lenses import _SCREEN_SQL, screens
from .profiles import _DAILY_SQL, _Z_SQL, QUERIES, SQL, Z_BASES, register, rounded, with_counterparties


@register("""p AS (SELECT business_id, eod, net, lag(eod) OVER (PARTITION BY business_id ORDER BY date) AS e FROM dly) SELECT business_id, count(e) AS pairs, count(*) FILTER (abs(eod - e - net) <> 0) AS broken, max(abs(eod - e - net)) AS worst FROM p WHERE e IS NOT NULL GROUP BY 1""")
def balance_chain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.balance_chain(L.daily(spark, sf_dir))


@register("""SELECT business_id, date, coalesce(last_value(CASE WHEN inflow_count + outflow_count > 0 THEN eod END IGNORE NULLS) OVER (PARTITION BY business_id ORDER BY date ROWS UNBOUNDED PRECEDING), opening_cents) AS balance, inflow_count + outflow_count > 0 AS verified FROM dly""")
def balances_forward_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.filled_balances(L.daily(spark, sf_dir))


@register("""d AS (SELECT DISTINCT business_id, counterparty_id, date FROM ct WHERE counterparty_id IS NOT NULL), g AS (SELECT business_id, counterparty_id, date - lag(date) OVER (PARTITION BY business_id, counterparty_id ORDER BY date) AS gap FROM d),
m AS (SELECT business_id, counterparty_id, count(*) AS executions, median(gap) AS median_gap FROM g GROUP BY ALL HAVING count(*) >= 2)
SELECT *, CASE WHEN median_gap BETWEEN 25 AND 35 THEN 'monthly' WHEN median_gap BETWEEN 5 AND 9 THEN 'weekly' WHEN median_gap BETWEEN 80 AND 100 THEN 'quarterly' ELSE 'unknown' END AS frequency FROM m""")
def payment_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = L.clipped(L.transactions(spark, sf_dir), L.businesses(spark, sf_dir)).where("counterparty_id is not null")
    return D.frequencies(t, ["business_id", "counterparty_id"])


@register("""s AS (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY date) AS place FROM dly),
m AS (SELECT business_id, net, coalesce(lead(date) OVER (PARTITION BY business_id ORDER BY date), window_end + 1) - date AS days FROM s WHERE place = 1 OR net <> 0)
SELECT business_id, count(*) FILTER (net <> 0) AS changes, CAST(sum(days) AS BIGINT) AS days_held, CAST(max(days) AS INTEGER) AS longest FROM m GROUP BY 1""")
def balance_held_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.held_days(L.daily(spark, sf_dir))


@register("""SELECT o.business_id, o.transaction_id AS out_id, i.transaction_id AS in_id FROM ct o JOIN ct i ON o.business_id = i.business_id AND o.direction = 'out' AND i.direction = 'in' AND o.cents // 100000 = i.cents // 100000 AND abs(o.date - i.date) <= 2""")
def transfer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = L.clipped(L.transactions(spark, sf_dir), L.businesses(spark, sf_dir))
    return D.band_pairs(t, F.expr("cents div 100000"), 2)


@register("""h AS (SELECT business_id, direction, cents, CASE WHEN direction = 'out' OR CAST('0x' || substr(md5(CAST(transaction_id AS VARCHAR)), 1, 4) AS INTEGER) % 4 = 0 THEN CASE WHEN direction = 'in' THEN 4 ELSE 1 END ELSE 0 END AS w FROM ct)
SELECT business_id, direction, CAST(sum(cents) AS BIGINT) AS whole, CAST(sum(cents * w) AS DOUBLE) AS estimated FROM h GROUP BY ALL""")
def thinning_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole totals beside those that a weighted quarter of the inflows estimates."""
    t = L.clipped(L.transactions(spark, sf_dir), L.businesses(spark, sf_dir))
    part = D.thinned(t, 4).groupBy("business_id", "direction").agg(F.expr("sum(cents * sample_weight)").alias("estimated"))
    return t.groupBy("business_id", "direction").agg(F.sum("cents").alias("whole")).join(part, ["business_id", "direction"], "left").fillna(0.0, ["estimated"])


@register("""k AS (SELECT business_id, counterparty_id, sum(cents) AS v FROM ct WHERE dbe < 90 AND counterparty_id IS NOT NULL GROUP BY ALL) SELECT business_id, round(sum(v::DOUBLE ** 2) / sum(v)::DOUBLE ** 2, 6) AS concentration, count(*) AS counterparties FROM k GROUP BY 1""")
def counterparties_from_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration read from pre-thinning totals: the same as from the whole stream."""
    w = D.windows_as_rows(D.counterparty_windows(L.clipped(L.transactions(spark, sf_dir), L.businesses(spark, sf_dir)))).where("dbe < 90")
    v = w.groupBy("business_id", "counterparty_id").agg(F.sum("cents").alias("v"))
    return rounded(v.groupBy("business_id").agg(F.expr("sum(pow(double(v), 2)) / pow(double(sum(v)), 2)").alias("concentration"), F.count("*").alias("counterparties")))


_REC = "sha256(business_id || '|' || screen_status || '|' || evidence_basis || '|' || coalesce(CAST(mcc AS VARCHAR), '~') || '|' || rules_triggered)"


@register(_SCREEN_SQL.strip() + f" SELECT business_id, {_REC} AS receipt FROM scr")
def decision_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.receipt(screens(spark, sf_dir), "business_id", ["business_id", "screen_status", "evidence_basis", "mcc", "rules_triggered"])


@register(_Z_SQL + """, cur AS (SELECT population, sector, feature, avg(value) AS m, count(value) AS n, count(*) FILTER (abs((value - mean) / greatest(std, 1e-9)) > 3) AS clipped FROM zv JOIN biz USING (business_id) JOIN zs USING (sector, feature) GROUP BY population, sector, feature, mean, std)
SELECT population, sector, feature, round(m - mean, 6) AS drift, cur.n, clipped FROM cur JOIN zs USING (sector, feature)""")
def reference_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned against current means by population, and how many values a clip would touch."""
    f, biz = with_counterparties(spark, sf_dir), L.businesses(spark, sf_dir)
    pins = P.reference_stats(f, biz, Z_BASES).drop("n")
    v = f.join(biz.select("business_id", "population", "sector"), "business_id").select("population", "sector", *(F.col(c).cast("double") for c in Z_BASES)).unpivot(["population", "sector"], Z_BASES, "feature", "value").join(pins, ["sector", "feature"])
    g = v.groupBy("population", "sector", "feature", "mean", "std").agg(F.avg("value").alias("m"), F.count("value").alias("n"), F.expr("count_if(abs((value - mean) / greatest(std, 1e-9D)) > 3)").alias("clipped"))
    return rounded(g.select("population", "sector", "feature", F.expr("m - mean").alias("drift"), "n", "clipped"))


@register(_DAILY_SQL + " SELECT status, feature, count(*) AS businesses, count(*) FILTER (reason IS NULL) AS present FROM (" + " UNION ALL ".join(f"SELECT status, '{k}' AS feature, {k}__reason AS reason FROM f" for k in P.DAILY) + ") GROUP BY ALL")
def feature_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many businesses of each status have each feature."""
    names = [f"{k}__reason" for k in P.DAILY]
    long = P.daily_features(L.daily(spark, sf_dir)).select("status", *names).unpivot(["status"], names, "feature", "reason").withColumn("feature", F.expr("replace(feature, '__reason', '')"))
    return long.groupBy("status", "feature").agg(F.count("*").alias("businesses"), F.expr("count_if(reason is null)").alias("present"))


@register("""SELECT sector, business_id, CAST(v AS BIGINT) AS inflow, CAST(k AS INTEGER) AS place FROM (SELECT sector, business_id, v, rank() OVER (PARTITION BY sector ORDER BY v DESC) AS k FROM (SELECT sector, business_id, sum(inflow) AS v FROM dly JOIN biz USING (business_id) GROUP BY ALL)) WHERE k <= 10""")
def top_businesses_by_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = L.daily(spark, sf_dir).groupBy("business_id").agg(F.sum("inflow").alias("inflow")).join(L.businesses(spark, sf_dir).select("business_id", "sector"), "business_id")
    return v.withColumn("place", F.rank().over(Window.partitionBy("sector").orderBy(F.desc("inflow")))).where("place <= 10")


@register("""SELECT business_id, sector FROM biz WHERE population = 'research' AND sector = 'retail_trade' ORDER BY business_id LIMIT 10 OFFSET 2""")
def paged_businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a filtered list: the limit is the feature."""
    return L.businesses(spark, sf_dir).where("population = 'research' and sector = 'retail_trade'").select("business_id", "sector").orderBy("business_id").offset(2).limit(10)


@register("""w AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem) SELECT CAST(date_trunc('week', d) AS DATE) AS week, count(*) AS days, round(avg(CASE WHEN d BETWEEN DATE '2000-11-27' AND DATE '2000-12-29' THEN 1.0 ELSE 0.0 END), 6) AS season_share FROM w GROUP BY 1""")
def season_share_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each week's days with rows that lie inside a season."""
    d = L.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    return rounded(d.groupBy(F.to_date(F.date_trunc("week", "d")).alias("week")).agg(F.count("*").alias("days"), F.avg(F.expr("if(d between date'2000-11-27' and date'2000-12-29', 1.0D, 0.0D)")).alias("season_share")))


@register("""a AS (SELECT business_id FROM biz), o AS (SELECT DISTINCT business_id FROM obl), f AS (SELECT business_id FROM fac)
SELECT 'both' AS kind, count(*) AS businesses FROM (SELECT * FROM o INTERSECT SELECT * FROM f) UNION ALL SELECT 'obligations_only', count(*) FROM (SELECT * FROM o EXCEPT SELECT * FROM f) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM o UNION SELECT * FROM f) UNION ALL SELECT 'neither', count(*) FROM (SELECT * FROM a EXCEPT (SELECT * FROM o UNION SELECT * FROM f))""")
def coverage_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda df: df.select("business_id").distinct()
    a, o, f = ids(L.businesses(spark, sf_dir)), ids(L.obligations(spark, sf_dir)), ids(L.facilities(spark, sf_dir))
    sets = {"both": o.intersect(f), "obligations_only": o.subtract(f), "either": o.union(f).distinct(), "neither": a.subtract(o.union(f))}
    out = None
    for kind, s in sets.items():
        one = s.agg(F.count("*").alias("businesses")).select(F.lit(kind).alias("kind"), "businesses")
        out = one if out is None else out.unionByName(one)
    return out


@register("""SELECT business_id, sector FROM biz WHERE CAST(business_id AS VARCHAR) LIKE '1%' ORDER BY business_id LIMIT 25""")
def businesses_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of the businesses whose number starts as asked: the limit is the feature."""
    return D.page(L.businesses(spark, sf_dir), "business_id", id_prefix="1", limit=25).select("business_id", "sector")


__all__ = ["QUERIES", "SQL"]
