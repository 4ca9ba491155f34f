"""Ledger tables from the driver's star schema.

These are mappings, chosen to exercise every operator, not business facts: a supplier is a business, its line items are
its bank feed (amounts in whole cents, so that sums are exact), parts' brands are counterparties, orders give mandates,
and events are a second ledger with hours. Each function returns a DataFrame with the columns its name's contract lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF, TRAILING, HISTORY = "2000-12-31", 90, 180


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def businesses(spark: SparkSession, sf_dir: str, more_days: int = 0) -> DataFrame:
    """business_id, window_end, operating_start_date, data_source, sector, declared_mcc, population, opening_cents. more_days: by how much the operating period starts earlier."""
    s = table(spark, sf_dir, "supplier")
    end = F.expr(f"date_sub(date'{AS_OF}', cast(s_suppkey % 3 * 10 as int))")
    days = F.expr("case s_suppkey % 10 when 0 then 149 when 1 then 39 else 179 end")
    real = F.expr("s_suppkey % 7 = 0")
    sector = F.expr("element_at(array('construction', 'professional_services', 'food_beverage', 'retail_trade'), cast(s_nationkey % 4 + 1 as int))")
    return s.select(
        F.col("s_suppkey").alias("business_id"), end.alias("window_end"), F.date_sub(end, (days + more_days).cast("int")).alias("operating_start_date"),
        F.when(real, "external_real").otherwise("synthetic").alias("data_source"), F.when(real, "not_available_in_source").otherwise(sector).alias("sector"),
        F.expr("case s_suppkey % 6 when 0 then '5411' when 1 then '5813' when 2 then '5999' when 3 then '12a4' when 4 then ' 7995 ' end").alias("declared_mcc"),
        F.when(F.expr("s_suppkey % 4 = 3"), "serving").otherwise("research").alias("population"), F.expr("20 * cast(round(s_acctbal * 100) as bigint)").alias("opening_cents"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transaction_id, business_id, date, hour, direction, cents, counterparty_id, counterparty_type, category, subfamily, recurring, sample_weight."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_linestatus", "l_returnflag")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    out, bank = F.col("l_linestatus") == "F", F.col("p_brand").isin("Brand#1", "Brand#2")
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.expr("l_orderkey * 100 + l_linenumber").alias("transaction_id"), F.col("l_suppkey").alias("business_id"), F.to_date("l_shipdate").alias("date"),
        F.expr("cast(8 + l_orderkey % 12 as int)").alias("hour"), F.when(out, "out").otherwise("in").alias("direction"), F.expr("cast(round(l_extendedprice * 100) as bigint)").alias("cents"),
        F.when(~((F.col("p_brand") == "Brand#3") & (F.col("l_returnflag") == "N")), F.col("p_brand")).alias("counterparty_id"),
        F.when(bank, "financial_institution").when(out, "supplier").otherwise("customer").alias("counterparty_type"), F.col("p_type").alias("category"),
        F.when(bank & out & (F.col("l_returnflag") == "R"), "LOAN").otherwise("OTHR").alias("subfamily"), (out & (F.col("l_returnflag") == "R")).alias("recurring"), F.lit(1.0).alias("sample_weight"),
    )


def clipped(tx: DataFrame, biz: DataFrame) -> DataFrame:
    """Transactions inside each business's operating period, with dbe, the days before its as-of date."""
    b = biz.select("business_id", "window_end", "operating_start_date")
    return tx.join(b, "business_id").where("date between operating_start_date and window_end").withColumn("dbe", F.datediff("window_end", "date"))


def daily(spark: SparkSession, sf_dir: str, more_days: int = 0) -> DataFrame:
    """Every business on every day of its operating period: totals and counts by direction, recurring outflow, net flow and closing balance, in cents."""
    biz = businesses(spark, sf_dir, more_days)
    t = clipped(transactions(spark, sf_dir), biz)
    sums = t.groupBy("business_id", "date").agg(
        F.expr("sum(if(direction = 'in', cents, 0))").alias("inflow"), F.expr("count_if(direction = 'in')").alias("inflow_count"),
        F.expr("sum(if(direction = 'out', cents, 0))").alias("outflow"), F.expr("count_if(direction = 'out')").alias("outflow_count"), F.expr("sum(if(recurring, cents, 0))").alias("recurring"),
    )
    grid = biz.select("business_id", "window_end", "data_source", "opening_cents", F.explode(F.expr("sequence(operating_start_date, window_end, interval 1 day)")).alias("date"))
    names = ["inflow", "inflow_count", "outflow", "outflow_count", "recurring"]
    # the size of an exploded row isn't estimated: where a caller's filter makes this join an inner one, millions of days would be broadcast
    d = grid.hint("merge").join(sums, ["business_id", "date"], "left").fillna(0, names).withColumn("net", F.col("inflow") - F.col("outflow"))
    closing = F.expr("opening_cents + sum(net) over (partition by business_id order by date rows unbounded preceding)")
    return d.withColumn("eod", closing).withColumn("dbe", F.datediff("window_end", "date"))


def obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obligation_id, business_id, cents, frequency, status, final_date, final_cents, status_change_date, from orders, dealt over all businesses by customer."""
    o = table(spark, sf_dir, "orders")
    s = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first"))
    day = F.to_date("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("obligation_id"), (F.col("o_custkey") % s.select("n").scalar() + s.select("first").scalar()).alias("business_id"), F.expr("cast(round(o_totalprice * 100) as bigint)").alias("cents"),
        F.expr("case substring(o_orderpriority, 1, 1) when '1' then 'monthly' when '2' then 'weekly' when '3' then 'quarterly' when '4' then 'one_off' else 'unknown' end").alias("frequency"),
        F.when(F.col("o_orderstatus") == "P", "inactive").otherwise("active").alias("status"), F.when(F.expr("o_orderkey % 3 > 0"), F.date_add(day, 200)).alias("final_date"),
        F.when(F.expr("o_orderkey % 5 = 0"), F.expr("cast(round(o_totalprice * 100) as bigint) + (o_orderkey % 11 - 5) * 100000")).alias("final_cents"), F.when(F.col("o_orderstatus") == "P", F.date_add(day, 30)).alias("status_change_date"),
    )


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """business_id, facility_type (a quarter have none), limit_cents, drawn_cents, headroom_cents."""
    s = table(spark, sf_dir, "supplier")
    kind = F.expr("element_at(array('none', 'pre_agreed', 'emergency', 'temporary'), cast(s_suppkey % 4 + 1 as int))")
    limit = F.expr("(s_suppkey % 9) * 1000000")
    drawn = F.expr("cast(round(abs(s_acctbal) * 100) as bigint)")
    return s.select(F.col("s_suppkey").alias("business_id"), kind.alias("facility_type"), limit.alias("limit_cents"), drawn.alias("drawn_cents"), (limit - drawn).alias("headroom_cents"))


def balance_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """business_id, month_end and five end-of-month values in cents, from line items by month."""
    l = table(spark, sf_dir, "lineitem")
    c = F.expr("cast(round(l_extendedprice * 100) as bigint)")
    part = lambda flag, status: F.sum(F.when((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status), c).otherwise(0))
    return l.groupBy(F.col("l_suppkey").alias("business_id"), F.last_day("l_shipdate").alias("month_end")).agg(
        part("N", "O").alias("cash"), part("A", "O").alias("inventory"), part("R", "O").alias("receivables"), part("N", "F").alias("payables"), part("A", "F").alias("short_term"),
    )


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second ledger, with hours: transaction_id, business_id, date, hour, direction, cents, counterparty_id, category."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("transaction_id"), F.col("user_id").alias("business_id"), F.to_date("ts").alias("date"), F.hour("ts").alias("hour"),
        F.when(F.col("event_type").isin("purchase", "error"), "out").otherwise("in").alias("direction"), F.expr("cast(round(value * 100) as bigint)").alias("cents"),
        F.when(F.expr("event_id % 20 > 0"), F.get_json_object("props", "$.k")).alias("counterparty_id"), F.col("event_type").alias("category"),
    )


#: The same tables for DuckDB, as common table expressions.
SQL = r"""
biz AS (SELECT s_suppkey AS business_id, DATE '2000-12-31' - CAST(s_suppkey % 3 * 10 AS INTEGER) AS window_end,
  DATE '2000-12-31' - CAST(s_suppkey % 3 * 10 + CASE s_suppkey % 10 WHEN 0 THEN 149 WHEN 1 THEN 39 ELSE 179 END AS INTEGER) AS operating_start_date,
  CASE WHEN s_suppkey % 7 = 0 THEN 'external_real' ELSE 'synthetic' END AS data_source,
  CASE WHEN s_suppkey % 7 = 0 THEN 'not_available_in_source' ELSE ['construction', 'professional_services', 'food_beverage', 'retail_trade'][s_nationkey % 4 + 1] END AS sector,
  CASE s_suppkey % 6 WHEN 0 THEN '5411' WHEN 1 THEN '5813' WHEN 2 THEN '5999' WHEN 3 THEN '12a4' WHEN 4 THEN ' 7995 ' END AS declared_mcc,
  CASE WHEN s_suppkey % 4 = 3 THEN 'serving' ELSE 'research' END AS population, 20 * CAST(round(s_acctbal * 100) AS BIGINT) AS opening_cents FROM supplier),
tx AS (SELECT l_orderkey * 100 + l_linenumber AS transaction_id, l_suppkey AS business_id, CAST(l_shipdate AS DATE) AS date, CAST(8 + l_orderkey % 12 AS INTEGER) AS hour,
  CASE WHEN l_linestatus = 'F' THEN 'out' ELSE 'in' END AS direction, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
  CASE WHEN NOT (p_brand = 'Brand#3' AND l_returnflag = 'N') THEN p_brand END AS counterparty_id,
  CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'financial_institution' WHEN l_linestatus = 'F' THEN 'supplier' ELSE 'customer' END AS counterparty_type, p_type AS category,
  CASE WHEN p_brand IN ('Brand#1', 'Brand#2') AND l_linestatus = 'F' AND l_returnflag = 'R' THEN 'LOAN' ELSE 'OTHR' END AS subfamily, l_linestatus = 'F' AND l_returnflag = 'R' AS recurring
  FROM lineitem JOIN part ON l_partkey = p_partkey),
ct AS (SELECT tx.*, window_end, CAST(window_end - date AS INTEGER) AS dbe FROM tx JOIN biz USING (business_id) WHERE date BETWEEN operating_start_date AND window_end),
dsum AS (SELECT business_id, date, sum(CASE WHEN direction = 'in' THEN cents ELSE 0 END) AS inflow, count(*) FILTER (direction = 'in') AS inflow_count,
  sum(CASE WHEN direction = 'out' THEN cents ELSE 0 END) AS outflow, count(*) FILTER (direction = 'out') AS outflow_count, sum(CASE WHEN recurring THEN cents ELSE 0 END) AS recurring FROM ct GROUP BY ALL),
grid AS (SELECT business_id, window_end, data_source, opening_cents, CAST(unnest(generate_series(operating_start_date, window_end, INTERVAL 1 DAY)) AS DATE) AS date FROM biz),
dly AS (SELECT *, CAST(opening_cents + sum(net) OVER (PARTITION BY business_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS eod FROM (
  SELECT grid.business_id, grid.date, window_end, data_source, opening_cents, CAST(coalesce(inflow, 0) AS BIGINT) AS inflow, coalesce(inflow_count, 0) AS inflow_count,
    CAST(coalesce(outflow, 0) AS BIGINT) AS outflow, coalesce(outflow_count, 0) AS outflow_count, CAST(coalesce(recurring, 0) AS BIGINT) AS recurring,
    CAST(coalesce(inflow, 0) - coalesce(outflow, 0) AS BIGINT) AS net, CAST(window_end - grid.date AS INTEGER) AS dbe
  FROM grid LEFT JOIN dsum ON grid.business_id = dsum.business_id AND grid.date = dsum.date)),
obl AS (SELECT o_orderkey AS obligation_id, o_custkey % (SELECT count(*) FROM supplier) + (SELECT min(s_suppkey) FROM supplier) AS business_id, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'monthly' WHEN '2' THEN 'weekly' WHEN '3' THEN 'quarterly' WHEN '4' THEN 'one_off' ELSE 'unknown' END AS frequency,
  CASE WHEN o_orderstatus = 'P' THEN 'inactive' ELSE 'active' END AS status, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) + 200 END AS final_date,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) + (o_orderkey % 11 - 5) * 100000 END AS final_cents,
  CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS DATE) + 30 END AS status_change_date FROM orders),
fac AS (SELECT s_suppkey AS business_id, ['none', 'pre_agreed', 'emergency', 'temporary'][s_suppkey % 4 + 1] AS facility_type, (s_suppkey % 9) * 1000000 AS limit_cents,
  CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS drawn_cents, (s_suppkey % 9) * 1000000 - CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS headroom_cents FROM supplier),
sheet AS (SELECT l_suppkey AS business_id, last_day(l_shipdate) AS month_end,
  sum(CASE WHEN l_returnflag || l_linestatus = 'NO' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS cash, sum(CASE WHEN l_returnflag || l_linestatus = 'AO' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS inventory,
  sum(CASE WHEN l_returnflag || l_linestatus = 'RO' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS receivables, sum(CASE WHEN l_returnflag || l_linestatus = 'NF' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS payables,
  sum(CASE WHEN l_returnflag || l_linestatus = 'AF' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS short_term
  FROM lineitem GROUP BY ALL),
ev AS (SELECT event_id AS transaction_id, user_id AS business_id, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour,
  CASE WHEN event_type IN ('purchase', 'error') THEN 'out' ELSE 'in' END AS direction, CAST(round(value * 100) AS BIGINT) AS cents,
  CASE WHEN event_id % 20 > 0 THEN json_extract_string(props, '$.k') END AS counterparty_id, event_type AS category FROM events)
"""


def sql(more_days: int) -> str:
    """SQL with operating periods that start earlier."""
    days = "ELSE 179 END AS INTEGER) AS operating_start_date"
    return SQL.replace(days, f"ELSE 179 END + {more_days} AS INTEGER) AS operating_start_date")
