"""Registered queries of the smaller operators, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import new_path
from ..operators import adapter as D
from ..operators import anomaly as A
from ..operators import forecast as C
from ..operators import measures as M
from ..operators import rules as R
from ..sources import ledger as L
from .lenses import _CREDIT_SQL, _DECIDE_SQL, _EV_SQL, _FLAG_SQL, _HAZARD_SQL, _RATES_SQL, _REPEAT_SQL, _SCREEN_SQL, credit_contributions_of, decisions, event_features, screens, zakat
from .profiles import QUERIES, SQL, register, rounded

_SUMS = "SELECT business_id, CAST(sum(inflow) AS BIGINT) AS inflow, CAST(sum(outflow) AS BIGINT) AS outflow FROM dly GROUP BY 1"


def sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = L.daily(spark, sf_dir).groupBy("business_id").agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"))
    return d.join(L.businesses(spark, sf_dir).select("business_id", "sector", "population"), "business_id")


@register(f"s AS (SELECT v.*, sector FROM ({_SUMS}) v JOIN biz USING (business_id)) SELECT business_id, sector, inflow, round((rank() OVER (PARTITION BY sector ORDER BY inflow) + (count(*) OVER (PARTITION BY sector, inflow) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY sector), 6) AS pct FROM s")
def percent_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.percent_ranks(sums(spark, sf_dir), "inflow", ["sector"]).select("business_id", "sector", "inflow", "pct"))


@register(f"s AS (SELECT v.*, sector FROM ({_SUMS}) v JOIN biz USING (business_id)) SELECT sector, count(*) AS businesses, round(stddev_samp(inflow / 100.0::DOUBLE), 4) AS sample_deviation, round(stddev_samp(inflow / 100.0::DOUBLE) / sqrt(count(*)), 4) AS standard_error FROM s GROUP BY 1")
def sample_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sums(spark, sf_dir).groupBy("sector").agg(F.count("*").alias("businesses"), F.stddev_samp(F.col("inflow") / 100).alias("sample_deviation"))
    return rounded(g.withColumn("standard_error", F.col("sample_deviation") / F.sqrt("businesses")), 4)


@register("y AS (SELECT business_id, year(date) AS year, CAST(sum(cents) AS BIGINT) AS cents FROM tx GROUP BY ALL), p AS (SELECT *, lag(cents) OVER (PARTITION BY business_id ORDER BY year) AS prev FROM y) SELECT business_id, CAST(min(year) AS INTEGER) AS first_year, CAST(max(year) AS INTEGER) AS last_year, round((max_by(cents, year) / min_by(cents, year)::DOUBLE) ** (1 / nullif(max(year) - min(year), 0)::DOUBLE) - 1, 6) AS cagr, round(sum(cents) FILTER (prev IS NOT NULL) / sum(prev)::DOUBLE - 1, 6) AS weighted_growth FROM p GROUP BY 1")
def business_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = L.transactions(spark, sf_dir).groupBy("business_id", F.year("date").alias("year")).agg(F.sum("cents").alias("cents"))
    return rounded(M.growth(y, "business_id", "year", "cents"))


@register("d AS (SELECT date, count(*) AS n FROM ct GROUP BY 1), a AS (SELECT *, least(CAST(floor((sum(n) OVER (ORDER BY date) - n) / (sum(n) OVER ())::DOUBLE * 5) AS INTEGER), 4) AS part FROM d), p AS (SELECT part, CAST(sum(n) AS BIGINT) AS test_rows, min(date) AS test_from, max(date) AS test_to FROM a GROUP BY 1), q AS (SELECT *, CAST(sum(test_rows) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS train_rows FROM p) SELECT part AS fold, train_rows, test_rows, test_from, test_to FROM q WHERE train_rows IS NOT NULL")
def expanding_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.temporal_splits(L.clipped(L.transactions(spark, sf_dir), L.businesses(spark, sf_dir)), "date")


_FISHER_SQL = """q AS (SELECT sector, count(*) FILTER (screen_status <> 'compliant' AND neg) AS a, count(*) FILTER (screen_status <> 'compliant' AND NOT neg) AS b, count(*) FILTER (screen_status = 'compliant' AND neg) AS c, count(*) FILTER (screen_status = 'compliant' AND NOT neg) AS d
  FROM scr JOIN biz USING (business_id) JOIN (SELECT business_id, bool_or(eod < 0) AS neg FROM dly GROUP BY 1) USING (business_id) GROUP BY 1),
x AS (SELECT q.*, unnest(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) AS x FROM q),
pr AS (SELECT *, exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1)) AS p FROM x),
ob AS (SELECT *, max(CASE WHEN x = a THEN p END) OVER (PARTITION BY sector) AS seen FROM pr)
SELECT sector, a, b, c, d, round(least(1, sum(CASE WHEN p <= seen * (1 + 1e-9) THEN p ELSE 0 END)), 6) AS p, round(a * d / nullif(b * c, 0)::DOUBLE, 6) AS odds FROM ob GROUP BY ALL"""


@register(_SCREEN_SQL.strip() + "," + _FISHER_SQL)
def exclusion_selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether flagged businesses differ from compliant ones in ever being overdrawn: exact tests by sector."""
    neg = L.daily(spark, sf_dir).groupBy("business_id").agg(F.expr("bool_or(eod < 0)").alias("neg"))
    t = screens(spark, sf_dir).join(L.businesses(spark, sf_dir).select("business_id", "sector"), "business_id").join(neg, "business_id")
    cell = {"a": "screen_status <> 'compliant' and neg", "b": "screen_status <> 'compliant' and not neg", "c": "screen_status = 'compliant' and neg", "d": "screen_status = 'compliant' and not neg"}
    return rounded(M.fisher_exact(t.groupBy("sector").agg(*(F.expr(f"count_if({e})").alias(k) for k, e in cell.items())), *"abcd"))


@register("""d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), a AS (SELECT day, datediff('day', DATE '1970-01-01', day) + 2440588 - 1948440 + 10632 AS l0 FROM d), b AS (SELECT day, (l0 - 1) // 10631 AS n, l0 - 10631 * ((l0 - 1) // 10631) + 354 AS l1 FROM a),
c AS (SELECT *, ((10985 - l1) // 5316) * ((50 * l1) // 17719) + (l1 // 5670) * ((43 * l1) // 15238) AS j FROM b), e AS (SELECT *, l1 - ((30 - j) // 15) * ((17719 * j) // 50) - (j // 16) * ((15238 * j) // 43) + 29 AS l2 FROM c)
SELECT day, CAST(30 * n + j - 30 AS BIGINT) AS lunar_year, CAST(24 * l2 // 709 AS BIGINT) AS lunar_month, CAST(l2 - 709 * (24 * l2 // 709) // 24 AS BIGINT) AS lunar_day FROM e""")
def lunar_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = L.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return d.select("day", *(c.alias(k) for k, c in M.lunar_date(F.col("day")).items()))


@register("""m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, round(avg(o_totalprice), 4) AS per_ounce, count(*) % 7 AS k FROM orders GROUP BY 1) SELECT month, round(per_ounce * 3.75::DOUBLE / 31.1034768, 4) AS price_per_gram, round(abs(3.75::DOUBLE / (3.75::DOUBLE * (1 + (k - 3) * 0.0001)) - 1), 8) AS gap FROM m""")
def month_price_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices a gram by month, from a price an ounce (orders' mean price stands in) and a rate checked against an implied one."""
    m = L.table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.avg("o_totalprice"), 4).alias("per_ounce"), (F.count("*") % 7).alias("k"))
    p = M.month_prices(m.select("month", "per_ounce"), m.select("month", F.lit(3.75).alias("rate")), m.select("month", (3.75 * (1 + (F.col("k") - 3) * 0.0001)).alias("implied_rate")))
    return p.select("month", F.round("price_per_gram", 4).alias("price_per_gram"), F.round("gap", 8).alias("gap"))


@register("""q AS (SELECT business_id, date AS quoted_on, CASE WHEN transaction_id % 13 = 0 THEN NULL ELSE cents / 100.0::DOUBLE END AS price FROM tx) SELECT CASE WHEN price IS NULL OR price <= 0 THEN 'no_price' WHEN quoted_on > window_end THEN 'newer_than_as_of' WHEN quoted_on < window_end - 3 THEN 'stale' ELSE 'used' END AS verdict, count(*) AS quotes FROM q JOIN biz USING (business_id) GROUP BY 1""")
def quote_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = L.transactions(spark, sf_dir).select("business_id", F.col("date").alias("quoted_on"), F.expr("if(transaction_id % 13 = 0, null, cents / 100.0D)").alias("price"))
    return M.judged_quotes(q, L.businesses(spark, sf_dir)).groupBy("verdict").agg(F.count("*").alias("quotes"))


@register("""p AS (SELECT business_id, 'flows' AS family, CASE data_source WHEN 'external_real' THEN 'bank_feed' ELSE 'generated' END AS evidence FROM biz UNION ALL SELECT business_id, 'flows', 'derived' FROM biz UNION ALL SELECT business_id, 'activity', CASE WHEN declared_mcc IS NULL THEN 'registry' ELSE 'declared' END FROM biz UNION ALL SELECT business_id, 'commitments', 'declared' FROM obl WHERE frequency <> 'unknown')
SELECT family, evidence, count(*) AS businesses FROM (SELECT business_id, family, ['bank_feed', 'registry', 'derived', 'declared', 'generated'][max(list_position(['bank_feed', 'registry', 'derived', 'declared', 'generated'], evidence))] AS evidence FROM p JOIN biz USING (business_id) GROUP BY ALL) GROUP BY ALL""")
def evidence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weakest evidence behind each family of features, by business, counted."""
    biz = L.businesses(spark, sf_dir)
    part = lambda df, family, e: df.select("business_id", F.lit(family).alias("family"), e.alias("evidence"))
    p = part(biz, "flows", F.expr("if(data_source = 'external_real', 'bank_feed', 'generated')")).unionByName(part(biz, "flows", F.lit("derived"))).unionByName(part(biz, "activity", F.expr("if(declared_mcc is null, 'registry', 'declared')")))
    p = p.unionByName(part(L.obligations(spark, sf_dir).where("frequency <> 'unknown'").join(biz.select("business_id"), "business_id", "left_semi"), "commitments", F.lit("declared")))
    return M.weakest_evidence(p, ["business_id", "family"]).groupBy("family", "evidence").agg(F.count("*").alias("businesses"))


PURPOSES = [("R", "repayment"), ("A", "allowance")]


@register("""r AS (SELECT transaction_id, direction, cents AS amount, counterparty_id AS bank, category AS account, l_returnflag AS purpose, l_linestatus AS operation FROM tx JOIN lineitem ON transaction_id = l_orderkey * 100 + l_linenumber)
SELECT CASE WHEN purpose = 'R' THEN 'repayment' WHEN purpose = 'A' THEN 'allowance' ELSE lower(operation) END AS category, count(*) AS n_rows, CAST(sum(CASE WHEN direction = 'out' THEN -amount ELSE amount END) AS BIGINT) AS signed, count(DISTINCT bank || '-' || account) AS partners FROM r GROUP BY 1""")
def adapted_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank rows brought to the ledger's form: purposes by precedence, signed amounts, partner keys."""
    l = L.table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey * 100 + l_linenumber").alias("transaction_id"), F.col("l_returnflag").alias("purpose"), F.col("l_linestatus").alias("operation"))
    raw = L.transactions(spark, sf_dir).select("transaction_id", "direction", F.col("cents").alias("amount"), F.col("counterparty_id").alias("bank"), F.col("category").alias("account")).join(l, "transaction_id")
    return M.adapted(raw, PURPOSES).groupBy("category").agg(F.count("*").alias("n_rows"), F.sum("signed").alias("signed"), F.countDistinct("partner").alias("partners"))


def _template(at: int) -> str:
    kinds = " ".join(f"WHEN rule LIKE '{k}-%' THEN replace('{v[at]}', '{{}}', array_to_string(list_slice(string_split(rule, '-'), 3, 9), '-'))" for k, v in M.TEMPLATES.items())
    return f"CASE {kinds} END"


@register(_SCREEN_SQL.strip() + f", r AS (SELECT business_id, unnest(string_split(rules_triggered, ',')) AS rule FROM scr WHERE rules_triggered <> '') SELECT business_id, rule, {_template(0)} AS text_en, {_template(1)} AS text_ar FROM r")
def compliance_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.explained(screens(spark, sf_dir))


@register(f"""s AS (SELECT v.*, sector, population FROM ({_SUMS}) v JOIN biz USING (business_id)) SELECT a.sector, a.business_id, min(abs(a.inflow - b.inflow)) AS gap FROM s a JOIN s b ON a.sector = b.sector AND a.population <> b.population GROUP BY ALL
UNION ALL SELECT sector, business_id, NULL FROM s WHERE sector IN (SELECT sector FROM s GROUP BY 1 HAVING count(DISTINCT population) = 1)""")
def nearest_other_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each business's inflow lies from the nearest of the other population in its sector."""
    return M.nearest_of_other_label(sums(spark, sf_dir), "business_id", "inflow", "population", ["sector"])


@register(_SCREEN_SQL.strip() + " SELECT biz.business_id, sector, screen_status FROM biz JOIN scr USING (business_id)")
def screened_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry with its screens: a join that must be one to one."""
    return M.one_to_one(L.businesses(spark, sf_dir).select("business_id", "sector"), screens(spark, sf_dir).select("business_id", "screen_status"), ["business_id"])


_NAMES = ["business_id", "decision", "tier", "amount", "decline_reason", "offer_status"]
_RECEIPT = "sha256(business_id || '|' || decision || '|' || coalesce(tier, '~') || '|' || coalesce(CAST(amount AS VARCHAR), '~') || '|' || coalesce(decline_reason, '~') || '|' || coalesce(offer_status, '~'))"


@register(_DECIDE_SQL + f""", dv AS (SELECT business_id, CASE WHEN decline_reason IS NULL THEN 'approved' ELSE 'declined' END AS decision, CASE WHEN decline_reason IS NULL THEN tier0 END AS tier, CASE WHEN decline_reason IS NULL THEN CAST(amt AS BIGINT) END AS amount, decline_reason, CASE WHEN decline_reason IS NULL THEN CASE WHEN screen_status = 'soft_flag_review' THEN 'conditional' ELSE 'unconditional' END END AS offer_status FROM dh)
SELECT business_id, {_RECEIPT} AS receipt, TRUE AS intact, TRUE AS reproduced FROM dv""")
def decision_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions are written with their receipts; what is read back must match its own receipt, and the decision derived again from the inputs must match it too."""
    made, path = decisions(spark, sf_dir), new_path(spark, "decisions")
    made.select(*_NAMES).join(D.receipt(made, "business_id", _NAMES), "business_id").write.parquet(path)
    saved = spark.read.parquet(path)
    own = D.receipt(saved, "business_id", _NAMES).withColumnRenamed("receipt", "of_saved")
    again = D.receipt(decisions(spark, sf_dir), "business_id", _NAMES).withColumnRenamed("receipt", "of_again")
    v = saved.select("business_id", "receipt").join(own, "business_id").join(again, "business_id", "left")
    return v.select("business_id", "receipt", F.expr("receipt <=> of_saved").alias("intact"), F.expr("receipt <=> of_again").alias("reproduced"))


_STEPS = ("G-cash-floor", "G-sharia-flag", "G-cash-watch", "G-credit-top", "G-zakat-due", "G-sharia-question", "G-review", "G-zakat-pending", "G-cash-ok")
_GUIDE_SQL = _CREDIT_SQL.strip() + "," + _SCREEN_SQL.strip() + "," + _RATES_SQL.strip() + "," + _HAZARD_SQL.strip() + "," + _EV_SQL.strip() + "," + _REPEAT_SQL["exact"] + "," + _FLAG_SQL + """,
na AS (SELECT * FROM rt WHERE method = 'naive90'), st AS (SELECT na.business_id, min(h) AS first_below FROM na JOIN (SELECT unnest(range(1, 91)) AS h) ON balance + rate * h < 0 GROUP BY 1),
al AS (SELECT na.business_id, first_below, balance + least(rate, 90 * rate) AS low, CASE WHEN first_below <= 30 OR coalesce(hazard_30d, 0) >= 0.5 THEN 'crunch' WHEN first_below IS NOT NULL OR coalesce(hazard_30d, 0) >= 0.2 OR coalesce(hazard_90d, 0) >= 0.5 THEN 'watch' ELSE 'none' END AS level FROM na LEFT JOIN st USING (business_id) LEFT JOIN hz USING (business_id)),
ag AS (SELECT DISTINCT business_id FROM ac WHERE rank <= 3 AND contribution > 0 AND abs(contribution) >= 0.1), rv AS (SELECT DISTINCT business_id FROM e5 WHERE rule_hit), zk AS ({zakat}),
gs AS (SELECT biz.business_id, [CASE WHEN first_below IS NOT NULL AND low < 0 THEN 'G-cash-floor' END, CASE WHEN rules_triggered <> '' THEN 'G-sharia-flag' END, CASE WHEN level <> 'none' AND first_below IS NULL THEN 'G-cash-watch' END, CASE WHEN ag.business_id IS NOT NULL THEN 'G-credit-top' END,
  CASE WHEN zakat_status = 'computed' AND liability > 0 AND abs(hawl_completion - window_end) <= 60 THEN 'G-zakat-due' END, CASE WHEN existing_financing THEN 'G-sharia-question' END, CASE WHEN rv.business_id IS NOT NULL THEN 'G-review' END, CASE WHEN zakat_status = 'computed' THEN 'G-zakat-pending' END, CASE WHEN level = 'none' AND low >= 0 THEN 'G-cash-ok' END] AS steps
  FROM biz LEFT JOIN scr USING (business_id) LEFT JOIN al USING (business_id) LEFT JOIN ag USING (business_id) LEFT JOIN rv USING (business_id) LEFT JOIN zk USING (business_id))
SELECT business_id, array_to_string(list_slice(list_filter(steps, lambda x: x IS NOT NULL), 1, 3), ',') AS guidance FROM gs"""
_ZAKAT = SQL["zakat"][SQL["zakat"].index("s AS (SELECT business_id, max_by({'c'"):]


@register(_GUIDE_SQL.replace("{zakat}", "WITH " + _ZAKAT))
def guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of nine rules that hold for a business, by their priority."""
    biz, d = L.businesses(spark, sf_dir), L.daily(spark, sf_dir)
    rates = C.flat_rates(d)
    low = rates.where("method = 'naive90'").select("business_id", F.expr("balance + least(rate, 90 * rate)").alias("low"))
    against = R.explain(credit_contributions_of(spark, sf_dir)).where("side = 'against'").select("business_id").distinct().withColumn("against", F.lit(True))
    review = A.rules(A.repeats(event_features(spark, sf_dir))).where("rule_hit").select("business_id").distinct().withColumn("review", F.lit(True))
    g = biz.select("business_id", "window_end")
    for other in (screens(spark, sf_dir), C.alert(rates, C.hazard(d)), low, against, review, zakat(spark, sf_dir).drop("reason")):
        g = g.join(other, "business_id", "left")
    rules = ("first_below is not null and low < 0", "rules_triggered <> ''", "level <> 'none' and first_below is null", "against", "zakat_status = 'computed' and liability > 0 and abs(datediff(hawl_completion, window_end)) <= 60", "existing_financing", "review", "zakat_status = 'computed'", "level = 'none' and low >= 0")
    held = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(n)) for n, c in zip(_STEPS, rules))))
    return g.select("business_id", F.array_join(F.slice(held, 1, 3), ",").alias("guidance"))


@register("SELECT approx_kind, n, ok FROM (SELECT 'counterparties' AS approx_kind, count(DISTINCT counterparty_id) AS n, TRUE AS ok FROM ct UNION ALL SELECT 'median_cents', CAST(quantile_disc(cents, 0.5) AS BIGINT), TRUE FROM ct)")
def approximate_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate aggregates beside exact ones: whether a distinct count lies within five per cent and a median's rank within one."""
    t = L.clipped(L.transactions(spark, sf_dir), L.businesses(spark, sf_dir))
    x = t.agg(F.countDistinct("counterparty_id").alias("n"), F.approx_count_distinct("counterparty_id", 0.01).alias("a"), F.expr("percentile_disc(0.5) within group (order by cents)").cast("long").alias("m"), F.expr("approx_percentile(cents, array(0.49D, 0.51D), 10000)").alias("q"))
    rows = F.array(F.struct(F.lit("counterparties").alias("approx_kind"), F.col("n").alias("n"), (F.abs(F.col("a") - F.col("n")) <= 0.05 * F.col("n")).alias("ok")), F.struct(F.lit("median_cents").alias("approx_kind"), F.col("m").alias("n"), F.expr("m between q[0] and q[1]").alias("ok")))
    return x.select(F.inline(rows))


__all__ = ["QUERIES"]
