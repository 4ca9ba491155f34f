"""Registered queries of the analyses over the feature vector and the ledgers, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import saved
from ..operators import anomaly as A
from ..operators import forecast as C
from ..operators import profile as P
from ..operators import resampling as B
from ..operators import rules as R
from ..operators import stats as S
from ..sources import ledger as L
from .profiles import _DAILY_SQL, QUERIES, SQL, register, rounded

SEASONS = [("2024-01-10", "2024-01-14")]
HORIZONS = "(SELECT unnest([30, 60, 90]) AS horizon_days)"

_SCREEN_SQL = """
inc AS (SELECT business_id, sum(CASE WHEN direction = 'in' THEN cents ELSE 0 END) AS inflow, sum(CASE WHEN direction = 'in' AND counterparty_type = 'financial_institution' THEN cents ELSE 0 END) AS fi_in,
  bool_or(direction = 'out' AND counterparty_type = 'financial_institution') AS existing_financing FROM ct GROUP BY 1),
scr0 AS (SELECT biz.business_id, sector, CASE WHEN regexp_full_match(trim(declared_mcc), '[0-9]{4}') THEN CAST(trim(declared_mcc) AS INTEGER) END AS mcc, coalesce(CASE WHEN inflow > 0 THEN fi_in / inflow::DOUBLE ELSE 0 END, 0) AS fi_share, coalesce(existing_financing, FALSE) AS existing_financing
  FROM biz LEFT JOIN inc USING (business_id)),
scr1 AS (SELECT *, CASE WHEN mcc IN (5813, 5921, 7995, 7800, 7801, 7802, 7273) THEN 'hard_flag' WHEN mcc IN (5999, 5399, 5993, 6012, 6051, 7929, 8999) THEN 'soft_flag_review' WHEN mcc IS NOT NULL OR sector IN ('construction', 'professional_services', 'food_beverage') THEN 'compliant' ELSE 'soft_flag_review' END AS act FROM scr0),
scr AS (SELECT business_id, CASE WHEN act = 'hard_flag' THEN act WHEN act = 'soft_flag_review' OR fi_share >= 0.05 THEN 'soft_flag_review' ELSE 'compliant' END AS screen_status, CASE WHEN mcc IS NULL THEN 'registered_sector' ELSE 'declared_mcc' END AS evidence_basis, mcc, fi_share,
  concat_ws(',', CASE WHEN mcc IS NOT NULL AND act = 'hard_flag' THEN 'ACT-HARD-' || mcc WHEN mcc IS NOT NULL AND act = 'soft_flag_review' THEN 'ACT-SOFT-' || mcc WHEN mcc IS NULL AND act <> 'compliant' THEN 'ACT-NOMCC-' || sector END, CASE WHEN fi_share >= 0.05 THEN 'INC-FI-SHARE' END) AS rules_triggered, existing_financing FROM scr1)
"""


def screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    biz = L.businesses(spark, sf_dir)
    return R.screen(biz, L.clipped(L.transactions(spark, sf_dir), biz), R.rule_table(spark))


@register(_SCREEN_SQL.strip() + " SELECT business_id, screen_status, evidence_basis, mcc, round(fi_share, 6) AS fi_share, rules_triggered, existing_financing FROM scr")
def compliance_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(screens(spark, sf_dir))


@register(_SCREEN_SQL.strip() + " SELECT population, sector, count(*) FILTER (screen_status = 'compliant') AS compliant, count(*) FILTER (screen_status = 'soft_flag_review') AS soft_flag_review, count(*) FILTER (screen_status = 'hard_flag') AS hard_flag, round(count(*) FILTER (screen_status = 'compliant') / count(*)::DOUBLE, 6) AS compliant_share FROM scr JOIN biz USING (business_id) GROUP BY ALL")
def compliance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status counts by population and sector."""
    kinds = ["compliant", "soft_flag_review", "hard_flag"]
    s = screens(spark, sf_dir).join(L.businesses(spark, sf_dir).select("business_id", "population", "sector"), "business_id")
    p = s.groupBy("population", "sector").pivot("screen_status", kinds).count().fillna(0, kinds)
    return rounded(p.withColumn("compliant_share", F.expr("compliant / double(compliant + soft_flag_review + hard_flag)")))


@register(_SCREEN_SQL.strip() + " SELECT rule, count(*) AS businesses FROM (SELECT unnest(string_split(rules_triggered, ',')) AS rule FROM scr WHERE rules_triggered <> '') GROUP BY 1")
def compliance_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screens(spark, sf_dir).where("rules_triggered <> ''").select(F.explode(F.split("rules_triggered", ",")).alias("rule")).groupBy("rule").agg(F.count("*").alias("businesses"))


def prices(spark: SparkSession) -> DataFrame:
    """Price per gram by month, in currency units; a fixed small table."""
    return spark.createDataFrame([("2000-12", 520.5), ("2000-11", 498.25)], "month string, price_per_gram double")


@register("""s AS (SELECT business_id, max_by({'c': cash, 'i': inventory, 'r': receivables, 'p': payables, 's': short_term}, month_end) AS s FROM sheet JOIN biz USING (business_id) WHERE month_end <= window_end GROUP BY 1),
z AS (SELECT biz.business_id, window_end, s.s IS NULL AS no_sheet, (s.s.c + s.s.i + s.s.r - s.s.p - s.s.s) / 100.0::DOUBLE AS base, 85 * CASE strftime(window_end, '%Y-%m') WHEN '2000-12' THEN 520.5 WHEN '2000-11' THEN 498.25 END::DOUBLE AS nisab,
  window_end - CAST(300 + biz.business_id % 5 * 30 AS INTEGER) + 354 AS done, CASE WHEN biz.business_id % 6 <> 1 THEN opening_cents END AS opening FROM biz LEFT JOIN s USING (business_id)),
y AS (SELECT *, CASE WHEN no_sheet THEN 'no_balance_sheet_snapshot' WHEN nisab IS NULL THEN 'no_price' WHEN base < nisab THEN 'below_nisab' WHEN window_end < done THEN 'hawl_incomplete' WHEN opening IS NULL THEN 'hawl_incomplete' WHEN opening / 100.0::DOUBLE < nisab THEN 'below_nisab' END AS reason FROM z)
SELECT business_id, CASE WHEN reason IN ('no_balance_sheet_snapshot', 'no_price') THEN 'not_computed' WHEN reason IS NOT NULL THEN 'zero_liability' ELSE 'computed' END AS zakat_status, reason, round(base, 2) AS zakat_base, round(nisab, 2) AS nisab_value, done AS hawl_completion, round(CASE WHEN reason IS NULL THEN base * 0.025 ELSE 0 END, 2) AS liability FROM y""")
def zakat(spark: SparkSession, sf_dir: str) -> DataFrame:
    biz = L.businesses(spark, sf_dir)
    spine = biz.select("business_id", "window_end", F.expr("date_sub(window_end, cast(300 + business_id % 5 * 30 as int))").alias("hawl_start"), F.expr("if(business_id % 6 <> 1, opening_cents, null)").alias("opening_cents"))
    return R.zakat(spine, P.balance_sheet_row(L.balance_sheets(spark, sf_dir), biz), prices(spark))


_RATES_SQL = """
fr AS (SELECT business_id, max_by(eod, date) AS balance, avg(net) FILTER (dbe < 30) AS naive30, avg(net) FILTER (dbe < 90) AS naive90, sum(net * 0.5::DOUBLE ** (dbe / 21.0::DOUBLE)) FILTER (dbe < 90) / sum(0.5::DOUBLE ** (dbe / 21.0::DOUBLE)) FILTER (dbe < 90) AS ewma FROM dly GROUP BY 1 HAVING count(*) >= 30),
rt AS (SELECT business_id, balance, 'naive30' AS method, naive30 AS rate FROM fr UNION ALL SELECT business_id, balance, 'naive90', naive90 FROM fr UNION ALL SELECT business_id, balance, 'ewma', ewma FROM fr UNION ALL SELECT business_id, balance, 'blend', 0.5 * naive30 + 0.5 * naive90 FROM fr)
"""


@register(_RATES_SQL.strip() + f" SELECT business_id, method, horizon_days, round(rate * horizon_days / 100, 4) AS flow, round((balance + rate * horizon_days) / 100, 4) AS projected, round((balance + least(rate, rate * horizon_days)) / 100, 4) AS low FROM rt, {HORIZONS}")
def forecast_flat_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.flat_paths(C.flat_rates(L.daily(spark, sf_dir)))
    return rounded(p.select("business_id", "method", "horizon_days", (F.col("flow") / 100).alias("flow"), (F.col("end") / 100).alias("projected"), (F.col("low") / 100).alias("low")), 4)


@register("""d AS (SELECT *, net + recurring AS plain FROM dly WHERE dbe < 90), lv AS (SELECT business_id, window_end, avg(plain) FILTER (dbe < 30) AS level, avg(plain) AS mean, max_by(eod, date) AS balance, count(*) FILTER (dbe < 30) AS n30 FROM d GROUP BY ALL),
dw AS (SELECT business_id, isodow(date) AS dow, avg(plain) AS m FROM d GROUP BY ALL),
ah AS (SELECT lv.*, day, (day - 1) % n30 AS place, isodow(window_end + CAST(day AS INTEGER)) AS dow FROM lv, (SELECT unnest(range(1, 91)) AS day)),
pa AS (SELECT ah.business_id, day, balance + sum(level + coalesce(m - mean, 0) - recurring) OVER (PARTITION BY ah.business_id ORDER BY day) AS pos, level + coalesce(m - mean, 0) - recurring AS net
  FROM ah LEFT JOIN dw ON ah.business_id = dw.business_id AND ah.dow = dw.dow JOIN d ON d.business_id = ah.business_id AND n30 - 1 - d.dbe = place AND d.dbe < 30)
SELECT business_id, horizon_days, round(sum(net) / 100, 4) AS flow, round(max_by(pos, day) / 100, 4) AS projected, round(min(pos) / 100, 4) AS low, CAST(min(day) FILTER (pos < 0) AS INTEGER) AS first_below FROM pa JOIN """ + HORIZONS + """ h ON day <= horizon_days GROUP BY ALL""")
def forecast_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.path_summary(C.structural_path(L.daily(spark, sf_dir)))
    return rounded(p.select("business_id", "horizon_days", (F.col("flow") / 100).alias("flow"), (F.col("end") / 100).alias("projected"), (F.col("low") / 100).alias("low"), "first_below"), 4)


_OLS_SQL = """
od AS (SELECT business_id, window_end, date, net, eod, -dbe::DOUBLE AS t, isodow(date) AS dow FROM dly WHERE dbe < 90),
om AS (SELECT *, t - avg(t) OVER w AS dt, net - avg(net) OVER w AS dy FROM od WINDOW w AS (PARTITION BY business_id, dow)),
os AS (SELECT business_id, coalesce(sum(dt * dy) / nullif(sum(dt * dt), 0), 0) AS slope, count(*) AS days, max_by(eod, date) AS balance, max(window_end) AS window_end FROM om GROUP BY 1 HAVING count(*) >= 30),
ow AS (SELECT business_id, dow, avg(t) AS t0, avg(net) AS y0 FROM od GROUP BY ALL),
oh AS (SELECT os.*, day, isodow(window_end + CAST(day AS INTEGER)) AS dow FROM os, (SELECT unnest(range(1, 91)) AS day)),
op AS (SELECT oh.business_id, day, coalesce(y0, 0) + slope * (0.5 * day - coalesce(t0, 0)) AS net, balance + sum(coalesce(y0, 0) + slope * (0.5 * day - coalesce(t0, 0))) OVER (PARTITION BY oh.business_id ORDER BY day) AS pos FROM oh LEFT JOIN ow ON oh.business_id = ow.business_id AND oh.dow = ow.dow)
"""


@register(_OLS_SQL + """SELECT business_id, horizon_days, round(sum(net) / 100, 4) AS flow, round(max_by(pos, day) / 100, 4) AS projected, round(min(pos) / 100, 4) AS low, CAST(min(day) FILTER (pos < 0) AS INTEGER) AS first_below FROM op JOIN """ + HORIZONS + """ h ON day <= horizon_days GROUP BY ALL""")
def forecast_ols_damped(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.path_summary(C.ols_damped_path(L.daily(spark, sf_dir)))
    return rounded(p.select("business_id", "horizon_days", (F.col("flow") / 100).alias("flow"), (F.col("end") / 100).alias("projected"), (F.col("low") / 100).alias("low"), "first_below"), 4)


_HAZARD_SQL = """
hn AS (SELECT business_id, list(net ORDER BY date) AS nets, max_by(eod, date) AS balance FROM dly WHERE dbe < 90 GROUP BY 1),
hs AS (SELECT business_id, nets, balance, sim, j, CAST('0x' || substr(sha256('0|' || business_id || '|' || sim), CAST(1 + 4 * j AS INTEGER), 4) AS BIGINT) % greatest(len(nets) - 7, 1) AS i FROM hn, (SELECT unnest(range(0, 500)) AS sim), (SELECT unnest(range(0, 13)) AS j)),
hd AS (SELECT business_id, sim, 7 * j + k AS day, balance, nets[least(i + k, len(nets) - 1) + 1] AS net FROM hs, (SELECT unnest(range(0, 7)) AS k) WHERE 7 * j + k < 90),
hp AS (SELECT business_id, sim, day, balance + sum(net) OVER (PARTITION BY business_id, sim ORDER BY day) AS pos FROM hd),
hm AS (SELECT business_id, sim, min(pos) FILTER (day < 30) AS a, min(pos) FILTER (day < 60) AS b, min(pos) AS c FROM hp GROUP BY ALL),
hz AS (SELECT business_id, round(avg(CASE WHEN a < 0 THEN 1.0 ELSE 0.0 END), 6) AS hazard_30d, round(avg(CASE WHEN b < 0 THEN 1.0 ELSE 0.0 END), 6) AS hazard_60d, round(avg(CASE WHEN c < 0 THEN 1.0 ELSE 0.0 END), 6) AS hazard_90d FROM hm GROUP BY 1)
"""


@register(_HAZARD_SQL + "SELECT business_id, hazard_30d, hazard_60d, hazard_90d FROM hz")
def liquidity_hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.hazard(L.daily(spark, sf_dir)))


@register(_RATES_SQL.strip() + "," + _HAZARD_SQL.strip() + """, na AS (SELECT * FROM rt WHERE method = 'naive90'), st AS (SELECT na.business_id, min(h) AS first_below FROM na JOIN (SELECT unnest(range(1, 91)) AS h) ON balance + rate * h < 0 GROUP BY 1)
SELECT na.business_id, CAST(first_below AS INTEGER) AS first_below, CASE WHEN first_below <= 30 OR coalesce(hazard_30d, 0) >= 0.5 THEN 'crunch' WHEN first_below IS NOT NULL OR coalesce(hazard_30d, 0) >= 0.2 OR coalesce(hazard_90d, 0) >= 0.5 THEN 'watch' ELSE 'none' END AS level FROM na LEFT JOIN st USING (business_id) LEFT JOIN hz USING (business_id)""")
def forecast_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = L.daily(spark, sf_dir)
    return C.alert(C.flat_rates(d), C.hazard(d))


@register(_RATES_SQL.strip() + """, na AS (SELECT * FROM rt WHERE method = 'naive90'), st AS (SELECT na.business_id, min(h) AS first_below FROM na JOIN (SELECT unnest(range(1, 91)) AS h) ON balance + rate * h < 0 GROUP BY 1)
SELECT na.business_id, CAST(first_below AS INTEGER) AS first_below, CASE WHEN first_below <= 30 THEN 'crunch' WHEN first_below IS NOT NULL THEN 'watch' ELSE 'none' END AS level FROM na LEFT JOIN st USING (business_id)""")
def forecast_alert_path_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alert without hazards, which SQL can follow."""
    d = L.daily(spark, sf_dir)
    none = d.select("business_id").distinct().select("business_id", F.lit(0.0).alias("hazard_30d"), F.lit(0.0).alias("hazard_90d"))
    return C.alert(C.flat_rates(d), none)


_EV_SQL = """
e0 AS (SELECT *, ln(1 + greatest(cents, 0) / 100.0::DOUBLE) AS la, CASE WHEN direction = 'in' THEN 1 ELSE 0 END AS direction_in, date BETWEEN DATE '2024-01-10' AND DATE '2024-01-14' AS ins FROM ev),
e1 AS (SELECT *, median(la) OVER (PARTITION BY business_id, direction) AS m1, median(la) OVER (PARTITION BY business_id, direction, category) AS m2, median(la) OVER (PARTITION BY business_id, direction, category, ins) AS m3,
  stddev_pop(la) OVER (PARTITION BY business_id, direction) AS s1, stddev_pop(la) OVER (PARTITION BY business_id, direction, category) AS s2, stddev_pop(la) OVER (PARTITION BY business_id, direction, category, ins) AS s3,
  count(*) OVER (PARTITION BY business_id, direction, category) AS n2, count(*) OVER (PARTITION BY business_id, direction, category, ins) AS n3, bool_or(ins) OVER (PARTITION BY business_id) AS anys, count(*) OVER (PARTITION BY business_id) AS n,
  count(*) OVER (PARTITION BY business_id, hour) AS nh, count(*) OVER (PARTITION BY business_id, category) AS nc, median(cents) OVER (PARTITION BY business_id, counterparty_id, category) AS mc,
  row_number() OVER (PARTITION BY business_id, counterparty_id ORDER BY date, hour, transaction_id) AS rn, min(date) OVER (PARTITION BY business_id) AS d0, min(direction) OVER (PARTITION BY business_id, counterparty_id) <> max(direction) OVER (PARTITION BY business_id, counterparty_id) AS two FROM e0),
e2 AS (SELECT *, median(abs(la - m1)) OVER (PARTITION BY business_id, direction) * 1.4826 AS d1, median(abs(la - m2)) OVER (PARTITION BY business_id, direction, category) * 1.4826 AS d2, median(abs(la - m3)) OVER (PARTITION BY business_id, direction, category, ins) * 1.4826 AS d3,
  counterparty_id IS NOT NULL AND mc <> 0 AND abs(cents / mc - 1) <= 0.10 AS inb FROM e1),
e3 AS (SELECT *, inb AND count(*) FILTER (inb) OVER (PARTITION BY business_id, counterparty_id, category) >= 3 AS recurring, CASE WHEN anys AND n3 >= 5 THEN (la - m3) / coalesce(nullif(d3, 0), nullif(s3, 0), 1) WHEN n2 >= 5 THEN (la - m2) / coalesce(nullif(d2, 0), nullif(s2, 0), 1) ELSE (la - m1) / coalesce(nullif(d1, 0), nullif(s1, 0), 1) END AS amount_z,
  nh / n::DOUBLE AS hour_share, nc / n::DOUBLE AS category_share, CASE WHEN counterparty_id IS NOT NULL AND rn = 1 AND date >= d0 + 10 THEN 1 ELSE 0 END AS new_counterparty, CASE WHEN counterparty_id IS NOT NULL AND two THEN 1 ELSE 0 END AS both_directions FROM e2)
"""
_REPEAT_SQL = {
    "exact": "e4 AS (SELECT *, CASE WHEN direction = 'out' AND counterparty_id IS NOT NULL AND NOT recurring THEN row_number() OVER (PARTITION BY business_id, counterparty_id, date, cents, recurring, direction ORDER BY hour, transaction_id) > 1 ELSE FALSE END AS repeat_payment FROM e3)",
    "window": "own AS (SELECT * FROM e3 WHERE direction = 'out' AND counterparty_id IS NOT NULL AND NOT recurring), rp AS (SELECT DISTINCT b.transaction_id FROM own a JOIN own b ON a.business_id = b.business_id AND a.counterparty_id = b.counterparty_id AND b.date - a.date BETWEEN 0 AND 3 AND (a.date, a.hour, a.transaction_id) < (b.date, b.hour, b.transaction_id) AND a.cents <> 0 AND abs(b.cents / a.cents::DOUBLE - 1) <= 0.05), e4 AS (SELECT e3.*, rp.transaction_id IS NOT NULL AS repeat_payment FROM e3 LEFT JOIN rp USING (transaction_id))",
}
_FLAG_SQL = """e5 AS (SELECT *, amount_z >= 3 OR hour_share < 0.01 OR repeat_payment AS rule_hit, CASE WHEN repeat_payment THEN 'repeat_payment' WHEN amount_z >= 3 THEN 'amount_outlier' WHEN new_counterparty = 1 AND amount_z >= 2 THEN 'new_counterparty_large_amount' WHEN both_directions = 1 THEN 'counterparty_both_directions'
  WHEN hour_share < 0.01 THEN 'unusual_hour' WHEN NOT recurring AND category_share < 0.01 THEN 'rare_category' ELSE 'multivariate_outlier' END AS flag_reason FROM e4)"""


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.features(L.event_ledger(spark, sf_dir), SEASONS, burn_in=10)


@register(_EV_SQL.strip() + " SELECT business_id, transaction_id, round(amount_z, 6) AS amount_z, round(-ln(hour_share), 6) AS hour_rarity, round(CASE WHEN recurring THEN 0 ELSE -ln(category_share) END, 6) AS category_rarity, new_counterparty, both_directions, direction_in, recurring FROM e3")
def anomaly_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(event_features(spark, sf_dir).select("business_id", "transaction_id", *A.FOREST, "recurring"))


@register(_EV_SQL.strip() + "," + _REPEAT_SQL["window"] + " SELECT business_id, transaction_id FROM e4 WHERE repeat_payment")
def anomaly_repeats_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.repeats(event_features(spark, sf_dir), "window", tolerance=0.05).where("repeat_payment").select("business_id", "transaction_id")


@register(_EV_SQL.strip() + "," + _REPEAT_SQL["exact"] + "," + _FLAG_SQL + " SELECT business_id, transaction_id, flag_reason FROM e5 WHERE rule_hit")
def anomaly_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rules(A.repeats(event_features(spark, sf_dir))).where("rule_hit").select("business_id", "transaction_id", "flag_reason")


@register(_EV_SQL.strip() + "," + _REPEAT_SQL["exact"] + "," + _FLAG_SQL + " SELECT ins AS in_season, count(*) AS n_rows, count(*) FILTER (rule_hit) AS hits, round(1000 * count(*) FILTER (rule_hit) / count(*)::DOUBLE, 6) AS hits_per_1000 FROM e5 GROUP BY 1")
def anomaly_hits_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.rules(A.repeats(event_features(spark, sf_dir)))
    return rounded(t.groupBy("in_season").agg(F.count("*").alias("n_rows"), F.expr("count_if(rule_hit)").alias("hits"), F.expr("1000 * count_if(rule_hit) / double(count(*))").alias("hits_per_1000")))


@register()
def anomaly_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.detect(A.rules(A.repeats(A.features(A.scanned(L.event_ledger(spark, sf_dir)), SEASONS, burn_in=10))))


def _pu(kind: str, what: str) -> str:
    return f"((CAST('0x' || substr(md5('p1|{kind}|{what}|' || business_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE)"


def _planted_sql() -> str:
    parts = []
    for at, (kind, (least, most, low, high)) in enumerate(A.KINDS.items(), 1):
        number = f"transaction_id + {at * 10_000_000_000} AS transaction_id"
        lag = f"CAST({least} + floor({most - least + 1} * {_pu(kind, 'lag')}) AS INTEGER)"
        own = f"(SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY md5('p1|{kind}|' || transaction_id), transaction_id) AS r FROM (SELECT *, {lag} AS lag FROM po) WHERE date + lag <= latest)"
        share, hour = f"({low} + {high - low!r} * {_pu(kind, 'share')})", "least(hour + 1, 23)" if kind == "duplicate_payment" else f"CAST(9 + floor(8 * {_pu(kind, 'hour')}) AS INTEGER)"
        if kind == "round_trip_transfer":
            sent = f"CAST(round(med * (6 + 6 * {_pu(kind, 'size')})) AS BIGINT)"
            parts += [f"SELECT business_id, '{kind}' AS anomaly_type, date, 11 AS hour, 'out' AS direction, {sent} AS cents, 'RT-' || business_id AS counterparty_id, {number}, 'transfer' AS category FROM {own} WHERE r = 1", f"SELECT business_id, '{kind}', date + lag, 15, 'in', CAST(round({sent} * {share}) AS BIGINT), 'RT-' || business_id, transaction_id + {at * 10_000_000_000 + 5_000_000_000}, 'transfer' FROM {own} WHERE r = 1"]
        else:
            name = "counterparty_id || '-B'" if kind == "vendor_record_duplicate" else "counterparty_id"
            parts.append(f"SELECT business_id, '{kind}' AS anomaly_type, date + lag AS date, {hour} AS hour, direction, CAST(round(cents * {share}) AS BIGINT) AS cents, {name} AS counterparty_id, {number}, category FROM {own} WHERE r = 1")
    return "po AS (SELECT *, median(cents) OVER (PARTITION BY business_id) AS med FROM (SELECT *, max(date) OVER (PARTITION BY business_id) AS latest FROM ev) WHERE direction = 'out' AND counterparty_id IS NOT NULL), pl AS (" + " UNION ALL ".join(parts) + ")"


@register(_planted_sql() + " SELECT business_id, anomaly_type, date, hour, direction, cents, counterparty_id FROM pl")
def planted_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the injector plants, five kinds."""
    return A.planted(L.event_ledger(spark, sf_dir)).select("business_id", "anomaly_type", "date", "hour", "direction", "cents", "counterparty_id")


def with_planted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = L.event_ledger(spark, sf_dir)
    truth = A.planted(e)
    return A.scanned(e.withColumn("anomaly_type", F.lit(None).cast("string")).unionByName(truth)), truth


@register()
def anomaly_detector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five kinds of planted anomalies against the detector's ten flags a business."""
    t, truth = with_planted(spark, sf_dir)
    flags = A.detect(A.rules(A.repeats(A.features(t, SEASONS, burn_in=10))))
    return S.detector_scores(truth.select("business_id", "transaction_id", "anomaly_type"), flags, 10)


_SEEN_SQL = _planted_sql() + """, evp AS (SELECT transaction_id, business_id, date, hour, direction, cents, counterparty_id, category, CAST(NULL AS VARCHAR) AS anomaly_type FROM ev UNION ALL SELECT transaction_id, business_id, date, hour, direction, cents, counterparty_id, category, anomaly_type FROM pl),
evs AS (SELECT * EXCLUDE (last) FROM (SELECT *, max(date) OVER (PARTITION BY business_id) AS last FROM evp) WHERE date > last - 180), """ + _EV_SQL.strip().replace("FROM ev)", "FROM evs)")


@register(_SEEN_SQL + "," + _REPEAT_SQL["window"].replace("e4 AS", "e4w AS") + "," + _REPEAT_SQL["exact"] + """,
pay AS (SELECT * FROM own WHERE cents > 0), ct1 AS (SELECT business_id, counterparty_id, count(*) AS k FROM pay GROUP BY ALL), pr AS (SELECT a.business_id, a.counterparty_id, count(*) AS pairs FROM pay a JOIN pay b ON a.business_id = b.business_id AND a.counterparty_id = b.counterparty_id AND (a.cents, a.transaction_id) < (b.cents, b.transaction_id) AND b.cents / a.cents::DOUBLE - 1 <= 0.05 GROUP BY ALL),
rt1 AS (SELECT business_id, counterparty_id, coalesce(pairs, 0) / nullif(k * (k - 1) / 2.0::DOUBLE, 0) AS rate FROM ct1 LEFT JOIN pr USING (business_id, counterparty_id)),
mk AS (SELECT 'off' AS mode, anomaly_type, FALSE AS hit FROM e4 UNION ALL SELECT 'exact', anomaly_type, repeat_payment FROM e4 UNION ALL SELECT 'window', anomaly_type, repeat_payment FROM e4w UNION ALL SELECT 'rarity', anomaly_type, repeat_payment AND coalesce(rate < 0.01, FALSE) FROM e4w LEFT JOIN rt1 USING (business_id, counterparty_id))
SELECT mode, coalesce(anomaly_type, '(none)') AS anomaly_type, count(*) AS n_rows, count(*) FILTER (hit) AS marked FROM mk GROUP BY ALL""")
def repeat_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which planted rows each repeat mode marks, and how many others."""
    t, _ = with_planted(spark, sf_dir)
    f, out = saved(A.features(t, SEASONS, burn_in=10)), None
    for mode in ("off", "exact", "window", "rarity"):
        g = A.repeats(f, mode, tolerance=0.05).groupBy(F.lit(mode).alias("mode"), F.coalesce("anomaly_type", F.lit("(none)")).alias("anomaly_type")).agg(F.count("*").alias("n_rows"), F.expr("count_if(repeat_payment)").alias("marked"))
        out = g if out is None else out.unionByName(g)
    return out


#: A linear model for the tests of scoring: feature, coefficient, mean, scale, median, signed logarithm.
ARTIFACT = [("cash_flow_volatility", 0.4, 10.0, 1.5, 10.0, True), ("inflow_outflow_ratio", -0.6, 1.0, 0.5, 1.0, False), ("inflow_regularity_score", -0.3, 0.4, 0.2, 0.4, False), ("days_negative_balance_90d", 0.5, 30.0, 30.0, 20.0, False), ("avg_daily_balance", -0.35, 3.0, 9.0, 5.0, True), ("flow_asymmetry_ratio", 0.2, 1.0, 0.6, 1.0, False)]
INTERCEPT = -2.6
_CREDIT_SQL = _DAILY_SQL + """,
av AS (""" + " UNION ALL ".join(f"SELECT business_id, '{n}' AS feature, {c}::DOUBLE * (CASE WHEN {n} IS NULL THEN {md} " + (f"ELSE sign({n}) * ln(1 + abs({n}))" if lg else f"ELSE {n}") + f" END - {m}) / {s} AS contribution, {n} IS NULL AS imputed FROM f WHERE status <> 'insufficient_data'" for n, c, m, s, md, lg in ARTIFACT) + """),
ac AS (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY abs(round(contribution, 9)) DESC, feature) AS rank FROM av)
"""


def credit_contributions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.contributions(P.daily_features(L.daily(spark, sf_dir)).where("status <> 'insufficient_data'"), ARTIFACT)


@register(_CREDIT_SQL + "SELECT business_id, feature, round(contribution, 6) AS contribution, imputed, CAST(rank AS INTEGER) AS rank FROM ac")
def credit_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(credit_contributions_of(spark, sf_dir))


@register(_CREDIT_SQL + "SELECT business_id, CAST(rank AS INTEGER) AS rank, feature, magnitude, CASE WHEN magnitude = 'marginally' THEN 'either' WHEN contribution > 0 THEN 'against' ELSE 'supports' END AS side FROM (SELECT *, CASE WHEN abs(contribution) > 0.3 THEN 'strongly' WHEN abs(contribution) >= 0.1 THEN 'moderately' ELSE 'marginally' END AS magnitude FROM ac WHERE rank <= 3)")
def credit_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.explain(credit_contributions_of(spark, sf_dir)).select("business_id", "rank", "feature", "magnitude", "side")


_DECIDE_SQL = _CREDIT_SQL + "," + _SCREEN_SQL.strip() + """,
de AS (SELECT f.business_id, 1 / (1 + exp(-(logit - 2.6))) AS pd, installment_capacity AS cap, screen_status FROM f JOIN (SELECT business_id, sum(contribution) AS logit FROM ac GROUP BY 1) USING (business_id) LEFT JOIN scr USING (business_id)),
df AS (SELECT *, CASE WHEN pd < 0.03 THEN 'A' WHEN pd < 0.06 THEN 'B' WHEN pd < 0.10 THEN 'C' END AS tier0, CASE WHEN pd < 0.03 THEN 5.0 WHEN pd < 0.06 THEN 6.5 WHEN pd < 0.10 THEN 8.0 END::DOUBLE AS mk FROM de),
dg AS (SELECT *, least(floor(0.40::DOUBLE * cap * 12 / (1 + mk / 100 * 12 / 12.0) / 1000) * 1000, 500000) AS amt FROM df),
dh AS (SELECT *, CASE WHEN screen_status = 'hard_flag' THEN 'hard_flag' WHEN pd >= 0.10 OR tier0 IS NULL THEN 'risk_model' WHEN cap IS NULL OR cap <= 0 THEN 'affordability_no_installment_capacity' WHEN amt < 5000 THEN 'affordability_below_minimum_amount' END AS decline_reason FROM dg)
"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cap = P.daily_features(L.daily(spark, sf_dir)).select("business_id", F.col("installment_capacity").alias("capacity"))
    return R.decide(credit_contributions_of(spark, sf_dir), INTERCEPT, cap, screens(spark, sf_dir).select("business_id", "screen_status"))


@register(_DECIDE_SQL + """SELECT business_id, round(pd, 6) AS pd, CASE WHEN decline_reason IS NULL THEN 'approved' ELSE 'declined' END AS decision, CASE WHEN decline_reason IS NULL THEN tier0 END AS tier, CASE WHEN decline_reason IS NULL THEN CAST(amt AS BIGINT) END AS amount, CASE WHEN decline_reason IS NULL THEN mk END AS markup, decline_reason,
  CASE WHEN decline_reason = 'hard_flag' THEN 'compliance' WHEN decline_reason = 'risk_model' THEN 'risk_model' WHEN decline_reason IS NOT NULL THEN 'affordability' END AS decline_origin, CASE WHEN decline_reason IS NULL THEN CASE WHEN screen_status = 'soft_flag_review' THEN 'conditional' ELSE 'unconditional' END END AS offer_status FROM dh""")
def credit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(decisions(spark, sf_dir))


@register(_DECIDE_SQL + "SELECT coalesce(decline_reason, 'approved') AS outcome, count(*) AS businesses FROM dh GROUP BY 1")
def credit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).groupBy(F.coalesce("decline_reason", F.lit("approved")).alias("outcome")).agg(F.count("*").alias("businesses"))


@register(_CREDIT_SQL + ", fs AS (SELECT sector, feature, round(avg(contribution), 6) AS mean_contribution, round(avg(abs(contribution)), 6) AS mean_abs, round(stddev_pop(contribution), 6) AS spread FROM ac JOIN biz USING (business_id) GROUP BY ALL) SELECT *, rank() OVER (PARTITION BY sector ORDER BY mean_abs DESC) AS impact_rank FROM fs")
def fairness_by_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions by sector and feature with their impact ranks, ties sharing the least."""
    c = credit_contributions_of(spark, sf_dir).join(L.businesses(spark, sf_dir).select("business_id", "sector"), "business_id")
    g = rounded(c.groupBy("sector", "feature").agg(F.avg("contribution").alias("mean_contribution"), F.avg(F.abs("contribution")).alias("mean_abs"), F.stddev_pop("contribution").alias("spread")))
    return g.withColumn("impact_rank", F.rank().over(Window.partitionBy("sector").orderBy(F.desc("mean_abs"))).cast("long"))


@register("""a AS (SELECT business_id, window_end - CAST(k * 30 AS INTEGER) AS as_of FROM biz, (SELECT unnest(range(0, 4)) AS k)),
h AS (SELECT a.business_id, a.as_of, count(*) FILTER (date > a.as_of - 90) AS n, avg(net) FILTER (date > a.as_of - 90) AS m, avg(eod) FILTER (date > a.as_of - 90) AS b, count(*) FILTER (date > a.as_of - 90 AND eod < 0) AS neg, max_by(eod, date) AS last FROM a JOIN dly ON a.business_id = dly.business_id AND date <= a.as_of GROUP BY ALL)
SELECT business_id, as_of, round(m / 100, 4) AS mean_net_flow, round(b / 100, 4) AS avg_daily_balance, neg AS days_negative, round(last / 100.0::DOUBLE, 4) AS balance FROM h WHERE n = 90""")
def history_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point-in-time history: the trailing window at the as-of date and every 30 days before it, where it is whole. Days are dealt to the points whose window holds them, so no point re-reads the ledger."""
    d = L.daily(spark, sf_dir).select("business_id", "window_end", "date", "net", "eod", "dbe")
    points = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda k: (F.col("dbe") >= k * 30) & (F.col("dbe") < k * 30 + 90))
    h = d.withColumn("k", F.explode(points)).groupBy("business_id", F.expr("date_sub(window_end, k * 30)").alias("as_of"))
    h = h.agg(F.count("*").alias("n"), F.avg(F.col("net")).alias("m"), F.avg("eod").alias("b"), F.expr("count_if(eod < 0)").alias("days_negative"), F.expr("max_by(eod, date)").alias("last")).where("n = 90")
    return rounded(h.select("business_id", "as_of", F.expr("m / 100").alias("mean_net_flow"), F.expr("b / 100").alias("avg_daily_balance"), "days_negative", F.expr("last / 100.0D").alias("balance")), 4)


@register("""d AS (SELECT business_id, date, eod, avg(net) OVER w AS rate, count(*) OVER w AS n FROM dly WINDOW w AS (PARTITION BY business_id ORDER BY date ROWS 89 PRECEDING))
SELECT business_id, min(date) FILTER (n = 90 AND (eod + rate < 0 OR eod + 30 * rate < 0)) AS first_detection, min(date) FILTER (eod < 0) AS first_negative FROM d GROUP BY 1""")
def shortage_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first day on which a 30-day projection of the trailing rate would have gone below zero, and the first negative day."""
    over = "over (partition by business_id order by date rows 89 preceding)"
    d = L.daily(spark, sf_dir).select("business_id", "date", "eod", F.expr(f"avg(net) {over}").alias("rate"), F.expr(f"count(*) {over}").alias("n"))
    return d.groupBy("business_id").agg(F.expr("min(if(n = 90 and (eod + rate < 0 or eod + 30 * rate < 0), date, null))").alias("first_detection"), F.expr("min(if(eod < 0, date, null))").alias("first_negative"))


def _selection_sql(cut: int, window: str) -> str:
    """Every method's path over 30 days from a day `cut` days before the as-of date, beside what came."""
    ols = _OLS_SQL.strip().replace("FROM dly", "FROM dl")
    return f"""SELECT '{window}' AS time_window, * FROM (WITH dl AS (SELECT business_id, window_end - {cut} AS window_end, date, net, recurring, eod, dbe - {cut} AS dbe FROM dly WHERE dbe >= {cut}), {_RATES_SQL.strip().replace("FROM dly", "FROM dl")},
d AS (SELECT *, net + recurring AS plain FROM dl WHERE dbe < 90), lv AS (SELECT business_id, window_end, avg(plain) FILTER (dbe < 30) AS level, avg(plain) AS mean, max_by(eod, date) AS balance, count(*) FILTER (dbe < 30) AS n30 FROM d GROUP BY ALL), dw AS (SELECT business_id, isodow(date) AS dow, avg(plain) AS m FROM d GROUP BY ALL),
ah AS (SELECT lv.*, day, (day - 1) % n30 AS place, isodow(window_end + CAST(day AS INTEGER)) AS dow FROM lv, (SELECT unnest(range(1, 91)) AS day)),
pa AS (SELECT ah.business_id, day, balance + sum(level + coalesce(m - mean, 0) - recurring) OVER (PARTITION BY ah.business_id ORDER BY day) AS pos, level + coalesce(m - mean, 0) - recurring AS net FROM ah LEFT JOIN dw ON ah.business_id = dw.business_id AND ah.dow = dw.dow JOIN d ON d.business_id = ah.business_id AND n30 - 1 - d.dbe = place AND d.dbe < 30),
{ols}, me AS (SELECT business_id, method, 30 * rate AS flow, balance + least(rate, 30 * rate) AS low FROM rt UNION ALL SELECT business_id, 'structural', sum(net), min(pos) FROM pa WHERE day <= 30 GROUP BY 1 UNION ALL SELECT business_id, 'ols_damped', sum(net), min(pos) FROM op WHERE day <= 30 GROUP BY 1),
ac AS (SELECT business_id, sum(net) FILTER (dbe BETWEEN {cut - 30} AND {cut - 1}) AS actual, min(eod) FILTER (dbe BETWEEN {cut - 30} AND {cut - 1}) < 0 AS crunch, avg(abs(net)) FILTER (dbe BETWEEN {cut} AND {cut + 89}) AS scale FROM dly GROUP BY 1 HAVING count(*) FILTER (dbe >= {cut}) >= 90)
SELECT business_id, method, flow, low, actual, crunch, scale FROM me JOIN ac USING (business_id) WHERE scale > 0)"""


@register(f"se AS ({_selection_sql(60, 'select')} UNION ALL {_selection_sql(30, 'report')}) SELECT time_window, method, count(*) AS businesses, round(median(abs(flow - actual) / (30 * scale)), 6) AS median_error, round(count(*) FILTER (crunch AND low < 0) / nullif(count(*) FILTER (crunch), 0)::DOUBLE, 6) AS crunch_recall, round(count(*) FILTER (NOT crunch AND low < 0) / nullif(count(*) FILTER (NOT crunch), 0)::DOUBLE, 6) AS false_alarm_rate FROM se GROUP BY ALL")
def forecast_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six methods over 30 days held out: a window to select by (days 121 to 150 of 180) and a later one to report; median scale-free error, recall of shortages, false alarms."""
    d, out = L.daily(spark, sf_dir), None
    for cut, window in ((60, "select"), (30, "report")):
        past = d.where(f"dbe >= {cut}").withColumn("window_end", F.date_sub("window_end", cut)).withColumn("dbe", F.col("dbe") - cut)
        paths = C.flat_paths(C.flat_rates(past), (30,)).select("business_id", "method", "flow", "low")
        for name, method in C.PATHS.items():
            paths = paths.unionByName(C.path_summary(method(past), (30,)).select("business_id", F.lit(name).alias("method"), "flow", "low"))
        came = d.groupBy("business_id").agg(F.expr(f"sum(if(dbe between {cut - 30} and {cut - 1}, net, null))").alias("actual"), F.expr(f"min(if(dbe between {cut - 30} and {cut - 1}, eod, null)) < 0").alias("crunch"), F.expr(f"avg(if(dbe between {cut} and {cut + 89}, abs(net), null))").alias("scale"), F.expr(f"count_if(dbe >= {cut})").alias("days")).where("days >= 90 and scale > 0")
        one = paths.join(came, "business_id").withColumn("time_window", F.lit(window))
        out = one if out is None else out.unionByName(one)
    g = out.groupBy("time_window", "method").agg(F.count("*").alias("businesses"), F.expr("median(abs(flow - actual) / (30 * scale))").alias("median_error"), F.expr("try_divide(count_if(crunch and low < 0), count_if(crunch))").alias("crunch_recall"), F.expr("try_divide(count_if(not crunch and low < 0), count_if(not crunch))").alias("false_alarm_rate"))
    return rounded(g)


#: A label for evaluation: whether the last 30 days hold a negative balance; a score: the pressure of the 90 days before.
_LABEL_SQL = """la AS (SELECT business_id, CASE WHEN min(eod) FILTER (dbe < 30) < 0 THEN 1 ELSE 0 END AS label, round(stddev_pop(net) FILTER (dbe BETWEEN 30 AND 119) / 100, 2) AS volatility, round(-avg(eod) FILTER (dbe BETWEEN 30 AND 119) / 100, 2) AS pressure, count(*) FILTER (dbe BETWEEN 30 AND 119 AND net < 0) AS down_days FROM dly GROUP BY 1),
ll AS (SELECT business_id, label, 'volatility' AS feature, volatility AS score FROM la UNION ALL SELECT business_id, label, 'pressure', pressure FROM la UNION ALL SELECT business_id, label, 'down_days', down_days::DOUBLE FROM la),
lr AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY score) + (count(*) OVER (PARTITION BY feature, score) - 1) / 2.0::DOUBLE AS r FROM ll WHERE score IS NOT NULL)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = L.daily(spark, sf_dir).groupBy("business_id").agg(F.expr("if(min(if(dbe < 30, eod, null)) < 0, 1, 0)").alias("label"), F.expr("round(stddev_pop(if(dbe between 30 and 119, net, null)) / 100, 2)").alias("volatility"), F.expr("round(-avg(if(dbe between 30 and 119, eod, null)) / 100, 2)").alias("pressure"), F.expr("cast(count_if(dbe between 30 and 119 and net < 0) as double)").alias("down_days"))
    return d.unpivot(["business_id", "label"], ["volatility", "pressure", "down_days"], "feature", "score")


@register(_LABEL_SQL + " SELECT feature, round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / nullif(sum(label) * (count(*) - sum(label)), 0), 6) AS auc, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos FROM lr GROUP BY 1")
def feature_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.auc(labelled(spark, sf_dir), "score", "label", ["feature"]))


@register(_LABEL_SQL + """, cut AS (SELECT i, c FROM (SELECT unnest([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]) AS c, generate_subscripts([1, 2, 3, 4, 5, 6], 1) AS i)),
dr AS (SELECT ll.*, draw, CAST('0x' || substr(md5('auc|' || draw || '|' || business_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM ll, (SELECT unnest(range(0, 1000)) AS draw) WHERE score IS NOT NULL),
dw AS (SELECT feature, draw, business_id, label, score, (SELECT count(*) FROM cut WHERE u >= c) AS weight FROM dr),
dc AS (SELECT feature, draw, score, sum(weight) AS m, sum(weight * label) AS p FROM dw WHERE weight > 0 GROUP BY ALL),
dd AS (SELECT *, sum(m) OVER (PARTITION BY feature, draw ORDER BY score) - (m - 1) / 2.0::DOUBLE AS r FROM dc),
da AS (SELECT feature, draw, (sum(r * p) - sum(p) * (sum(p) + 1) / 2.0::DOUBLE) / nullif(sum(p) * (sum(m) - sum(p)), 0) AS auc FROM dd GROUP BY ALL)
SELECT feature, round(quantile_cont(auc, 0.025), 6) AS low, round(median(auc), 6) AS mid, round(quantile_cont(auc, 0.975), 6) AS high FROM da GROUP BY 1""")
def feature_auc_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bootstrap interval of each feature's AUC; draws come from md5, so any engine repeats them."""
    return rounded(B.auc_interval(labelled(spark, sf_dir), "score", "label", "business_id", ["feature"]))


@register("""s AS (SELECT sector, business_id, sum(inflow) AS a, sum(outflow) AS b FROM dly JOIN biz USING (business_id, window_end) GROUP BY ALL), r AS (SELECT sector, rank() OVER (PARTITION BY sector ORDER BY a) + (count(*) OVER (PARTITION BY sector, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY sector ORDER BY b) + (count(*) OVER (PARTITION BY sector, b) - 1) / 2.0::DOUBLE AS rb FROM s)
SELECT sector, round(corr(ra, rb), 6) AS rho FROM r GROUP BY 1""")
def inflow_outflow_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = L.daily(spark, sf_dir).groupBy("business_id").agg(F.sum("inflow").alias("a"), F.sum("outflow").alias("b")).join(L.businesses(spark, sf_dir).select("business_id", "sector"), "business_id")
    return rounded(S.spearman(d, "a", "b", ["sector"]))


@register(_EV_SQL.strip() + """, ow AS (SELECT business_id, counterparty_id, transaction_id, date, hour, cents FROM e3 WHERE direction = 'out' AND counterparty_id IS NOT NULL AND NOT recurring),
cm AS (SELECT b.transaction_id, count(*) AS close FROM ow a JOIN ow b ON a.business_id = b.business_id AND a.counterparty_id = b.counterparty_id AND a.transaction_id <> b.transaction_id AND a.cents <> 0 AND abs(b.cents / a.cents::DOUBLE - 1) <= 0.01 GROUP BY 1)
SELECT least(close, 5) AS close_matches, count(*) AS payments FROM (SELECT coalesce(close, 0) AS close FROM ow LEFT JOIN cm USING (transaction_id)) GROUP BY 1""")
def close_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many payments to the same counterparty lie within one per cent of each, from counts by amount: no two payments are paired."""
    t = event_features(spark, sf_dir).where("direction = 'out' and counterparty_id is not null and not recurring").select("business_id", "counterparty_id", "cents")
    t = saved(t.groupBy("business_id", "counterparty_id", "cents").agg(F.count("*").alias("k")))
    c = A.close_amounts(t, count="k").select(F.least("close", F.lit(5)).cast("long").alias("close_matches"), "m")
    c = c.unionByName(t.where("cents <= 0").select(F.lit(0).cast("long").alias("close_matches"), F.col("k").alias("m")))
    return c.groupBy("close_matches").agg(F.sum("m").alias("payments"))


@register("""c AS (SELECT sector, category, sum(CASE WHEN direction = 'in' THEN cents ELSE 0 END) AS a, sum(CASE WHEN direction = 'out' THEN cents ELSE 0 END) AS b FROM ct JOIN biz USING (business_id) GROUP BY ALL),
p AS (SELECT *, a / (sum(a) OVER (PARTITION BY sector))::DOUBLE AS p, b / (sum(b) OVER (PARTITION BY sector))::DOUBLE AS q FROM c), g AS (SELECT *, abs(sum(p - q) OVER (PARTITION BY sector ORDER BY category)) AS g FROM p)
SELECT sector, round(0.5 * sum(abs(p - q)), 6) AS tv, round(max(g), 6) AS ks FROM g GROUP BY 1""")
def category_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    biz = L.businesses(spark, sf_dir)
    t = L.clipped(L.transactions(spark, sf_dir), biz).join(biz.select("business_id", "sector"), "business_id")
    c = t.groupBy("sector", "category").agg(F.expr("sum(if(direction = 'in', cents, 0))").alias("a"), F.expr("sum(if(direction = 'out', cents, 0))").alias("b"))
    return rounded(S.distances(c, "category", "a", "b", ["sector"]))


@register("""c AS (SELECT sector, category, count(*) AS k FROM ct JOIN biz USING (business_id) GROUP BY ALL), s AS (SELECT *, round(k / (sum(k) OVER (PARTITION BY sector))::DOUBLE, 3) AS sh, row_number() OVER (PARTITION BY sector ORDER BY k DESC, category) AS r FROM c)
SELECT sector, category, round(CASE WHEN r = 1 THEN sh + 1 - sum(sh) OVER (PARTITION BY sector) ELSE sh END, 3) AS share FROM s""")
def sector_category_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    biz = L.businesses(spark, sf_dir)
    t = L.clipped(L.transactions(spark, sf_dir), biz).join(biz.select("business_id", "sector"), "business_id")
    return S.rounded_shares(t.groupBy("sector", "category").agg(F.count("*").alias("k")), "category", "k", ["sector"]).select("sector", "category", "share")


@register("""SELECT business_id, population, row_number() OVER (PARTITION BY population ORDER BY md5('cv|' || business_id), business_id) - 1 - 5 * CAST(floor((row_number() OVER (PARTITION BY population ORDER BY md5('cv|' || business_id), business_id) - 1) / 5) AS BIGINT) AS fold FROM biz""")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = S.folds(L.businesses(spark, sf_dir), "business_id", "population", 5, "cv")
    return f.select("business_id", "population", F.col("fold").cast("long").alias("fold"))


@register("""k AS (SELECT *, md5(CAST(transaction_id AS VARCHAR) || '|' || l_partkey) AS h FROM (SELECT l_orderkey * 100 + l_linenumber AS transaction_id, l_partkey FROM lineitem)) SELECT count(*) AS n_rows, count(DISTINCT h) AS distinct_rows, count(*) FILTER (h < '80') AS lower_half FROM k""")
def row_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hashes of ledger rows, for receipts: counted without order."""
    h = F.md5(F.concat_ws("|", F.expr("l_orderkey * 100 + l_linenumber").cast("string"), F.col("l_partkey").cast("string")).cast("binary"))
    k = L.table(spark, sf_dir, "lineitem").select(h.alias("h"))
    return k.agg(F.count("*").alias("n_rows"), F.countDistinct("h").alias("distinct_rows"), F.expr("count_if(h < '80')").alias("lower_half"))


@register("""s AS (SELECT population, sector, direction, sum(cents) AS c, count(*) AS n, GROUPING_ID(population, sector, direction) AS level FROM ct JOIN biz USING (business_id) GROUP BY CUBE (population, sector, direction)) SELECT population, sector, direction, CAST(c AS BIGINT) AS cents, n, CAST(level AS BIGINT) AS level FROM s""")
def portfolio_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    biz = L.businesses(spark, sf_dir)
    t = L.clipped(L.transactions(spark, sf_dir), biz).join(biz.select("business_id", "population", "sector"), "business_id")
    return t.cube("population", "sector", "direction").agg(F.sum("cents").alias("cents"), F.count("*").alias("n"), F.grouping_id().alias("level"))


@register("""SELECT 'cents > 0' AS rule, count(*) FILTER (NOT cents > 0) AS violations FROM tx UNION ALL SELECT 'hour in 0..23', count(*) FILTER (NOT hour BETWEEN 0 AND 23) FROM tx UNION ALL SELECT 'direction in (in, out)', count(*) FILTER (direction NOT IN ('in', 'out')) FROM tx
UNION ALL SELECT 'unique transaction_id', (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM tx GROUP BY transaction_id)) UNION ALL SELECT 'business exists', count(*) FILTER (biz.business_id IS NULL) FROM tx LEFT JOIN biz USING (business_id)""".replace("SELECT 'cents", "SELECT rule, CAST(violations AS BIGINT) AS violations FROM (SELECT 'cents", 1) + ")")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of the transactions contract: checks in one pass, uniqueness and references by aggregate and anti-join."""
    t, biz = L.transactions(spark, sf_dir), L.businesses(spark, sf_dir)
    checks = {"cents > 0": "cents > 0", "hour in 0..23": "hour between 0 and 23", "direction in (in, out)": "direction in ('in', 'out')"}
    counts = F.array(*(F.struct(F.lit(n).alias("rule"), F.expr(f"count_if(not ({c}))").alias("violations")) for n, c in checks.items()))
    one = t.agg(counts.alias("c")).select(F.inline("c"))
    twice = t.groupBy("transaction_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.expr("sum(n - 1)"), F.lit(0)).alias("violations")).select(F.lit("unique transaction_id").alias("rule"), "violations")
    lost = t.join(biz, "business_id", "left_anti").agg(F.count("*").alias("violations")).select(F.lit("business exists").alias("rule"), "violations")
    return one.unionByName(twice).unionByName(lost)


__all__ = ["QUERIES", "SQL"]
