"""Seasonal least squares by sector, contracts of the ledger's tables, calibration within sectors, lookups in keyed CSV: with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import new_path
from ..operators import calibration as K
from ..operators import contracts as V
from ..operators import least_squares as Q
from ..sources import keyed_csv
from ..sources import ledger as L
from .lenses import _LABEL_SQL, labelled
from .profiles import register, rounded

#: Seasons of the recovery: the second lies outside the ledger's days, so its term is dropped.
WINDOWS = {"season": ("2000-11-27", "2000-12-29"), "outside": ("1999-01-01", "1999-01-31")}
TERMS = {"level": "1.0D", "trend": "t / 180.0D", **{f"day_{k}": f"if(weekday(date) = {k}, 1, 0)" for k in range(1, 7)}, **{n: f"if(date between date'{a}' and date'{b}', 1, 0)" for n, (a, b) in WINDOWS.items()}}
_KEPT = [n for n in TERMS if n != "outside"]
_X = [f"CASE WHEN isodow(date) = {int(n[4:]) + 1} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" if n.startswith("day_") else "1.0::DOUBLE" if n == "level" else "t / 180.0::DOUBLE" if n == "trend" else f"CASE WHEN date BETWEEN DATE '{WINDOWS[n][0]}' AND DATE '{WINDOWS[n][1]}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for n in _KEPT]
_P = len(_KEPT)


@register(f"""se AS (SELECT sector, date, CAST(date - DATE '2000-01-01' AS INTEGER) AS t, ln(greatest(avg(inflow / m), 1e-3)) AS y FROM (SELECT business_id, date, inflow, avg(inflow) OVER (PARTITION BY business_id) AS m FROM dly) JOIN biz USING (business_id) WHERE m > 0 GROUP BY ALL),
xs AS (SELECT sector, y, [{", ".join(_X)}] AS x FROM se),
ne AS (SELECT sector, count(*) AS n, [{", ".join("[" + ", ".join(f"sum(x[{i}] * x[{j}])" for j in range(1, _P + 1)) + f", sum(x[{i}] * y)]" for i in range(1, _P + 1))}] AS m FROM xs GROUP BY 1),
ge(sector, n, k, m) AS (SELECT sector, n, 1, m FROM ne UNION ALL SELECT sector, n, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k]) ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END) FROM ge WHERE k <= {_P}),
co AS (SELECT sector, n, m FROM ge WHERE k = {_P + 1})
SELECT sector, term, round(coefficient, 5) AS coefficient, dropped, n FROM (""" + " UNION ALL ".join([f"SELECT sector, '{t}' AS term, m[{i}][{_P + 1}] AS coefficient, FALSE AS dropped, n FROM co" for i, t in enumerate(_KEPT, 1)] + ["SELECT sector, 'outside', NULL, TRUE, n FROM co"]) + ")")
def seasonal_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By sector, level, trend, weekdays and seasons of the log of its mean relative inflow, fitted together."""
    d = L.daily(spark, sf_dir).select("business_id", "date", "inflow", F.expr("avg(inflow) over (partition by business_id)").alias("m")).where("m > 0")
    d = d.join(L.businesses(spark, sf_dir).select("business_id", "sector"), "business_id").groupBy("sector", "date").agg(F.expr("ln(greatest(avg(inflow / m), 1e-3D))").alias("y"))
    return rounded(Q.fit(d.withColumn("t", F.expr("datediff(date, date'2000-01-01')")), "y", TERMS, ["sector"]), 5)


CONTRACTS = {
    "businesses": V.Contract("business_id", {"four digits declared": "declared_mcc rlike '^[0-9]{4}$'", "period in order": "operating_start_date <= window_end", "opening at or above zero": "opening_cents >= 0"}),
    "transactions": V.Contract("transaction_id", {"cents > 0": "cents > 0", "hour in 0..23": "hour between 0 and 23", "counterparty named": "counterparty_id is not null"}, references={"business_id": "businesses"}),
    "obligations": V.Contract("obligation_id", {"known frequency": "frequency in ('monthly', 'weekly', 'quarterly', 'one_off')", "an end where inactive": "status = 'active' or status_change_date is not null"}, references={"business_id": "businesses"}),
    "facilities": V.Contract("business_id", {"drawn within the limit": "drawn_cents <= limit_cents"}, references={"business_id": "businesses"}),
    "balance_sheets": V.Contract("business_id", {"cash at or above zero": "cash >= 0"}, unique=False, references={"business_id": "businesses"}),
}
_NAMES = {"businesses": "biz", "transactions": "tx", "obligations": "obl", "facilities": "fac", "balance_sheets": "sheet"}


def _contract_sql() -> str:
    parts = []
    for name, c in CONTRACTS.items():
        for rule, test in c.rules.items():
            test = test.replace("declared_mcc rlike '^[0-9]{4}$'", "regexp_full_match(declared_mcc, '[0-9]{4}')")
            bad = f"FILTER (NOT coalesce({test}, FALSE))"
            parts.append(f"SELECT '{name}' AS table_name, '{rule}' AS rule, count(*) AS \"rows\", count(*) {bad} AS violations, min({c.key}) {bad} AS first_key, max({c.key}) {bad} AS last_key FROM {_NAMES[name]}")
        if c.unique:
            parts.append(f"SELECT '{name}', 'unique {c.key}', CAST(sum(n) AS BIGINT), CAST(sum(n - 1) AS BIGINT), min(CASE WHEN n > 1 THEN k END), max(CASE WHEN n > 1 THEN k END) FROM (SELECT {c.key} AS k, count(*) AS n FROM {_NAMES[name]} GROUP BY 1)")
        for col, other in c.references.items():
            bad = f"FILTER ({col} NOT IN (SELECT {CONTRACTS[other].key} FROM {_NAMES[other]}))"
            parts.append(f"SELECT '{name}', '{col} in {other}', count(*), count(*) {bad}, min({col}) {bad}, max({col}) {bad} FROM {_NAMES[name]} WHERE {col} IS NOT NULL")
    return "\nUNION ALL ".join(parts)


@register("z0 AS (SELECT 1)\n" + _contract_sql())
def ledger_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of every table of the ledger, counted while the tables are written: rows, violations, and the least and largest key that broke it."""
    rows, written = [], {}
    for name, c in CONTRACTS.items():
        path = new_path(spark, f"contract-{name}")
        rows += [(name, *r) for r in V.checked_write(getattr(L, name)(spark, sf_dir), path, c)]
        written[name] = spark.read.parquet(path)
    observed = spark.createDataFrame(rows, "table_name string, rule string, rows long, violations long, first_key long, last_key long")
    return observed.unionByName(V.key_rules(written, CONTRACTS))


_CAL_SQL = f"""sc AS (SELECT sector, label, 1 / (1 + exp(-score / 50000)) AS s FROM ll JOIN biz USING (business_id) WHERE feature = 'pressure' AND score IS NOT NULL),
bn AS (SELECT sector, least(CAST(floor(s * {K.BINS}) AS INTEGER), {K.BINS - 1}) AS bin, count(*) AS n, count(*) FILTER (label = 1) AS positives, avg(s) AS mean_score FROM sc GROUP BY ALL),
pv AS (SELECT a.sector, a.bin, (SELECT max(v) FROM (SELECT l.bin, (SELECT min(v) FROM (SELECT sum(q.positives) / sum(q.n)::DOUBLE AS v FROM bn u JOIN bn q ON q.sector = a.sector AND q.bin BETWEEN l.bin AND u.bin WHERE u.sector = a.sector AND u.bin >= a.bin GROUP BY u.bin)) AS v FROM bn l WHERE l.sector = a.sector AND l.bin <= a.bin)) AS fitted FROM bn a)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labelled(spark, sf_dir).where("feature = 'pressure' and score is not null").withColumn("s", F.expr("1 / (1 + exp(-score / 50000))"))
    return d.join(L.businesses(spark, sf_dir).select("business_id", "sector"), "business_id")


@register(_LABEL_SQL + ", " + _CAL_SQL + " SELECT sector, bin, n, positives, round(mean_score, 6) AS mean_score, round(positives / n::DOUBLE, 6) AS rate, round(fitted, 6) AS fitted FROM bn JOIN pv USING (sector, bin)")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within each sector, a pressure score against the label in bins, and the rising curve fitted to them."""
    return rounded(K.monotone(K.bins(_scored(spark, sf_dir), "s", "label", ["sector"]), ["sector"]))


@register(_LABEL_SQL + ", " + _CAL_SQL + " SELECT sector, CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(mean_score - positives / n::DOUBLE)) / sum(n), 6) AS ece, round(max(abs(mean_score - positives / n::DOUBLE)), 6) AS worst FROM bn GROUP BY 1")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(K.error(K.bins(_scored(spark, sf_dir), "s", "label", ["sector"]), ["sector"]))


@register("SELECT business_id, transaction_id, date, direction, cents, counterparty_id FROM tx WHERE business_id IN (1, 4, 9)")
def keyed_csv_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions written as CSV in ranges of the business, and those of three businesses asked for: the source plans their stretches only."""
    path = new_path(spark, "keyed")
    keyed_csv.write(L.transactions(spark, sf_dir).select("business_id", "transaction_id", "date", "direction", "cents", "counterparty_id"), path, "business_id")
    return keyed_csv.read(spark, path, "business_id long, transaction_id long, date date, direction string, cents long, counterparty_id string", "business_id").where("business_id in (1, 4, 9)")
