"""Small hand-built frames for single operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import storage
from tidemark.operators import anomaly, forecast, profile, stats
from tidemark.sources import files
from tidemark.streaming import rollup

END = dt.date(2026, 6, 30)


def ledger(spark, n, inflow=lambda i: 3000, outflow=lambda i: 2000, start=50000):
    rows, bal = [], start * 100
    for i in range(n):
        a, b = int(inflow(i) * 100), int(outflow(i) * 100)
        bal += a - b
        rows.append((1, END - dt.timedelta(days=n - 1 - i), END, "synthetic", a, 3 if a else 0, b, 2 if b else 0, b // 2, a - b, bal, n - 1 - i))
    return spark.createDataFrame(rows, "business_id long, date date, window_end date, data_source string, inflow long, inflow_count long, outflow long, outflow_count long, recurring long, net long, eod long, dbe int")


def features(spark, *a, **k):
    return profile.daily_features(ledger(spark, *a, **k), min_coverage=60).first()


def test_scored_constant_business(spark):
    f = features(spark, 200)
    assert f.status == "scored" and f.avg_monthly_inflow == pytest.approx(90000) and f.cash_flow_volatility == 0
    assert f.revenue_growth_90d == pytest.approx(0) and f.runway_days_current_balance is None
    assert f.runway_days_current_balance__reason == "not_applicable" and f.recurring_expense_ratio == pytest.approx(0.5)


def test_partial_and_refused(spark):
    assert features(spark, 100).status == "partial_profile"
    assert features(spark, 100).revenue_growth_90d__reason == "insufficient_history"
    f = features(spark, 40)
    assert f.status == "insufficient_data" and f.avg_monthly_inflow is None and f.avg_monthly_inflow__reason == "insufficient_data"


def test_overdraft_runs_and_shock(spark):
    f = features(spark, 180, inflow=lambda i: 0 if 100 <= i < 110 or 120 <= i < 125 else 3000, outflow=lambda i: 3000, start=1000)
    eod = np.cumsum([(0 if 100 <= i < 110 or 120 <= i < 125 else 3000) - 3000 for i in range(180)]) + 1000
    neg = eod[90:] < 0
    best = run = 0
    for x in neg:
        run = run + 1 if x else 0
        best = max(best, run)
    assert f.max_consecutive_overdraft_days == best and f.days_negative_balance_90d == neg.sum() and f.revenue_shock_absorption_pct == 0


def test_break_recency(spark):
    f = features(spark, 180, inflow=lambda i: 3000 + (i % 7) * 10 + (3000 if i >= 150 else 0))
    assert 0 <= f.inflow_break_recency_days < 30


def test_robust_z_and_repeats(spark):
    rows = [(1, i, END - dt.timedelta(days=60 - i), 10, "out", 10000 + i, f"S{i % 4}", "a") for i in range(60)]
    rows.append((1, 100, rows[40][2], 11, "out", rows[40][5], rows[40][6], "a"))
    rows.append((1, 101, END, 3, "out", 9_000_000, "S1", "a"))
    tx = spark.createDataFrame(rows, "business_id long, transaction_id long, date date, hour int, direction string, cents long, counterparty_id string, category string")
    t = anomaly.features(tx, band=0.00001)
    got = {r.transaction_id: r for r in anomaly.rules(anomaly.repeats(t)).collect()}
    assert got[100].repeat_payment and got[100].flag_reason == "repeat_payment" and not got[40].repeat_payment
    assert got[101].amount_z >= 3 and got[101].flag_reason == "amount_outlier"
    assert {r.transaction_id for r in anomaly.repeats(t, "window").where("repeat_payment").collect()} >= {100}
    with pytest.raises(ValueError):
        anomaly.repeats(t, "other")


def test_isolation_forest_finds_the_far_point():
    x = np.random.default_rng(1).normal(size=(200, 3))
    x[17] = 12
    s = anomaly.isolation_scores(x, trees=100)
    assert s.argmax() == 17 and (s == anomaly.isolation_scores(x, trees=100)).all()


def test_scan_window_and_forest_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(b, 1000 * b + i, END - dt.timedelta(days=int(rng.integers(0, 250))), int(rng.integers(8, 18)), "out", int(rng.integers(5000, 9000)), f"S{i % 40}", "ab"[i % 2]) for b, n in ((1, 900), (2, 60), (3, 20)) for i in range(n)]
    rows += [(1, 1999, END, 3, "in", 90_000_000, "X", "c"), (2, 2999, END, 12, "out", 6000, "S1", "a"), (1, 1998, END - dt.timedelta(days=179), 12, "out", 6000, "S1", "a"), (1, 1997, END - dt.timedelta(days=180), 12, "out", 6000, "S1", "a")]
    tx = spark.createDataFrame(rows, "business_id long, transaction_id long, date date, hour int, direction string, cents long, counterparty_id string, category string")
    kept = anomaly.scanned(tx.where("business_id < 3"))
    ids = {r.transaction_id for r in kept.collect()}
    assert ids == {r[1] for r in rows if r[0] < 3 and (END - r[2]).days < 180} and 1998 in ids and 1997 not in ids
    t = storage.saved(anomaly.rules(anomaly.repeats(anomaly.features(anomaly.scanned(tx)))))
    whole = sorted(map(tuple, anomaly.detect(t, trees=50).collect()))
    assert {r[0] for r in whole} == {1, 2} and (1, 1999, 1) in {r[:3] for r in whole}
    monkeypatch.setattr(anomaly, "ROWS", 100)
    assert sorted(map(tuple, anomaly.detect(t, trees=50).collect())) == whole


def test_flat_rates(spark):
    d = ledger(spark, 90, inflow=lambda i: 40 if i >= 60 else 10, outflow=lambda i: 0)
    r = {x.method: x.rate / 100 for x in forecast.flat_rates(d).collect()}
    assert r["naive30"] == pytest.approx(40) and r["naive90"] == pytest.approx(20) and r["blend"] == pytest.approx(30)


def test_auc_and_shares(spark):
    d = spark.createDataFrame([("a", 0.1, 0), ("a", 0.4, 0), ("a", 0.4, 1), ("a", 0.9, 1)], "k string, s double, y int")
    assert stats.auc(d, "s", "y", ["k"]).first().auc == pytest.approx(0.875)
    s = stats.rounded_shares(spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("a", "z", 1)], "k string, c string, n int"), "c", "n", ["k"])
    assert s.agg(F.round(F.sum("share"), 9)).first()[0] == 1


def test_store_and_lookup(spark, tmp_path):
    df = spark.createDataFrame([(i % 5, i) for i in range(50)], "k long, v long")
    files.write_store(df, str(tmp_path / "s"), "k", ["v"])
    assert [r.v for r in files.lookup(spark, str(tmp_path / "s"), "k", [3], ["v"]).collect()] == list(range(3, 50, 5))
    with pytest.raises(KeyError):
        files.lookup(spark, str(tmp_path / "s"), "k", [3, 99], ["v"])


def test_streams(spark, tmp_path):
    feed = spark.range(200).selectExpr("id % 3 as business_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(id as int)) as ts", "if(id % 2 = 0, 'in', 'out') as direction", "id as cents")
    feed.write.parquet(str(tmp_path / "in"))
    for build, mode in ((rollup.daily_rollup, "complete"), (rollup.sessions, "append")):
        stream = spark.readStream.schema(feed.schema).parquet(str(tmp_path / "in"))
        q = build(stream).writeStream.format("memory").queryName(build.__name__).outputMode(mode).option("checkpointLocation", str(tmp_path / build.__name__)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
    got = spark.table("daily_rollup")
    assert got.agg(F.sum("n")).first()[0] == 200 and got.agg(F.sum("inflow") + F.sum("outflow")).first()[0] == sum(range(200))
    days = ledger(spark, 30, inflow=lambda i: 0, outflow=lambda i: 100, start=500).select("business_id", "date", "eod")
    days.write.parquet(str(tmp_path / "days"))
    q = rollup.overdraft_runs(spark.readStream.schema(days.schema).parquet(str(tmp_path / "days"))).writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", str(tmp_path / "runs")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    assert spark.table("runs").agg(F.max("longest")).first()[0] == 25
