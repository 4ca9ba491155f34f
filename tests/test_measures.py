"""The smaller operators, training, the generator, files and streams on small frames, against plain Python."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import storage
from tidemark.operators import anomaly, credit, forecast, generator, measures, profile, rules
from tidemark.sources import files
from tidemark.streaming import rollup
from tests.test_operators import END, ledger


def test_damped_trend_equals_least_squares(spark):
    rng = np.random.default_rng(0)
    flows = rng.integers(-500, 500, 80)
    d = ledger(spark, 80, inflow=lambda i: 1000 + int(flows[i]) + 3 * i, outflow=lambda i: 900)
    got = {r.day: (r.net, r.balance) for r in forecast.ols_damped_path(d).collect()}
    rows = sorted(d.collect(), key=lambda r: r.date)
    x = np.array([[1.0, i, *(float(r.date.weekday() == k) for k in range(1, 7))] for i, r in enumerate(rows)])
    beta = np.linalg.lstsq(x, np.array([float(r.net) for r in rows]), rcond=None)[0]
    for h in (1, 7, 40, 90):
        w = (END + dt.timedelta(days=h)).weekday()
        want = np.array([1.0, 79 + 0.5 * h, *(float(w == k) for k in range(1, 7))]) @ beta
        assert got[h][0] == pytest.approx(want) and got[h][1] == rows[-1].eod


def test_structural_repeats_what_days_there_are(spark):
    d = ledger(spark, 20, inflow=lambda i: 100, outflow=lambda i: 2 * i)
    assert forecast.structural_path(d).count() == 90


def test_hazards_by_definition(spark):
    import hashlib

    rng = np.random.default_rng(1)
    flows = rng.integers(-2000, 2000, 95)
    d = ledger(spark, 95, inflow=lambda i: max(int(flows[i]), 0), outflow=lambda i: max(-int(flows[i]), 0), start=6000)
    got = forecast.hazard(d, seed=3, sims=60).first()
    last = sorted(d.where("dbe < 90").collect(), key=lambda r: r.date)
    nets, below = [r.net for r in last], {30: 0, 60: 0, 90: 0}
    for sim in range(60):
        at, low = last[-1].eod, {}
        for day in range(90):
            start = int(hashlib.sha256(f"3|1|{sim}".encode()).hexdigest()[4 * (day // 7) : 4 * (day // 7) + 4], 16) % 83
            at += nets[min(start + day % 7, 89)]
            low[day] = min(at, low.get(day - 1, at))
        for h in below:
            below[h] += low[h - 1] < 0
    assert (got.hazard_30d, got.hazard_60d, got.hazard_90d) == pytest.approx(tuple(below[h] / 60 for h in (30, 60, 90)))


def test_registry_reasons(spark):
    """Hand-built businesses: real without obligations, one with a facility of type none, one without a code."""
    d = ledger(spark, 200)
    base = profile.daily_features(d, 60, arrays=True)
    real = base.withColumn("business_id", F.lit(2).cast("long")).withColumn("data_source", F.lit("external_real"))
    base = base.unionByName(real).withColumns({f"c_{k}": F.lit(None).cast("double") for k in ("largest_single_source_ratio", "top_expense_category_share", "unique_counterparties_count", "counterparty_concentration_index", "new_counterparty_ratio_30d", "circular_counterparty_count", "counterparty_persistence_ratio", "prior_tx_days", "fi_outflow_90", "loan_outflow_90")}).withColumn("c_seen", F.lit(None).cast("boolean"))
    biz = spark.createDataFrame([(1, "retail_trade"), (2, "not_available_in_source")], "business_id long, sector string")
    obl = spark.createDataFrame([(1, 1, 30000 * 100, "monthly", "active", None, None, None)], "obligation_id long, business_id long, cents long, frequency string, status string, final_date date, final_cents long, status_change_date date")
    spine = spark.createDataFrame([(1, END), (2, END)], "business_id long, window_end date")
    sheets = spark.createDataFrame([], "business_id long, month_end date, cash long, inventory long, receivables long, payables long, short_term long")
    fac = spark.createDataFrame([(1, "none", 0, 0, 0)], "business_id long, facility_type string, limit_cents long, drawn_cents long, headroom_cents long")
    scr = spark.createDataFrame([(1, 5411, "compliant"), (2, None, "compliant")], "business_id long, mcc int, screen_status string")
    stats = spark.createDataFrame([("retail_trade", "cash_flow_volatility", 10.0, 5.0, 3)], "sector string, feature string, mean double, std double, n long")
    out = profile.registry(base, biz, profile.obligation_features(obl, spine), profile.balance_sheet_row(sheets, spine), fac, scr, forecast.hazard_of(base.select("business_id", "nets", "balance"), sims=10), stats, ["cash_flow_volatility"], [("2026-02-18", "2026-03-22")])
    a, b = (r for r in out.orderBy("business_id").collect())
    assert (a.committed_monthly_outflow, a.obligation_coverage_ratio) == pytest.approx((30000, 3.0)) and a.obligation_horizon_months__reason == "not_applicable"
    assert b.committed_monthly_outflow == 0 and b.obligation_coverage_ratio__reason == "not_applicable" and b.mandate_cancellation_count_90d__reason == "not_available_in_source"
    assert (a.declared_mcc_code, b.declared_mcc_code__reason) == (5411, "not_available_in_source") and a.compliance_screen_status == "compliant"
    assert (a.esg_proxy_score__reason, b.esg_proxy_score__reason, b.governance_transparency_score__reason) == ("not_implemented", "not_available_in_source", "not_implemented")
    assert a.emergency_line_present is False and a.facility_utilisation__reason == "not_applicable" and b.emergency_line_present__reason == "not_available_in_source"
    assert (a.cash_eom__reason, b.cash_eom__reason) == ("insufficient_history", "not_available_in_source") and a.financing_outflow_ratio__reason == "insufficient_events"
    assert a.season_adjusted is False and b.season_adjusted__reason == "not_available_in_source" and a.liquidity_hazard_90d == 0
    assert a.sector_relative_cash_flow_volatility_z == pytest.approx(-2.0) and b.sector_relative_cash_flow_volatility_z__reason == "not_available_in_source"


def test_training_is_exact(spark):
    """The exported artifact's scores equal a Newton solution of the penalised likelihood."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) * [1, 50, 1000]
    y = (rng.random(200) < 1 / (1 + np.exp(-(x[:, 0] - x[:, 1] / 50)))).astype(int)
    rows = [(i, int(y[i]), float(x[i, 0]) if i % 9 else None, float(x[i, 1]), float(x[i, 2]), 7.0) for i in range(200)]
    df = spark.createDataFrame(rows, "business_id long, label int, a double, b double, avg_daily_balance double, flat double")
    names = ["a", "b", "avg_daily_balance", "flat"]
    artifact, intercept = credit.train(df, names, "label", c=0.5)
    assert [r[0] for r in artifact] == names[:3] and artifact[2][5] and not artifact[0][5]
    z = np.array([[np.nan if v is None else v for v in r[2:5]] for r in rows])
    z[:, 2] = np.sign(z[:, 2]) * np.log1p(np.abs(z[:, 2]))
    z = np.where(np.isnan(z), np.nanmedian(z, axis=0), z)
    z = np.c_[np.ones(200), (z - z.mean(axis=0)) / z.std(axis=0)]
    beta, ridge = np.zeros(4), np.diag([0, 2.0, 2.0, 2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (p - y) + ridge @ beta)
    assert [intercept, *(r[1] for r in artifact)] == pytest.approx(beta.tolist(), abs=1e-5)
    got = {r.business_id: r.s + intercept for r in rules.contributions(df, artifact).groupBy("business_id").agg(F.sum("contribution").alias("s")).collect()}
    w = np.array([intercept, *(r[1] for r in artifact)])
    assert all(got[i] == pytest.approx(float(z[i] @ w), abs=1e-9) for i in range(200))
    auc = {r.model: r.auc for r in credit.compared(df, names[:3], "business_id", "label").collect()}
    assert auc["linear"] > 0.75 and auc["boosted"] > 0.6


def test_fisher_and_nearest(spark):
    t = spark.createDataFrame([("x", 3, 1, 1, 3), ("y", 8, 2, 1, 5), ("z", 0, 0, 2, 3)], "k string, a long, b long, c long, d long")
    for r in measures.fisher_exact(t, *"abcd").collect():
        n, row, col = r.a + r.b + r.c + r.d, r.a + r.b, r.a + r.c
        law = {x: math.comb(row, x) * math.comb(n - row, col - x) / math.comb(n, col) for x in range(max(0, row + col - n), min(row, col) + 1)}
        assert r.p == pytest.approx(min(1, sum(p for p in law.values() if p <= law[r.a] * (1 + 1e-9))))
    rng = np.random.default_rng(4)
    rows = [("g", i, float(rng.integers(0, 50)), "ab"[int(rng.integers(0, 2))]) for i in range(60)]
    got = {r.i: r.gap for r in measures.nearest_of_other_label(spark.createDataFrame(rows, "g string, i int, v double, l string"), "i", "v", "l", ["g"]).collect()}
    assert got == {i: min(abs(v - w) for _, _, w, m in rows if m != l) for _, i, v, l in rows}


def test_calendar_prices_joins_and_evidence(spark):
    day = spark.createDataFrame([(dt.date(2000, 1, 1),), (dt.date(2024, 7, 7),)], "d date")
    got = [tuple(r) for r in day.select(*(c.alias(k) for k, c in measures.lunar_date(F.col("d")).items())).collect()]
    assert got == [(1420, 9, 24), (1445, 12, 30)]
    m = lambda v: spark.createDataFrame([("2024-01", v)], "month string, x double")
    ok = measures.month_prices(m(2000.0).toDF("month", "per_ounce"), m(3.75).toDF("month", "rate"), m(3.7501).toDF("month", "implied_rate")).first()
    assert ok.price_per_gram == pytest.approx(2000 * 3.75 / 31.1034768)
    with pytest.raises(Exception, match="rates disagree in 2024-01"):
        measures.month_prices(m(2000.0).toDF("month", "per_ounce"), m(3.75).toDF("month", "rate"), m(3.8).toDF("month", "implied_rate")).collect()
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, l string"), spark.createDataFrame([(1, "p"), (1, "q")], "k int, r string")
    assert measures.one_to_one(a, b.dropDuplicates(["k"]), ["k"]).count() == 1
    with pytest.raises(Exception, match="twice on the right side"):
        measures.one_to_one(a, b, ["k"]).collect()
    e = spark.createDataFrame([("f", "registry"), ("f", "declared"), ("g", "bank_feed")], "f string, evidence string")
    assert {tuple(r) for r in measures.weakest_evidence(e, ["f"]).collect()} == {("f", "declared"), ("g", "bank_feed")}
    with pytest.raises(Exception, match="no such evidence"):
        measures.weakest_evidence(e.withColumn("evidence", F.lit("rumour")), ["f"]).collect()
    raw = spark.createDataFrame([("out", 5, " ", "1", "R", "PAY"), ("in", 7, "b", "2", "", "Wire"), ("in", 1, None, None, None, None)], "direction string, amount long, bank string, account string, purpose string, operation string")
    assert [(r.signed, r.partner, r.category) for r in measures.adapted(raw, [("R", "repayment")]).collect()] == [(-5, None, "repayment"), (7, "b-2", "wire"), (1, None, "unknown")]


def test_generator_is_stable_and_bounded(spark):
    ids = spark.range(1, 400).withColumnRenamed("id", "business_id")
    b = generator.businesses(ids)
    some = {r.business_id: r for r in generator.businesses(ids.where("business_id % 50 = 0")).collect()}
    whole = {r.business_id: r for r in b.collect()}
    assert all(whole[i] == r for i, r in some.items())
    assert 0.2 < np.mean([r.resilience for r in whole.values()]) < 0.37 and 0.02 < np.mean([r.label for r in whole.values()]) < 0.4
    seen = np.corrcoef([r.resilience for r in whole.values()], [r.resilience_band for r in whole.values()])[0, 1]
    assert 0.4 < seen < 0.75
    r = generator.rates(b.where("business_id < 40"), generator.overlays({"baseline": {}, "closed": {"shock": 0.0, "shock_from": 10, "shock_days": 20}})).cache()
    counts = r.groupBy("scenario").agg(F.sum("count").alias("n"), F.sum("lam").alias("lam"), F.sum(F.when(F.col("day").between(10, 29), F.col("count"))).alias("closed")).collect()
    by = {x.scenario: x for x in counts}
    assert by["closed"].closed == 0 and by["baseline"].closed > 0 and by["baseline"].n == pytest.approx(by["baseline"].lam, rel=0.05)
    with pytest.raises(ValueError, match="not allowed"):
        generator.overlays({"x": {"rate": 99}})
    with pytest.raises(ValueError, match="not allowed"):
        generator.overlays({"x": {"seed": 1}})
    r.unpersist()


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", 1.5), (1, None, 2.5)], "k long, s string, v double")
    files.write_csv(df, str(tmp_path / "c"), ["k"])
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "c"), "k long, s string, v double").orderBy("k").collect()] == [(1, None, 2.5), (2, "b", 1.5)]
    (tmp_path / "trans.csv").write_text("trans_id;date;type\n1;930105;PRIJEM\n2;930106;VYDAJ\n")
    raw = files.read_csv(spark, str(tmp_path / "trans.csv"), "trans_id string, date string, type string", ";")
    good = files.mapped(raw, {"id": ("trans_id", "long"), "day": ("date", "yymmdd"), "kind": ("type", "string")}, {"kind": ["PRIJEM", "VYDAJ"]}).orderBy("id").collect()
    assert tuple(good[0]) == (1, dt.date(1993, 1, 5), "PRIJEM")
    with pytest.raises(Exception, match="outside its domain"):
        files.mapped(raw, {"kind": ("type", "string")}, {"kind": ["PRIJEM"]}).collect()
    seen = files.hash_sidecars(spark, str(tmp_path / "trans.csv"))
    side = spark.createDataFrame(seen.collect(), seen.schema)
    assert files.altered(spark, str(tmp_path / "trans.csv"), side).count() == 0
    (tmp_path / "trans.csv").write_text("other")
    assert [r.verdict for r in files.altered(spark, str(tmp_path / "trans.csv"), side).collect()] == ["changed"]
    lines = files.decision_lines(df, "k").collect()
    assert all(len(r.receipt) == 64 and r.value.startswith("{") for r in lines)
    (tmp_path / "s.csv").write_text('﻿Period,Series,Value\n2024,Shops,"1,000"\n2024,Other,500\n2024,Total,1500\n', encoding="utf-8")
    got = {tuple(r) for r in files.read_statistics(spark, str(tmp_path / "s.csv"), {"Shops": "retail"}).collect()}
    assert got == {("2024", "retail", 1000.0), ("2024", "Other", 500.0)}
    (tmp_path / "t.csv").write_text("Period,Series,Value\n2024,Shops,900\n2024,Total,1500\n")
    with pytest.raises(Exception, match="add up in 2024"):
        files.read_statistics(spark, str(tmp_path / "t.csv"), {}).collect()
    files.write_report(df, str(tmp_path / "r"), "Rows")
    assert spark.read.text(str(tmp_path / "r"), wholetext=True).first().value.strip().split("\n") == ["# Rows", "", "| k | s | v |", "|-|-|-|", "| 1 | - | 2.5 |", "| 2 | b | 1.5 |"]
    assert storage.saved(df).count() == 2


def run(stream, name, tmp_path, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()


def test_streams_by_rows(spark, tmp_path):
    feed = spark.createDataFrame([(1, dt.datetime(2024, 1, d, 12), "in", 10 * d) for d in (1, 2, 3, 10, 11, 25)], "business_id long, ts timestamp, direction string, cents long")
    feed.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(feed.schema).parquet(str(tmp_path / "in"))
    run(rollup.sessions(source()), "spells", tmp_path, "append")
    got = sorted((r.start.day, r.n, r.cents) for r in spark.table("spells").collect())
    assert got[:2] == [(1, 3, 60), (10, 2, 210)]
    run(rollup.trailing_totals(source(), 7), "trailing", tmp_path, "complete")
    week = {r.through: r.inflow for r in spark.table("trailing").collect()}
    assert week[dt.date(2024, 1, 3)] == 60 and week[dt.date(2024, 1, 7)] == 60 and week[dt.date(2024, 1, 9)] == 30 and week[dt.date(2024, 1, 11)] == 210
    rows = [(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), 100.0 + (80.0 if i >= 20 else 0.0), 100.0, 20.0) for i in range(30)]
    days = spark.createDataFrame(rows, "business_id long, date date, inflow double, mean double, sd double")
    days.coalesce(1).write.parquet(str(tmp_path / "days"))
    run(rollup.break_signals(spark.readStream.schema(days.schema).parquet(str(tmp_path / "days"))), "breaks", tmp_path, "append")
    up = last = 0
    for i, r in enumerate(rows):
        up = max(0, up + (r[2] - 100) / 20 - 0.5)
        if up > 5:
            up, last = 0, i
    assert spark.table("breaks").first().last_signal == rows[last][1]


def test_flags_by_definition(spark):
    """detect() ranks rules first, then the forest, and keeps ten a business; what it keeps follows from features and scores of all rows of the window."""
    rng = np.random.default_rng(6)
    rows = [(1, i, END - dt.timedelta(days=int(rng.integers(0, 170))), int(rng.integers(8, 18)), "out", int(rng.integers(5000, 9000)), f"S{i % 9}", "ab"[i % 2]) for i in range(300)]
    rows += [(1, 900 + k, END - dt.timedelta(days=5 + k), 12, "in", 50_000_000 + k, f"X{k}", "c") for k in range(3)] + [(1, 999, END - dt.timedelta(days=400), 3, "in", 90_000_000, "Y", "z")]
    tx = spark.createDataFrame(rows, "business_id long, transaction_id long, date date, hour int, direction string, cents long, counterparty_id string, category string")
    t = storage.saved(anomaly.rules(anomaly.repeats(anomaly.features(anomaly.scanned(tx)))))
    flags = sorted(anomaly.detect(t, trees=40).collect(), key=lambda r: r.rank)
    hits = {r.transaction_id for r in t.where("rule_hit").collect()}
    ids = [r.transaction_id for r in flags]
    assert 999 not in ids and len(ids) == len(set(ids)) <= 10 and [r.rank for r in flags] == list(range(1, len(flags) + 1))
    assert [i in hits for i in ids] == sorted((i in hits for i in ids), reverse=True) and {900, 901, 902} <= set(ids)
