"""Features, methods and sweeps that a user adds."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.test_operators import ledger
from tidemark import plans
from tidemark.operators import forecast, profile, sweeps
from tidemark.operators.extensions import Registry
from tidemark.sources import ledger as L


@pytest.fixture
def added():
    profile.FEATURES.add("net_per_inflow", "margin / greatest(avg_monthly_inflow, 1.0D)", ("avg_monthly_inflow < 1", "near_zero_denominator"), inputs=["margin", "avg_monthly_inflow"])
    profile.FEATURES.add("margin", "m_in - m_out", inputs=["m_in", "m_out"])
    forecast.PATHS.add("last_day", lambda d: d.where("dbe = 0").select("business_id", F.explode(F.sequence(F.lit(1), F.lit(90))).alias("day"), F.col("eod").alias("balance"), "net"))
    yield
    profile.FEATURES.remove("net_per_inflow")
    profile.FEATURES.remove("margin")
    forecast.PATHS.remove("last_day")


def test_added_features_and_methods_are_seen(spark, added):
    rows = plans.queries()["profile"](spark, SF).collect()
    for r in rows:
        if r.status == "insufficient_data":
            assert r.margin is None and r.margin__reason == "insufficient_data"
        else:
            assert r.margin == pytest.approx(r.avg_monthly_inflow - r.avg_monthly_outflow, abs=1e-4)
            assert r.net_per_inflow is None and r.net_per_inflow__reason == "near_zero_denominator" or r.net_per_inflow == pytest.approx(r.margin / max(r.avg_monthly_inflow, 1), abs=1e-4)
    assert any(r.net_per_inflow for r in rows)
    chosen = plans.queries()["forecast_selection"](spark, SF)
    assert "last_day" in {r.method for r in chosen.collect()}


def test_one_feature_gathers_no_more_than_it_reads(spark, added):
    d = ledger(spark, 200)
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    one, all_ = profile.daily_features(d, names=["net_per_inflow"]), profile.daily_features(d)
    assert "Window" in plan(all_) and "collect_list" in plan(all_)
    assert "Window" not in plan(one) and "collect_list" not in plan(one) and "regr_slope" not in plan(one)
    assert profile.FEATURES.needs(["net_per_inflow"]) == {"m_in", "m_out"}
    a, b = one.first(), all_.first()
    assert a.net_per_inflow == b.net_per_inflow is not None and "margin" not in one.columns


def test_duplicates_cycles_and_unknown_names_raise():
    r = Registry({"a": ("x + 1",), "b": ("a * 2", ("y < 0", "low"))}, lambda: {"x", "y"})
    assert r.inputs == {"a": ("x",), "b": ("a", "y")} and r.levels() == [["a"], ["b"]] and r.needs(["a"]) == {"x"}
    for name in ("a", "x"):
        with pytest.raises(ValueError, match="registered already"):
            r.add(name, "1", inputs=[])
    r.add("c", "d + 1", inputs=["d"])
    with pytest.raises(ValueError, match="d is not registered"):
        r.levels()
    r.add("d", "e + b", inputs=["e", "b"])
    r.add("e", "c", inputs=["c"])
    with pytest.raises(ValueError, match="cycle: c -> d -> e -> c"):
        r.levels()
    assert r.levels(["b"]) == [["a"], ["b"]]


def test_a_sweep_reads_the_ledger_once(spark):
    base = L.daily(spark, SF).groupBy("business_id").agg(F.avg("eod").alias("m"), F.expr("cast(count_if(eod < 0) > 0 as int)").alias("label"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    scans = lambda df: plan(df).count("lineitem.parquet")
    out = sweeps.sweep(base, {"cap": ([1e3, 1e9], "least(m, {v})"), "none": ([1, 2], "cast(null as double) + {v}")}, "label", "m")
    assert scans(base) == 1 and scans(out) == 0
    rows = {(r.parameter, r.setting): r for r in out.collect()}
    assert rows["cap", 1e9].rho == pytest.approx(1) and rows["cap", 1e9].auc == pytest.approx(0, abs=1) and rows["none", 1.0].n == 0 and rows["none", 1.0].auc is None
