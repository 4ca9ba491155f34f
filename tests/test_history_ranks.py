"""Panes, ranks by range partitions and bootstrap vectors against plain Python."""

import datetime as dt


import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.test_operators import END, ledger
from tidemark.operators import history, measures, profile, ranks, resampling, stats
from tidemark.plans.history import MORE_DAYS
from tidemark.sources import ledger as L



@pytest.mark.parametrize("days", [89, 90, 200, 431])
def test_every_point_equals_the_profile_of_that_day(spark, days):
    rng = np.random.default_rng(days)
    flows = rng.integers(0, 3, days) * rng.integers(0, 6000, days)
    d = ledger(spark, days, inflow=lambda i: int(flows[i]), outflow=lambda i: 2500 + i % 11 * 100, start=20000).persist()
    got = {r.as_of: r for r in history.history(d).collect()}
    want = {}
    for k in range(12):
        end = END - dt.timedelta(days=30 * k)
        past = d.where(F.col("date") <= F.lit(end)).withColumn("window_end", F.lit(end)).withColumn("dbe", F.col("dbe") - 30 * k)
        if 30 * k + 90 <= days:
            want[end] = profile.daily_features(past).first()
    assert got.keys() == want.keys() and len(want) == (0 if days < 90 else min(12, (days - 90) // 30 + 1))
    for end, w in want.items():
        for name in profile.DAILY:
            a, b = got[end][name], w[name]
            assert (a is None) == (b is None) and got[end][f"{name}__reason"] == w[f"{name}__reason"]
            assert a is None or a == pytest.approx(b, rel=1e-9, abs=1e-7), (end, name)


def test_merging_panes_is_associative(spark):
    rng = np.random.default_rng(3)
    flows = rng.integers(-9000, 9000, 150)
    p = history.panes(ledger(spark, 150, inflow=lambda i: max(0, int(flows[i])), outflow=lambda i: max(0, -int(flows[i])), start=100))
    held = p.groupBy("business_id").agg(F.expr("transform(array_sort(collect_list(struct(-pane as k, s))), x -> x.s)").alias("h"))
    left = F.expr(f"aggregate(slice(h, 2, 4), h[0], (a, x) -> {history.merge('a', 'x')})")
    right = F.expr(f"aggregate(reverse(slice(h, 1, 4)), h[4], (a, x) -> {history.merge('x', 'a')})")
    a, b = held.select(left.alias("a"), right.alias("b")).first()
    assert a.n == 150 and len(a.days) == 150
    for name in a.asDict():
        assert a[name] == b[name] or a[name] == pytest.approx(b[name]), name


def test_history_needs_no_further_exchange(spark):
    d = L.daily(spark, SF, MORE_DAYS)
    hashed = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert hashed(history.history(d)) == hashed(d)


def rank_of(values):
    v = np.array(values, float)
    return [(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v]


def test_one_group_is_dealt_over_partitions(spark):
    """All rows in one group, a third of them one value: no task holds the group, and no window is keyed by it alone."""
    rows = [(i, "only", float(i % 997) if i % 3 else 5.0, int(i % 5 == 0)) for i in range(6000)]
    d = spark.createDataFrame(rows, "id int, g string, v double, l int").repartition(6)
    placed = ranks.row_numbers(d, ["g"], ["v", "id"])
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    assert [r.id for r in placed.orderBy("_below").collect()] == [r[0] for r in order]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = d.repartitionByRange("g", "v", "id").groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) == 4 and max(r["count"] for r in parts) < 3000
        v = ranks.ranked_values(d, ["g"], "v").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = dict(zip([r[2] for r in rows], rank_of([r[2] for r in rows])))
    assert {r.v: r._below + (r._m + 1) / 2 for r in v} == want and {r._total for r in v} == {6000}
    pos = [want[r[2]] for r in rows if r[3]]
    got = stats.auc(d, "v", "l", ["g"]).first()
    assert got.auc == pytest.approx((sum(pos) - len(pos) * (len(pos) + 1) / 2) / (len(pos) * (6000 - len(pos))))
    pct = {r.id: r.pct for r in measures.percent_ranks(d, "v", ["g"]).collect()}
    assert all(pct[r[0]] == pytest.approx(want[r[2]] / 6000) for r in rows)


def test_ranks_of_null_groups_and_nothing(spark):
    d = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", None), ("a", 3.0)], "g string, v double")
    assert sorted((str(r.g), r.v, r._below, r._total) for r in ranks.ranked_values(d, ["g"], "v").collect()) == [("None", 1.0, 0, 2), ("None", 2.0, 1, 2), ("a", 3.0, 0, 1)]
    assert ranks.ranked_values(d.limit(0), ["g"], "v").count() == 0 and stats.auc(d.limit(0).withColumn("l", F.lit(1)), "v", "l", ["g"]).count() == 0
    assert stats.spearman(d.withColumn("w", F.col("v")), "v", "w", ["g"]).where("g is null").first().rho == pytest.approx(1)


def test_folds_are_stratified(spark):
    d = spark.createDataFrame([(i, i % 7 == 0) for i in range(210)], "id int, l boolean")
    f = stats.folds(d, "id", "l", 5, "x").groupBy("l", "fold").count().collect()
    assert {(r.l, r["count"]) for r in f} == {(True, 6), (False, 36)}


DRAWS = 40


def draws_of(rows, key, seed):
    return np.array([resampling.weights([str(r[key])], DRAWS, seed)[0] for r in rows]).T


def midranks(v, w):
    v = np.asarray(v)
    return np.array([w[v < x].sum() + (w[v == x].sum() + 1) / 2 for x in v])


def test_intervals_by_definition(spark):
    """AUC, rank correlation and median against draws made one by one; clusters of two rows; ties that cross partitions; null and single-row groups."""
    rng = np.random.default_rng(0)
    rows = [(i, "ab"[i % 3 > 0], float(rng.integers(0, 9)) if i % 2 else 0.0, float(rng.integers(-3, 4)) if i % 7 else 0.0, int(rng.random() < 0.4), i // 2) for i in range(500)]
    rows += [(1000, "a", None, 1.0, 1, 1), (1001, "a", float("nan"), 1.0, 1, 1), (1002, None, 2.0, 3.0, 1, 7), (1003, None, 2.0, 1.0, 0, 9), (1004, "one", 1.0, 1.0, None, 3)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double, l int, c long").repartition(5)

    def auc(rs, w):
        own = np.array([r[4] for r in rs])
        p = (w * own).sum()
        return ((w * own * midranks([r[2] for r in rs], w)).sum() - p * (p + 1) / 2) / (p * (w.sum() - p)) if p * (w.sum() - p) else None

    def rho(rs, w):
        a, b = (midranks([r[k] for r in rs], w) - (w.sum() + 1) / 2 for k in (2, 3))
        spread = (w * a * a).sum() * (w * b * b).sum()
        return (w * a * b).sum() / spread**0.5 if spread > 0 else None

    def median(rs, w):
        return float(np.median(np.repeat([r[3] for r in rs], w))) if w.sum() else None

    def want(f, seed, key, usable):
        out = {}
        for g in ("a", "b", None, "one"):
            rs = [r for r in rows if r[1] == g and usable(r)]
            found = [v for v in (f(rs, w) for w in draws_of(rs, key, seed)) if v is not None] if rs else []
            if found:
                out[g] = tuple(np.percentile(found, [2.5, 50, 97.5]))
        return out

    fine = lambda r: r[2] is not None and r[2] == r[2]
    cases = [
        (resampling.auc_interval(df, "x", "l", "c", ["g"], DRAWS), want(auc, "auc", 5, lambda r: fine(r) and r[4] is not None)),
        (resampling.spearman_interval(df, "x", "y", "c", ["g"], DRAWS), want(rho, "rho", 5, fine)),
        (resampling.median_interval(df, "y", "id", ["g"], DRAWS), want(median, "median", 0, lambda r: True)),
    ]
    for made, wanted in cases:
        got = {r.g: (r.low, r.mid, r.high) for r in made.collect()}
        assert got.keys() == wanted.keys() and all(got[g] == pytest.approx(wanted[g]) for g in wanted)
    assert resampling.auc_interval(df.limit(0), "x", "l", "c", ["g"], DRAWS).count() == 0
    whole = resampling.median_interval(df, "y", "id", draws=DRAWS).first()
    assert tuple(whole) == pytest.approx(tuple(np.percentile([median(rows, w) for w in draws_of(rows, 0, "median")], [2.5, 50, 97.5])))


def test_constant_inflow_has_no_variance(spark):
    """Prior windows without any change: the deviation is 0 and not the noise of a difference, which would make breaks of it."""
    rows = [(b, i, 0 if i < 90 else 10_007 * b * b + i * i % (97 + b)) for b in range(1, 41) for i in range(180)]
    d = spark.createDataFrame(rows, "business_id long, i int, inflow long").selectExpr(
        "business_id", "date_add(date'2024-01-01', i) as date", "date'2024-06-28' as window_end", "'synthetic' as data_source", "179 - i as dbe", "inflow", "if(inflow > 0, 1L, 0L) as inflow_count",
        "0L as outflow", "0L as outflow_count", "0L as recurring", "inflow as net", "1000L + inflow as eod")
    got = history.window_stats(history.panes(d)).where("n_prior = 90").select("prior_sd", "prior_mean").collect()
    assert len(got) == 40 and {tuple(r) for r in got} == {(0.0, 0.0)}
