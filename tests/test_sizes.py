"""Plans that must hold for tables of any size."""

import re

import numpy as np

from tests.conftest import SF
from tidemark import plans
from tidemark.operators import anomaly
from tidemark.plans import runs


def plan_of(spark, name: str) -> str:
    return plans.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_days_are_not_broadcast(spark):
    """The filter on movement makes the join of days and sums an inner one; a day is an exploded row, whose number Spark doesn't estimate."""
    assert re.search(r"SortMergeJoin \[business_id#\d+L, date#\d+\]", plan_of(spark, "balance_held_days"))


def test_generated_sales_are_not_broadcast(spark):
    assert "Join" not in plan_of(spark, "scenario_runs")


def test_small_forests_do_not_draw_their_numbers_again():
    """10,000 small businesses take minutes and not a quarter of an hour: each one's forest works on the nodes that hold rows and draws no number anew."""
    rng = np.random.default_rng(3)
    x, h = np.c_[rng.normal(size=67), rng.integers(0, 9, (67, 5))].astype(float), rng.integers(-(2**63), 2**63 - 1, 67)
    drawn = np.argsort(anomaly.draws(h, 200, 0), axis=1, kind="stable")
    forest, ended = anomaly.grow(x, drawn, 0)
    depth = np.empty((200, 67))
    np.put_along_axis(depth, drawn, ended, axis=1)
    assert (anomaly._score(depth, 67) == anomaly.scores_in(forest, x, 200, 67)).all()
    again, _ = anomaly.grow(x, drawn, np.random.default_rng(0))
    assert all((a == b).all() for one, other in zip(forest, again) for a, b in zip(one, other))


def test_windows_of_features_share_their_sorts(spark):
    """Each sort of a chain of windows holds a task's rows; five orders serve all of them, in tasks whose number isn't cut to the cores (7 before)."""
    plan = plan_of(spark, "anomaly_features")
    assert len(re.findall(r"\bSort \[", plan)) <= 5 and "REPARTITION_BY_NUM" in plan


def test_second_writing_has_no_fixed_number_of_tasks(spark, monkeypatch):
    """Of a table's exchange for the second writing only the keys are given, so its tasks grow with it."""
    seen, write = [], type(spark.range(0)).write.fget
    monkeypatch.setattr(type(spark.range(0)), "write", property(lambda df: (seen.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1]))
    runs.writings(spark, SF, "facilities")
    assert any("REPARTITION_BY_COL" in p for p in seen) and not any("REPARTITION_BY_NUM" in p for p in seen)
