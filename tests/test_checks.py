"""Least squares, calibration and contracts against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark import plans
from tidemark.operators import adapter, calibration, contracts, credit, least_squares, thinning, verification
from tidemark.sources import files, ledger


def test_least_squares_equals_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [("ab"[i % 2], float(rng.normal()), float(rng.normal()), float(i % 3 == 0), float(i)) for i in range(300)]
    rows = [(*r, 2.0 + 3 * r[1] - r[2] + 5 * r[3] + 0.01 * r[4] + float(rng.normal())) for r in rows]
    df = spark.createDataFrame([*rows, ("a", None, 1.0, 1.0, 1.0, 9.0), ("one", 1.0, 2.0, 0.0, 4.0, 7.0)], "g string, u double, v double, f double, t double, y double")
    terms = {"level": "1.0D", "u": "u", "v": "v", "f": "f", "again": "2 * u - v + 1", "t": "t", "none": "0.0D"}
    got = {(r.g, r.term): r for r in least_squares.fit(df, "y", terms, ["g"]).collect()}
    for g in "ab":
        own = np.array([r[1:] for r in rows if r[0] == g])
        want = np.linalg.lstsq(np.column_stack([np.ones(len(own)), own[:, 0], own[:, 1], own[:, 2], own[:, 3]]), own[:, 4], rcond=None)[0]
        assert [got[g, n].coefficient for n in ("level", "u", "v", "f", "t")] == pytest.approx(list(want), abs=1e-8)
        assert {n for n in terms if got[g, n].dropped} == {"again", "none"} and got[g, "again"].coefficient is None and got[g, "t"].n == 150
    assert [n for n in terms if not got["one", n].dropped] == ["level"] and got["one", "level"].coefficient == pytest.approx(7)
    assert least_squares.fit(df.limit(0), "y", terms, ["g"]).count() == 0


def plain_fit(rates, weights):
    """Pool adjacent violators, block by block."""
    blocks = []
    for r, w in zip(rates, weights):
        blocks.append([r * w, w, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], a)]
    return [b[0] / b[1] for b in blocks for _ in range(b[2])]


@pytest.mark.parametrize("seed", range(3))
def test_calibration_by_definition(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [("ab"[i % 2], float(rng.random() * 1.1 - 0.05), int(rng.random() < 0.4)) for i in range(250)] + [("a", None, 1), ("a", float("nan"), 0), ("b", 0.5, None), (None, 0.3, 1)]
    df = spark.createDataFrame(rows, "g string, s double, l int")
    binned = calibration.bins(df, "s", "l", ["g"], 10)
    fitted, errors = calibration.monotone(binned, ["g"]).collect(), {r.g: r for r in calibration.error(binned, ["g"]).collect()}
    for g in ("a", "b", None):
        own = [(min(max(s, 0), 1), y) for k, s, y in rows if k == g and s is not None and s == s and y is not None]
        by = {}
        for s, y in own:
            by.setdefault(min(int(s * 10), 9), []).append((s, y))
        rates, n = [np.mean([y for _, y in by[b]]) for b in sorted(by)], [len(by[b]) for b in sorted(by)]
        mine = sorted((r for r in fitted if r.g == g), key=lambda r: r.bin)
        assert [r.bin for r in mine] == sorted(by) and [r.fitted for r in mine] == pytest.approx(plain_fit(rates, n))
        gaps = [abs(np.mean([s for s, _ in by[b]]) - r) for b, r in zip(sorted(by), rates)]
        assert errors[g].ece == pytest.approx(np.average(gaps, weights=n)) and errors[g].worst == pytest.approx(max(gaps)) and errors[g].n == len(own)


def test_contracts_name_what_broke_them(spark, tmp_path):
    tables = {"t": spark.createDataFrame([(1, 5, 10), (2, -1, 10), (2, 7, 99), (4, None, None)], "k long, v int, home long"), "h": spark.createDataFrame([(10,), (11,), (None,)], "k long")}
    rules = {"t": contracts.Contract("k", {"v > 0": "v > 0", "any": "true"}, references={"home": "h"}), "h": contracts.Contract("k")}
    assert list(contracts.checked_write(tables["t"], str(tmp_path / "t"), rules["t"])) == [("v > 0", 4, 2, 2, 4), ("any", 4, 0, None, None)]
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    got = {(r.table_name, r.rule): tuple(r)[2:] for r in contracts.key_rules(tables, rules).collect()}
    assert got == {("t", "unique k"): (4, 1, 2, 2), ("t", "home in h"): (3, 1, 99, 99), ("h", "unique k"): (3, 0, None, None)}
    assert list(contracts.checked_write(tables["t"].limit(0), str(tmp_path / "e"), rules["t"])) == [("v > 0", 0, 0, None, None), ("any", 0, 0, None, None)]


def test_contracts_count_in_the_writing_pass(spark, tmp_path):
    """No scan but the one that writes: an accumulator counts how often rows are made."""
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.range(1000).mapInArrow(seen, "id long")
    assert list(contracts.checked_write(df, str(tmp_path / "x"), contracts.Contract("id", {"even": "id % 2 = 0"}))) == [("even", 1000, 500, 1, 999)]
    assert made.value == 1000


def test_values_are_coerced(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("true", 1.0, True), (" No ", nan, False), ("", inf, None), ("2.5", -inf, True), ("x", None, True)], "t string, d double, b boolean")
    got = credit.transformed(df, ["t", "d", "b"], frozenset()).collect()
    assert [r.t for r in got] == [1.0, 0.0, None, 2.5, None] and [r.d for r in got] == [1.0, None, None, None, None] and [r.b for r in got] == [1.0, 0.0, None, 1.0, 1.0]
    found = {r.feature: tuple(r)[1:] for r in credit.inputs(credit.transformed(df, ["t", "d", "b"], frozenset()).withColumn("none", credit.F.lit(None).cast("double")), ["t", "d", "b", "none"]).collect()}
    assert found == {"t": (3, 0.0, 2.5, 1.0), "d": (1, 1.0, 1.0, 1.0), "b": (4, 0.0, 1.0, 1.0), "none": (0, None, None, None)}


def test_medians_over_ranges(spark):
    rng = np.random.default_rng(4)
    v = np.r_[rng.integers(0, 9, 900), np.full(400, 3)].astype(float)
    df = spark.createDataFrame([(float(x), float(i)) for i, x in enumerate(v)], "a double, b double").repartition(5)
    found = {r.feature: r.median for r in credit.inputs(df, ["a", "b"]).collect()}
    assert found == {"a": np.median(v), "b": np.median(np.arange(len(v)))}


def test_pages(spark):
    df = spark.createDataFrame([(12, "x"), (1, "x"), (21, "y"), (101, "y"), (None, "x")], "k long, s string")
    ids = lambda *a, **b: [r.k for r in adapter.page(df, "k", *a, **b).collect()]
    assert ids("1") == [1, 12, 101] and ids("1", offset=1, limit=1) == [12] and ids("1", s="x") == [1, 12] and ids(limit=2, offset=1) == [1, 12] and ids("9") == []


def test_every_day_has_a_balance_that_stands(spark):
    """The opening balance stands from the first day on, and for good where nothing moves; a day whose movements cancel out ends no balance."""
    nets = {1: [0, 0, 0, 5, 0, -5, 0, 0, 0, 0], 2: [0] * 7, 3: [4, 0, 0], 4: [1]}
    rows = [(b, i, len(v), n) for b, v in nets.items() for i, n in enumerate(v)]
    df = spark.createDataFrame(rows, "business_id long, i int, n int, net long").selectExpr("business_id", "date_add(date'2000-02-27', i) date", "date_add(date'2000-02-26', n) window_end", "net")
    got = {r.business_id: (r.changes, r.days_held, r.longest) for r in adapter.held_days(df).collect()}
    assert got == {1: (2, 10, 5), 2: (0, 7, 7), 3: (1, 3, 3), 4: (1, 1, 1)}


def test_held_days_cover_the_ledger(spark):
    days = {r.business_id: r["count"] for r in ledger.daily(spark, SF).groupBy("business_id").count().collect()}
    assert {r.business_id: r.days_held for r in plans.queries()["balance_held_days"](spark, SF).collect()} == days


def test_references_as_typed(spark):
    h = "ab12cd34" + "0" * 56
    rows = [(7, h, "M-7-AB12CD34"), (7, h, " m-7-ab12cd34 "), (8, h, "M-7-AB12CD34"), (7, h, "M-7-AB12CD35"), (7, h, "M-7-AB12CD3"), (7, h, "x M-7-AB12CD34"), (7, h, None), (7, h, "")]
    df = spark.createDataFrame(rows, "k long, receipt string, typed string")
    assert [r.matches for r in verification.matched_reference(df, "typed", "k", "receipt").collect()] == [True, True, False, False, False, False, False, False]
    assert {r.r for r in df.select(verification.reference(F.col("k"), F.col("receipt")).alias("r")).collect()} == {"M-7-AB12CD34", "M-8-AB12CD34"}


def test_a_year_stays_out(spark):
    df = spark.createDataFrame([("2019-12-31",), ("2020-01-01",), ("2020-12-31",), ("2021-01-01",), (None,)], "d string").selectExpr("cast(d as date) d")
    assert [str(r.d) for r in files.without_year(df, "d", 2020).collect()] == ["2019-12-31", "2021-01-01"]


def test_features_of_a_thinned_ledger(spark):
    """Windows give the whole ledger's features exactly, but for how recent a counterparty is inside one; weighting brings totals back, not counterparties."""
    rows = [(1, i, f"c{i % 9}" if i % 10 else None, "in" if i % 4 else "out", (i * 7) % 180, 100 + i) for i in range(400)]
    df = spark.createDataFrame(rows, "business_id long, transaction_id long, counterparty_id string, direction string, dbe int, cents long")
    made = {n: thinning.counterparty_shares(v).first().asDict() for n, v in thinning.variants(df, 4).items()}
    assert all(made["windows"][f] == pytest.approx(made["whole"][f]) for f in thinning.FEATURES)
    named = [r for r in rows if r[2] is not None and r[4] < 90]
    cin = {}
    for r in named:
        if r[3] == "in":
            cin[r[2]] = cin.get(r[2], 0) + r[5]
    assert made["whole"]["largest_single_source_ratio"] == pytest.approx(max(cin.values()) / sum(cin.values())) and made["whole"]["unique_counterparties_count"] == len({r[2] for r in named})
    found = {(r.feature, r.variant): r for r in thinning.bias(df, 4).collect()}
    assert all(found[f, "windows"].median_error == 0 and found[f, "windows"].businesses == 1 for f in thinning.FEATURES) and found["largest_single_source_ratio", "sampled"].median_error > 0
