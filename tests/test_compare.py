"""Comparison of two runs by digest trees."""

import random

import pytest

from tidemark.operators import compare, verification

SCHEMA = "k long, a string, b double"


def plain(before, after):
    """Leaves' columns and keys whose rows differ as multisets."""
    out = set()
    for i, c in enumerate("kab"):
        for k in {r[0] for r in before + after}:
            if sorted(str(r[i]) for r in before if r[0] == k) != sorted(str(r[i]) for r in after if r[0] == k):
                out.add((c, k))
    return out


def test_digests_ignore_order_and_files(spark):
    rows = [(i * 37, f"t{i % 9}", float(i)) for i in range(3000)]
    one = spark.createDataFrame(rows, SCHEMA)
    random.Random(1).shuffle(rows)
    other = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert compare.compare(one, other, "k").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_cells_are_named(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(-5000, 90000) if i % 50 else None, rng.choice([None, "x", "y"]), rng.choice([None, 1.0, 2.0])) for i in range(800)]
    rows += rows[:40]  # keys and rows repeat
    after = [list(r) for r in rows]
    for i in rng.sample(range(len(after)), 6):
        after[i][1] = "new"
    after[7][2] = 99.0
    after = [tuple(r) for r in after][:-1] + [(95000, "added", None)]
    got = compare.compare(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(after, SCHEMA).repartition(3), "k").collect()
    assert {(r.column, r.key) for r in got} == plain(rows, after)
    assert all(r.key is None and r.first_key is None or r.first_key <= r.key <= r.last_key for r in got)
    assert ("b", after[7][0]) in {(r.column, r.key) for r in got if r.after == "99.0"}


def test_swapped_values_are_seen(spark):
    """Column sums alone would not tell: two keys exchange their values."""
    rows = [(i, f"v{i}", 0.0) for i in range(100)]
    swapped = rows[:]
    swapped[3], swapped[90] = (3, "v90", 0.0), (90, "v3", 0.0)
    got = compare.compare(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(swapped, SCHEMA), "k").collect()
    assert {(r.column, r.key, r.before, r.after) for r in got} == {("a", 3, "v3", "v90"), ("a", 90, "v90", "v3")}


def test_empty_and_other_columns(spark):
    one = spark.createDataFrame([(1, "x", 1.0)], SCHEMA)
    assert compare.compare(one.limit(0), one.limit(0), "k").count() == 0
    assert {r.column for r in compare.compare(one, one.limit(0), "k").collect()} == {"k", "a", "b"}
    more = one.selectExpr("k", "a", "cast(b as string) b", "1 as c")
    assert {r.column for r in compare.compare(one, more, "k").collect()} == {"b", "c"}


def test_few_ranges_reach_the_scan(spark, tmp_path):
    rows = [(i, "x", 1.0) for i in range(20000)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "a"))
    df = spark.read.parquet(str(tmp_path / "a"))
    bounds = compare.key_bounds("k", df)
    leaves = compare.ranges(spark.createDataFrame([("a", 7)], "column string, node int"), bounds)
    plan = compare.cells(df, df, "k", leaves, bounds)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(IsNull(k),And(GreaterThanOrEqual(k,140),LessThanOrEqual(k,159)))]" in plan


def test_audit_names_rows_and_inputs(spark, tmp_path):
    made = spark.createDataFrame([(i, f"d{i}", i * 10) for i in range(6)], "k long, decision string, amount long")
    one = spark.createDataFrame([(i, f"t{i % 5}", float(i)) for i in range(0, 3000, 3)], SCHEMA)
    inputs = lambda t: {"one": (t, "k"), "two": (made, "k")}
    names = ["k", "decision", "amount"]
    verification.seal(made, "k", names, inputs(one), str(tmp_path / "a"))
    audit = lambda folder, again, t: {tuple(r) for r in verification.audit(spark, str(tmp_path / folder), "k", names, again, inputs(t)).collect()}
    assert audit("a", made, one.repartition(4)) == set()
    again = made.where("k <> 1").selectExpr("k", "decision", "if(k = 2, 99, amount) as amount").unionByName(spark.createDataFrame([(50, "x", 1)], made.schema))
    got = audit("a", again, one)
    assert got == {("missing", "decisions", None, 1, 1), ("not reproduced", "decisions", None, 2, 2), ("new", "decisions", None, 50, 50)}
    spark.read.parquet(str(tmp_path / "a/decisions")).selectExpr("k", "if(k = 4, 'forged', decision) as decision", "amount", "receipt").write.parquet(str(tmp_path / "b/decisions"))
    spark.read.parquet(str(tmp_path / "a/inputs")).write.parquet(str(tmp_path / "b/inputs"))
    # a cell inside, and a row whose key lies past all that were sealed
    later = one.selectExpr("k", "if(k = 300, 'other', a) as a", "b").unionByName(spark.createDataFrame([(99_999, "t0", 1.0)], SCHEMA))
    got = audit("b", made, later)
    assert ("damaged row", "decisions", None, 4, 4) in got and {r[:3] for r in got if r[0] == "changed input"} == {("changed input", "one", c) for c in "kab"}
    assert any(r[2] == "a" and r[3] <= 300 <= r[4] for r in got) and all(r[1] == "one" or r[0] != "changed input" for r in got)
