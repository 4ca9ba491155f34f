"""Close and repeated payments against pairs made one by one, and a counterparty with 100,000 equal ones."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import anomaly

SCHEMA = "business_id long, transaction_id long, date date, hour int, direction string, cents long, counterparty_id string, recurring boolean"


def payments(seed, n=260):
    rng = random.Random(seed)
    amount = lambda: rng.choice([rng.randint(1, 12), rng.randint(95, 106), rng.randint(9900, 10100), rng.randint(1, 10**6), 0, -100])
    return [(rng.randint(1, 2), i, dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(20)), rng.randrange(24), rng.choice(["out", "out", "in"]), amount(), rng.choice(["x", "y", None]), rng.random() < 0.1) for i in range(n)]


def own(rows):
    return [r for r in rows if r[4] == "out" and r[6] is not None and not r[7]]


@pytest.mark.parametrize("seed,tolerance", [(0, 0.01), (1, 0.05), (2, 0.01)])
def test_close_and_repeated_by_pairs(spark, seed, tolerance):
    rows = payments(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    paid = [r for r in own(rows) if r[5] > 0]
    same = lambda a, b: (a[0], a[6]) == (b[0], b[6]) and a[1] != b[1]
    close = {(b[0], b[6], b[5]): sum(same(a, b) and abs(b[5] / a[5] - 1) <= tolerance for a in paid) for b in paid}
    above = {(b[0], b[6], b[5]): sum(same(a, b) and a[5] > b[5] and abs(a[5] / b[5] - 1) <= tolerance for a in paid) for b in paid}
    got = anomaly.close_amounts(df.where("direction = 'out' and counterparty_id is not null and not recurring"), tolerance).collect()
    assert {(r.business_id, r.counterparty_id, r.cents): r.close for r in got} == close and {(r.business_id, r.counterparty_id, r.cents): r.above for r in got} == above
    when = lambda r: (r[2], r[3], r[1])
    again = {b[1] for b in paid for a in paid if same(a, b) and 0 <= (b[2] - a[2]).days <= 3 and when(a) < when(b) and abs(b[5] / a[5] - 1) <= tolerance}
    assert {r.transaction_id for r in anomaly.repeats(df, "window", tolerance).where("repeat_payment").collect()} == again != set()
    rate = {}
    for k in {(r[0], r[6]) for r in paid}:
        of = [r for r in paid if (r[0], r[6]) == k]
        pairs = sum(max(a[5], b[5]) / min(a[5], b[5]) - 1 <= tolerance for i, a in enumerate(of) for b in of[:i])
        rate[k] = pairs / (len(of) * (len(of) - 1) / 2)
    limit = sorted(rate.values())[1] + 1e-12
    rare = {b[1] for b in paid if b[1] in again and rate[b[0], b[6]] < limit}
    out = anomaly.repeats(df, "rarity", tolerance, rarity=limit)
    assert {r.transaction_id for r in out.where("repeat_payment").collect()} == rare and out.columns == [*df.columns, "repeat_payment"] and out.count() == len(rows)


def test_a_hot_counterparty(spark):
    """100,000 payments of one amount on one day: a row each for the day and the amount, so no pairs."""
    df = spark.range(100_000).select(F.lit(1).cast("long").alias("business_id"), F.col("id").alias("transaction_id"), F.lit("2024-01-01").cast("date").alias("date"), F.lit(1).alias("hour"), F.lit("out").alias("direction"), F.lit(500).cast("long").alias("cents"), F.lit("x").alias("counterparty_id"), F.lit(False).alias("recurring"))
    assert [tuple(r) for r in anomaly.close_amounts(df).collect()] == [(1, "x", 500, 100_000, 99_999, 0, 100_000)]
    assert anomaly.repeats(df, "window").where("repeat_payment").count() == 99_999
    assert anomaly.repeats(df, "rarity", rarity=2.0).where("repeat_payment").count() == 99_999
