"""Streams whose days come shuffled, stop and restart, or are replayed, against the batch result."""

import datetime as dt
import random
import shutil

import pytest

from tidemark.streaming import restate, rollup, stateful

START = dt.datetime(2024, 1, 1)
FAR = START + dt.timedelta(days=400)


@pytest.fixture(scope="module")
def rocks(spark):
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    stateful.use_rocksdb(spark)
    spark.conf.set(names[1], 1)
    yield spark
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def shuffled(rows, at, most_late, rng, parts):
    """Rows in batches, each at most so many days out of order."""
    rows = sorted(rows, key=lambda r: (r[at], r[0]))
    keys = [(r[at] + dt.timedelta(days=rng.uniform(0, most_late)), i) for i, r in enumerate(rows)]
    order = [rows[i] for _, i in sorted(keys)]
    size = -(-len(order) // parts)
    return [order[i : i + size] for i in range(0, len(order), size)]


def drop(spark, batches, schema, folder, first=0):
    for i, b in enumerate(batches, first):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{folder}/b{i:03d}")


def feed(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def run(df, out, checkpoint):
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def runs_of(rows, gap):
    out = []
    for b in {r[0] for r in rows}:
        first = last = None
        n = 0
        for _, ts, eod in sorted(r for r in rows if r[0] == b):
            if first is not None and (eod >= 0 or (ts - last).days > gap):
                out.append((b, first.date(), last.date(), n))
                first, n = None, 0
            if eod < 0:
                first, last, n = first or ts, ts, n + 1
        if first is not None:
            out.append((b, first.date(), last.date(), n))
    return sorted(out)


def test_overdraft_runs_of_shuffled_days_over_a_restart(rocks, tmp_path):
    rng = random.Random(2)
    rows = [(b, START + dt.timedelta(days=i), float(rng.choice([-5, -1, 3]))) for b in (1, 2, 3) for i in range(40) if (b + i) % 9 or i < 5]
    rows += [(3, START + dt.timedelta(days=60), -1.0)]  # a pause: the run before it is closed by its timer
    # a timer set while timers fire is due in the next batch
    batches = [*shuffled(rows, 1, 1.9, rng, 3), [(9, FAR, 1.0)], [(9, FAR + dt.timedelta(days=9), 1.0)]]
    schema, src = "business_id long, ts timestamp, eod double", str(tmp_path / "in")
    drop(rocks, batches[:2], schema, src)
    for part in (batches[2:], []):  # the query stops after two batches and goes on from its checkpoint
        run(stateful.overdraft_runs(feed(rocks, schema, src)), str(tmp_path / "out"), str(tmp_path / "cp"))
        drop(rocks, part, schema, src, 2)
    got = sorted(map(tuple, rocks.read.parquet(str(tmp_path / "out")).collect()))
    assert got == runs_of(rows, 3) and len(got) > 10


def test_break_signals_of_shuffled_days(rocks, tmp_path):
    rng = random.Random(5)
    rows = [(b, START + dt.timedelta(days=i), 100.0 + (60 if i >= 12 + b else 0) - (150 if i > 30 else 0), 100.0, 20.0) for b in (1, 2) for i in range(45)]
    schema, src = "business_id long, ts timestamp, inflow double, mean double, sd double", str(tmp_path / "in")
    drop(rocks, [*shuffled(rows, 1, 1.9, rng, 3), [(9, FAR, 1.0, 1.0, 0.0)]], schema, src)
    run(stateful.break_signals(feed(rocks, schema, src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    want = []
    for b in (1, 2):
        up = down = 0.0
        for _, ts, x, m, s in sorted(r for r in rows if r[0] == b):
            up, down = max(0.0, up + (x - m) / s - 0.5), max(0.0, down - (x - m) / s - 0.5)
            if up > 5 or down > 5:
                want.append((b, ts.date(), "up" if up > 5 else "down"))
                up = down = 0.0
    assert sorted(map(tuple, rocks.read.parquet(str(tmp_path / "out")).collect())) == sorted(want) and {w[2] for w in want} == {"up", "down"}


def test_replayed_rows_are_seen_once(rocks, tmp_path):
    schema, src = "business_id long, transaction_id long, cents long", str(tmp_path / "in")
    drop(rocks, [[(1, 1, 5), (1, 2, 6), (2, 1, 7)], [(1, 1, 5), (1, 3, 8)], [(1, 3, 8), (2, 1, 7), (2, 2, 9)]], schema, src)
    rocks.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        run(stateful.first_sightings(feed(rocks, schema, src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    finally:
        rocks.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert sorted(map(tuple, rocks.read.parquet(str(tmp_path / "out")).collect())) == [(1, 1, 5), (1, 2, 6), (1, 3, 8), (2, 1, 7), (2, 2, 9)]


def test_restatement_equals_the_batch(spark, tmp_path):
    """Rows up to 50 days late: the watermarked stream loses some, the restated totals none; replays change nothing."""
    rng = random.Random(7)
    rows = [(i, i % 4, START + dt.timedelta(days=rng.randrange(80), hours=rng.randrange(24)), rng.choice(["in", "out"]), rng.randrange(1, 999)) for i in range(400)]
    batches = shuffled(rows, 2, 50, rng, 3)
    batches[2] = batches[2] + batches[0][:10]  # told again
    src, folder = str(tmp_path / "in"), str(tmp_path / "store")
    drop(spark, batches, restate.FEED, src)
    restate.restated(feed(spark, restate.FEED, src), folder, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted(map(tuple, df.select("business_id", "date", "inflow", "outflow", "n").collect()))
    want = key(restate.totals(spark.createDataFrame(rows, restate.FEED)))
    assert key(restate.read(spark, folder)) == want and restate.recorded(spark, folder).count() == 3
    run(rollup.daily_rollup(feed(spark, restate.FEED, src)), str(tmp_path / "live"), str(tmp_path / "cp2"))
    assert sum(r[4] for r in key(spark.read.parquet(str(tmp_path / "live")))) < len(rows)
    for number in (1, 99):  # a batch done before, and the same rows under a new number
        restate.upsert(spark.createDataFrame(batches[1], restate.FEED), number, folder)
        assert key(restate.read(spark, folder)) == want
    # a failure after the totals and before the record: the batch runs again
    restate.upsert(spark.createDataFrame([(900, 1, START, "in", 7)], restate.FEED), 100, folder)
    once = key(restate.read(spark, folder))
    shutil.rmtree(f"{folder}/batches/batch=100")
    restate.upsert(spark.createDataFrame([(900, 1, START, "in", 7)], restate.FEED), 100, folder)
    assert key(restate.read(spark, folder)) == once != want


def test_restatement_of_nothing(spark, tmp_path):
    restate.upsert(spark.createDataFrame([], restate.FEED), 0, str(tmp_path))
    assert restate.recorded(spark, str(tmp_path)).count() == 1
