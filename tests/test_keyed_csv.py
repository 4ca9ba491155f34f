"""The source that takes the filter: which parts it plans, and the same rows as a full scan."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.sources import keyed_csv

SCHEMA = "k long, name string, v double, day date, flag boolean"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    texts = ["plain", 'a "quoted" one', "two\nlines", "comma, here", "", None, "é你"]
    rows = [(i // 3 if i % 400 else None, texts[i % 7], i / 7 if i % 5 else None, dt.date(2024, 1, 1) + dt.timedelta(days=i % 300), i % 2 == 0) for i in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path_factory.mktemp("keyed"))
    keyed_csv.write(df, path, "k", block=4096)
    return df, path


def planned(df):
    return df.rdd.getNumPartitions()


def key(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_full_scan_gives_the_rows_back(spark, store):
    df, path = store
    assert key(keyed_csv.read(spark, path, SCHEMA, "k")) == key(df)
    assert spark.read.parquet(f"{path}/index").count() > 40


@pytest.mark.parametrize("rule", ["k = 77", "k in (3, 1500, 1999)", "k > 1990", "k >= 1990 and k < 1995", "k <= 4", "k = 5000", "k is null", "k = 77 and name is null", "v > 500", "k in (5, 6) or v < 1"])
def test_filters_give_the_same_rows(spark, store, rule):
    df, path = store
    assert key(keyed_csv.read(spark, path, SCHEMA, "k").where(rule)) == key(df.where(rule))


def test_only_stretches_of_the_keys_are_planned(spark, store):
    _, path = store
    reader = lambda: keyed_csv._Reader(None, path, "k")
    size = lambda r: sum(p.stop - p.start for p in r.partitions())
    whole = size(reader())
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan

    for rules, most in (([EqualTo(("k",), 77)], 3), ([In(("k",), (3, 1500, 1999))], 8), ([GreaterThan(("k",), 1990)], 3), ([GreaterThan(("k",), 900), LessThan(("k",), 910)], 3)):
        r = reader()
        assert list(r.pushFilters(rules)) == rules and 0 < size(r) <= most * 4400 < whole / 3
    r = reader()
    list(r.pushFilters([EqualTo(("k",), 9999)]))
    assert size(r) == 0
    assert planned(keyed_csv.read(spark, path, SCHEMA, "k").where("k in (3, 1500, 1999)")) == 3


def test_lookup(spark, store):
    df, path = store
    got = keyed_csv.lookup(spark, path, SCHEMA, "k", [10, 900], ["day", "v"])
    assert key(got) == key(df.where("k in (10, 900)")) and [r.k for r in got.collect()] == [10] * 3 + [900] * 3
    with pytest.raises(KeyError):
        keyed_csv.lookup(spark, path, SCHEMA, "k", [10, 7777], ["day"])


def test_empty_table(spark, tmp_path):
    keyed_csv.write(spark.createDataFrame([], SCHEMA), str(tmp_path), "k")
    assert keyed_csv.read(spark, str(tmp_path), SCHEMA, "k").where(F.col("k") == 1).count() == 0
