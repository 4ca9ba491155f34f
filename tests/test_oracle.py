"""Every registered query with SQL against DuckDB over the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from tests.conftest import SF
from tidemark import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _same(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.7g}")
    return v


def equal(a, b):
    """Numbers within 1e-5 (the queries round to five or six places), all else the same."""
    if isinstance(a, bool) or isinstance(b, bool) or not (isinstance(a, (int, float)) and isinstance(b, (int, float))):
        return a == b
    return math.isclose(a, b, rel_tol=1e-5, abs_tol=1e-5)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted((tuple(map(_same, r)) for r in df.select(*cols).collect()), key=repr)
    cur = con.execute(plans.oracle_sql()[name])
    theirs_cols = [d[0] for d in cur.description]
    assert sorted(theirs_cols) == cols
    at = [theirs_cols.index(c) for c in cols]
    theirs = sorted((tuple(_same(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert all(map(equal, a, b)), (a, b)


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
