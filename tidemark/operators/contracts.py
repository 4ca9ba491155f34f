"""Contracts of tables as observed metrics: rules are counted by the pass that writes, not by one of their own.

A contract is a declared list of rules (name: SQL that is true for a good row; null counts as bad). checked_write() hangs
counters on the frame that is written, so a table is read once; its violations come with the least and the largest key that
broke the rule. Uniqueness and references need keys of many rows side by side: key_rules() answers both for all tables by
one aggregate over the written key columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Contract:
    """key: SQL of a whole number that names a row; rules: name: SQL; references: column: the table whose key it must be in."""

    key: str
    rules: dict[str, str] = field(default_factory=dict)
    unique: bool = True
    references: dict[str, str] = field(default_factory=dict)


def checked_write(df: DataFrame, path: str, contract: Contract) -> Iterator[tuple[str, int, int, int | None, int | None]]:
    """Writes df as Parquet and gives (rule, rows, violations, least key, largest key) of each rule, all from that one pass."""
    seen = Observation()
    cols = [F.count(F.lit(1)).alias("rows")]
    for i, rule in enumerate(contract.rules.values()):
        bad = F.expr(f"not coalesce({rule}, false)")
        key = F.when(bad, F.expr(f"cast({contract.key} as bigint)"))
        cols += [F.count_if(bad).alias(f"bad{i}"), F.min(key).alias(f"first{i}"), F.max(key).alias(f"last{i}")]
    df.observe(seen, *cols).write.mode("overwrite").parquet(path)
    got = seen.get
    return ((name, got["rows"], got[f"bad{i}"], got[f"first{i}"], got[f"last{i}"]) for i, name in enumerate(contract.rules))


def key_rules(tables: dict[str, DataFrame], contracts: dict[str, Contract]) -> DataFrame:
    """(table_name, rule, rows, violations, first_key, last_key): keys told twice (beyond the first) and references to keys that aren't there. Every key column is read once, and one aggregate by table and key answers all; a null reference is none."""
    told = []
    for name, c in contracts.items():
        row = lambda df, rule, key, kind: df.select(F.lit(kind[0]).alias("home"), F.expr(f"cast({key} as bigint)").alias("key"), F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), F.lit(kind[1]).alias("kind"))  # noqa: E731, B023
        told.append(row(tables[name], f"unique {c.key}", c.key, (name, "key")))
        told += [row(tables[name].where(f"{col} is not null"), f"{col} in {other}", col, (other, "reference")) for col, other in c.references.items()]
    counted = reduce(DataFrame.unionByName, told).groupBy("home", "key", "table_name", "rule", "kind").agg(F.count("*").alias("n"))
    each = counted.groupBy("home", "key").agg(F.expr("max(if(kind = 'key', n, 0))").alias("keys"), F.collect_list(F.struct("table_name", "rule", "kind", "n")).alias("told"))  # one entry for each rule
    rows = each.select("key", "keys", F.inline("told")).withColumn("bad", F.expr("if(kind = 'key', n - 1, if(keys = 0, n, 0))"))
    checked = [(n, f"unique {c.key}") for n, c in contracts.items() if c.unique] + [(n, f"{col} in {o}") for n, c in contracts.items() for col, o in c.references.items()]
    wanted = rows.where(F.struct("table_name", "rule").isin([F.struct(F.lit(a).alias("table_name"), F.lit(b).alias("rule")) for a, b in checked]))
    hit = F.when(F.col("bad") > 0, F.col("key"))
    return wanted.groupBy("table_name", "rule").agg(F.sum("n").alias("rows"), F.sum("bad").alias("violations"), F.min(hit).alias("first_key"), F.max(hit).alias("last_key"))
