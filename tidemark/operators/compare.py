"""Two runs of a table compared column by column, by digests in a tree over key ranges.

A column's digest over a set of rows is a sum of row hashes (key, column, value), so it depends neither on the order of rows
nor on files, and digests of parts add up to the whole's. One pass over a run gives a digest for every column and leaf (a
range of the whole-number key); inner nodes are sums of leaves. The tree is small, bounded by columns times twice 2^DEPTH,
and can be kept beside a run: two runs are compared by their trees, from the root down, joining at each level only the
children of nodes that differ. Only the ranges found that way are read again, to name keys and cells.

Rows: nulls differ from every value; repeated rows count each time; rows whose key is null form a leaf of their own (low
null); an empty table has an empty tree, and all of the other's nodes differ from it. Columns that only one run has, or that
changed their type, differ everywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import saved

#: Levels under the root, and bits of fan-out of each: 32 children a node, 1,024 leaves.
LEVELS, BITS = 2, 5
DEPTH = LEVELS * BITS
#: Ranges of keys that are pushed to the scan.
PUSHED = 64
_HASH = "xxhash64({key}, '{column}', {value} is null, {value})"


def key_bounds(key: str, *runs: DataFrame) -> tuple[int, int]:
    """(least key, width of a leaf at DEPTH): the same for all runs that are compared; two numbers reach the driver."""
    spans = reduce(DataFrame.unionByName, (r.select(F.expr(f"cast({key} as bigint)").alias("k")) for r in runs)).agg(F.min("k").alias("a"), F.max("k").alias("b")).first()
    low = spans["a"] or 0
    return low, max(1, -(-((spans["b"] or 0) - low + 1) // (1 << DEPTH)))


def _leaf(key: str, bounds: tuple[int, int]) -> str:
    # keys beyond the bounds, as a later run may have, belong to the outermost leaves
    # a null key has no leaf: greatest and least would pass over the null
    return f"if({key} is null, null, cast(greatest(0, least({(1 << DEPTH) - 1}, floor((cast({key} as bigint) - {bounds[0]}) / {bounds[1]}))) as int))"


def digest_tree(df: DataFrame, key: str, bounds: tuple[int, int]) -> DataFrame:
    """(column, level, node, n, high, low): the digest of each column over each node, as sums of the two halves of 64-bit hashes. Level 0 is the root, level LEVELS has the leaves; keys that are null are node -1 of every level but the root."""
    names = df.columns
    hashed = df.select(F.expr(_leaf(key, bounds)).alias("_leaf"), *(F.expr(_HASH.format(key=f"cast({key} as bigint)", column=f"{c}:{t}", value=f"`{c}`")).alias(f"_h{i}") for i, (c, t) in enumerate(df.dtypes)))
    halves = [x for i in range(len(names)) for x in (F.expr(f"sum(shiftright(_h{i}, 32))").alias(f"_a{i}"), F.expr(f"sum(_h{i} & 4294967295L)").alias(f"_b{i}"))]
    leaves = hashed.groupBy("_leaf").agg(F.count("*").alias("n"), *halves)  # at most 2^DEPTH + 1 rows
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_a{i}").alias("high"), F.col(f"_b{i}").alias("low")) for i, c in enumerate(names)))
    nodes = leaves.select("_leaf", "n", F.inline(each)).select("*", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"))
    node = F.expr(f"case when level = 0 then 0 when _leaf is null then -1 else shiftright(_leaf, {DEPTH} - {BITS} * level) end")
    return nodes.groupBy("column", "level", node.alias("node")).agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))


def differing(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, node): leaves of two trees whose digests differ, found from the root down. A level's join holds children of differing nodes only."""
    own = lambda t, k, p: t.where(F.col("level") == k).select("column", "node", *(F.col(c).alias(f"{p}_{c}") for c in ("n", "high", "low")))
    found = None
    for k in range(LEVELS + 1):
        sides = [own(before, k, "a"), own(after, k, "b")]
        if found is not None:
            up = found.select("column", F.col("node").alias("_up"))
            parent = F.expr(f"case when node = -1 then {-1 if k > 1 else 0} else shiftright(node, {BITS}) end")
            sides = [s.withColumn("_up", parent).join(up, ["column", "_up"], "left_semi").drop("_up") for s in sides]
        both = sides[0].join(sides[1], ["column", "node"], "full")
        found = both.where("not (a_n <=> b_n and a_high <=> b_high and a_low <=> b_low)").select("column", "node")
    return found


def ranges(leaves: DataFrame, bounds: tuple[int, int]) -> DataFrame:
    """(column, node, first_key, last_key) of leaves; null keys have no range."""
    low, width = bounds
    inside = lambda e: F.expr(f"if(node < 0, null, {low}L + cast(node as bigint) * {width}L + {e})")
    return leaves.withColumn("first_key", inside("0")).withColumn("last_key", inside(f"{width - 1}"))


def cells(before: DataFrame, after: DataFrame, key: str, leaves: DataFrame, bounds: tuple[int, int]) -> DataFrame:
    """(column, key, before, after, n_before, n_after): keys and values that differ inside the leaves found. Both runs are read there only; values are texts. A key's rows are compared as a multiset, so keys may repeat."""
    spans = leaves.where("node >= 0").select("first_key", "last_key").distinct().orderBy("first_key").collect()  # at most 2^DEPTH pairs
    joined: list[list[int]] = []
    for a, b in spans:
        if joined and joined[-1][1] + 1 >= a:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    within = " or ".join([f"{key} is null", *(f"{key} between {a} and {b}" for a, b in joined)])

    def long(df, name):
        # a few ranges reach the scan as a filter; the semi-join below holds for any number
        rows = (df.where(within) if len(joined) <= PUSHED else df).withColumn("_node", F.expr(f"coalesce({_leaf(key, bounds)}, -1)"))
        shared = [c for c, t in before.dtypes if (c, t) in after.dtypes]
        values = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in shared))
        part = rows.join(F.broadcast(leaves.select(F.col("node").alias("_node")).distinct()), "_node", "left_semi")  # at most 2^DEPTH + 1 rows
        one = part.select(F.expr(f"cast({key} as bigint)").alias("key"), "_node", F.inline(values)).join(F.broadcast(leaves.select("column", F.col("node").alias("_node"))), ["column", "_node"], "left_semi")
        return one.groupBy("column", "key", "value").agg(F.count("*").alias(name))

    a, b = long(before, "a"), long(after, "b")
    met = a.alias("x").join(b.alias("y"), F.expr("x.column = y.column and x.key <=> y.key and x.value <=> y.value"), "full")
    d = met.where("coalesce(a, 0) <> coalesce(b, 0)").select(F.coalesce("x.column", "y.column").alias("column"), F.coalesce("x.key", "y.key").alias("key"), "a", "b", F.col("x.value").alias("u"), F.col("y.value").alias("v"))
    more = F.col("a").isNotNull() & (F.coalesce("a", F.lit(0)) > F.coalesce("b", F.lit(0)))
    return d.groupBy("column", "key").agg(F.min(F.when(more, F.col("u"))).alias("before"), F.min(F.when(~more, F.col("v"))).alias("after"), F.sum(F.coalesce("a", F.lit(0))).alias("n_before"), F.sum(F.coalesce("b", F.lit(0))).alias("n_after"))


def compare(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(column, first_key, last_key, key, before, after): every differing cell and the range it was located in."""
    bounds = key_bounds(key, before, after)
    leaves = saved(ranges(differing(saved(digest_tree(before, key, bounds)), saved(digest_tree(after, key, bounds))), bounds))
    found = cells(before, after, key, leaves, bounds).withColumn("node", F.expr(f"coalesce({_leaf('key', bounds)}, -1)"))
    return leaves.join(found, ["column", "node"], "left").select("column", "first_key", "last_key", "key", "before", "after")
