"""Embedding near-dedup by Euclidean p-stable hashing (operator 1).

Vectors are normalised; each of several hash tables joins HASHES or more quantised random projections
floor((a.x + b) / WIDTH) into a bucket key. Two unit vectors with cosine 0.95 lie 0.316 apart and share one projection's
cell with probability 0.874, and unrelated ones with 0.487. Projections grow with the logarithm of the classes, so that
buckets of unrelated vectors stay small, and tables with them (sized), so that a pair at 0.95 misses all tables with
probability MISS at most; nearer pairs are surer. Equal vectors become one class before hashing, so large groups of copies
cost nothing.

Only a class's number and a 64-bit sketch (signs of random projections) travel with its keys. Inside a bucket sketches rule
out vectors with no other within RADIUS bits (a pair at 0.95 differs in 6.5 bits, and in more than 20 with probability
1e-6); those left are joined with their vectors, and the exact cosine in double precision decides. A pair found in several
tables counts in the first in which it shares a bucket; buckets over BLOCK classes are cut into blocks, whose pairs are
dealt to different tasks, and groups of buckets follow the number of rows. A bucket gives counts and a spanning forest,
never its pairs.

Rows: a vector that is null, empty, zero or holds null or non-finite components links with nothing and is its own
component; vectors of different lengths never link; repeated rows link with each other; a null id takes part in links
and counts, but names no component (a component of null ids only is null, and such rows aren't kept); other columns are
left out, whatever their names.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, saved, small_batches

HASHES, WIDTH, SEED, BLOCK, RADIUS = 12, 2.0, 20240229, 2048, 20
NEAR, FAR, MISS, ROWS, SLICE = 0.874, 0.487, 2.3e-5, 100_000, 4096


def sized(classes: int) -> tuple[int, int]:
    """(tables, projections of each): HASHES up to a hundred thousand classes, then so many that unrelated vectors in a bucket don't grow."""
    hashes = max(HASHES, math.ceil(math.log(max(classes, 1) / 18) / -math.log(FAR)))
    return math.ceil(math.log(MISS) / math.log(1 - NEAR**hashes)), hashes


@functools.lru_cache(maxsize=8)
def _projections(dim: int, tables: int, hashes: int, width: float):
    rng = np.random.default_rng([SEED, dim])
    a = rng.standard_normal((dim, tables * hashes))
    b = rng.uniform(0, width, tables * hashes)
    odd = rng.integers(1, 1 << 62, tables * hashes, dtype=np.int64) | 1
    return a, b, odd, rng.integers(1, 1 << 62, tables, dtype=np.int64), rng.standard_normal((dim, 64))


def keys(unit: np.ndarray, tables: int, hashes: int, width: float = WIDTH) -> np.ndarray:
    """Bucket keys of unit vectors: a row for each vector, a column for each table; a key names its table and dimension too."""
    a, b, odd, salt, _ = _projections(unit.shape[1], tables, hashes, width)
    cells = np.floor((unit @ a + b) / width).astype(np.int64)
    mixed = (cells * odd).reshape(len(unit), tables, hashes).sum(axis=2)
    return (mixed ^ (mixed >> 31)) * np.int64(0x9E3779B97F4A7C1 | 1) ^ salt


def sketches(unit: np.ndarray, tables: int, hashes: int, width: float = WIDTH) -> np.ndarray:
    """64 signs of projections of each unit vector."""
    signs = unit @ _projections(unit.shape[1], tables, hashes, width)[4] > 0
    return np.packbits(signs, axis=1).view(np.int64).reshape(-1)


def _unit(vectors) -> np.ndarray:
    v = np.stack([np.asarray(x, np.float64) for x in vectors])
    scale = np.abs(v).max(axis=1, keepdims=True)
    v = v / scale
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _stars(linked: np.ndarray) -> np.ndarray:
    """The least reachable row of each row of a symmetric link matrix."""
    root = np.arange(len(linked))
    wide = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(wide, root[None, :], len(root)).min(axis=1)
        new = new[new]
        if (new == root).all():
            return root
        root = np.minimum(root, new)


def _buckets(table: pa.Table):
    """The rows' columns in order of their pairs of blocks, and (first, middle, end) of each: rows from the middle on are of its second block, where there are two."""
    i, j, side, key, cls = (table[c].to_numpy() for c in ("i", "j", "side", "key", "cls"))
    order = np.lexsort((cls, side, j, i, key))
    i, j, side, key = i[order], j[order], side[order], key[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
    starts = np.flatnonzero(new)
    spans = []
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
        mid = lo + int(np.searchsorted(side[lo:hi], 1)) if i[lo] != j[lo] else hi
        if hi - lo > 1 and (i[lo] == j[lo] or lo < mid < hi):
            spans.append((lo, mid, hi))
    return order, spans


def _hopeful(table: pa.Table) -> pa.Table:
    """The rows with another within RADIUS bits in their bucket."""
    order, spans = _buckets(table)
    sketch, stay = table["sketch"].to_numpy()[order].view(np.uint64), np.zeros(len(order), bool)
    for lo, mid, hi in spans:
        if mid == hi:
            near = np.bitwise_count(sketch[lo:hi, None] ^ sketch[None, lo:hi]) <= RADIUS
            stay[lo:hi] = near.sum(axis=1) > 1
        else:
            near = np.bitwise_count(sketch[lo:mid, None] ^ sketch[None, mid:hi]) <= RADIUS
            stay[lo:mid], stay[mid:hi] = near.any(axis=1), near.any(axis=0)
    return table.take(pa.array(order[stay])).drop_columns(["sketch"])


def _compare(table: pa.Table, least: float, tables: int, hashes: int, width: float) -> pa.Table:
    """(a, b, n): n other vectors linked to class a here; b a class that a reaches here."""
    order, spans = _buckets(table)
    cls, count, key = (table[c].to_numpy()[order] for c in ("cls", "n", "key"))
    vectors, out = table["vector"].take(pa.array(order)), []
    for lo, mid, hi in spans:
        unit = _unit(vectors[lo:hi].to_pylist())
        near = unit @ unit.T >= least
        if mid < hi:
            near[: mid - lo, : mid - lo] = near[mid - lo :, mid - lo :] = False
        np.fill_diagonal(near, False)
        rows = np.flatnonzero(near.any(axis=1))
        if not len(rows):
            continue
        near, own = near[np.ix_(rows, rows)], lo + rows
        roots = _stars(near)
        seen = keys(unit[rows], tables, hashes, width)
        x, y = np.nonzero(near)
        first = np.empty(len(x), bool)
        for at in range(0, len(x), 100_000):
            p, q = seen[x[at : at + 100_000]], seen[y[at : at + 100_000]]
            shared = (p == q).argmax(axis=1)
            first[at : at + 100_000] = p[np.arange(len(p)), shared] == key[lo]
        n = np.bincount(x[first], weights=count[own[y[first]]], minlength=len(rows)).astype(np.int64)
        out.append((cls[own], cls[own[roots]], n))
    got = [np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(3)]
    return pa.table({"a": got[0], "b": got[1], "n": got[2]})


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", least: float = 0.95, width: float = WIDTH) -> DataFrame:
    """(the id, n_links, component_id, kept): a row for each row of vectors."""
    small_batches(vectors.sparkSession)
    v, kind = F.col("vector"), vectors.schema[vector].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").cast(kind).alias("vector"))
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = rows.where(fine)
    # a class of equal vectors is named by its 64-bit hash
    classes = saved(good.groupBy("vector").agg(F.count("*").alias("n"), F.min("id").alias("least")).withColumn("cls", F.xxhash64("vector")))
    tables, hashes = sized(classes.count())

    def hashed(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                dims = np.array(pa.compute.list_value_length(b["vector"]))
                for d in np.unique(dims):
                    part = b.take(pa.array(np.flatnonzero(dims == d)))
                    unit = _unit(part["vector"].to_pylist())
                    k = keys(unit, tables, hashes, width)
                    yield pa.RecordBatch.from_arrays([part["cls"], pa.array(sketches(unit, tables, hashes, width)), pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * tables), pa.array(k.ravel()))], ["cls", "sketch", "keys"])

    bucket = classes.select("cls", "vector").mapInArrow(hashed, "cls long, sketch long, keys array<long>").select("cls", "sketch", F.explode("keys").alias("key"))
    sizes = bucket.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    dealt = bucket.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("own"), o).alias("i"), F.greatest(F.col("own"), o).alias("j"), F.when(F.col("own") <= o, 0).otherwise(1).alias("side")))
    dealt = saved(dealt.select("cls", "sketch", "key", F.explode(pairs).alias("p")).select("cls", "sketch", "key", "p.*"))
    groups = max(1, -(-dealt.count() // ROWS))
    deal = lambda df: df.withColumn("g", F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups))).groupBy("g")
    hopeful = deal(dealt).applyInArrow(lambda t: _hopeful(t.drop_columns(["g"])), "cls long, key long, i int, j int, side int")
    found = deal(hopeful.join(classes.select("cls", "n", "vector"), "cls")).applyInArrow(lambda t: _compare(t, least, tables, hashes, width), "a long, b long, n long")
    found = saved(found)
    counts = found.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("linked"))
    parts = connected_components(found.select("a", "b"))
    joined = classes.join(counts, "cls", "left").join(parts.select(F.col("id").alias("cls"), "component"), "cls", "left")
    joined = joined.select("vector", "least", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("root"))
    roots = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(roots, "root").select("vector", "n_links", "component_id")
    linked = good.join(named, "vector").select("id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(fine, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
