"""Bootstrap intervals without copies: a row has one vector of weights, one entry a draw, and statistics fold vectors.

Weights are Poisson of mean 1, read from md5 of seed, draw and key, so any engine repeats them, and rows of one key (a
cluster) are drawn together: statistics over several columns of a row are paired by construction. Rows are dealt by range on
(group, value, key), so that not even rows alike need one task. A first pass gives each partition's weights, and those of
its least and largest value, which neighbours may share; from them follow the weights under each partition and each shared
value (_bounds: a row for each partition and group). The second pass meets its partition's bounds as the first row of its
stream, folds the rows in order, and gives sums that partitions add. Weights are made where they are used, not shuffled.

Rows with a null value are left out, NaN counts as null; a draw in which a statistic isn't defined (one label only, no
variation, no weight) has no part in the interval.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.storage import saved
from .ranks import PID

DRAWS, BLOCK, KNOWN = 1000, 256, 20_000
#: Cut points of a Poisson law of mean 1: e^-1, 2 e^-1, 2.5 e^-1, 2.6666... e^-1, and so on.
CUTS = np.array([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183])
BOUNDS = ("low_first", "tied_first", "low_last", "tied_last", "total")
_known: dict[tuple, np.ndarray] = {}


def weights(keys: list[str], draws: int, seed: str) -> np.ndarray:
    """A row of weights for each key, a column for each draw. A worker keeps the last KNOWN keys' weights, a byte a draw."""
    if len(_known) > KNOWN:
        _known.clear()
    md5, heads, out = hashlib.md5, [f"{seed}|{d}|".encode() for d in range(draws)], np.empty((len(keys), draws), np.int64)
    for i, k in enumerate(keys):
        w = _known.get((seed, draws, k))
        if w is None:
            tail = k.encode()
            u = np.frombuffer(b"".join([md5(h + tail).digest()[:4] for h in heads]), ">u4") / 4294967296.0
            w = _known[seed, draws, k] = np.searchsorted(CUTS, u, "right").astype(np.int8)
        out[i] = w
    return out


def _rows(df: DataFrame, by: list[str], key: str, value: str, carried: dict) -> DataFrame:
    """Rows in range partitions, each with its partition's number; kept, as they are read twice."""
    v = F.col(value).cast("double")
    own = df.where(v.isNotNull() & ~F.isnan(v)).select(*by, F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), v.alias("_value"), *(c.alias(n) for n, c in carried.items()))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(own.repartitionByRange(n, *by, "_value", "_key").withColumn(PID, F.spark_partition_id()))


def _blocks(batches, by: list[str]):
    """(group and partition, block of rows of one value): rows come in order; a value may go on in the next block."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            t = b.slice(at, BLOCK)
            keys = list(zip(*(t[c].to_pylist() for c in (*by, PID, "_value"))))
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    yield keys[start][:-1], keys[start][-1], t.slice(start, i - start)
                    start = i


def _ordered(df: DataFrame, by: list[str], *first) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *by, PID).sortWithinPartitions(*by, PID, *first, "_value")


def _bounds(rows: DataFrame, by: list[str], draws: int, seed: str) -> DataFrame:
    """(by, _pid and the vectors BOUNDS): weights under a partition's least and largest value and of all rows that have them, and the group's."""
    group = [rows.schema[c] for c in by]
    vectors = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("w", "first_w", "last_w")]
    partial = T.StructType([*group, T.StructField(PID, T.IntegerType()), T.StructField("first", T.DoubleType()), T.StructField("last", T.DoubleType()), *vectors])

    def fold(batches):
        held: dict[tuple, list] = {}
        for g, v, t in _blocks(batches, by):
            w = weights(t["_key"].to_pylist(), draws, seed).sum(axis=0)
            s = held.setdefault(g, [v, v, np.zeros(draws, np.int64), np.zeros(draws, np.int64), np.zeros(draws, np.int64)])
            s[2] += w
            s[3] += w if v == s[0] else 0
            s[4] = s[4] + w if v == s[1] else w
            s[1] = v
        for g, s in held.items():
            yield pa.RecordBatch.from_pydict(dict(zip(partial.names, ([x] for x in (*g, *s)))), schema=_arrow(partial))

    def combine(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(PID)
        tied, low, under = {}, {}, np.zeros(draws, np.int64)
        for r in p.itertuples(index=False):
            w, a, z = (np.asarray(getattr(r, c)) for c in ("w", "first_w", "last_w"))
            low.setdefault(r.first, under)
            tied[r.first] = tied.get(r.first, 0) + a
            if r.last != r.first:
                low.setdefault(r.last, under + w - z)
                tied[r.last] = tied.get(r.last, 0) + z
            under = under + w
        out = p[[*by, PID]].copy()
        for name, at in (("first", p["first"]), ("last", p["last"])):
            out[f"low_{name}"], out[f"tied_{name}"] = [low[v] for v in at], [tied[v] for v in at]
        out["total"] = [under] * len(p)
        out["first"], out["last"] = p["first"], p["last"]
        return out[[*by, PID, "first", "last", *BOUNDS]]

    parts = _ordered(rows, by).mapInArrow(fold, partial)
    return parts.groupBy(*by).applyInPandas(combine, T.StructType([*partial.fields[:-3], *(T.StructField(n, T.ArrayType(T.LongType())) for n in BOUNDS)]))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class Fold:
    """What a statistic does with ties: add() takes rows of one value with their weights; close() has their doubled rank (twice the weight under them and their own), their weight here and in all partitions, and the group's; done() gives output rows."""

    def __init__(self, draws: int):
        self.sums: dict[tuple, np.ndarray] = {}
        self.draws = draws

    def sum(self, g, n: int) -> np.ndarray:
        return self.sums.setdefault(g, np.zeros((n, self.draws)))

    def done(self):
        return [(*g, *v) for g, v in self.sums.items()]


class _Auc(Fold):
    def add(self, tie, w, t):
        own = w[t["_label"].to_numpy(zero_copy_only=False) == 1].sum(axis=0)
        return own if tie is None else tie + own

    def close(self, g, tie, rank, local, whole, total):
        s = self.sum(g, 3)
        s += np.stack([tie * rank, tie, local])
        return []


class _First(Fold):
    """Rows of a tie wait for their rank as key and other value only."""

    def add(self, tie, w, t):
        tie = tie or []
        tie += zip(t["_key"].to_pylist(), t["_other"].to_pylist())
        return tie

    def close(self, g, tie, rank, local, whole, total):
        ranks = (rank - total).tobytes()
        return [(*g, k, o, ranks) for k, o in tie]


class _Second(Fold):
    def add(self, tie, w, t):
        r = np.frombuffer(b"".join(t["_ranks"].to_pylist()), np.int64).reshape(len(w), -1).astype(np.float64)
        own = np.stack([(w * r).sum(axis=0), (w * r * r).sum(axis=0)])
        return own if tie is None else tie + own

    def close(self, g, tie, rank, local, whole, total):
        y = (rank - total).astype(np.float64)
        s = self.sum(g, 3)
        s += np.stack([tie[0] * y, tie[1], local * y * y])
        return []


class _Median(Fold):
    """The values at the two middle places of each draw."""

    def add(self, tie, w, t):
        self.value = t["_value"][0].as_py()
        return 0

    def close(self, g, tie, rank, local, whole, total):
        low = (rank - whole) // 2
        return [(*g, int(d), self.value) for at in ((total - 1) // 2, total // 2) for d in np.flatnonzero((total > 0) & (low <= at) & (at < low + whole))]


def _folded(rows: DataFrame, by: list[str], kind: type[Fold], fields: list[T.StructField], draws: int, seed: str) -> DataFrame:
    """Rows of kind's done() and close(): (by, fields). A value that neighbouring partitions share is closed in each, with the same rank."""
    schema = T.StructType([*(rows.schema[c] for c in by), *fields])
    bounds = _bounds(rows, by, draws, seed)
    stream = rows.unionByName(bounds, allowMissingColumns=True)

    def run(batches):
        out, typed = kind(draws), _arrow(schema)
        g = value = tie = bound = low = tied = None

        def close():
            nonlocal low
            at, own = (bound["low_first"], bound["tied_first"]) if value == bound["first"] else (bound["low_last"], bound["tied_last"]) if value == bound["last"] else (low, tied)
            found = out.close(g[:-1], tie, 2 * at + own, tied, own, bound["total"])
            low = at + own
            for i in range(0, len(found), BLOCK):
                yield pa.RecordBatch.from_pydict(dict(zip(typed.names, map(list, zip(*found[i : i + BLOCK])))), schema=typed)

        for key, v, t in _blocks(batches, by):
            if key != g or v != value:
                if tie is not None:
                    yield from close()
                g, value, tie, tied = key, v, None, np.zeros(draws, np.int64)
            if v is None:
                bound = {c: np.array(t[c][0].as_py(), np.int64) for c in BOUNDS} | {c: t[c][0].as_py() for c in ("first", "last")}
                low = bound["low_first"]
                continue
            w = weights(t["_key"].to_pylist(), draws, seed)
            tied = tied + w.sum(axis=0)
            tie = out.add(tie, w, t)
        if tie is not None:
            yield from close()
        rest = out.done()
        if rest:
            yield pa.RecordBatch.from_pydict(dict(zip(typed.names, map(list, zip(*rest)))), schema=typed)

    return _ordered(stream, by, F.col("_value").isNotNull()).mapInArrow(run, schema)


def _added(parts: DataFrame, by: list[str], names: list[str], draws: int) -> DataFrame:
    """Vectors of one partition each, added."""
    fold = "aggregate(collect_list({}), array_repeat(0.0D, %d), (a, v) -> zip_with(a, v, (p, q) -> p + q))" % draws
    return parts.groupBy(*by).agg(*(F.expr(fold.format(c)).alias(c) for c in names))


def _interval(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, low, mid, high) over one value a draw."""
    own = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    return own.groupBy(*by).agg(*(F.expr(f"percentile({value}, {q})").alias(n) for n, q in (("low", 0.025), ("mid", 0.5), ("high", 0.975))))


def _vector_fields(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.ArrayType(T.DoubleType())) for n in names]


def auc_interval(df: DataFrame, score: str, label: str, key: str, by: list[str] = (), draws: int = DRAWS, seed: str = "auc") -> DataFrame:
    """(by, low, mid, high): the 95 % interval and the median of the AUC over draws of keys; rows without a label are left out."""
    by = list(by)
    rows = _rows(df.where(F.col(label).isNotNull()), by, key, score, {"_label": F.col(label).cast("int")})
    g = _added(_folded(rows, by, _Auc, _vector_fields("u", "p", "w"), draws, seed), by, ["u", "p", "w"], draws)
    # ranks of positive rows, doubled, less those among themselves
    return _interval(g.select(*by, F.explode(F.expr(f"transform(sequence(0, {draws - 1}), i -> try_divide(u[i] - p[i] * p[i], 2 * p[i] * (w[i] - p[i])))")).alias("v")), by, "v")


def median_interval(df: DataFrame, value: str, key: str, by: list[str] = (), draws: int = DRAWS, seed: str = "median") -> DataFrame:
    """(by, low, mid, high): of the weighted median over draws of keys, the mean of the two middle values where a draw's weight is even."""
    by = list(by)
    found = _folded(_rows(df, by, key, value, {}), by, _Median, [T.StructField("draw", T.IntegerType()), T.StructField("v", T.DoubleType())], draws, seed)
    # a value that partitions share is found in each of them; the two middle values are the least and the largest of a draw
    medians = found.groupBy(*by, "draw").agg(((F.min("v") + F.max("v")) / 2).alias("v"))
    return _interval(medians, by, "v")


def spearman_interval(df: DataFrame, x: str, y: str, key: str, by: list[str] = (), draws: int = DRAWS, seed: str = "rho") -> DataFrame:
    """(by, low, mid, high): of the rank correlation over draws of keys, each draw ranked anew with mean ranks for ties.

    A row needs its rank in both orders and every draw: the vector of doubled centred ranks in the order of x travels with the
    row to the order of y (8 bytes a draw), where the products are summed. That is what the exact statistic costs.
    """
    by, other = list(by), F.col(y).cast("double")
    rows = _rows(df.where(other.isNotNull() & ~F.isnan(other)), by, key, x, {"_other": other})
    first = _folded(rows, by, _First, [T.StructField("_key", T.StringType()), T.StructField("_value", T.DoubleType()), T.StructField("_ranks", T.BinaryType())], draws, seed)
    sums = _folded(_rows(first, by, "_key", "_value", {"_ranks": F.col("_ranks")}), by, _Second, _vector_fields("xy", "xx", "yy"), draws, seed)
    g = _added(sums, by, ["xy", "xx", "yy"], draws)
    rho = g.select(*by, F.explode(F.expr(f"transform(sequence(0, {draws - 1}), i -> try_divide(xy[i], sqrt(xx[i] * yy[i])))")).alias("v"))
    return _interval(rho, by, "v")
