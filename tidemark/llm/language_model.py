"""LM scoring by context-tree weighting (operator 8).

A text is read as its lower-cased words, a blank before, between and behind them, and a line feed as its end. Each byte is
binary decisions along a Huffman code of the training bytes; the context of a decision is the code's bits so far and the
DEPTH bytes before it, across words (zeros before a text's start). Every context of every depth keeps Krichevsky-Trofimov
counts of the training texts; a node's weighted probability is half its own estimate and half the product of its
children's, so a prediction mixes the estimates of all depths on its path by their posterior weights. A depth that
training never saw adds nothing. The log probability of a text is the sum over its bytes; divided by them it is the code
length.

Texts are dealt to chunks of CHUNK_BYTES. A chunk gives its distinct events (context and byte) with their training counts,
one packed row for each group of contexts; a group, which holds the whole subtrees of its contexts' last `top` bytes, sums
counts over chunks and evaluates its subtrees; the levels above are DataFrame aggregates and joins of their roots; then
each group answers each chunk's events in the order asked, and a chunk adds up its texts. Words take the same way for the
base counts. So a passage that repeats costs once a chunk, and nothing that grows with the corpus reaches the driver: only
256 byte counts and a size do. Groups follow the size of the text, and so does `top` (cells_of).

Rows: a null text counts as empty (its one token is the end); repeated rows get equal scores; null ids are scored and
learned from as the empty id; without training rows every decision costs one bit; other columns are left out; an empty
table gives no rows. A text is held whole by its chunk's task; events are worked on in steps of
about STEP bytes of texts, a longer text being one step. An event's log probability travels in single precision, and a
text's score is their sum in double precision.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc32_of, small_batches

DEPTH, CHUNK_BYTES, GROUP_BYTES, WORD_GROUP_BYTES, STEP = 6, 24 << 20, 4 << 20, 16 << 20, 2 << 20
END = b"\n"
_LOG_PI, _SMALL = float(np.log(np.pi)), 1 << 16
ASK = "g long, chunk long, keys binary, counts binary"


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for x of 0.5 or more: Stirling's series after a shift by seven."""
    p = np.ones_like(x)
    for k in range(7):
        p *= x + k
    z = x + 7
    i = 1 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + (1 / 12 - i * (1 / 360 - i / 1260)) / z - np.log(p)


_HALF, _WHOLE = _lgamma(np.arange(_SMALL) + 0.5), _lgamma(np.arange(2 * _SMALL) + 1.0)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log Krichevsky-Trofimov probability of a zeros and b ones in any order; small counts come from a table."""
    x, y = np.minimum(a, _SMALL - 1).astype(np.int64), np.minimum(b, _SMALL - 1).astype(np.int64)
    out = _HALF[x] + _HALF[y] - _WHOLE[x + y] - _LOG_PI
    big = np.flatnonzero((a >= _SMALL) | (b >= _SMALL))
    if len(big):
        a, b = a[big].astype(np.float64), b[big].astype(np.float64)
        out[big] = _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - _LOG_PI
    return out


class Code:
    """A Huffman code of the bytes: for each byte its decisions as (inner node, bit)."""

    def __init__(self, counts):
        heap = [(int(c) + 1, s, s) for s, c in enumerate(counts)]
        heapq.heapify(heap)
        children, at = [], 256
        while len(heap) > 1:
            (m, _, x), (n, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            children.append((x, y))
            heapq.heappush(heap, (m + n, at, at))
            at += 1
        paths: dict[int, list] = {at - 1: []}
        for inner in range(at - 1, 255, -1):
            for bit, child in enumerate(children[inner - 256]):
                paths[child] = [*paths[inner], (inner - 256, bit)]
        self.lengths = np.array([len(paths[s]) for s in range(256)])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.nodes = np.array([n for s in range(256) for n, _ in paths[s]], np.uint64)
        self.bits = np.array([b for s in range(256) for _, b in paths[s]], np.int64)

    def decisions(self, symbols: np.ndarray):
        """(which symbol, its node, its bit) of all decisions of some symbols, in order."""
        n = self.lengths[symbols]
        which = np.repeat(np.arange(len(symbols)), n)
        at = np.arange(len(which)) + np.repeat(self.starts[symbols] - np.cumsum(n) + n, n)
        return which, self.nodes[at], self.bits[at]


def spelled(text: bytes) -> bytes:
    """The bytes that the model reads; the first is given, not coded."""
    words = text.lower().split()
    return b" " + b" ".join(words) + b" \n" if words else b" \n"


def event_keys(streams: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(key, coded bytes of each stream): a key for each coded byte: its context of seven bytes at most, last byte first, and the byte in the lowest eight bits."""
    lengths = np.fromiter(map(len, streams), np.int64, len(streams))
    starts = np.cumsum(lengths) - lengths
    raw = b"\0" * 7 + b"".join(streams)
    eight = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))  # at each byte, it and the seven before
    keys = eight << np.uint64(8)
    keys |= eight >> np.uint64(56)
    keys &= _context(depth)
    for o in range(1, depth):  # contexts end at a text's start
        keys[starts[lengths > o] + o] &= _context(o)
    coded = np.ones(len(keys), bool)
    coded[starts] = False
    return keys[coded], lengths - 1


def _context(n: int) -> np.uint64:
    """The bits of a key that hold its byte and its last n context bytes."""
    return np.uint64((0xFFFFFFFFFFFFFFFF << 8 * (8 - n) & 0xFFFFFFFFFFFFFFFF) | 255)


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)


def _steps(texts: list[bytes]):
    """(first text, streams) of some texts at a time, about STEP bytes."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(spelled(t))
        size += len(held[-1])
        if size >= STEP or i == len(texts) - 1:
            yield at, held
            at, held, size = i + 1, [], 0


def chunk_events(texts: list[bytes], learn: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct events of some texts in order, and their counts in those that are learned from."""
    keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for told in (True, False):
        for _, streams in _steps([t for t, x in zip(texts, learn) if x == told]):
            k = event_keys(streams, depth)[0]
            k.sort()
            first = _runs(k)
            keys.append(k[first])
            counts.append(told * np.diff(np.r_[first, len(k)]))
            if sum(map(len, keys)) > 2 * len(keys[0]) + STEP:
                keys, counts = ([x] for x in summed(np.concatenate(keys), np.concatenate(counts))[:2])
    return summed(np.concatenate(keys), np.concatenate(counts))[:2]


def summed(keys: np.ndarray, counts: np.ndarray):
    """(distinct keys in order, summed counts, place of each key among them)."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = _runs(ordered)
    place = np.empty(len(keys), np.int64)
    place[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))
    return ordered[first], np.add.reduceat(counts[order], first) if len(first) else counts, place


def planes(values: np.ndarray) -> bytes:
    """64-bit numbers as byte planes: small ones leave planes of zeros, which the shuffle's compression takes away."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def numbers(data: bytes, kind=np.uint64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).reshape(-1)


def group_of(ctx, groups: int):
    """The group of a context of `top` bytes, for numpy and for columns alike."""
    return ctx * 48271 % 2147483647 % groups


class Subtrees:
    """The tree from depth `top` to `depth` over the events of whole subtrees; nodes of each level are distinct and in order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, code: Code, depth: int = DEPTH, top: int = 3):
        self.which, node, self.bit = code.decisions((keys & np.uint64(255)).astype(np.int64))
        n = counts[self.which]
        key, ones = keys[self.which] & ~np.uint64(255) | node, n * self.bit
        zeros, lp, self.levels = n - ones, None, []
        for d in range(depth, top - 1, -1):
            if d < depth:
                key = key & _context(d)
            order = np.argsort(key)
            first = _runs(key[order])
            place = np.empty(len(key), np.int64)
            place[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
            zeros, ones = (np.bincount(place, x, len(first)) for x in (zeros, ones))
            own = log_kt(zeros, ones)
            if lp is None:
                lp, weight = own, np.ones(len(own))
            else:
                lp = np.logaddexp(own, np.bincount(place, lp, len(first))) - np.log(2)
                weight = np.exp(own - np.log(2) - lp)
            key = key[order][first]
            self.levels.append((place, zeros + ones, (ones + 0.5) / (zeros + ones + 1), weight))
        self.roots = key, zeros, ones, lp

    def log10_of_events(self, a: np.ndarray, b: np.ndarray, stop: np.ndarray, events: int) -> np.ndarray:
        """The log probability of each event, if a root's prediction p counts as a + b * p, and stop stands where it is unseen."""
        for place, seen, own, weight in reversed(self.levels):
            stop = np.where(seen > 0, a + b * own, stop)
            a, b = a + b * weight * own, b * (1 - weight)
            a, b, stop = a[place], b[place], stop[place]  # to the level below, at last to the decisions
        return np.bincount(self.which, np.log10(np.where(self.bit == 1, stop, 1 - stop)), events)


def _table(**columns) -> pa.Table:
    return pa.table(columns)


def score(docs: DataFrame, train: F.Column, id_col: str = "doc_id", text: str = "text", depth: int = DEPTH, top: int | None = None) -> DataFrame:
    """(the id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte): a row for each row of docs."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))

    def tallied(batches):
        """A task's training bytes by value, and the size of all its texts at place 256."""
        n = np.zeros(257, np.int64)
        for b in batches:
            for t, learn in zip(b["text"].to_pylist(), b["train"].to_pylist()):
                s = spelled(t)
                n[256] += len(s)
                if learn:
                    n[:256] += np.bincount(np.frombuffer(s, np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(257)), pa.array(n)], ["place", "n"])

    tally = {r.place: r.n for r in rows.select("text", "train").mapInArrow(tallied, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()}
    size, code = tally.get(256, 0), Code([tally.get(s, 0) for s in range(256)])
    chunks, groups, word_groups = (max(1, -(-size // n)) for n in (CHUNK_BYTES, GROUP_BYTES, WORD_GROUP_BYTES))
    top = min(top or top_of(size), depth)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)))

    def event_parts(texts: list[bytes], learn: np.ndarray):
        """(group, keys, counts) of a chunk's events."""
        keys, counts = chunk_events(texts, learn, depth)
        g = group_of((keys >> np.uint64(8 * (8 - top))).astype(np.int64), groups)
        order = np.argsort(g, kind="stable")
        keys, counts, g = keys[order], counts[order], g[order]
        cut = np.r_[_runs(g), len(g)]
        return [(int(g[lo]), keys[lo:hi], counts[lo:hi]) for lo, hi in zip(cut[:-1], cut[1:])]

    def word_parts(words) -> list[tuple[int, list[bytes]]]:
        """(group, words in order) of a chunk's distinct words."""
        parts: dict[int, list[bytes]] = {}
        for w in words:
            parts.setdefault(groups + zlib.crc32(w) % word_groups, []).append(w)
        return [(g, sorted(ws)) for g, ws in sorted(parts.items())]

    def ask(table: pa.Table) -> pa.Table:
        texts, learn = table["text"].to_pylist(), np.array(table["train"].to_pylist(), bool)
        count: dict[bytes, int] = {END: int(learn.sum())}
        for t, x in zip(texts, learn.tolist()):
            words = t.lower().split()
            if x:
                for w in words:
                    count[w] = count.get(w, 0) + 1
            else:
                for w in set(words).difference(count):
                    count[w] = 0
        told = [(g, planes(np.diff(k, prepend=np.uint64(0))), planes(n)) for g, k, n in event_parts(texts, learn)]
        told += [(g, b" ".join(ws), planes(np.fromiter(map(count.__getitem__, ws), np.int64, len(ws)))) for g, ws in word_parts(count)]
        g, keys, counts = map(list, zip(*told))
        return _table(g=pa.array(g, pa.int64()), chunk=pa.array([table["chunk"][0].as_py()] * len(g), pa.int64()), keys=pa.array(keys, pa.binary()), counts=pa.array(counts, pa.binary()))

    def gathered(table: pa.Table):
        """A group's distinct events, their counts, and for each row asked the places of its events."""
        keys = [np.cumsum(numbers(b.as_buffer()), dtype=np.uint64) for b in table["keys"]]
        uniq, counts, place = summed(np.concatenate(keys), np.concatenate([numbers(b.as_buffer(), np.int64) for b in table["counts"]]))
        return uniq, counts, np.split(place, np.cumsum([len(k) for k in keys])[:-1])

    def word_counts(table: pa.Table):
        """A group's words with their counts, and for each row asked its words."""
        count: dict[bytes, int] = {}
        lists = [b.split(b" ") for b in table["keys"].to_pylist()]
        for words, n in zip(lists, table["counts"].to_pylist()):
            for w, k in zip(words, numbers(n, np.int64).tolist()):
                count[w] = count.get(w, 0) + k
        return count, lists

    def group_roots(table: pa.Table) -> pa.Table:
        """The roots of a group's subtrees; of a group of words one row with context -1: its known words and their count."""
        if table["g"][0].as_py() >= groups:
            count = word_counts(table)[0]
            known, total = sum(1 for n in count.values() if n), sum(count.values())
            return _table(ctx=pa.array([-1], pa.int64()), node=pa.array([0], pa.int32()), zeros=pa.array([float(known)]), ones=pa.array([float(total)]), lp=pa.array([0.0]))
        uniq, counts, _ = gathered(table)
        key, zeros, ones, lp = Subtrees(uniq, counts, code, depth, top).roots
        return _table(ctx=pa.array((key >> np.uint64(8 * (8 - top))).astype(np.int64)), node=pa.array((key & np.uint64(255)).astype(np.int32)), zeros=pa.array(zeros), ones=pa.array(ones), lp=pa.array(lp))

    asks = rows.groupBy("chunk").applyInArrow(ask, ASK)
    # every reader of the roots takes all their columns, so that one exchange, and one evaluation, serves them all
    roots = asks.groupBy("g").applyInArrow(group_roots, "ctx long, node int, zeros double, ones double, lp double")
    roots = roots.select(*(F.coalesce(c, F.lit(0)).alias(c) for c in roots.columns)).repartition(F.shiftright("ctx", 8))

    @F.arrow_udf("struct<lp double, w double>")
    def weighted(zeros: pa.Array, ones: pa.Array, below: pa.Array) -> pa.Array:
        own = log_kt(zeros.to_numpy(zero_copy_only=False), ones.to_numpy(zero_copy_only=False))
        lp = np.logaddexp(own, below.to_numpy(zero_copy_only=False)) - np.log(2)
        return pa.StructArray.from_arrays([pa.array(lp), pa.array(np.exp(own - np.log(2) - lp))], ["lp", "w"])

    # the levels above: each node's counts and weight, then for each root the mixture a + b * p of its own prediction p
    upper, below = {}, roots
    for d in range(top - 1, -1, -1):
        level = below.groupBy(F.shiftright("ctx", 8).alias("ctx"), "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("lp").alias("below"))
        level = level.withColumn("x", weighted("zeros", "ones", "below")).select("ctx", "node", "zeros", "ones", F.col("x.lp").alias("lp"), F.col("x.w").alias("w"))
        upper[d] = below = level
    path = roots.select("ctx", "node", "zeros", "ones", "lp", F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), F.lit(0.5).alias("stop"))
    for d in range(top):
        level = upper[d].select(F.col("ctx").alias("c_"), F.col("node").alias("n_"), (F.col("zeros") + F.col("ones")).alias("seen"), ((F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)).alias("own"), "w")
        path = path.join(level, (F.shiftright("ctx", 8 * (top - d)) == F.col("c_")) & (F.col("node") == F.col("n_")))
        a, b, own, w = F.col("a"), F.col("b"), F.col("own"), F.col("w")
        path = path.select("ctx", "node", "zeros", "ones", "lp", (a + b * w * own).alias("a"), (b * (1 - w)).alias("b"), F.when(F.col("seen") > 0, a + b * own).otherwise(F.col("stop")).alias("stop"))
    path = path.withColumn("g", F.when(F.col("ctx") < 0, F.lit(-1)).otherwise(group_of(F.col("ctx"), groups)).cast("long"))

    def answer(key, table: pa.Table, above: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table(chunk=pa.array([], pa.int64()), g=pa.array([], pa.int64()), told=pa.array([], pa.binary()))
        if table["g"][0].as_py() >= groups:
            count, lists = word_counts(table)
            told = [planes(np.fromiter(map(count.__getitem__, ws), np.int64, len(ws))) for ws in lists]
        else:
            uniq, counts, places = gathered(table)
            tree = Subtrees(uniq, counts, code, depth, top)
            k = above["ctx"].to_numpy().astype(np.uint64) << np.uint64(8 * (8 - top)) | above["node"].to_numpy().astype(np.uint64)
            sort = np.argsort(k)
            at = sort[np.searchsorted(k, tree.roots[0], sorter=sort)]
            a, b, stop = (above[c].to_numpy()[at] for c in ("a", "b", "stop"))
            lp = tree.log10_of_events(a, b, stop, len(uniq)).astype("<f4")
            told = [lp[p].tobytes() for p in places]
        return _table(chunk=table["chunk"], g=table["g"], told=pa.array(told, pa.binary()))

    answers = asks.groupBy("g").cogroup(path.groupBy("g")).applyInArrow(answer, "chunk long, g long, told binary")

    def doc_scores(key, table: pa.Table, given: pa.Table) -> pa.Table:
        texts, learn = table["text"].to_pylist(), np.array(table["train"].to_pylist(), bool)
        told = dict(zip(given["g"].to_pylist(), given["told"].to_pylist()))
        events = event_parts(texts, learn)
        keys, lp = np.concatenate([k for _, k, _ in events]), np.concatenate([np.frombuffer(told[g], "<f4") for g, _, _ in events])
        order = np.argsort(keys)
        keys, lp = keys[order], lp[order].astype(np.float64)
        out = np.zeros((5, len(texts)))
        for at, streams in _steps(texts):
            k, sizes = event_keys(streams, depth)
            order = np.argsort(k)
            k = k[order]
            first = _runs(k)
            got = np.empty(len(k))
            got[order] = np.repeat(lp[np.searchsorted(keys, k[first])], np.diff(np.r_[first, len(k)]))
            out[3, at : at + len(sizes)] = np.add.reduceat(got, np.cumsum(sizes) - sizes)
            out[4, at : at + len(sizes)] = sizes
        distinct = {END}
        for t in texts:
            distinct.update(t.lower().split())
        words = word_parts(distinct)
        place = {w: i for i, w in enumerate(w for _, ws in words for w in ws)}
        c = np.concatenate([numbers(told[g], np.int64) for g, _ in words])
        values = np.stack([(c > 0).astype(np.float64), np.log10(c + 0.5)])
        for i, t in enumerate(texts):
            tokens = t.lower().split()
            tokens.append(END)
            at = np.fromiter(map(place.__getitem__, tokens), np.int64, len(tokens))
            out[0, i] = len(at)
            out[1:3, i] = values[:, at].sum(axis=1)
        return _table(id=table["id"], held_out=pa.array(~learn), n_tokens=pa.array(out[0].astype(np.int64)), n_known=pa.array(out[1].astype(np.int64)), base=pa.array(out[2]), score=pa.array(out[3]), bits_per_byte=pa.array(-out[3] / np.log10(2) / out[4]))

    id_type = rows.schema["id"].dataType.simpleString()
    result = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(doc_scores, f"id {id_type}, held_out boolean, n_tokens long, n_known long, base double, score double, bits_per_byte double")
    words_only = lambda c: F.coalesce(F.sum(F.when((F.col("ctx") < 0) & (F.col("node") == 0) & (F.col("lp") == 0), F.col(c))), F.lit(0.0)).alias(c)
    totals = roots.agg(F.struct(words_only("zeros"), words_only("ones"))).scalar()
    known, tokens = totals["zeros"], totals["ones"]
    base = F.col("base") - F.col("n_tokens") * F.log10(tokens + 0.5 * (known + 1))
    return result.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", tokens.cast("long").alias("train_tokens"), base.alias("base_score"), "score", "bits_per_byte")


def top_of(size: int) -> int:
    """How many context bytes name a subtree that one group holds whole: one more for every 64-fold of 64 GB."""
    top, limit = 3, 64 << 30
    while size > limit and top < 5:
        top, limit = top + 1, limit * 64
    return top


def learners(id_col: str = "doc_id") -> F.Column:
    """Rows that may be learned from: crc32 of the id as text, mod 5, is not 1."""
    return F.pmod(crc32_of(id_col), F.lit(5)) != 1
