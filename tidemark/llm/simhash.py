"""SimHash near-dedup by bit-sliced comparison (operator 9).

Fingerprints come from word shingles hashed by XXH64; equal fingerprints become one row before any comparison. Two
forms exist. Of 64 bits, repeats included: candidates share two of four 16-bit parts, which any two fingerprints at
distance 2 or less must, so none is missed. Of 512 bits over distinct shingles, for a similarity (Jaccard) of 0.8 or
more: candidates share one of 16 keys, each made of the least of five permuted shingle hashes (at 0.8 all but 0.2 % of
pairs do, nearer pairs more surely); the bits only rule out pairs that lie MARGIN standard deviations past the expected
78 bits, and no pair with a text of fewer than FEW shingles; the exact Jaccard similarity of the two sets of distinct
shingle hashes decides the others. Here rows are one where their sets are equal, and the sets of those texts that share
a key are computed again from the text, so that no set is stored for the others.

Inside a bucket the fingerprints of a block lie as bit planes: 64 of them in each machine word of a plane. A query's
distance to the whole block is counted by bitwise carry-save adders, plane after plane, and a block is left as soon as
all its distances exceed the radius; pairs of small buckets are laid side by side in one block. A bucket with more than
BLOCK fingerprints is cut into blocks, and pairs of blocks are dealt to different tasks, so that no task's size follows
a bucket's and nothing is lost. A task returns a spanning forest of the links it found, not the links.

Rows: a null text counts as empty; texts without words have fingerprint zero and link like any other; shorter texts than
a shingle use all their words; repeated rows each get their row; null ids link and keep their rows, and count for no
component id (null where a component has no other); other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import connected_components, fresh, saved, small_batches

SHINGLE, SEED, RADIUS = 3, 42, 2
PARTS, PART_BITS = 4, 16
WIDE_WORDS, BANDS, BAND_ROWS = 8, 16, 5
MARGIN, FEW, BLOCK_HASHES = 4, 64, 1 << 21
BLOCK, TILE, SMALL, PAIRS, ROWS = 4096, 256, 48, 1 << 17, 100_000
_ODD = np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
TABLES = tuple(combinations(range(PARTS), 2))
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of a text's word shingles, repeats included, as big-endian words; shorter texts give one of all their words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, ">u8")
    grams = [b" ".join(words)] if len(words) <= shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(SEED))), ">u8")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> bytes:
    """The 64-bit fingerprint of a text in UTF-8: a bit is 1 if set in over half the shingles' hashes."""
    raw = shingle_hashes(text, shingle).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), 1 << 15):
        ones += np.unpackbits(raw[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(raw)).tobytes()


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of a text in order."""
    return np.unique(shingle_hashes(text, shingle).astype("<u8"))


def wide_fingerprint(h: np.ndarray) -> tuple[bytes, np.ndarray]:
    """512 bits over a set of shingle hashes, and the candidate keys."""
    ones, least = np.zeros(64 * WIDE_WORDS, np.int64), np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    mixers, perms = _ODD[:WIDE_WORDS], _ODD[WIDE_WORDS : WIDE_WORDS + BANDS * BAND_ROWS]
    for at in range(0, len(h), 4096):
        x = h[at : at + 4096]
        y = x ^ (x >> np.uint64(32))
        z = y[:, None] * mixers
        z ^= z >> np.uint64(29)
        ones += np.unpackbits(z.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
        np.minimum(least, (y * perms[:, None]).min(axis=1), out=least)
    bands = (least.reshape(BANDS, BAND_ROWS) * _ODD[128 : 128 + BAND_ROWS]).sum(axis=1) ^ _ODD[192 : 192 + BANDS]
    return np.packbits(2 * ones > len(h)).tobytes(), bands.view(np.int64)


def radius_of(similarity: float, bits: int = 64 * WIDE_WORDS) -> int:
    """Bits that fingerprints of sets with a Jaccard similarity differ in at most, but for chance: the angle's share of a half turn and MARGIN standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * p + MARGIN * math.sqrt(bits * p * (1 - p)))


def fingerprints(docs: DataFrame, text: str, out: str, shingle: int = SHINGLE, wide: bool = False) -> DataFrame:
    """docs with a struct more (led by an underscore where docs have its name): the fingerprint as bytes, its candidate keys, and of wide ones a number for the set of shingles and its size."""
    names = ["fp", "keys", "cls", "size"]

    @F.arrow_udf(T.StructType([T.StructField("fp", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("cls", T.LongType()), T.StructField("size", T.LongType())]))
    def prints(texts: pa.Array) -> pa.Array:
        data = texts.cast(pa.binary()).to_pylist()
        if wide:
            got, cls, sizes = [], [], []
            for t in data:
                h = shingle_set(t or b"", shingle)
                got.append(wide_fingerprint(h))
                cls.append(int.from_bytes(xxhash.xxh64_digest(h.tobytes(), SEED), "big", signed=True))
                sizes.append(len(h))
            keys = pa.ListArray.from_arrays(np.arange(len(got) + 1, dtype=np.int32) * BANDS, pa.array(np.concatenate([k for _, k in got]) if got else np.empty(0, np.int64)))
            return pa.StructArray.from_arrays([pa.array([f for f, _ in got], pa.binary()), keys, pa.array(cls, pa.int64()), pa.array(sizes, pa.int64())], names)
        none = pa.nulls(len(data), pa.int64())
        return pa.StructArray.from_arrays([pa.array([fingerprint(t or b"", shingle) for t in data], pa.binary()), pa.nulls(len(data), pa.list_(pa.int64())), none, none], names)

    small_batches(docs.sparkSession)
    return docs.withColumn(*fresh(docs.columns, out), prints(F.col(f"`{text}`").cast("string")))


def _bits(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(prints, axis=1)


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (rows of bytes), highest bit first: each plane holds a bit of every fingerprint, in 64-bit words (filled up with zeros)."""
    n = -(-len(prints) // 64) * 64
    bits = np.zeros((8 * prints.shape[1], n), np.uint8)
    bits[:, : len(prints)] = _bits(prints).T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def _near(different, bits: int, shape, radius: int) -> np.ndarray | None:
    """Words whose bits are set where a distance is the radius or less; None as soon as all exceed it. different(p): plane p of the differences."""
    digits = [np.zeros(shape, np.uint64) for _ in range(max(1, radius.bit_length()))]
    far = np.zeros(shape, np.uint64)  # distances past what the digits hold
    for p in range(bits):
        carry = different(p)
        for d in digits:
            held = d & carry
            d ^= carry
            carry = held
            if not carry.any():
                break
        else:
            far |= carry
        if p % 16 == 15 and (_over(digits, far, radius) == _FULL).all():
            return None
    return ~_over(digits, far, radius)


def _over(digits: list[np.ndarray], far: np.ndarray, radius: int) -> np.ndarray:
    """Bits set where the counted distance exceeds the radius: a bitwise comparison from the highest digit."""
    more, equal = np.zeros_like(far), np.full_like(far, _FULL)
    for k in reversed(range(len(digits))):
        if radius >> k & 1:
            equal &= digits[k]
        else:
            more |= equal & digits[k]
            equal &= ~digits[k]
    return more | far


def within(queries: np.ndarray, block: np.ndarray, count: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) of all pairs at the radius or less. block: planes of count fingerprints; queries: fingerprints as rows of bytes."""
    masks = (-_bits(queries).astype(np.int64)).view(np.uint64)  # all ones where a query's bit is set
    near = _near(lambda p: block[p][None, :] ^ masks[:, p][:, None], len(block), (len(queries), block.shape[1]), radius)
    if near is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    q, word = np.nonzero(near)
    k, bit = np.nonzero(np.unpackbits(near[q, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    member = word[k] * 64 + bit
    there = member < count
    return q[k][there], member[there]


def pairs_within(prints: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs (a, b) of rows are at the radius or less; the pairs' differences lie side by side in planes."""
    block = planes(prints[a] ^ prints[b])
    near = _near(lambda p: block[p], len(block), (block.shape[1],), radius)
    if near is None:
        return np.zeros(len(a), bool)
    return np.unpackbits(near.astype("<u8").view(np.uint8), bitorder="little")[: len(a)].astype(bool)


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of linked rows."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        np.minimum.at(root, a, np.minimum(x, y))
        np.minimum.at(root, b, np.minimum(x, y))
        while (root[root] != root).any():
            root[:] = root[root]


class Sets:
    """The shingle sets of rows, for exact similarities."""

    def __init__(self, grams: list[bytes], similarity: float):
        self.sizes = np.fromiter(map(len, grams), np.int64, len(grams)) // 8
        self.starts = np.cumsum(self.sizes) - self.sizes
        distinct, self.flat = np.unique(np.frombuffer(b"".join(grams), "<u8"), return_inverse=True)
        self.mark = np.zeros(len(distinct), np.int64)
        least = Fraction(str(similarity))
        self.num, self.den = least.numerator, least.denominator

    def may(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the sizes of sets allow the similarity."""
        x, y = self.sizes[a], self.sizes[b]
        return self.den * np.minimum(x, y) >= self.num * np.maximum(x, y)

    def few(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a set is too small for its fingerprint to rule a pair out."""
        return np.minimum(self.sizes[a], self.sizes[b]) < FEW

    def similar(self, q: int, m: np.ndarray) -> np.ndarray:
        """Which of the rows m reach the similarity with row q, exactly."""
        own = self.flat[self.starts[q] : self.starts[q] + self.sizes[q]]
        sizes = self.sizes[m]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[m] - ends + sizes, sizes)
        self.mark[own] = 1
        total = np.concatenate([[0], np.cumsum(self.mark[self.flat[at]])])
        self.mark[own] = 0
        both = total[ends] - total[ends - sizes]
        return self.den * both >= self.num * (sizes + len(own) - both)


def _decide(root: np.ndarray, a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray, sets: Sets) -> None:
    """Joins the trees of those pairs (a, b) that are similar; pairs in one tree need no comparison. first, last: the bounds of each row's bucket."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    bounds = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True]) if len(a) else [0]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        q, m, step = a[lo], b[lo:hi], 4
        m = m[root[m] != root[q]]
        while len(m):
            some, m = m[:step], m[step:]
            hit = some[sets.similar(q, some)]
            step *= 4 if step < TILE else 1
            if len(hit):
                trees = {int(root[q]), *root[hit].tolist()}
                here = root[first[q] : last[q]]
                for t in trees:
                    here[here == t] = min(trees)
                m = m[root[m] != root[q]]


def _links(pdf: pd.DataFrame, radius: int, similarity: float | None = None) -> pd.DataFrame:
    """A spanning forest of the links inside the buckets of a group; with a similarity, of the pairs whose sets (grams) have it."""
    pdf = pdf.sort_values(["bucket", "i", "j", "side"], kind="stable")
    cls, side = pdf["cls"].to_numpy(np.int64), pdf["side"].to_numpy()
    if not len(cls):
        return pd.DataFrame({"a": cls, "b": cls})
    prints = np.frombuffer(b"".join(pdf["fp"]), np.uint8).reshape(len(cls), -1)
    key = pdf[["bucket", "i", "j"]].to_numpy()
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
    ends = np.r_[starts[1:], len(cls)]
    two, root = key[starts, 1] != key[starts, 2], np.arange(len(cls))
    small = (ends - starts < SMALL) & ~two
    sets = Sets(pdf["grams"].tolist(), similarity) if similarity is not None else None
    first, last = np.repeat(starts, ends - starts), np.repeat(ends, ends - starts)
    for size in np.unique((ends - starts)[small]):  # buckets of a size give their pairs together
        if size < 2:
            continue
        at = starts[small & (ends - starts == size)]
        x, y = np.triu_indices(size, 1)
        step = max(1, PAIRS // len(x))
        for k in range(0, len(at), step):
            a, b = (at[k : k + step, None] + x).ravel(), (at[k : k + step, None] + y).ravel()
            near = pairs_within(prints, a, b, radius)
            if sets:
                near = (near | sets.few(a, b)) & sets.may(a, b)
                _decide(root, a[near], b[near], first, last, sets)
            else:
                _join(root, a[near], b[near])
    for lo, hi, parted in zip(starts[~small], ends[~small], two[~small]):
        mid = lo + int((side[lo:hi] == 0).sum()) if parted else lo
        top = mid if parted else hi
        if mid >= hi or top <= lo:
            continue
        block = planes(prints[mid:hi])
        for at in range(lo, top, TILE):
            q, m = within(prints[at : min(at + TILE, top)], block, hi - mid, radius)
            if sets:
                rows, members = np.arange(at, min(at + TILE, top))[:, None], np.arange(mid, hi)[None]
                near = sets.few(rows, members)
                near[q, m] = True
                q, m = np.nonzero(near & sets.may(rows, members) & ((rows < members) | parted))
                _decide(root, at + q, mid + m, first, last, sets)
            else:
                _join(root, at + q, mid + m)
    linked = root != np.arange(len(root))
    return pd.DataFrame({"a": cls[linked], "b": cls[root[linked]]}).drop_duplicates()


def _dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows (cls, bucket and others) of the buckets in sizes (bucket, blocks), once for each pair of blocks (i, j) that they are compared in."""
    others = [c for c in rows.columns if c != "bucket"]
    dealt = rows.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("own"), o).alias("i"), F.greatest(F.col("own"), o).alias("j"), F.when(F.col("own") <= o, 0).otherwise(1).alias("side")))
    return dealt.select(*others, "bucket", F.explode(pairs).alias("p")).select(*others, "bucket", "p.*")


def _grouped(dealt: DataFrame, groups: int):
    """Pairs of blocks by the group that compares them."""
    return dealt.withColumn("g", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(groups))).groupBy("g")


def near_links(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that join exactly the fingerprints which links at the radius or less join. prints: cls, fp, keys, each fingerprint once."""
    rows = prints.select("cls", "fp", F.explode("keys").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = saved(_dealt(rows, sizes))
    return _grouped(dealt, max(1, -(-dealt.count() // ROWS))).applyInPandas(lambda pdf: _links(pdf, radius), "a long, b long")


def similar_links(prints: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): links that join exactly the sets which pairs that share a key and reach the similarity join.

    prints: cls, fp, keys, size and r (the row_key and text_hash of a text with the set), each set once; texts: row_key,
    text_hash, text. Of buckets with the same members one is compared; blocks hold up to BLOCK sets or BLOCK_HASHES hashes.
    """
    rows = prints.select("cls", "size", F.explode("keys").alias("bucket"))
    same = (F.bit_xor(F.xxhash64("cls", F.lit(k))) for k in (1, 2))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("hashes"), *(x.alias(f"x{k}") for k, x in enumerate(same))).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.col("n"), F.ceil(F.col("hashes") / BLOCK_HASHES))).cast("int")
    sizes = sizes.groupBy("n", "hashes", "x0", "x1").agg(F.min("bucket").alias("bucket")).select("bucket", blocks.alias("blocks"))
    dealt = saved(_dealt(rows, sizes))
    n, hashes = dealt.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    groups = max(1, -(-n // ROWS), -(-hashes // (2 * BLOCK_HASHES)))

    @F.arrow_udf("binary")
    def grams(data: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t or b"", shingle).tobytes() for t in data.cast(pa.binary()).to_pylist()], pa.binary())

    wanted = prints.join(dealt.select("cls").distinct(), "cls").select("cls", "fp", "r.row_key", "r.text_hash")
    sets = texts.join(wanted, ["row_key", "text_hash"]).dropDuplicates(["row_key", "text_hash"]).select("cls", "fp", grams("text").alias("grams"))
    radius = radius_of(similarity)
    return _grouped(dealt.drop("size").join(sets, "cls"), groups).applyInPandas(lambda pdf: _links(pdf, radius, similarity), "a long, b long")


def _parts() -> F.Column:
    """Bucket keys of a 64-bit fingerprint: every two of its four parts, numbered."""
    n = F.conv(F.hex("fp"), 16, -10).cast("long")
    part = lambda k: F.shiftrightunsigned(n, PART_BITS * (PARTS - 1 - k)).bitwiseAND(F.lit(0xFFFF))
    return F.array(*(F.lit(t).cast("long") * (1 << 32) + part(x) * (1 << 16) + part(y) for t, (x, y) in enumerate(TABLES)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """(the id, fingerprint in hex, component_id, root, text_hash): a row for each row of docs.

    Without a similarity, 64-bit fingerprints link at 2 or fewer differing bits; with one, sets of distinct shingles link
    at that Jaccard similarity or more. root names the component even where ids are null.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = fingerprints(texts, "text", "p", shingle, similarity is not None)
    if similarity is None:
        same, rows = "fp", saved(rows.select("id", F.xxhash64("text").alias("text_hash"), "p.fp"))
        prints = rows.groupBy("fp").agg(F.min("id").alias("least")).withColumn("cls", F.xxhash64("fp")).withColumn("keys", _parts())
        links = near_links(prints.select("cls", "fp", "keys"), RADIUS)
    else:
        names = [F.xxhash64("id", F.lit(1)).alias("row_key"), F.xxhash64("text").alias("text_hash")]
        same, rows = "cls", saved(rows.select("id", *names, "p.*"))
        prints = rows.groupBy("cls").agg(F.min("id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("size").alias("size"), F.min(F.struct("row_key", "text_hash")).alias("r"))
        links = similar_links(prints, texts.select(*names, "text"), shingle, similarity)
    parts = connected_components(links)
    prints = prints.select(same, "least", "cls").join(parts.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("component", "cls"))
    named = prints.groupBy("root").agg(F.min("least").alias("component_id"))
    prints = prints.select(same, "root").join(named, "root")
    return rows.join(prints, same).select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id", "root", "text_hash")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float | None = 0.8) -> DataFrame:
    """The rows of docs of which one stays in each component: that with the least id (null last), then the least text hash; repeated rows once."""
    key, hashed = fresh(docs.columns, "row_key", "text_hash")
    groups = near_duplicates(docs, id_col, text, shingle, similarity)
    own = F.col(f"`{id_col}`")
    stay = groups.groupBy("root").agg(F.min(F.struct(own.isNull().alias("no"), own.alias("id"), F.col("text_hash"))).alias("s"))
    stay = stay.select(F.xxhash64("s.id", F.lit(1)).alias(key), F.col("s.text_hash").alias(hashed)).distinct()
    marked = docs.withColumn(hashed, F.xxhash64(F.col(f"`{text}`").cast("string"))).withColumn(key, F.xxhash64(own, F.lit(1)))
    kept = marked.join(stay, [key, hashed], "left_semi")  # partitioned as dropDuplicates needs it
    return kept.dropDuplicates([key, hashed]).select(*(F.col(f"`{c}`") for c in docs.columns))
