"""Fill-in-middle transformation (operator 11) by succinct rank and select.

The bytes of a batch of whole texts carry two packed bit vectors: one marks bytes where a token starts (a run of letters
A-Z or a-z, or any other single character), one marks bytes where a character starts. A directory holds the ones before
each block of 512 bits. A text's number of tokens n is the difference of two ranks (a total popcount); a cut after k tokens
is the select of the rank k past its start; characters between cuts are ranks in the second vector. No list of tokens is
ever made: beside the text itself, its vectors take a quarter of its bytes.

Where the cuts lie, and which form a text takes, follows from the sha256 of seed and id alone, so reruns agree and rows with
the same id and text come out alike. The output is put together from byte ranges by Spark itself; Python only sees the text
and returns four numbers.

Rows: a null text counts as empty; empty texts, and texts that hold one of the marks, stay plain (n is still counted);
a null id counts as an empty one. Texts of any length are read whole, in batches bounded in bytes. An empty table gives an
empty table. Other columns pass through; of the new names, those that docs have are led by an underscore.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches, fresh

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
NAMES = ("n", "form", "prefix_chars", "middle_chars", "output")
CUTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "a", "b", "prefix_chars", "middle_chars")])
WORDS, PIECE = 8, 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class BitVector:
    """Bits packed in 64-bit words, with the count of ones before every block of WORDS words."""

    def __init__(self, packed: np.ndarray):
        size = 8 * WORDS * (len(packed) // (8 * WORDS) + 1)
        self.words = np.concatenate([packed, np.zeros(size - len(packed), np.uint8)]).view("<u8").reshape(-1, WORDS)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).sum(axis=1, dtype=np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block, word, bit = at >> 9, (at >> 6) & (WORDS - 1), (at & 63).astype(np.uint64)
        rows = self.words[block]
        whole = (np.bitwise_count(rows) * (np.arange(WORDS) < word[:, None])).sum(axis=1, dtype=np.int64)
        part = rows[np.arange(len(at)), word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + whole + np.bitwise_count(part)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The position of the one that has k ones before it."""
        block = np.searchsorted(self.before, k, "right") - 1
        rest, rows, each = k - self.before[block], self.words[block], np.arange(len(k))
        sums = np.cumsum(np.bitwise_count(rows), axis=1, dtype=np.int64)
        word = (sums <= rest[:, None]).sum(axis=1)
        rest = rest - np.where(word > 0, sums[each, word - 1], 0)
        bits = (rows[each, word][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        bit = (np.cumsum(bits, axis=1, dtype=np.int64) <= rest[:, None]).sum(axis=1)
        return (block << 9) + (word << 6) + bit


def boundaries(data: np.ndarray, starts: np.ndarray) -> tuple[BitVector, BitVector]:
    """Token starts and character starts of texts that lie one after the other; starts has the first byte of each one that isn't empty, ascending."""
    tokens, chars = [], []
    for i in range(0, len(data), PIECE):
        piece = data[i : i + PIECE]
        letter = _LETTER[piece]
        after = np.empty(len(piece), bool)
        after[0], after[1:] = i > 0 and _LETTER[data[i - 1]], letter[:-1]
        char = (piece & 0xC0) != 0x80
        token = np.where(letter, ~after, char)
        token[starts[np.searchsorted(starts, i) : np.searchsorted(starts, i + len(piece))] - i] = True
        tokens.append(np.packbits(token, bitorder="little"))
        chars.append(np.packbits(char, bitorder="little"))
    none = [np.empty(0, np.uint8)]
    return BitVector(np.concatenate(tokens or none)), BitVector(np.concatenate(chars or none))


def cut(texts: pa.Array, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """For each text: n, the bytes before the first and before the second cut, the characters of prefix and of middle. texts are binary, without nulls."""
    ends = np.frombuffer(texts.buffers()[1], "<i4")[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None and ends[-1] > ends[0] else np.empty(0, np.uint8)
    ends = ends - ends[0]
    first, last = ends[:-1], ends[1:]
    tokens, chars = boundaries(data, first[last > first])
    base = tokens.rank(first)
    n = tokens.rank(last) - base
    at = []
    for k in (np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))):
        place, inside = last.copy(), k < n
        place[inside] = tokens.select((base + k)[inside])
        at.append(place)
    marks = [chars.rank(p) for p in (first, *at)]
    return np.stack([n, at[0] - first, at[1] - first, marks[1] - marks[0], marks[2] - marks[1]], axis=1)


def draws(id_col: str, seed: int) -> list[Column]:
    """Four numbers of 32 bits that a row's id gives."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, k, 8), 16, 10).cast("long") for k in (1, 9, 17, 25)]


def transform(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 1, rate: int = 90, spm: int = 20, names: tuple[str, ...] = NAMES) -> DataFrame:
    """docs with n, form (plain, psm or spm), the characters of prefix and middle (null if plain) and the output; of 100 texts about `rate` are cut, of which about `spm` % start with the suffix."""

    @F.arrow_udf(CUTS)
    def cuts(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        rows = cut(texts.cast(pa.binary()).fill_null(b""), h1.to_numpy(), h2.to_numpy())
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], list(CUTS.names))

    bounded_batches(docs.sparkSession)
    names = fresh(docs.columns, *names)
    whole, found, kind = fresh([*docs.columns, *names], "whole", "cuts", "kind")
    h1, h2, h3, h4 = draws(id_col, seed)
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    marked = F.contains(value, F.lit(PREFIX)) | F.contains(value, F.lit(SUFFIX)) | F.contains(value, F.lit(MIDDLE))
    form = F.when((value == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    out = docs.withColumns({whole: value, kind: form}).withColumn(found, cuts(F.col(whole), h1, h2))
    data, a, b = F.col(whole).cast("binary"), F.col(f"{found}.a"), F.col(f"{found}.b")
    part = lambda start, length: F.substring(data, (start + 1).cast("int"), length.cast("int"))
    mark = lambda m: F.lit(m).cast("binary")
    prefix, middle, suffix = part(F.lit(0), a), part(a, b - a), part(b, F.octet_length(whole) - b)
    psm = F.concat(mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle)
    spm_ = F.concat(mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle)
    text_out = F.when(F.col(kind) == "plain", data).when(F.col(kind) == "spm", spm_).otherwise(psm).cast("string")
    cuts_only = [F.when(F.col(kind) != "plain", F.col(f"{found}.{c}")).alias(o) for c, o in zip(("prefix_chars", "middle_chars"), names[2:4])]
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(f"{found}.n").alias(names[0]), F.col(kind).alias(names[1]), *cuts_only, text_out.alias(names[4]))


def restore(df: DataFrame, output: str = "output", form: str = "form", out: str = "restored") -> DataFrame:
    """df with the text rebuilt from output and form. A cut text holds no mark of its own, and no mark can overlap one across a cut, so each mark stands once."""
    o = F.col(f"`{output}`")
    before, after = lambda c, m: F.substring_index(c, m, 1), lambda c, m: F.substring_index(c, m, -1)
    head, middle = before(o, MIDDLE), after(o, MIDDLE)
    psm = F.concat(after(before(head, SUFFIX), PREFIX), middle, after(head, SUFFIX))
    spm = F.concat(after(head, PREFIX), middle, after(before(head, PREFIX), SUFFIX))
    text = F.when(F.col(f"`{form}`") == "plain", o).when(F.col(f"`{form}`") == "spm", spm).otherwise(psm)
    return df.withColumn(*fresh(df.columns, out), text)
