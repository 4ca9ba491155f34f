"""Token-id files with an adaptive context-mixing range coder (operator 10).

A table of chunks: whole documents in id order, each chunk with its documents' ids and lengths and its blocks. A block
holds up to BLOCK token ids and carries a CRC-32 of them. Up to LANES blocks of a chunk are coded side by side, a lane of
numpy arrays each, by one model that starts afresh with them: what any lane has coded, all lanes know at the next id. So a
chunk can be read alone, and its blocks only together.

The model predicts each id by three orders. Order 0 is an adaptive distribution over all ids: counts that start from a law
of falling shares (vocabularies list frequent ids first) and are renewed while ids come. Orders 1 and 2 name the id that
last followed the last one or two ids and stood its test since; how far each is believed follows how often ids named with
such reliability came. Every id is range-coded in one step with the mixture of the three: an id named adds its weight to its
share of order 0. No id passes by the coder. All arithmetic is in integers, so any machine decodes alike. Where ids reach
past 2**17, their ranks among the ids that occur are coded, and the first block names these ids.

Rows: a null text counts as empty and gives the end id alone; documents of any length stay whole in a chunk; equal ids
are ordered by the hash of the text, null ids come first; an empty table gives no chunks; other columns are left out. A
wrong checksum raises ValueError.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, located, scratch

BLOCK, LANES, CHUNK_IDS, TEXTS, PART_BYTES = 512, 1 << 14, 6 << 20, 200, 10 << 20
#: Words in a worker's table, the longest that a slot holds, and the longest that is kept at all.
CACHE_WORDS, SLOT_BYTES, CACHE_BYTES = 1_500_000, 15, 48
#: Bits of a whole distribution, the least share of an id in it, bits of a slot's width, of a weight, and of order 2's table.
_SCALE, _LEAST, _SLOT, _WEIGHT, _HASHED = 28, 16, 12, 16, 19
_U32, _WORD = np.uint64(32), np.uint64((1 << 32) - 1)
#: What an id counts, how many ids the law before the first counts for, and the weight that orders 1 and 2 share at most.
_SEEN, _PRIOR_IDS, _NAMED = 32, 2048, (1 << _WEIGHT) * 15 // 16
#: Two blanks, a blank before other white space, and white space other than blank and bytes 9 to 13, in UTF-8 (E2 80 and E2 81 hold more than white space).
_UNCUT = [b"  ", *(b" " + bytes([c]) for c in range(9, 14)), *(bytes([c]) for c in range(0x1C, 0x20)), b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
CHUNK = "part long, seq long, ids_before long, n_ids long, doc_ids array<long>, lengths array<int>, blocks array<struct<n:int,crc:long,payload:binary>>"
_ARROW = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("blocks", pa.list_(pa.struct([("n", pa.int32()), ("crc", pa.int64()), ("payload", pa.binary())])))])


class _Lanes:
    """The model of blocks side by side and their coders; lanes are sorted by length, longest first."""

    def __init__(self, lanes: int, size: int):
        self.size = size  # of the alphabet
        mass = 1 / (np.arange(size) + 40)
        self.counts = 1 + (mass * (_SEEN * _PRIOR_IDS / mass.sum())).astype(np.int64)
        self.t1, self.t2 = (np.full(n, size << 3, np.int32) for n in (size + 1, 1 << _HASHED))  # the id named and its reliability, 0 to 7 (0: none)
        sure = np.arange(8)
        #: By the reliabilities of both orders, and again where both name one id: how often, and how often order 1's or 2's id came.
        self.met, self.hit1, self.hit2 = np.full(128, 64), 2 * np.tile(np.repeat(sure, 8), 2), 3 * np.r_[np.tile(sure, 8), np.zeros(64, np.int64)]
        self.hit1[64:72] = 0
        self.last, self.then = np.full(lanes, size), np.full(lanes, size)
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
        self.new, self.fresh, self.seen = [], 0, 0
        self.renew()

    def renew(self) -> None:
        """Counts what came into order 0: cum has the cumulative shares, each at least _LEAST, and slot the id that each slot of them begins in."""
        if self.new:
            self.counts += np.bincount(np.concatenate(self.new), minlength=self.size) * _SEEN
            if self.counts.sum() >= 1 << 33:
                self.counts -= self.counts >> 1
        self.seen, self.new, self.fresh = self.seen + self.fresh, [], 0
        total = np.cumsum(self.counts)
        ends = np.arange(1, self.size + 1) * _LEAST + total * ((1 << _SCALE) - self.size * _LEAST) // total[-1]
        self.cum = np.concatenate([[0], ends, ends[-1:]])
        self.slot = np.searchsorted(self.cum[:-2], np.arange(0, 1 << _SCALE, 1 << _SLOT), "right") - 1
        self.due = max(self.size >> 4, min(self.seen >> 2, 1 << 18))

    def predict(self, m: int) -> None:
        """The ids that orders 1 and 2 name (the alphabet's size: none) and the weights of the three orders, for the first m lanes."""
        last = self.last[:m]
        self.at2 = (last * 2654435761 + self.then[:m] * 2246822519 >> 7) & ((1 << _HASHED) - 1)
        self.e1, self.e2 = self.t1.take(last).astype(np.int64), self.t2.take(self.at2).astype(np.int64)
        self.p1, self.p2 = self.e1 >> 3, self.e2 >> 3
        self.state = ((self.e1 & 7) << 3) + (self.e2 & 7) + (self.p1 == self.p2) * 64
        w1, w2 = self.hit1 * _NAMED // self.met, self.hit2 * _NAMED // self.met
        over = np.maximum(w1 + w2, _NAMED)
        w1, w2 = w1 * _NAMED // over, w2 * _NAMED // over
        self.w0 = ((1 << _WEIGHT) - w1 - w2).take(self.state)
        self.w1, self.w2 = (w1 << _SCALE - _WEIGHT).take(self.state), (w2 << _SCALE - _WEIGHT).take(self.state)

    def below(self, ids: np.ndarray) -> np.ndarray:
        """What order 0 gives all ids below, by its weight."""
        return self.w0 * self.cum.take(ids) >> _WEIGHT

    def interval(self, ids: np.ndarray):
        """(start, width, where order 1 and where order 2 named it) of ids in the mixture: those named lie before order 0's part of the same id."""
        came1, came2 = self.p1 == ids, self.p2 == ids
        start = self.below(ids)
        width = self.below(ids + 1) - start
        start += self.w1 * (self.p1 < ids)
        start += self.w2 * (self.p2 < ids)
        width += self.w1 * came1
        width += self.w2 * came2
        return start, width, came1, came2

    def find(self, m: int, value: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold the values: without what ids named take up before them, order 0's shares tell the id."""
        t = np.minimum((value - self.low[:m]) // (self.range[:m] >> np.uint64(_SCALE)), np.uint64((1 << _SCALE) - 1)).astype(np.int64)
        after = self.p2 < self.p1
        rest = t - np.minimum(np.maximum(t - self.below(self.p1) - self.w2 * after, 0), self.w1)
        rest -= np.minimum(np.maximum(t - self.below(self.p2) - self.w1 * ~after, 0), self.w2)
        share = ((rest + 1 << _WEIGHT) - 1) // self.w0
        ids = self.slot.take(share >> _SLOT)
        past = np.flatnonzero(self.cum.take(ids + 1) <= share)
        if len(past):
            ids[past] = np.searchsorted(self.cum[:-1], share[past], "right") - 1
        return ids

    def narrow(self, m: int, start: np.ndarray, width: np.ndarray, shift) -> None:
        """Takes intervals of the first m lanes' ranges; where a range falls to 32 bits, its upper word is settled (a range across its border keeps the larger side) and shifted out or in."""
        step = self.range[:m] >> np.uint64(_SCALE)
        self.low[:m] += step * start.view(np.uint64)
        np.multiply(step, width.view(np.uint64), out=self.range[:m])
        lanes = np.flatnonzero(self.range[:m] <= _WORD)
        if len(lanes):
            low, size = self.low[lanes], self.range[lanes]
            under = (np.uint64(0) - low) & _WORD
            cut = (under > 0) & (under < size)
            over = np.where(cut, size - under, np.uint64(0))
            low += under * (over > under)
            size = np.where(cut, np.maximum(over, under), size)
            shift(lanes, low >> _U32)
            self.low[lanes], self.range[lanes] = low << _U32, size << _U32

    def learn(self, m: int, ids: np.ndarray, came1: np.ndarray, came2: np.ndarray) -> None:
        """Moves the model towards the ids that came. Of lanes with the same context the last one counts."""
        for count, states in ((self.met, self.state), (self.hit1, self.state[came1]), (self.hit2, self.state[came2 & (self.state < 64)])):
            count += np.bincount(states, minlength=128)
        if self.met.max() >= 1 << 20:
            self.met, self.hit1, self.hit2 = self.met + 1 >> 1, self.hit1 >> 1, self.hit2 >> 1
        named = (ids << 3) + 1
        for table, at, e, came in ((self.t1, self.last[:m], self.e1, came1), (self.t2, self.at2, self.e2, came2)):
            sure = e & 7
            table[at] = np.where(came, e + (sure < 7), np.where(sure > 2, e - 1, named))
        self.then[:m] = self.last[:m]
        self.last[:m] = ids
        self.new.append(ids)
        self.fresh += m
        if self.fresh >= self.due:
            self.renew()


def _by_length(sizes: list[int]):
    """(lanes' order, their sizes, for each step how many are still at work)."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    size = np.array([sizes[i] for i in order])
    return order, size, np.searchsorted(-size, -np.arange(size[0]), "left").tolist()


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The coded bytes of each block of ids, up to LANES blocks side by side; the first of them begins with their number, the alphabet's size and the ids named."""
    size = -(-len(blocks) // max(1, -(-len(blocks) // LANES)))  # even shares
    return [c for at in range(0, len(blocks), max(1, size)) for c in _encode_lanes(blocks[at : at + size])]


def _encode_lanes(blocks: list[np.ndarray]) -> list[bytes]:
    order, size, still = _by_length([len(b) for b in blocks])
    names, most = np.zeros(0, "<u4"), max(int(b.max(initial=0)) for b in blocks)
    grid = np.zeros((len(still), len(blocks)), np.int64 if most >= 1 << 17 else np.int32)
    for k, i in enumerate(order):
        grid[: size[k], k] = blocks[i]
    if most >= 1 << 17:
        names, ranks = np.unique(grid, return_inverse=True)
        grid, names, most = ranks.reshape(grid.shape), names.astype("<u4"), len(names) - 1
    x = _Lanes(len(blocks), most + 1)
    out, used = np.zeros((len(blocks), 512), "<u4"), np.zeros(len(blocks), np.int64)

    def write(lanes, words):
        nonlocal out
        place = used[lanes]
        if place.max() >= out.shape[1] - 1:
            out = np.concatenate([out, np.zeros_like(out)], axis=1)
        out[lanes, place] = words
        used[lanes] = place + 1

    for step, m in enumerate(still):
        ids = grid[step, :m].astype(np.int64)
        x.predict(m)
        start, width, *came = x.interval(ids)
        x.narrow(m, start, width, write)
        x.learn(m, ids, *came)
    out[np.arange(len(blocks)), used] = x.low + _WORD >> _U32
    done = [b""] * len(blocks)
    for k, i in enumerate(order):
        done[i] = out[k, : used[k] + 1].tobytes()
    done[0] = struct.pack("<III", len(blocks), most + 1, len(names)) + names.tobytes() + done[0]
    return done


def decode_blocks(coded: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of each block; blocks are given as encode_blocks() gave them, all of a call together."""
    result: list = []
    while len(result) < len(coded):
        at = len(result)
        lanes, size, named = struct.unpack_from("<III", coded[at])
        names = np.frombuffer(coded[at], "<u4", named, 12).astype(np.int64)
        result += _decode_lanes([coded[at][12 + 4 * named :], *coded[at + 1 : at + lanes]], sizes[at : at + lanes], size, names)
    return result


def _decode_lanes(coded: list[bytes], sizes: list[int], alphabet: int, names: np.ndarray) -> list[np.ndarray]:
    order, size, still = _by_length(sizes)
    x = _Lanes(len(order), alphabet)
    longest = max(map(len, coded)) // 4 + 2
    data = np.zeros((len(order), longest), "<u4")
    for k, i in enumerate(order):
        data[k, : len(coded[i]) // 4] = np.frombuffer(coded[i], "<u4")
    value, used = data[:, 0].astype(np.uint64) << _U32 | data[:, 1], np.full(len(order), 2)
    grid = np.zeros((len(still), len(order)), np.int32)

    def fetch(lanes, _):
        place = used[lanes]
        value[lanes] = value[lanes] << _U32 | data[lanes, np.minimum(place, longest - 1)]
        used[lanes] = place + 1

    for step, m in enumerate(still):
        x.predict(m)
        ids = x.find(m, value[:m])
        start, width, *came = x.interval(ids)
        x.narrow(m, start, width, fetch)
        x.learn(m, ids, *came)
        grid[step, :m] = ids
    if len(names):
        grid = names.take(grid)
    result: list = [None] * len(coded)
    for k, i in enumerate(order):
        result[i] = grid[: size[k], k]
    return result


class _Words:
    """Where the ids of short words lie, by their bytes: an open hash table of numpy arrays, for many words at a time."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.k1, self.k2, self.place = (np.zeros(1 << bits, k) for k in (np.uint64, np.uint64, np.int64))

    def _slots(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        h = k1 * np.uint64(0x9E3779B97F4A7C15) ^ k2 * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ h >> _U32) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """The places of words, -1 where they are missing. k2 of a word is never 0."""
        out, left, at = np.full(len(k1), -1), np.arange(len(k1)), self._slots(k1, k2)
        while len(left):
            there = self.k2.take(at)
            same = (there == k2) & (self.k1.take(at) == k1)
            out[left[same]] = self.place.take(at[same])
            on = np.flatnonzero(~same & (there != 0))
            left, k1, k2, at = left[on], k1[on], k2[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def put(self, k1: np.ndarray, k2: np.ndarray, place: np.ndarray) -> None:
        """Adds distinct words that are missing."""
        self.n += len(k1)
        if self.n > 3 << self.bits - 2:
            old, more = np.flatnonzero(self.k2), _Words((self.n * 4 // 3).bit_length())
            more.put(self.k1[old], self.k2[old], self.place[old])
            self.bits, self.k1, self.k2, self.place = more.bits, more.k1, more.k2, more.place
        at = self._slots(k1, k2)
        while len(k1):
            free = np.flatnonzero(self.k2.take(at) == 0)
            self.k1[at[free]], self.k2[at[free]], self.place[at[free]] = k1[free], k2[free], place[free]
            on = np.flatnonzero((self.k2.take(at) != k2) | (self.k1.take(at) != k1))  # of words with one slot the last stays
            k1, k2, place, at = k1[on], k2[on], place[on], (at[on] + 1) & ((1 << self.bits) - 1)


#: Masks of a word's first and second eight bytes, by its length; the second's last byte is the length, and one.
_MASK1, _MASK2 = (np.array([(1 << 8 * min(max(n - at, 0), 8)) - 1 for n in range(SLOT_BYTES + 1)], np.uint64) for at in (0, 8))
_SIZE = np.array([n + 1 << 56 for n in range(SLOT_BYTES + 1)], np.uint64)


_ALNUM = np.array([bytes([c]).isalnum() for c in range(256)])


class _Pieces:
    """Ids of text pieces as bytes; the library encodes those that are missing."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        size = self.tok.get_vocab_size(with_added_tokens=True)
        # a character of a token's name stands for one byte, and special tokens are ASCII
        self.bytes_of = np.array([len(self.tok.id_to_token(i) or "") for i in range(size)])
        self.marks = np.full(256, -1)  # ids of marks that are cut from the end of a word
        for c in b".,":
            if len(ids := self.whole(bytes([c]))) == 1:
                self.marks[c] = ids[0]
        self.clear()

    def clear(self) -> None:
        """Forgets all words. Ids lie one word's behind the other's; a place is where they begin, shifted by 32 bits, and how many they are."""
        self.short = _Words()
        self.long: dict[bytes, int] = {}  # words after a blank that no slot holds
        self.first: dict[bytes, int] = {}  # texts up to their first blank
        self.ids, self.end = np.zeros(1 << 16, np.int32), 0

    def add(self, ids: np.ndarray) -> int:
        """Where ids begin that are put behind the others."""
        at, self.end = self.end, self.end + len(ids)
        if self.end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.int32)])
        self.ids[at : self.end] = ids
        return at

    def learn(self, words: list[bytes]) -> np.ndarray:
        """Places of words after a blank that are new."""
        return np.concatenate([self._learn(words[i : i + 128]) for i in range(0, len(words), 128)])

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """Encodes words in one text; where a word doesn't end at a token's end, each alone."""
        text = "".join([" " + w.decode("utf-8", "replace") for w in words])
        ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        ends, want = np.cumsum(self.bytes_of[ids]), np.cumsum([len(w) + 1 for w in words])
        at = np.searchsorted(ends, want)
        if b"" in words or not len(ids) or ends[-1] != want[-1] or (ends[at] != want).any():
            each = [e.ids for e in self.tok.encode_batch_fast([" " + w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
            ids, at = np.concatenate(each).astype(np.int32), np.cumsum([len(e) for e in each]) - 1
        cut = np.concatenate([[0], at + 1])
        return (self.add(ids) + cut[:-1] << 32) | np.diff(cut)

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tok.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of whole texts as 32-bit integers.

        A pre-token of the file's pattern begins at a blank between marks, so texts are cut there and each piece is
        encoded once; texts with two blanks, a blank before other white space, or rarer white space go to the library whole.
        A full stop or comma between an ASCII letter or digit and a blank is a pre-token of its own.
        """
        joined = b".".join(texts)
        data = np.frombuffer(joined, np.uint8)
        after = data.take(np.flatnonzero(data[:-1] == 32) + 1)
        doubtful = ((after == 32) | (after - np.uint8(9) < 5)).any() or any(x in joined for x in _UNCUT if x[0] != 32)
        odd = {i for i, t in enumerate(texts) if any(x in t for x in _UNCUT)} if doubtful else set()
        cut = [i for i in range(len(texts)) if i not in odd]
        out = {i: self.whole(texts[i]) for i in odd} | dict(zip(cut, self._cut([texts[i] for i in cut]) if cut else []))
        return [out[i] for i in range(len(texts))]

    def _cut(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts that can be cut at every blank."""
        if self.short.n + len(self.long) + len(self.first) > CACHE_WORDS or self.end > 16 * CACHE_WORDS:
            self.clear()
        raw = b" ".join(texts) + b" "
        data = np.frombuffer(raw, np.uint8)
        ends = np.flatnonzero(data == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        heads = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]))
        mark = self.marks.take(data.take(ends - 1))
        mark[(ends - starts < 2) | ~_ALNUM.take(data.take(np.maximum(ends - 2, 0)))] = -1
        mark[heads] = -1
        marked = np.flatnonzero(mark >= 0)
        ends[marked] -= 1
        sizes, place = ends - starts, np.full(len(starts), -1)
        is_short = sizes <= SLOT_BYTES
        is_short[heads] = False
        for i in heads.tolist():
            w = raw[starts[i] : ends[i]]
            if w not in self.first:
                ids = self.whole(w)
                self.first[w] = self.add(ids) << 32 | len(ids)
            place[i] = self.first[w]

        at = np.flatnonzero(is_short)
        eight = np.ndarray(len(raw) + 9, "<u8", raw + bytes(16), strides=(1,))  # from each byte on
        k1 = eight[starts[at]] & _MASK1.take(sizes[at])
        k2 = eight[starts[at] + 8] & _MASK2.take(sizes[at]) | _SIZE.take(sizes[at])
        got = self.short.get(k1, k2)
        if len(new := np.flatnonzero(got < 0)):
            words = {raw[a:b]: i for a, b, i in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), new.tolist())}
            one = np.array(list(words.values()))  # where each of them stands
            self.short.put(k1[one], k2[one], self.learn(list(words)))
            got[new] = self.short.get(k1[new], k2[new])
        place[at] = got

        is_short[heads] = True
        at = np.flatnonzero(~is_short)
        words = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        if missing := list(set(words).difference(self.long)):
            self.long.update(zip(missing, self.learn(missing).tolist()))
        place[at] = [self.long[w] for w in words]

        n = (place & int(_WORD)) + (mark >= 0)
        stop = np.cumsum(n)
        flat = self.ids.take(np.repeat((place >> 32) - stop + n, n) + np.arange(stop[-1]), mode="clip")
        flat[stop[marked] - 1] = mark[marked]
        for known, words in ((self.long, missing), (self.first, [raw[starts[i] : ends[i]] for i in heads.tolist()])):
            for w in words:
                if len(w) > CACHE_BYTES:
                    known.pop(w, None)
        return np.split(flat, (stop - n)[heads[1:]])


@functools.cache
def _pieces(path: str) -> _Pieces:
    return _Pieces(located(path))


def _chunk(part: int, docs: list[tuple[int | None, np.ndarray]], seq: int, before: int) -> pa.RecordBatch:
    """A chunk of whole documents; its blocks are coded side by side."""
    ids = np.concatenate([i for _, i in docs])
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    coded = [{"n": len(b), "crc": zlib.crc32(b.astype("<i4").tobytes()), "payload": c} for b, c in zip(blocks, encode_blocks(blocks))]
    return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "ids_before": before, "n_ids": len(ids), "doc_ids": [d for d, _ in docs], "lengths": [len(i) for _, i in docs], "blocks": coded}], _ARROW)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text: str = "text") -> None:
    """Writes the chunks of docs in ascending id order to a folder that Spark can write."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n, seq, before = TaskContext.get().partitionId(), [], 0, 0, 0
        pieces = _pieces(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                b = whole.slice(at, TEXTS)
                for d, ids in zip(b["id"].to_pylist(), pieces.encode([t or b"" for t in b["text"].cast(pa.binary()).to_pylist()])):
                    held.append((d, np.append(ids, np.int32(end_id))))
                    n += len(ids) + 1
                    if n >= CHUNK_IDS:
                        yield _chunk(part, held, seq, before)
                        held, n, seq, before = [], 0, seq + 1, before + n
        if held:
            yield _chunk(part, held, seq, before)

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // PART_BYTES))  # tasks follow the size of the texts
    rows.repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h").mapInArrow(coded, CHUNK).write.parquet(path)


def read(spark: SparkSession, path: str, more: dict[str, tuple[str, Callable]] | None = None) -> DataFrame:
    """(doc_id, start, ids): every document's ids, read back from the blocks after their checksums; start: the ids of all documents before it.

    more: further columns by name, each a type and a function that gives an Arrow array for many documents: of their ids, one
    document's behind the other's, and where each begins and the last one ends. It runs in the worker that decodes.
    """
    more = more or {}

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):
                (r,) = whole.slice(k, 1).to_pylist()
                ids = [i.astype("<i4") for i in decode_blocks([x["payload"] for x in r["blocks"]], [x["n"] for x in r["blocks"]])]
                if any(zlib.crc32(i.tobytes()) != x["crc"] for x, i in zip(r["blocks"], ids)):
                    raise ValueError(f"wrong checksum in part {r['part']}, chunk {r['seq']}")
                flat, ends = np.concatenate(ids).astype(np.int32, copy=False), np.concatenate([[0], np.cumsum(r["lengths"])])
                for at in range(0, len(ends) - 1, TEXTS):
                    cut = ends[at : at + TEXTS + 1]
                    some, own = flat[cut[0] : cut[-1]], (cut - cut[0]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"][at : at + TEXTS], pa.int64()), pa.array(r["before"] + r["ids_before"] + cut[:-1]), pa.ListArray.from_arrays(pa.array(own), pa.array(some)), *(f(some, own) for _, f in more.values())], ["doc_id", "start", "ids", *more])

    bounded_batches(spark)
    chunks = spark.read.parquet(path)
    sums = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each written partition, so few that they are broadcast
    before = sums.select(F.col("part").alias("part_"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return chunks.join(F.broadcast(before), F.col("part") == F.col("part_")).drop("part_").mapInArrow(decoded, "doc_id long, start long, ids array<int>" + "".join(f", `{k}` {t}" for k, (t, _) in more.items()))


def store(docs: DataFrame, tokenizer: str, end_id: int, more: dict[str, tuple[str, Callable]] | None = None, **names) -> DataFrame:
    """write() to a new shared folder and read() from it."""
    path = scratch(docs.sparkSession, "token-files")
    write(docs, path, tokenizer, end_id, **names)
    return read(docs.sparkSession, path, more)
