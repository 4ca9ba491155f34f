"""BPE encoding and decoding by a tokenization automaton (operator 5).

The merges are compiled, one gadget after another, into a deterministic automaton over tokens that accepts exactly the
token sequences the merges yield. The gadget of merge (u, v) -> w copies the state that u leads to, takes v away from
the copy, lets u lead to the copy instead, and lets w lead where v led. So a state is the number of the merge that made
it (0: the first state, which lets everything pass), and what a state lets pass follows from the gadgets; each table
entry is filled when a word first asks for it. Encoding walks a pre-split word from left to right: a second table, over
bytes, tells which labels end at a place, and the one arc that leads there is found among them, as every prefix of a word
has exactly one path. Decoding emits the arcs' labels.

Rows: a null text counts as empty; an empty text gives no ids and an empty decoded text; repeated rows give repeated
results; other columns pass through untouched, and where they bear the names of results, those are led by an underscore.
A worker holds a batch of texts (see small_batches) or one longer text.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, located, small_batches

#: Words that a worker remembers before it starts afresh, and the longest it remembers.
CACHE_WORDS, CACHE_BYTES = 250_000, 64
_ODD_SPACE = re.compile("[" + "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]")
RESULT = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])


class MergeAutomaton:
    """The automaton of a list of merges: base tokens, merges as (u, v, w) in rank order, all as ids."""

    def __init__(self, base: list[int], merges: list[tuple[int, int, int]]):
        n = 1 + max([*base, *(w for _, _, w in merges)], default=0)
        self.born = [-1] * n  # the merge that makes a token; 0 for base tokens
        self.first = [0] * n  # where a token led when it was made
        self.own: list[list[int]] = [[] for _ in range(n)]  # states made for a token, in order
        self.left, self.owner = [0] * n, [0] * (len(merges) + 1)
        self.cut: dict[int, int] = {}  # u << 32 | v -> the merge that takes v away after u
        self.arcs: dict[int, int] = {}  # state << 32 | token -> next state, or -1
        for t in base:
            self.born[t] = 0
        for k, (u, v, w) in enumerate(merges, 1):
            self._gadget(k, u, v, w)
        self.arcs.clear()  # what was asked while merges were missing

    def state(self, token: int) -> int:
        """Where a token leads now."""
        return self.own[token][-1] if self.own[token] else self.first[token]

    def _gadget(self, k: int, u: int, v: int, w: int) -> None:
        if self.born[u] < 0 or self.born[v] < 0 or not self.passes(self.state(u), v):
            return  # u and v never meet, so w never arises
        self.born[w], self.left[w], self.first[w] = k, u, self.state(v)
        self.own[u].append(k)
        self.owner[k] = u
        self.cut[u << 32 | v] = k

    def passes(self, state: int, token: int) -> bool:
        """Whether a state lets a token pass: taken away by a later gadget, or else as its left part passed when it was made."""
        while (born := self.born[token]) >= 0:
            while state > born:
                u = self.owner[state]
                if born < self.cut.get(u << 32 | token, -1) <= state:
                    return False
                i = bisect_right(self.own[u], born)
                state = self.own[u][i - 1] if i else self.first[u]
            if not born:
                return True
            token = self.left[token]
        return False

    def step(self, state: int, token: int) -> int:
        """The table entry: the next state, or -1."""
        key = state << 32 | token
        if (to := self.arcs.get(key)) is None:
            to = self.arcs[key] = self.state(token) if self.passes(state, token) else -1
        return to


class Labels:
    """The arcs' labels that end at a place of a word, by a table over bytes (the labels' trie with links to longest proper suffixes); entries are filled when asked for."""

    def __init__(self, labels: list[tuple[bytes, int, bool]]):
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        self.suffix, owns = [0], [([], [])]
        for name, token, last in labels:
            node = 0
            for c in name:
                if (to := self.child.get(node << 8 | c)) is None:
                    to = self.child[node << 8 | c] = len(owns)
                    owns.append(([], []))
                    self.suffix.append(0)
                node = to
            owns[node][last].append((token, len(name)))
        self.go = _Table(self._go)
        below: dict[int, list[tuple[int, int]]] = {}
        for k, to in self.child.items():
            below.setdefault(k >> 8, []).append((k & 255, to))
        level = [(0, c, to) for c, to in below.get(0, ())]
        self.plain, self.last = [()] * len(owns), [()] * len(owns)
        while level:  # by length, so suffixes are ready
            deeper = []
            for node, c, to in level:
                self.suffix[to] = self.go[self.suffix[node] << 8 | c] if node else 0
                self.plain[to] = (*owns[to][0], *self.plain[self.suffix[to]])
                self.last[to] = (*owns[to][1], *self.last[self.suffix[to]])
                deeper += [(to, d, x) for d, x in below.get(to, ())]
            level = deeper

    def _go(self, key: int) -> int:
        node, c = key >> 8, key & 255
        while (to := self.child.get(node << 8 | c)) is None and node:
            node = self.suffix[node]
        return to or 0


class _Table(dict):
    """A table whose entries are worked out when first asked for."""

    def __init__(self, f):
        super().__init__()
        self.f = f

    def __missing__(self, key: int) -> int:
        out = self[key] = self.f(key)
        return out


class BpeCodec:
    """Encodes and decodes as the tokenizers library does for a file of byte-level BPE with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, self.end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = {a + b for a, b in pairs}
        self.labels = {i: s for s, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        base = [i for s, i in vocab.items() if s not in made]
        self.automaton = MergeAutomaton(base, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cutter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        tok = Tokenizer.from_file(path)
        self.normalizer, self.splitter = tok.normalizer, tok.pre_tokenizer
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        symbols = [chr(c) for c in [*range(33, 127), *range(161, 173), *range(174, 256)]]
        there = {ord(c) for c in symbols}
        self.byte_of = {c: ord(c) for c in symbols} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in there)}
        self.labelled = Labels([(bytes(map(self.byte_of.__getitem__, s[: len(s) - len(self.end)] if self._last(s) else s)), i, self._last(s)) for s, i in vocab.items()])
        self.spaced = {i: (label + " ").encode() for i, label in self.labels.items()}
        self.words: dict[bytes, list[int]] = {}
        self.chunks = _Memo(self._chunk)

    def _last(self, label: str) -> bool:
        return bool(self.end) and label.endswith(self.end)

    def word(self, word: bytes) -> list[int]:
        """Ids of one pre-split word."""
        if (known := self.words.get(word)) is None:
            known = self._path(word)
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            if len(word) <= CACHE_BYTES:
                self.words[word] = known
        return known

    def _path(self, word: bytes) -> list[int]:
        """The automaton's path for a word: one arc only leads to each place, so the labels that end there are tried from the longest on."""
        n, arcs, go, plain = len(word), self.automaton.arcs, self.labelled.go, self.labelled.plain
        state, back, node, at = [0] * (n + 1), [(0, 0)] * (n + 1), 0, 0
        for byte in word:
            at += 1
            node = go[node << 8 | byte]
            for token, size in plain[node] if at < n or not self.end else self.labelled.last[node]:
                key = state[at - size] << 32 | token
                if (to := arcs.get(key)) is None:
                    to = self.automaton.step(state[at - size], token)
                if to >= 0:
                    state[at], back[at] = to, (at - size, token)
                    break
            else:
                raise ValueError(f"no path for {word[:40]!r}")
        out = []
        while at:
            at, token = back[at]
            out.append(token)
        out.reverse()
        return out

    def split(self, text: str) -> list[bytes]:
        """Normalised pre-split words."""
        if text.isascii() and not _ODD_SPACE.search(text):
            return [w.encode() for w in self.pattern.findall(text.lower())]
        if max(text) < "\u0250" and not _ODD_SPACE.search(text):
            return [w.encode() for w in self.pattern.findall(unicodedata.normalize("NFC", text).lower())]
        return [bytes(self.byte_of[c] for c in w) for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.cutter.split(text) if self.cutter else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for w in self.split(part):
                    out += self.word(w)
        return out

    def decode(self, ids) -> str:
        """Labels of the arcs, joined as the library does without a decoder."""
        return " ".join([self.labels[int(i)] for i in ids])

    def _chunk(self, chunk: bytes) -> tuple[bytes, bytes]:
        if chunk.isalpha():  # ASCII letters only: one word
            ids = self._path(chunk) if chunk.islower() else self.word(chunk.lower())
        else:
            ids = self.encode(chunk.decode("utf-8", "replace"))
        return array("i", ids).tobytes(), b"".join([self.spaced[i] for i in ids])

    def document(self, text: bytes) -> tuple[bytes, bytes]:
        """Ids as 32-bit integers, and the decoded text. No word crosses white space, so white space cuts the work."""
        got = list(map(self.chunks.__getitem__, text.split()))
        return b"".join([x for x, _ in got]), b"".join([y for _, y in got])[:-1]


class _Memo(dict):
    """Remembers a function of short byte strings, up to a bound."""

    def __init__(self, f):
        super().__init__()
        self.f = f

    def __missing__(self, key: bytes):
        out = self.f(key)
        if len(key) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[key] = out
        return out


@functools.cache
def codec(path: str) -> BpeCodec:
    """One compiled automaton for each worker and file."""
    return BpeCodec(located(path))


def encode_decode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with two more columns: the ids (array of int) and the text decoded from them, their names led by _ where docs have them."""

    @F.arrow_udf(RESULT)
    def coded(texts: pa.Array) -> pa.Array:
        own = codec(path)
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        got = [own.document(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
        ends = np.cumsum([0] + [len(a) // 4 for a, _ in got])
        values = pa.array(np.frombuffer(b"".join([a for a, _ in got]), "<i4"), pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        return pa.StructArray.from_arrays([lists, pa.array([b for _, b in got], pa.binary()).cast(pa.string())], ["ids", "decoded"])

    small_batches(docs.sparkSession)
    taken, (ids, decoded) = docs.columns, fresh(docs.columns, ids, decoded)
    (tmp,) = fresh([*taken, ids, decoded], "coded")
    out = docs.withColumn(tmp, coded(F.col(f"`{text}`").cast("string")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(f"{tmp}.ids").alias(ids), F.col(f"{tmp}.decoded").alias(decoded))
