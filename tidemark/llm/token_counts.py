"""Token counts by dynamic programming shared in a trie (operator 4).

A unigram model gives every piece of a public vocabulary a log probability by its rank (Zipf's law over the file's
order, in whole millionths, so that sums are exact). Distinct pre-tokens (a blank mark and a word) are inserted in a
trie; a node keeps the best forward score of its prefix and the tokens it takes, computed once from its ancestors, so
words with a common prefix share it. A terminal node's count is the word's. A character that no piece covers falls back
to its UTF-8 bytes. Of equal scores the one with fewer tokens counts.

A worker keeps one trie for all its batches, cut down to nothing when it exceeds NODES, so memory is bounded; the count
of a word never depends on it. Texts of any length are read whole. A word of more than ROLLED_BYTES bytes stays out of the
trie: its forward scores roll over as many places as the longest piece has, so a text without blanks needs no more.

Rows: null and empty texts have no words, no tokens and score 0; repeated rows get equal counts; other columns pass through.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, located, small_batches

NODES, CACHE_WORDS, CACHE_BYTES, ROLLED_BYTES, SCALE = 400_000, 400_000, 64, 4096, 1_000_000
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("score", T.LongType())])


def zipf(pieces: list[str]) -> dict[str, int]:
    """Log probabilities of pieces in rank order, in millionths."""
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {p: round(-SCALE * (math.log(r + 1) + total)) for r, p in reversed(list(enumerate(pieces)))}


class TrieCounter:
    """The trie over pre-tokens. A node: its children by character, at 0 the best score and at 1 the tokens of its prefix."""

    def __init__(self, scores: dict[str, int], byte_score: int):
        self.scores, self.byte_score = scores, byte_score
        self.endings: dict = {}  # pieces from their last character to the first; the score of a whole piece at None
        for p, s in scores.items():
            node = self.endings
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[None] = s
        self.longest = max(map(len, scores), default=1)
        self.root: dict = {0: 0, 1: 0}
        self.nodes = 0
        self.known: dict[bytes, tuple[int, int]] = {}

    def insert(self, word: str) -> tuple[int, int]:
        """(score, tokens) at the word's terminal node."""
        if self.nodes > NODES:
            self.root, self.nodes = {0: 0, 1: 0}, 0
        node, path = self.root, [self.root]
        for c in word:
            if (node := node.get(c)) is None:
                break
            path.append(node)
        for i in range(len(path), len(word) + 1):
            node = path[-1][word[i - 1]] = self._node(word, i, path)
            path.append(node)
            self.nodes += 1
        return path[-1][0], path[-1][1]

    def rolled(self, word: str) -> tuple[int, int]:
        """What insert() gives, from the last places only."""
        size, endings, byte_score = self.longest + 1, self.endings, self.byte_score
        scores, counts = [0] * size, [0] * size
        for i, c in enumerate(word, 1):
            n = 1 if c < "\x80" else len(c.encode("utf-8", "replace"))
            score, tokens = scores[(i - 1) % size] + n * byte_score, counts[(i - 1) % size] + n
            ending, j = endings, i
            while j:
                j -= 1
                if (ending := ending.get(word[j])) is None:
                    break
                if (s := ending.get(None)) is not None:
                    new, k = scores[j % size] + s, counts[j % size] + 1
                    if new > score or (new == score and k < tokens):
                        score, tokens = new, k
            scores[i % size], counts[i % size] = score, tokens
        return scores[len(word) % size], counts[len(word) % size]

    def _node(self, word: str, i: int, path: list) -> dict:
        """The node of the word's first i characters, from its ancestors: pieces that end here are read backwards."""
        c, last = word[i - 1], path[i - 1]
        n = 1 if c < "\x80" else len(c.encode("utf-8", "replace"))
        score, tokens = last[0] + n * self.byte_score, last[1] + n
        ending, j = self.endings, i
        while j:
            j -= 1
            if (ending := ending.get(word[j])) is None:
                break
            if (s := ending.get(None)) is not None:
                new, k = path[j][0] + s, path[j][1] + 1
                if new > score or (new == score and k < tokens):
                    score, tokens = new, k
        return {0: score, 1: tokens}

    def count(self, text: bytes) -> tuple[int, int, int]:
        """(words, tokens, score) of a whole text."""
        words = text.split()
        known = self.known
        for w in set(words).difference(known):
            known[w] = (self.insert if len(w) <= ROLLED_BYTES else self.rolled)("▁" + w.decode("utf-8", "replace"))
        got = list(map(known.__getitem__, words))
        tokens, score = sum([t for _, t in got]), sum([s for s, _ in got])
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in [w for w in set(words) if len(w) > CACHE_BYTES]:
            known.pop(w, None)
        return len(words), tokens, score


@functools.cache
def counter(path: str) -> TrieCounter:
    """A worker's trie over the pieces of a public vocabulary; bytes share the probability of the least piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=located(path))
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    scores = zipf([sp.id_to_piece(i) for i in sorted(ids, key=lambda i: -sp.get_score(i))])
    return TrieCounter(scores, min(scores.values()))


def count_tokens(docs: DataFrame, path: str, text: str = "text", names: tuple[str, str, str] = ("n_words", "n_tokens", "score")) -> DataFrame:
    """docs with the words of each whole text, its tokens and its log probability in millionths. Names that docs have are led by an underscore."""

    @F.arrow_udf(RESULT)
    def counted(texts: pa.Array) -> pa.Array:
        own = counter(path)
        rows = np.array([own.count(t or b"") for t in texts.cast(pa.binary()).to_pylist()], np.int64).reshape(-1, 3)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)], ["n_words", "n_tokens", "score"])

    small_batches(docs.sparkSession)
    names = tuple(fresh(docs.columns, *names))
    (tmp,) = fresh([*docs.columns, *names], "counted")
    out = docs.withColumn(tmp, counted(F.col(f"`{text}`").cast("string")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(f"{tmp}.{a}").alias(b) for a, b in zip(("n_words", "n_tokens", "score"), names)))
