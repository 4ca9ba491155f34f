"""Words without an end: what they cost and that they count as short ones do."""

import random
import resource

import pytest

from tidemark.llm import token_counts


@pytest.fixture(scope="module")
def counter():
    return token_counts.counter("piece_bpe_32k.model")


def test_rolled_scores_equal_the_tries(counter):
    rng = random.Random(6)
    words = ["▁" + "".join(rng.choices(alphabet, k=rng.randint(0, 300))) for alphabet in ("etaoin shr", "ab", "aé你👍", "0123456789_-") for _ in range(25)]
    assert [counter.rolled(w) for w in words] == [counter.insert(w) for w in words]


def test_an_unbroken_word_of_ten_megabytes(counter):
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    words, tokens, score = counter.count(b"abcdefgh" * 1_250_000)
    assert words == 1 and 0 < tokens < 10_000_000 and score < 0
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # kilobytes
    one, two = counter.count(b"x" * 5000), counter.count(b"x" * 5000 + b" " + b"x" * 5000)
    assert two == (2, 2 * one[1], 2 * one[2])
