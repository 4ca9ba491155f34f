import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import ROWS, awkward, empty
from tidemark.llm import bpe_automaton as B

PATH = "/opt/tokenizers/word_bpe_49k.json"
TOK, CODEC = Tokenizer.from_file(PATH), B.BpeCodec(PATH)


def same(text):
    ids, out = CODEC.document(text.encode())
    want = TOK.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<i4").tolist() == want
    assert out.decode() == TOK.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abehilnorst'd .,\n1", max_size=80), st.lists(st.sampled_from(["the", "The", "don't", "aaaa", "abab", "<|endoftext|>", "É", "ß", "ΑΣ", " ", " ", "12", "…"]), max_size=12).map("".join)))
def test_equals_the_library(text):
    same(text)


def test_automaton_on_random_merges():
    """Brute force: apply merges by rank, against the automaton's only path."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        names, merges = ["a", "b", "c"], []
        while len(merges) < 12:
            u, v = rng.integers(0, len(names), 2)
            if names[u] + names[v] not in names:
                names.append(names[u] + names[v])
                merges.append((int(u), int(v), len(names) - 1))
        auto = B.MergeAutomaton([0, 1, 2], merges)
        for _ in range(30):
            word = "".join(rng.choice(list("abc"), rng.integers(1, 14)))
            ids = ["abc".index(c) for c in word]
            for u, v, w in merges:
                out, i = [], 0
                while i < len(ids):
                    if ids[i : i + 2] == [u, v]:
                        out.append(w)
                        i += 2
                    else:
                        out.append(ids[i])
                        i += 1
                ids = out
            reach = {0: [(0, [])]}
            for i in range(len(word)):
                for state, path in reach.get(i, []):
                    for t, name in enumerate(names):
                        if word.startswith(name, i) and auto.born[t] >= 0 and (to := auto.step(state, t)) >= 0:
                            reach.setdefault(i + len(name), []).append((to, [*path, t]))
            assert [p for _, p in reach[len(word)]] == [ids]


def test_operator_on_awkward_rows(spark):
    out = B.encode_decode(awkward(spark, ["coded"]), PATH).collect()
    assert len(out) == len(ROWS)
    for r in out:
        want = TOK.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == TOK.decode(want, skip_special_tokens=False) and r.coded == "x"
    assert B.encode_decode(empty(spark), PATH).count() == 0
