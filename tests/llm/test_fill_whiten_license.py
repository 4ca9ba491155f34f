import decimal
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF
from tests.llm.helpers import LONG, ROWS, awkward, empty
from tidemark.llm import fill_in_middle as FIM
from tidemark.llm import licenses as LI
from tidemark.llm import queries
from tidemark.llm import whitening as W

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain_cut(text, h1, h2):
    tokens = TOKEN.findall(text)
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    return len(tokens), "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.text(max_size=700), st.text("aZ é你\n<P>", max_size=1500)), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), max_size=8))
def test_cuts_by_definition(rows):
    rows = [(t.encode("utf-8", "ignore").decode(), x, y) for t, x, y in rows]
    got = FIM.cut(pa.array([t for t, _, _ in rows], pa.string()).cast(pa.binary()), *(np.array([r[k] for r in rows], np.int64) for k in (1, 2)))
    for (t, x, y), g in zip(rows, got):
        n, p, m, _ = plain_cut(t, x, y)
        assert tuple(g) == (n, len(p.encode()), len((p + m).encode()), len(p), len(m))


@pytest.mark.parametrize("share", [0.0, 0.001, 0.5, 1.0])
def test_rank_and_select(share):
    bits = np.random.default_rng(3).random(5000) < share
    v = FIM.BitVector(np.packbits(bits, bitorder="little"))
    at = np.arange(5001)
    assert (v.rank(at) == np.concatenate([[0], np.cumsum(bits)])).all()
    ones = np.flatnonzero(bits)
    assert (v.select(np.arange(len(ones))) == ones).all()


def test_long_texts_are_cut_whole():
    """Pieces meet inside letters and inside characters; an unbroken word of 3 MB is one token."""
    for text in ("a" * 3_000_001, "é你x" * 700_001, "ab c" * 600_001):
        n, p, m, _ = plain_cut(text, 2**31 + 7, 12345)
        got = FIM.cut(pa.array(["x", text, "y"]).cast(pa.binary()), np.full(3, 2**31 + 7), np.full(3, 12345))[1]
        assert tuple(got) == (n, len(p.encode()), len((p + m).encode()), len(p), len(m))


def test_fill_in_middle_rows(spark):
    extra = [(20 + i, f"some {m} text", "en", "a", 1) for i, m in enumerate(("<P>", "<S>", "<M>"))] + [(40 + i, "ends with < and <S and >P> é" * (i % 3 + 1), "en", "a", 1) for i in range(40)]
    docs = awkward(spark).unionByName(spark.createDataFrame(extra, awkward(spark).schema))
    rows = FIM.restore(FIM.transform(docs)).collect()
    assert len(rows) == len(ROWS) + len(extra) and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        text = r.text or ""
        d = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(d[k : k + 8], 16) for k in (0, 8, 16, 24))
        n, p, m, s = plain_cut(text, h1, h2)
        plain = not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90
        form = "plain" if plain else "spm" if h4 % 100 < 20 else "psm"
        want = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r.n, r.form, r.output, r.restored) == (n, form, want, text)
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if plain else (len(p), len(m)))
    clash = FIM.restore(FIM.transform(awkward(spark, ["N", "form", "output", "whole", "cuts", "kind", "restored"])), "_output", "_form")
    assert clash.columns[-6:] == ["_n", "_form", "prefix_chars", "middle_chars", "_output", "_restored"] and clash.where("_restored = coalesce(text, '')").count() == len(ROWS)
    assert FIM.transform(empty(spark)).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_whitening_by_definition(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    own = {r.vec_id: np.array(r.embedding, float) for r in rows if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)}
    x = np.floor(1024 * np.array(list(own.values()))).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    cov = centred.T @ centred / n
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1], vecs[:, ::-1]
    want = centred @ vecs[:, :8] / np.sqrt(values[:8])
    got = queries.op12_whitening(spark, sf).collect()
    assert len(got) == 8 * n and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    by = {(r.vec_id, r.component): r for r in got}
    signs = [np.sign(by[next(iter(own)), k + 1].whitened * want[0, k]) for k in range(8)]
    for i, v in enumerate(own):
        for k in range(8):
            r = by[v, k + 1]
            assert r.n == n and r.deviation == int(((n * x[i] - s).astype(object) ** 2).sum())
            assert r.whitened == pytest.approx(signs[k] * want[i, k], abs=1e-7) and r.explained == pytest.approx(values[k] / np.trace(cov), rel=1e-9)


def test_whitening_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=3).tolist()) for i in range(30)]
    bad = [(100, None), (101, []), (102, [nan, 0.0, 1.0]), (103, [inf, 0.0, 1.0]), (104, [None, 0.0, 1.0]), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0])]
    df = vectors(spark, [*good, good[0], (None, [0.1, 0.2, 0.3]), *bad])
    model = W.fit(df)
    assert model.n == 32 and len(model.values) == 3 and sum(model.explained) == pytest.approx(1) and W.identity_error(df, model) < 1e-9
    out = W.transform(df, model)
    assert out.count() == 32 and out.where("vec_id is null").count() == 1 and out.where("vec_id >= 100").count() == 0
    clash = W.transform(df.selectExpr("*", "'x' as whitened", "'y' as found"), model)
    assert clash.columns == ["vec_id", "embedding", "whitened", "found", "deviation", "_whitened"]
    none = W.fit(df.limit(0))
    assert none.n == 0 and none.explained == [] and W.transform(df, none).count() == 0 and W.identity_error(df, none) is None
    for rows in ([(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]):
        flat = vectors(spark, rows)
        model = W.fit(flat)
        assert model.n == len(rows) and len(model.values) == 0 and {(r.deviation, tuple(r.whitened)) for r in W.transform(flat, model).collect()} == {(0, ())}
    wide = vectors(spark, [(i, [float(i % 3 == k) for k in range(3)]) for i in range(9)])
    assert len(W.fit(wide).values) == 2  # entries sum to one: a direction without variance
    large = vectors(spark, [(i, [1e9 * (i % 2), -1e9]) for i in range(40)])
    got = {r.deviation for r in W.transform(large, W.fit(large)).collect()}
    x = [1024 * 10**9 * (i % 2) + 100_000 for i in range(40)]
    assert got == {decimal.Decimal((40 * v - sum(x)) ** 2) for v in x}


def test_partial_moments_merge():
    z = np.random.default_rng(7).normal(size=(100, 4)) + 1e6
    parts = [z[:1], z[1:40], z[40:]]
    held = None
    for p in parts:
        mean = p.mean(axis=0)
        held = W.merged(held, (len(p), mean, (p - mean).T @ (p - mean)))
    assert held[0] == 100 and np.allclose(held[1], z.mean(axis=0)) and np.allclose(held[2] / 100, np.cov(z.T, bias=True), rtol=1e-6)


def plain_blocks(text, templates, threshold=(4, 5)):
    """Every window of every size against every template."""
    words = [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))]
    out = set()
    for no, (label, t) in enumerate(templates):
        own = LI.words_of(t)
        size, need = LI.class_of(len(own)), {w.decode() for w in own}
        for k in range(0, max(len(words), 1), size):
            common = len(need & set(words[k : k + 2 * size]))
            if need and threshold[1] * common >= threshold[0] * len(need):
                out.add((label, no, k, min(2 * size, len(words) - k), common / len(need)))
    return len(words), out


def test_blocks_by_definition(spark):
    rng = random.Random(4)
    pool = "a b c d e f g h i j k".split()
    templates = [(f"t{i}", " ".join(rng.choices(pool, k=rng.choice([1, 3, 5, 9, 17, 40])))) for i in range(25)]
    texts = [" ".join(rng.choices(pool + ["x", "y"], k=rng.randint(0, 120))) for _ in range(120)] + [None, "", LONG, "the MIT license " * 3000, "x" * 2_000_000 + " a b c"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    for threshold in ((4, 5), (1, 2), (1, 1)):
        for r in LI.scan(docs, templates, [], threshold).collect():
            n, want = plain_blocks(r.text or "", templates, threshold)
            assert r.n_words == n and {tuple(b) for b in r.blocks} == want and len(r.blocks) == len(want) and r.places == []


def test_rounds_of_templates_find_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    key = lambda rows: sorted((r.doc_id, r.n_words, sorted(map(tuple, r.places)), sorted(map(tuple, r.blocks))) for r in rows)
    whole = key(LI.scan(docs).collect())
    monkeypatch.setattr(LI, "MAX_WORDS", 60)
    assert len(LI._rounds([(0, "", [b"w"] * 50)] * 3)) == 3 and key(LI.scan(docs).collect()) == whole and any(r[3] for r in whole)


def test_licenses_rows(spark):
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, "UNDER the mit-license, under the MIT license under the mit license"), (3, "Apache License (Version 2)"), (4, "cc by nc cc BY-NC"), (5, "This work is licensed under the GNU General Public License, version 3."), (6, "a license to kill under the sea, version 2 of the film"), (7, None), (8, "under the mıt license"), (9, "under the mit licenseé")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    found = {r.doc_id: r for r in LI.scan(docs).collect()}
    places = {i: sorted((p.label, p.word) for p in r.places) for i, r in found.items() if r.places}
    assert places == {1: [("mit", 2)], 2: [("mit", 0), ("mit", 4), ("mit", 8)], 3: [("apache-2", 0)], 4: [("cc-by-nc", 0), ("cc-by-nc", 3)]}
    assert {b.label for b in found[5].blocks} >= {"gpl-3"} and not any(found[i].blocks for i in (6, 7, 8, 9))
    out = LI.scan(awkward(spark, ["N_words", "places", "blocks", "scanned"]))
    assert out.columns[-3:] == ["_n_words", "_places", "_blocks"] and out.count() == len(ROWS) and LI.scan(empty(spark)).count() == 0
    assert LI.scan(docs, [], []).where("size(places) + size(blocks) > 0").count() == 0
    assert LI.scan(docs, [("none", "... !")], [("none", "")]).where("size(places) + size(blocks) > 0").count() == 0
    with pytest.raises(ValueError):
        LI.scan(docs, threshold=(0, 1))


def test_frequencies_cover_all_texts(spark):
    docs = spark.createDataFrame([("a b B c",), ("b",), (None,)] * 50, "text string").repartition(7)
    assert LI.frequencies(docs, [b"a", b"b", b"z"]) == {b"a": 50, b"b": 150}
