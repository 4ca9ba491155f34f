import numpy as np
import xxhash

from tests.llm.helpers import ROWS, awkward, empty
from tidemark.llm import embeddings as E
from tidemark.llm import simhash as S
from tidemark.llm.shared import connected_components


def groups(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def plain_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    ones = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if k in got} and all(k in got for e in edges for k in e if e[0] != e[1])


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (300, 8)).astype(np.uint8)
    x[100:200] = x[:100]
    x[100:200, 0] ^= 5
    x[150:200, 1] ^= 1
    d = np.unpackbits(x[:, None] ^ x[None], axis=2).sum(axis=2)
    for radius in (0, 1, 2, 3, 9):
        q, m = S.within(x, S.planes(x), len(x), radius)
        assert set(zip(q.tolist(), m.tolist())) == set(zip(*map(list, np.nonzero(d <= radius))))
        a, b = np.triu_indices(300, 1)
        assert (S.pairs_within(x, a, b, radius) == (d[a, b] <= radius)).all()


def test_simhash_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(12)]
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)] + [(100 + i, t + " extra", "", "", 0) for i, t in enumerate(texts)] + [(200 + i, t.upper(), "", "", 0) for i, t in enumerate(texts[:3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").unionByName(awkward(spark).where("doc_id is not null").selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars"))
    out = S.near_duplicates(docs).collect()
    prints = {r[0]: plain_print(r[1]) for r in rows} | {r[0] + 1000: plain_print(r[1]) for r in ROWS if r[0] is not None}
    ids = sorted(prints)
    want = groups(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert len(out) == docs.count()
    for r in out:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


def test_blocks_of_a_hot_bucket_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = np.zeros((60, 8), np.uint8)
    base[:, 7] = np.arange(60)
    base[:30, 6] = 255
    prints = [(int.from_bytes(p.tobytes(), "big", signed=True), bytearray(p.tobytes())) for p in base[rng.permutation(60)]]
    df = spark.createDataFrame(prints, "cls long, fp binary").withColumn("keys", S._parts())
    whole = {r.id: r.component for r in connected_components(S.near_links(df, 2)).collect()}
    monkeypatch.setattr(S, "BLOCK", 7)
    assert {r.id: r.component for r in connected_components(S.near_links(df, 2)).collect()} == whole
    want = groups([c for c, _ in prints], [(a, b) for a, p in prints for b, q in prints if a > b and (int.from_bytes(p, "big") ^ int.from_bytes(q, "big")).bit_count() <= 2])
    assert whole == {k: v for k, v in want.items() if k in whole}


def test_keep_one_by_similarity(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(8):
        w = list(rng.choice(words, 300))
        rows += [(10 * i, " ".join(w)), (10 * i + 1, " ".join(w[:-3] + ["x", "y", "z"])), (10 * i + 2, " ".join(rng.choice(words, 300)))]
    docs = spark.createDataFrame([(a, b, "", "", 0) for a, b in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in S.keep_one(docs).collect()}
    assert kept == {a for a, _ in rows if a % 10 != 1}
    out = S.keep_one(awkward(spark, ["row_key", "text_hash"]))
    assert out.columns[-2:] == ["row_key", "text_hash"] and sorted(x.doc_id or -1 for x in out.collect()) == [-1, 1, 3, 5, 6, 7, 9, 10]
    assert S.keep_one(empty(spark)).count() == 0 and S.near_duplicates(empty(spark)).count() == 0


def test_embeddings_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((120, 16))
    v[40:80] = v[:40] + 0.05 * rng.standard_normal((40, 16))
    v[80:90] = 3 * v[:10]
    v[90:100] = v[90]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None]), (904, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    want = groups(range(120), [(i, j) for i, j in zip(*np.nonzero(near)) if i > j])
    for block in (2048, 5):
        monkeypatch.setattr(E, "BLOCK", block)
        got = {r.vec_id: r for r in E.near_duplicates(df).collect()}
        assert len(got) == 125
        for i in range(120):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum() - 1, want[i], want[i] == i)
        assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 905))
    assert E.near_duplicates(df.limit(0)).count() == 0
    clash = df.selectExpr("*", "'x' as cls", "'x' as n_links", "'x' as key")
    assert E.near_duplicates(clash).columns == ["vec_id", "n_links", "component_id", "kept"] and E.near_duplicates(clash).count() == 125


def test_recall_at_the_threshold():
    """Pairs at cosine 0.95 exactly share a bucket and a near sketch in all but a few of a hundred thousand cases, for any number of classes."""
    rng = np.random.default_rng(8)
    x, y = rng.standard_normal((2, 20000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    for classes in (1000, 2_000_000):
        tables, hashes = E.sized(classes)
        found = (E.keys(x, tables, hashes) == E.keys(y, tables, hashes)).any(axis=1)
        far = np.bitwise_count((E.sketches(x, tables, hashes) ^ E.sketches(y, tables, hashes)).view(np.uint64)) > E.RADIUS
        assert (~found | far).sum() <= 5
    assert E.sized(51_000) == (49, 12) and E.sized(10**9)[1] > 20


def test_similarity_is_decided_exactly(spark, monkeypatch):
    """Pairs around 0.8, on both sides, of long and of very short texts, against all pairs by definition."""
    rng = np.random.default_rng(7)
    texts = []
    for n in [4, 5, 6, 9, 12, 20, 40, 90, 200, 400] * 6:  # distinct shingles of the text
        w = [f"u{len(texts)}w{k}" for k in range(n + 4)]
        texts += [" ".join(w), " ".join([*w, "more"])]
        for share in rng.uniform(0.75, 0.9, 4):  # a tail replaced, so that the similarity is near the share
            kept = round(2 * n * share / (1 + share))
            texts.append(" ".join([*w[: kept + 4], *(f"v{len(texts)}x{k}" for k in range(n - kept))]))

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [grams(t) for t in texts]
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])]
    want = groups(range(len(texts)), linked)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block, small in ((4096, 48), (2, 2)):
        monkeypatch.setattr(S, "BLOCK", block)
        monkeypatch.setattr(S, "SMALL", small)
        assert {r.doc_id: r.component_id for r in S.near_duplicates(docs, shingle=5, similarity=0.8).collect()} == want
    assert {r.doc_id for r in S.keep_one(docs).collect()} == set(want.values())
