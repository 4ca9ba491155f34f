import hashlib
import math
import struct
import zlib

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.helpers import ROWS, awkward, empty
from tidemark.llm import media as M
from tidemark.llm import queries


def test_round_trip_and_checks(spark):
    out = M.read_media(M.to_png(awkward(spark, ["back"])), keep=["doc_id", "text"]).collect()
    assert len(out) == len(ROWS)
    for r in out:
        data = (r.text or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert r.payload_bytes == len(payload) and r.tail_crc32 == zlib.crc32(payload[-64:]) and len(r.low_hash) == 8
        assert M.read_pngs(M.write_pngs([payload, payload[:64]]))[0].tobytes() == payload
    assert M.read_media(M.to_png(empty(spark))).count() == 0


def test_damage_is_found():
    png = bytearray(M.write_pngs([bytes(range(64)) * 3])[0])
    for at in (3, 20, len(png) - 20, len(png) - 2):
        bad = bytes(png[:at]) + bytes([png[at] ^ 1]) + bytes(png[at + 1 :])
        with pytest.raises(ValueError):
            M.read_pngs([bad])
    with pytest.raises(ValueError):
        M.read_pngs([bytes(png[:-5])])


def paeth(a, b, c):
    return min(((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)))[2]


def test_query_equals_a_plain_reading(spark):
    """Every column of op3_media against the format's rules written out pixel by pixel."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op3_media(spark, SF).collect()}
    used = set()
    for r in sorted(docs, key=lambda r: len(r.text or ""))[:60]:
        payload = M.pad((r.text or "").encode())
        rows, lines = [list(payload[i : i + 64]) for i in range(0, len(payload), 64)], []
        for y, row in enumerate(rows):
            up = rows[y - 1] if y else [0] * 64
            neighbours = [(row[x - 1] if x else 0, up[x], up[x - 1] if x else 0) for x in range(64)]
            forms = [[(v - g) % 256 for v, g in zip(row, guess)] for guess in ([0] * 64, [a for a, _, _ in neighbours], up, [(a + b) // 2 for a, b, _ in neighbours], [paeth(*n) for n in neighbours])]
            kind = min(range(5), key=lambda k: (sum(min(v, 256 - v) for v in forms[k]), k))
            used.add(kind)
            lines.append(bytes([kind, *forms[kind]]))
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        packed = zlib.compress(b"".join(lines), M.LEVEL)
        png = M.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, len(rows), 8, 0, 0, 0, 0)) + b"".join(chunk(b"IDAT", packed[i : i + 65536]) for i in range(0, len(packed), 65536)) + chunk(b"IEND", b"")
        n = len(rows)
        cell = lambda i, j: [sum(rows[y][2 * j : 2 * j + 2]) / 2 for y in (range(i * n // 32, (i + 1) * n // 32) if n >= 32 else [i * n // 32])]
        small = [[sum(cell(i, j)) / len(cell(i, j)) for j in range(32)] for i in range(32)]
        wave = [[math.cos(math.pi / 32 * k * (x + 0.5)) for x in range(32)] for k in range(1, 9)]
        low = [round(sum(wave[u][i] * wave[v][j] * small[i][j] for i in range(32) for j in range(32)), 6) for u in range(8) for v in range(8)]
        middle = sum(sorted(low)[31:33]) / 2
        feature = f"{int(''.join('1' if v > middle else '0' for v in low), 2):016x}"
        want = (len((r.text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest())
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32, g.media_bytes, g.media_sha256) == want
        assert (int(g.feature, 16) ^ int(feature, 16)).bit_count() <= 1  # a tie at the middle may round either way
    assert len(used) == 5


@pytest.mark.parametrize("kind", range(5))
def test_all_row_filters(kind):
    rows = np.random.default_rng(kind).integers(0, 256, (7, 64)).astype(np.uint8)
    lines = np.zeros((7, 65), np.uint8)
    for y in range(7):
        lines[y, 0] = kind
        for x in range(64):
            a, b, c = (int(rows[y, x - 1]) if x else 0), (int(rows[y - 1, x]) if y else 0), (int(rows[y - 1, x - 1]) if x and y else 0)
            p = a + b - c
            paeth = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            lines[y, x + 1] = (int(rows[y, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) % 256
    assert (M.unfilter([lines])[0] == rows).all()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = M.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 7, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")
    assert (M.read_pngs([png])[0] == rows).all()


def test_images_of_many_heights_and_widths():
    rng = np.random.default_rng(9)
    images = []
    for h, w in [(1, 64), (7, 64), (300, 64), (2, 64), (40, 5), (1, 1), (90, 64)]:
        rows = rng.integers(0, 256, (h, w)).astype(np.uint8)
        lines = np.zeros((h, w + 1), np.uint8)
        lines[:, 0] = rng.integers(0, 5, h)
        for y in range(h):
            for x in range(w):
                a, b, c = (int(rows[y, x - 1]) if x else 0), (int(rows[y - 1, x]) if y else 0), (int(rows[y - 1, x - 1]) if x and y else 0)
                lines[y, x + 1] = (int(rows[y, x]) - (0, a, b, (a + b) // 2, paeth(a, b, c))[lines[y, 0]]) % 256
        images.append((rows, lines))
    for width in {len(r[0]) for r, _ in images}:
        own = [x for x in images if len(x[0][0]) == width]
        assert all((a == b).all() for a, (b, _) in zip(M.unfilter([i for _, i in own]), own))


def test_names_that_clash(spark):
    out = M.to_png(awkward(spark, ["media"]))
    assert out.columns[-2:] == ["media", "_media"] and {r.media for r in out.collect()} == {"x"}
    assert M.read_media(out, "_media").count() == len(ROWS)
    back = M.read_media(M.to_png(awkward(spark, ["payload_bytes", "Low_Hash"])))
    assert back.columns[-8:] == ["payload_bytes", "Low_Hash", "_payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "_low_hash"]
    assert back.where("payload_bytes = 'x' and _payload_bytes % 64 = 0 and _low_hash is not null").count() == len(ROWS)
