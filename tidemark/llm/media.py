"""Media columns (operator 3): bytes stored as PNG images, read back with every check, and hashed by low frequencies.

A payload is a text's bytes and as many zero bytes as make a positive multiple of 64; it becomes an 8-bit grey image of
64 columns. The stored form is a PNG file in a binary column: signature, IHDR, one IDAT for each part of the zlib
stream, IEND, each chunk with its CRC; each row takes the filter that makes it smallest. Reading tests all checksums (chunk CRCs, zlib's Adler-32), undoes any of the five
row filters with numpy along anti-diagonals, many images at once, and takes the low frequencies of a cosine transform as a 64-bit hash in a binary column.

Rows: null counts as empty, and an empty text gives one row of zeros; equal texts give equal files and hashes; very long
texts give tall images; a file with a wrong checksum or form raises ValueError.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, small_batches

WIDTH, IDAT_BYTES, LEVEL, SLICE_BYTES, LANE_BYTES, BLOCK_ROWS = 64, 1 << 16, 1, 1 << 20, 1 << 19, 1 << 13
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def pad(data: bytes) -> bytes:
    """data and zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of the three neighbours (16-bit) the one nearest to left + up - corner; left before up before corner."""
    a, b = up - corner, left - corner
    c = np.abs(a + b)
    np.abs(a, out=a)
    np.abs(b, out=b)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def filtered(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Lines of a filter byte and samples, from the rows of images below one another (first: which begin an image), BLOCK_ROWS at a time. Each row takes the filter with the least sum of magnitudes, the lower number of equal ones."""
    above = np.concatenate([np.zeros((1, rows.shape[1]), np.uint8), rows[:-1]])
    above[first] = 0
    parts = [_filtered(rows[i : i + BLOCK_ROWS], above[i : i + BLOCK_ROWS]) for i in range(0, len(rows), BLOCK_ROWS)]
    return np.concatenate(parts) if parts else np.zeros((0, rows.shape[1] + 1), np.uint8)


def _filtered(rows: np.ndarray, up: np.ndarray) -> np.ndarray:
    left, corner = np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:], corner[:, 1:] = rows[:, :-1], up[:, :-1]
    l, u, c = (x.astype(np.int16) for x in (left, up, corner))
    forms = [rows, rows - left, rows - up, rows - (l + u >> 1).astype(np.uint8), rows - _paeth(l, u, c).astype(np.uint8)]
    costs = np.stack([np.abs(f.view(np.int8).astype(np.int16)).sum(axis=1) for f in forms])
    kinds = costs.argmin(axis=0)
    lines = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    lines[:, 0] = kinds
    for k, f in enumerate(forms):
        own = kinds == k
        lines[own, 1:] = f[own]
    return lines


def write_pngs(payloads: list[bytes]) -> list[bytes]:
    """Payloads, each a positive multiple of 64 bytes, as grey PNGs."""
    heights = np.array([len(p) // WIDTH for p in payloads])
    ends = np.cumsum(heights)
    first = np.zeros(ends[-1] if len(ends) else 0, bool)
    first[ends - heights] = True
    lines = filtered(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH), first)
    files = []
    for lo, hi in zip(ends - heights, ends):
        packed = zlib.compress(lines[lo:hi].tobytes(), LEVEL)
        parts = [packed[i : i + IDAT_BYTES] for i in range(0, len(packed), IDAT_BYTES)]
        head = struct.pack(">IIBBBBB", WIDTH, hi - lo, 8, 0, 0, 0, 0)
        files.append(SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(b"IDAT", p) for p in parts) + _chunk(b"IEND", b""))
    return files


def _sheared(padded: np.ndarray, steps: int, columns: int) -> np.ndarray:
    """A view of padded images (image, row, column or 1) by (image, step, column): column x of a step is of row step - x."""
    image, row, column = padded.strides
    return np.lib.stride_tricks.as_strided(padded[:, columns - 1 :], (len(padded), steps, columns), (image, row, column - row))


def unfilter(images: list[np.ndarray]) -> list[np.ndarray]:
    """Samples of images of one width from their filtered lines (filter byte first), one byte a pixel.

    A pixel needs its left, upper and corner neighbours only, so all pixels of an anti-diagonal, and of all images, are
    undone in one step.
    """
    if any(i[:, 0].max(initial=0) > 4 for i in images):
        raise ValueError("unknown row filter")
    result: list = [None] * len(images)
    order = sorted(range(len(images)), key=lambda k: -len(images[k]))
    while order:
        tall, width = images[order[0]].shape[0], images[order[0]].shape[1] - 1
        some = order[: max(1, LANE_BYTES // ((tall + 2 * width) * width))]
        order = order[len(some) :]
        deep = tall + 2 * width - 2
        lines, kinds, back = (np.zeros((len(some), deep, n), np.uint8) for n in (width, 1, width))
        for k, i in enumerate(some):
            lines[k, width - 1 : width - 1 + len(images[i])] = images[i][:, 1:]
            kinds[k, width - 1 : width - 1 + len(images[i])] = images[i][:, :1]
        steps = tall + width - 1
        coded, made = _sheared(lines, steps, width), _sheared(back, steps, width)
        image, row, _ = kinds.strides
        kind = np.lib.stride_tricks.as_strided(kinds[:, width - 1 :], (len(some), steps, width), (image, row, -row))
        still = np.searchsorted(-np.array([len(images[i]) for i in some]) - width + 1, -np.arange(steps), "left")
        one = two = np.zeros((len(some), width), np.int16)  # what the last two steps made
        for step in range(steps):
            m = int(still[step])
            up, k = one[:m], kind[:m, step]
            left, corner = np.zeros((m, width), np.int16), np.zeros((m, width), np.int16)
            left[:, 1:], corner[:, 1:] = one[:m, :-1], two[:m, :-1]
            guess = np.where(k == 1, left, np.where(k == 2, up, np.where(k == 3, left + up >> 1, np.where(k == 4, _paeth(left, up, corner), 0))))
            now = coded[:m, step] + guess & 255
            made[:m, step] = now
            one, two = now.astype(np.int16), one
        for k, i in enumerate(some):
            result[i] = back[k, width - 1 : width - 1 + len(images[i])]
    return result


def read_lines(data: bytes) -> np.ndarray:
    """The filtered lines of an 8-bit grey PNG, after testing signature, chunk order, every CRC and the zlib checksum."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, packed, ended = 8, None, [], False
    while at < len(data):
        if ended or at + 12 > len(data):
            raise ValueError("bytes after the end, or a chunk cut short")
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))) != data[at + 8 + n : at + 12 + n]:
            raise ValueError(f"wrong CRC in {kind!r}")
        if (kind == b"IHDR") != (head is None):
            raise ValueError("the header must come first, and once")
        if kind == b"IHDR":
            if n != 13:
                raise ValueError("wrong header")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        elif kind[0] < 97:
            raise ValueError(f"unknown chunk {kind!r}")
        at += 12 + n
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != head[1] * (head[0] + 1):
        raise ValueError("wrong number of samples")
    return np.frombuffer(raw, np.uint8).reshape(head[1], head[0] + 1)


def read_pngs(files: list[bytes]) -> list[np.ndarray]:
    """Samples of 8-bit grey PNGs, whatever their sizes."""
    lines = [read_lines(f) for f in files]
    result: list = [None] * len(files)
    for width in {i.shape[1] for i in lines}:
        own = [k for k, i in enumerate(lines) if i.shape[1] == width]
        for k, samples in zip(own, unfilter([lines[k] for k in own])):
            result[k] = samples
    return result


def _slices(items: list[bytes]):
    """Some items at a time, about SLICE_BYTES."""
    held, size = [], 0
    for x in items:
        held.append(x)
        size += len(x)
        if size >= SLICE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


@functools.cache
def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi / n * np.outer(np.arange(1, k + 1), np.arange(n) + 0.5))


def low_frequency_hash(samples: np.ndarray, side: int = 32) -> bytes:
    """8 bytes: the 8 x 8 lowest frequencies (without the mean ones) of the image averaged to 32 rows of 32, each bit 1 above their median."""
    h, w = samples.shape
    wide = samples.astype(np.float64).reshape(h, side, w // side).mean(2) if w % side == 0 else np.add.reduceat(samples.astype(np.float64), np.arange(side) * w // side, axis=1)
    if h >= side:
        edges = np.arange(side) * h // side
        small = np.add.reduceat(wide, edges, axis=0) / np.diff([*edges, h])[:, None]
    else:
        small = wide[np.arange(side) * h // side]
    c = _cosines(side, 8)
    low = (c @ small @ c.T).round(6).ravel()
    return np.packbits(low > np.median(low)).tobytes()


def to_png(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with a binary column more: the stored form of each whole text. Where docs have a column of its name, it is led by an underscore."""

    @F.arrow_udf(T.BinaryType())
    def stored(texts: pa.Array) -> pa.Array:
        payloads = [pad(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
        return pa.array([f for some in _slices(payloads) for f in write_pngs(some)], pa.binary())

    small_batches(docs.sparkSession)
    return docs.withColumn(*fresh(docs.columns, media), stored(F.col(f"`{text}`").cast("string")))


READ = T.StructType([T.StructField(n, t) for n, t in (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("low_hash", T.BinaryType()))])


def read_media(media: DataFrame, column: str = "media", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with what was read back from the stored bytes: sizes, digests and the hash in a binary column. A null file gives nulls; of these names, those that the kept columns have are led by an underscore."""

    @F.arrow_udf(READ)
    def back(files: pa.Array) -> pa.Array:
        rows, given = [], files.to_pylist()
        for some in _slices([f for f in given if f is not None]):
            for f, samples in zip(some, read_pngs(some)):
                payload = samples.tobytes()
                rows.append({"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(f), "media_sha256": hashlib.sha256(f).hexdigest(), "low_hash": low_frequency_hash(samples)})
        found = iter(rows)
        rows = [None if f is None else next(found) for f in given]
        return pa.array(rows, pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("low_hash", pa.binary())]))

    small_batches(media.sparkSession)
    kept = keep if keep is not None else [c for c in media.columns if c != column]
    (tmp,) = fresh([*kept, column], "back")
    out = media.withColumn(tmp, back(F.col(f"`{column}`")))
    return out.select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"{tmp}.{a}").alias(b) for a, b in zip(READ.names, fresh(kept, *READ.names))))
