"""Quality classifier (operator 6): a regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance, shrunk towards its own mean variance; a score is the logistic of the difference
of two Gaussian log densities, each a Mahalanobis distance and a log determinant from a Cholesky factor computed once.
Statistics come from the whole text; counts and shares are transformed by logarithms and square roots.

Fitting reads a sample of at most about SAMPLE labelled rows (a documented parameter, chosen by a hash of the id), sums
their moments in Spark, and brings only two classes' moments to the driver; labels, language, source and id are never
inputs. Priors are the classes' shares among the rows learned from, unless one is given.

Rows: null text counts as empty; empty texts have the statistics of no words and a score like any other; very long
texts are read whole; rows labelled null or other than 0 and 1 are not learned from; with rows of fewer than two classes every score is 0.5;
repeated rows get equal scores; other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import crc32_of, fresh, saved, small_batches

SAMPLE, SHRINK, THRESHOLD = 20_000, 0.02, 0.3
_KINDS = bytes(bytearray([1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c in b" \t\r\x0b\x0c" else 5 if c == 10 else 6 if c in b".,;:!?'\"()-" else 7 if c < 128 else 8 for c in range(256)]))
_TAIL = re.compile(rb"[^A-Za-z0-9\x80-\xff]{2,}(?=\s|$)")
FEATURES = 18


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a whole text in UTF-8."""
    n = len(text)
    kinds = np.bincount(np.frombuffer(text.translate(_KINDS), np.uint8), minlength=9) if n else np.zeros(9, int)
    words = text.split()
    w = max(len(words), 1)
    lines = text.split(b"\n")
    distinct = set(words)
    share = lambda k, of: float(np.sqrt(k / max(of, 1)))
    same = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    letters = kinds[1] + kinds[2] + kinds[8]
    lone = sum(1 for x in words if len(x) == 1 and not x.isalnum() and x < b"\x80")
    return [
        float(np.log1p(n)), float(np.log1p(n / w)), share(kinds[2], letters), share(kinds[3], n), share(kinds[6], n), share(kinds[7], n), share(kinds[8], n), share(kinds[4] + kinds[5], n),
        share(len(_TAIL.findall(text)), w), share(same, w), share(len(distinct), w), share(pairs, w), share(lone, w), float(np.log1p(w / len(lines))), share(len(set(lines)), len(lines)),
        share(sum(map(bytes.isupper, words)), w), share(text.count(b"!"), n), float(np.log1p(np.log1p(max(map(len, words), default=0)))),
    ]


@dataclass
class Discriminant:
    """What scoring needs: for each class a mean, a Cholesky factor and a log prior less half the log determinant."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), 0.5)
        z = x / self.scale
        logs = [o - 0.5 * (np.linalg.solve(f, (z - m).T) ** 2).sum(axis=0) for m, f, o in zip(self.means, self.factors, self.offsets)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -700, 700)))


def discriminant(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = SHRINK, prior: float | None = None) -> Discriminant:
    """From each class's count, sum and sum of outer products."""
    if set(moments) != {0, 1} or min(m[0] for m in moments.values()) < 2:
        return Discriminant(np.empty((0, 0)), np.empty((0, 0, 0)), np.empty(0), np.empty(0))
    total = sum(m[0] for m in moments.values())
    mean = sum(m[1] for m in moments.values()) / total
    var = np.diag(sum(m[2] for m in moments.values())) / total - mean**2
    scale = np.sqrt(np.maximum(var, 1e-6))
    prior = moments[1][0] / total if prior is None else prior
    means, factors, offsets = [], [], []
    for c in (0, 1):
        n, s, ss = moments[c]
        mu = s / n
        cov = (ss / n - np.outer(mu, mu)) / np.outer(scale, scale)
        cov = (1 - shrink) * cov + shrink * max(np.trace(cov) / len(cov), 1e-3) * np.eye(len(cov))
        f = np.linalg.cholesky(cov)
        means.append(mu / scale)
        factors.append(f)
        offsets.append(np.log(prior if c else 1 - prior) - np.log(np.diag(f)).sum())
    return Discriminant(np.array(means), np.array(factors), np.array(offsets), scale)


def _moments(batches):
    """Moments of each class in a partition: (label, place, value) with the count, the sums and the outer products."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        labels = np.array(b["label"].to_pylist())
        x = np.array([statistics(t or b"") for t in b["text"].cast(pa.binary()).to_pylist()]).reshape(-1, FEATURES)
        one = np.c_[np.ones(len(x)), x]
        for c in np.unique(labels):
            held[int(c)] = held.get(int(c), 0) + one[labels == c].T @ one[labels == c]
    for c, m in held.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, c, np.int32)), pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m.ravel())], ["label", "place", "value"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, shrink: float = SHRINK, prior: float | None = None) -> Discriminant:
    """Learns from the labelled rows, of which a hash of the id picks at most about `sample`; ids labelled both ways, or repeated, count once as their least label."""
    own = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").alias("label")).where("id is not null and label in (0, 1)")
    own = own.groupBy("id").agg(F.min("label").alias("label"))
    spread = 1 << 24
    picked = own.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(spread)))
    n = max(picked.count(), 1)
    picked = saved(picked.where(F.col("h") < int(spread * min(1.0, sample / n))).select("id", "label"))
    # the sample's size is bounded by the parameter, so it may be broadcast; past a margin it isn't
    side = F.broadcast(picked) if picked.count() <= 2 * sample else picked
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).join(side, "id").select("label", "text")
    small_batches(docs.sparkSession)
    sums = rows.mapInArrow(_moments, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).collect()
    k = FEATURES + 1
    full: dict[int, np.ndarray] = {}
    for r in sums:
        full.setdefault(r["label"], np.zeros(k * k))[r["place"]] = r["value"]
    return discriminant({c: (m.reshape(k, k)[0, 0], m.reshape(k, k)[0, 1:], m.reshape(k, k)[1:, 1:]) for c, m in full.items()}, shrink, prior)


def score(docs: DataFrame, model: Discriminant, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of each whole text, 0 to 1. Where docs have a column of its name, it is led by an underscore."""

    @F.arrow_udf(T.DoubleType())
    def scores(texts: pa.Array) -> pa.Array:
        x = np.array([statistics(t or b"") for t in texts.cast(pa.binary()).to_pylist()]).reshape(-1, FEATURES)
        return pa.array(model.score(x), pa.float64())

    small_batches(docs.sparkSession)
    return docs.withColumn(*fresh(docs.columns, out), scores(F.col(f"`{text}`").cast("string")))


def reject(docs: DataFrame, model: Discriminant, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score the threshold or more, with the columns of docs."""
    (tmp,) = fresh(docs.columns, "score")
    return score(docs, model, text, tmp).where(F.col(tmp) >= threshold).drop(tmp)


def learners(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that may be learned from: crc32 of the id as text, mod 5, is not 0."""
    return df.where(F.pmod(crc32_of(id_col), F.lit(5)) != 0)
