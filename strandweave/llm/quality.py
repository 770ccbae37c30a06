"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal.

A text's words (white space parts) stand as they are, lower-cased, and by their form: runs of
capitals, small letters, digits and other letters become one sign each, other characters stay, and
a word like the one before becomes a mark of its own.  N-grams up to three, of words and of forms,
are hashed to `1 << BITS` weights; a text's features are their shares of all its n-grams, and its
score is the logistic function of a sparse dot product.

Nulls and empty texts have no n-grams and get the model's bias.  A null doc_id passes through and
isn't held out.  Without labelled rows every score is 1.0, so that nothing is rejected unseen; with
rows of one label only the score is that label's smoothed share.  Repeated rows score alike; an
empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import column, read_table, trained, within_bytes

BITS = 18
TRAIN_ROWS = 4000
EPOCHS, ALPHA, BETA, L1, L2 = 6, 0.5, 1.0, 1e-4, 1e-3
THRESHOLD = 0.7
SCALE = 8.0
#: What the training rows' counts may hold together, in bytes; further rows are left out of training.
TRAIN_BYTES = 64 << 20
CACHE_ENTRIES = 150_000
#: Longer words are hashed each time and never kept, so that the cache is bounded in bytes.
KEPT_CHARACTERS = 256
SAME = np.uint64(zlib.crc32(b"\0same"))
_SIZE = np.uint64((1 << BITS) - 1)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))

_CAPITALS, _DIGITS, _SMALL, _RUNS = (
    re.compile(p) for p in (r"[A-ZÀ-ÖØ-Þ]+", r"\d+", r"[^\W\d_A-ZÀ-ÖØ-Þ]+", r"(.)\1+")
)


def form(word: str) -> str:
    """The word's form: `THE!!` is `A!`, `foo12,` is `a0,`."""
    return _RUNS.sub(r"\1", _SMALL.sub("a", _DIGITS.sub("0", _CAPITALS.sub("A", word))))


class _Words(dict):
    """Word to its row in two growing tables: hashes of the word and of its form."""

    def __init__(self):
        super().__init__()
        self.hashes = np.zeros((1024, 2), np.uint64)
        self.used = 0

    def __missing__(self, word: str) -> int:
        row = self.used
        self.used += 1
        if len(word) <= KEPT_CHARACTERS:
            self[word] = row
        if row >= len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[row] = zlib.crc32(word.lower().encode()), zlib.crc32(form(word).encode()) + (1 << 32)
        return row


_WORDS = _Words()


def forget() -> None:
    """Empties the cache: a worker that goes on with other work doesn't hold it."""
    global _WORDS
    _WORDS = _Words()
    pa.default_memory_pool().release_unused()


def features(text: str | None) -> np.ndarray:
    """Hashed n-grams of the whole text, repeats included."""
    global _WORDS
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64)
    if _WORDS.used > CACHE_ENTRIES:
        _WORDS = _Words()
    rows = np.array(list(map(_WORDS.__getitem__, words)))
    own, forms = _WORDS.hashes[rows].T.copy()
    forms[1:][own[1:] == own[:-1]] = SAME
    grams = []
    for kind, salt in ((own, np.uint64(0)), (forms, np.uint64(1) << np.uint64(33))):
        grams.append((kind + salt) * _MIX[1])
        if len(words) > 1:
            pairs = kind[:-1] * _MIX[2] + (kind[1:] + salt) * _MIX[0]
            grams.append(pairs)
            if len(words) > 2:
                grams.append(pairs[:-1] * _MIX[1] + kind[2:])
    mixed = np.concatenate(grams)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * _MIX[0]) >> np.uint64(64 - BITS) & _SIZE).astype(np.int64)


class QualityModel:
    """Weights and bias, or a constant score."""

    def __init__(self, weights: np.ndarray | None, bias: float = 0.0, constant: float | None = None):
        self.weights, self.bias, self.constant = weights, bias, constant

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        grams = features(text)
        z = self.bias + (SCALE * float(self.weights[grams].mean()) if len(grams) else 0.0)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> QualityModel:
    """FTRL-proximal over (feature, share, label) rows in the given order, several times."""
    ones = sum(r[2] for r in rows)
    if not rows or ones in (0, len(rows)):
        return QualityModel(None, constant=(ones + 1) / (len(rows) + 2) if rows else 1.0)
    size = (1 << BITS) + 1  # the last is the bias
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    # Both labels weigh alike: the score is against an even prior.
    weight = (len(rows) / (2 * (len(rows) - ones)), len(rows) / (2 * ones))
    rng = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)).tolist():
            at, share, label = rows[k]
            at, x = np.append(at.astype(np.int64), size - 1), np.append(SCALE * share.astype(np.float64), 1.0)
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, float(wi @ x)))))
            g = weight[label] * (p - label) * x
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * wi
            n[at] = grown
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return QualityModel(w[:-1].astype(np.float32), float(w[-1]))


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Trains on at most `train_rows` labelled documents that aren't held out, chosen by their ids' hash.

    The sample is bounded in rows and, by TRAIN_BYTES, in bytes whatever the input; texts become
    feature counts on the executors, and one task trains on them.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    marked = marked.where(~_held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, shares = [], []
            for text in part.column("text").to_pylist():
                grams, counts = np.unique(features(text), return_counts=True)
                at.append(grams.astype("<i4").tobytes())
                shares.append((counts / max(1, counts.sum())).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("quality"), pa.array(at, pa.binary()), pa.array(shares, pa.binary())],
                names=["doc_id", "quality", "at", "shares"],
            )
        forget()

    # At most train_rows rows of two numbers: a bounded broadcast.  A repeated id trains once, with its least text.
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id")
        .agg(F.first("quality").alias("quality"), F.min("text").alias("text"))
        .mapInArrow(counted, "doc_id long, quality int, at binary, shares binary")
    )
    rows = within_bytes(rows, [F.xxhash64("doc_id"), "doc_id"], F.octet_length("at") + F.octet_length("shares"), TRAIN_BYTES)

    def of_table(table: pa.Table) -> QualityModel:
        got = table.sort_by([("doc_id", "ascending")])
        view = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in got.column(name)]
        return train(list(zip(view("at", "<i4"), view("shares", "<f4"), got.column("quality").to_pylist())))

    return trained(rows, of_table)


def scored(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for columns doc_id, text."""

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([model.score(t) for t in part.column("text").to_pylist()], pa.float64())],
                names=["doc_id", "score"],
            )
        forget()

    got = docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")
    return got.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose text scores at least `threshold`, with all their columns."""

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = column(part, "text").to_pylist()
            yield part.filter(pa.array([model.score(t) >= threshold for t in texts], pa.bool_()))
        forget()

    return docs.mapInArrow(keep, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the quality score of all `documents`."""
    docs = read_table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, read_table(spark, sf_dir, "labels")))
