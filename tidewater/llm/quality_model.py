"""Operator 9: quality scores from hashed word n-grams and logistic regression (FTRL-proximal).

Features of a text: its words and word pairs, and the shapes of its words (letters,
digits and runs collapsed) and shape pairs, each hashed into ``2**bits`` places with
the logarithm of its count, scaled to unit length.  Weights are trained online with per-coordinate
follow-the-regularised-leader updates on a bounded sample of labelled rows of the
training folds (``sample_rows``, the least hashes of the id), in one task, and kept
as a dense vector of fixed size.  A score is a sparse dot product through the
logistic function.  Labels, language, source and id are never features; the id only
picks the fold: rows with crc32(id as text) mod 3 = 1 are held out of training.

Results: null and empty texts score on the bias alone.  Labels with a null id or
null quality are ignored; an id labelled twice counts as 1 if half its labels do; a
repeated labelled document is trained on once.  Without labels every score is 0.5.
Null ids are held out of training and of the held-out fold (held_out false).
Repeated rows are kept, one output row each.  Only the named columns are read.  An
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import map_batches, ship_package

BITS = 18
SAMPLE_ROWS = 12_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-3, 1e-4
FOLDS, HELD_OUT = 3, 1
MEMO_ENTRIES = 100_000
_PAIR = np.uint32(0x9E3779B1)
_SHAPE_SEED = 0x5BD1E995


def _shape(word: str) -> str:
    """Letters to x or X, digits to 0, other characters as they are; runs of one sign collapse."""
    out: list[str] = []
    for ch in word:
        s = ("X" if ch.isupper() else "x") if ch.isalpha() else "0" if ch.isdigit() else ch
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


class _Hashes(dict):
    """Word -> (hash of the word, hash of its shape), bounded."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > MEMO_ENTRIES:
            self.clear()
        h = (zlib.crc32(word.encode("utf-8", "surrogatepass")), zlib.crc32(_shape(word).encode("utf-8", "surrogatepass"), _SHAPE_SEED))
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = _Hashes()


def _fold(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return (h ^ (h >> np.uint32(13))) >> np.uint32(32 - bits)


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature places of the whole text and their values, log(1 + count) scaled to unit length."""
    words = text.split() if text else []
    if not words:
        return np.empty(0, dtype=np.int64), np.empty(0)
    h = np.array([_hashes[w] for w in words], dtype=np.uint32)
    with np.errstate(over="ignore"):
        pairs = h[:-1] * _PAIR + h[1:]
        at, count = np.unique(_fold(np.concatenate([h, pairs]).ravel(), bits), return_counts=True)
    x = np.log1p(count)
    return at.astype(np.int64), x / np.sqrt(x @ x)


class Ftrl:
    """Logistic regression with FTRL-proximal updates over hashed places; the last place is the bias."""

    def __init__(self, bits: int) -> None:
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g

    def dense(self) -> np.ndarray:
        return self.weights(np.arange(len(self.z))).astype(np.float32)


def fold_of(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights (2**bits places and the bias) from at most ``sample_rows`` labelled rows of the training folds."""
    spark = docs.sparkSession
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold_of(F.col(id_col)) != HELD_OUT))
             .groupBy(F.col(id_col).alias("_id")).agg(F.avg(F.col(label_col).cast("double")).alias("_label"))
             .orderBy(F.xxhash64("_id"), "_id").limit(sample_rows))  # bounded, so small enough to send everywhere
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
            .join(F.broadcast(known), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text")))

    def hashed(batch: pa.RecordBatch) -> dict:
        found = [features(t, bits) for t in batch.column(2).to_pylist()]
        return {"id": [zlib.crc32(str(x).encode()) for x in batch.column(0).to_pylist()], "label": batch.column(1),
                "at": [a.astype(np.int32) for a, _ in found], "x": [x for _, x in found]}

    # at most sample_rows short rows of numbers: one bounded task
    sparse = map_batches(rows.select("_id", "_label", "_text"), hashed, "id long, label double, at array<int>, x array<double>")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = []
        for b in batches:
            data += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (np.asarray(a.values, dtype=np.int64) for a in b.column(2)),
                        (np.asarray(x.values) for x in b.column(3)))
        data.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))  # the order of updates must not depend on how rows arrived
        model = Ftrl(bits)
        for _ in range(EPOCHS):
            for _, label, at, x in data:
                model.update(at, x, 1.0 if label >= 0.5 else 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([model.dense().tobytes()])], names=["weights"])

    ship_package(spark)
    found = sparse.coalesce(1).mapInArrow(fit, "weights binary").collect()  # 1 MB whatever the input
    return np.frombuffer(bytes(found[0][0]), dtype=np.float32) if found else np.zeros((1 << bits) + 1, dtype=np.float32)


def score_text(text: str | None, weights: np.ndarray) -> float:
    at, x = features(text, (len(weights) - 1).bit_length() - 1)
    v = float(weights[-1]) + float(weights[at].astype(np.float64) @ x)
    return float(1 / (1 + np.exp(-np.clip(v, -35, 35))))


def quality_scores(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score (0 to 1), predicted (score >= 0.5)."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        scores = [score_text(t, sent.value) for t in batch.column(2).to_pylist()]
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    src = docs.select(F.col(id_col).alias("doc_id"),
                      F.coalesce(fold_of(F.col(id_col)) == HELD_OUT, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return map_batches(src, run, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, weights: np.ndarray, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([score_text(t, sent.value) >= threshold for t in b.column(at).to_pylist()], pa.bool_()))

    ship_package(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
