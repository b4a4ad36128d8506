"""A quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features of a text are its words, its pairs of neighbouring words, and the pairs of neighbouring word *shapes* (letter
case, last byte, length class, equal to the word before), all hashed to 2**18 places; shapes carry over to words that
training has not seen. A feature's value is its count over the number of words, scaled, so long and short texts are
scored alike. A score is the logistic function of a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_map, chunks, doc_rows
from textloom.llm.vector import U, Words, mix, sums

BITS = 18
#: Training reads at most so many labelled texts unless told otherwise: those with the least hash of their id.
SAMPLE = 12_000
#: Passes over the sample: a small one is too little for one pass.
EPOCHS = 2
#: The sum of a text's values within each of the three kinds of features.
SCALE = 20.0
#: Step size, its damping, and the two penalties of the updates.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.01
THRESHOLD = 0.3

_UPPER, _LOWER, _DIGIT = range(65, 91), range(97, 123), range(48, 58)
_KIND = np.full(256, 3, np.uint64)
for _k, _r in enumerate((_UPPER, _LOWER, _DIGIT)):
    _KIND[list(_r)] = _k
_KIND[128:] = 4


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature places of all texts (words, then pairs, then shape pairs of a word stand together), and the number of the
    first word of each text, with the total at the end. Each word has three places."""
    w = Words(texts)
    h = w.hashes()
    starts = np.zeros(len(h), bool)
    starts[w.first[:-1][np.diff(w.first) > 0]] = True
    before = np.where(starts, U(1), np.concatenate([h[:1], h[:-1]])) if len(h) else h
    second = np.minimum(w.start + 1, w.end - 1)
    shape = _KIND[w.bytes[w.start]] + U(8) * _KIND[w.bytes[second]] + U(64) * w.bytes[w.end - 1].astype(U) + U(1 << 16) * np.minimum(w.end - w.start, 15).astype(U) // U(3) + U(1 << 24) * (h == before).astype(U)
    shape = mix(shape + U(7))
    shape_before = np.where(starts, U(2), np.concatenate([shape[:1], shape[:-1]])) if len(h) else h
    places = np.empty((len(h), 3), np.int32)
    places[:, 0] = h >> U(64 - BITS)
    places[:, 1] = mix(before * U(3) + h) >> U(64 - BITS)
    places[:, 2] = mix(shape_before * U(5) + shape) >> U(64 - BITS)
    return places, w.first


class Leader:
    """Per-coordinate follow-the-regularised-leader (proximal) for the logistic loss. Place 2**BITS is the intercept."""

    def __init__(self):
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (logistic(w @ x) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def logistic(v):
    return 1 / (1 + np.exp(-np.clip(v, -35, 35)))


def sparse(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, counts = np.unique(places, return_counts=True)
    return np.append(at, 1 << BITS), np.append(counts * (SCALE / max(1, len(places))), 1.0)


def train(rows: DataFrame) -> np.ndarray:
    """Weights from ``sort long, text string, label double``: a bounded sample, streamed in order through one task."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.encode() for t in b.column(1).to_pylist()]
            found = []
            for i, j in chunks(texts):
                places, first = features(texts[i:j])
                found += [places[a:z].tobytes() for a, z in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary()), b.column(2)], ["sort", "places", "label"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = Leader()
        for b in batches:
            for p, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                leader.learn(*sparse(np.frombuffer(p, np.int32).reshape(-1, 3)), y)
        yield pa.RecordBatch.from_arrays([pa.array([leader.weights().astype(np.float32).tobytes()], pa.binary())], ["weights"])

    extracted = arrow_map(rows, extract, "sort long, places binary, label double")
    epochs = extracted.select(F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))).alias("epoch"), "sort", "places", "label")
    ordered = epochs.repartition(1).sortWithinPartitions("epoch", "sort", "places", "label")
    found = arrow_map(ordered, learn, "weights binary").first()
    return np.frombuffer(found[0], np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def fold_of(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % folds


def classify_quality(df: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``. Fold 0 is held out and never trained on. Training
    reads ``sample`` labelled documents at most, chosen among those that ``df`` holds.

    Labels are 1 or 0; null labels and ids are ignored, and of several labels of an id the greatest counts. Null and
    empty texts get the intercept's score. Without any label every score is 0.5. Repeated rows give repeated rows, an
    empty table gives none, further columns are ignored. Training joins the documents with a broadcast of at most
    ``sample`` labels; scoring is a scan with a broadcast of fixed size.
    """
    rows = doc_rows(df, id_col, text_col)
    known = labels.select(labels[id_col].cast("long").alias("l_id"), labels[label_col].cast("double").alias("label")).where("l_id IS NOT NULL AND label IS NOT NULL")
    known = known.where(fold_of(F.col("l_id")) != 0).groupBy("l_id").agg(F.max("label").alias("label"))
    # labels without a document are left out before the sample is cut; only ids meet here
    present = known.hint("merge").join(rows.select("doc_id"), F.col("l_id") == F.col("doc_id"), "left_semi")
    chosen = present.orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
    labelled = rows.join(F.broadcast(chosen), rows.doc_id == F.col("l_id")).select(F.xxhash64("l_id").alias("sort"), "text", "label")
    shared = df.sparkSession.sparkContext.broadcast(train(labelled))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.astype(np.float64)
        for b in batches:
            texts = [t.encode() for t in b.column(1).to_pylist()]
            found = [np.zeros(0)]
            for i, j in chunks(texts):
                places, first = features(texts[i:j])
                total = sums(weights[places].sum(axis=1), first)
                found.append(logistic(weights[-1] + total * SCALE / np.maximum(np.diff(first), 1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(found))], ["doc_id", "score"])

    scored = arrow_map(rows, score, "doc_id long, score double")
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
