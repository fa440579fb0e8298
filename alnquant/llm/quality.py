"""Quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader updates (operator 6).

Words are runs of non-space bytes, taken as they stand (lower-cased) and as shapes (runs of lower case, upper case and
digits shortened to one letter each, other characters kept).  Features are hashed word unigrams and bigrams, shape
n-grams up to three, and two n-gram patterns that hashing alone can't see: a word after itself, and a word trigram that the
text already had.  A feature's value is the square root of its share of the words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common as C

U64 = np.uint64
BITS = 18
TRAIN_ROWS = 8000  # documented bound of the labelled sample
THRESHOLD = 0.7
HELD_OUT = 2  # crc32(doc_id as text) mod 4 of the rows whose labels are never learnt

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x61:0x7B] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x30:0x3A] = ord("0")


def features(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted feature numbers, values) of each text; feature 0 is the bias."""
    buf, offs = C.text_buffer(col)
    s, e, h, first = C.words(buf, offs, C.SPACE_WORD)
    # shapes: hash of the run starts of each word
    c = _SHAPE[buf]
    start = np.ones(len(c), bool)
    start[1:] = c[1:] != c[:-1]
    start[s] = True
    at = np.concatenate([[0], np.cumsum(start)])
    shape = C.span_hash(c[start], at[s], at[e], lower=False) if len(s) else h
    low = U64((1 << BITS) - 1)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        if not n:
            out.append((np.zeros(1, np.int64), np.ones(1, np.float32)))
            continue
        w, p = h[a:b], shape[a:b]
        tri = C.grams(w, 3)
        again = len(tri) - len(np.unique(tri))
        twice = int((w[1:] == w[:-1]).sum())
        f = np.concatenate([w ^ U64(11), C.grams(w, 2) ^ U64(12), p ^ U64(13), C.grams(p, 2) ^ U64(14), C.grams(p, 3) ^ U64(15)])
        f, k = np.unique((C.mix(f) & low).astype(np.int64) + 3, return_counts=True)
        share = np.sqrt(k / n)
        out.append((np.concatenate([[0, 1, 2], f]), np.concatenate([[1.0, np.sqrt(again / n), np.sqrt(twice / n)], share]).astype(np.float32)))
    return out


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss."""

    def __init__(self, alpha=0.3, beta=1.0, l1=0.05, l2=1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 3), np.zeros((1 << BITS) + 3)

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, i: np.ndarray, v: np.ndarray, y: int) -> None:
        w = self.weights(i)
        g = (1 / (1 + np.exp(-float(np.clip(w @ v, -35, 35)))) - y) * v
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 3) -> np.ndarray:
    """Every fifth document is also learnt by the bias alone, so a text without known features scores as the labels' share."""
    model, rng = Ftrl(), np.random.default_rng(7)
    bias = np.zeros(1, np.int64), np.ones(1, np.float32)
    for _ in range(epochs):
        for n, j in enumerate(rng.permutation(len(rows))):
            model.learn(*rows[j])
            if n % 5 == 0:
                model.learn(*bias, rows[j][2])
    return model.weights().astype(np.float32)


def score(w: np.ndarray, col: pa.Array) -> np.ndarray:
    return np.array([1 / (1 + np.exp(-float(np.clip(w[i] @ v, -35, 35)))) for i, v in features(col)])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learnt from at most about ``rows`` labelled documents, drawn by a hash of doc_id among those not held out.

    Labels that are null, and documents that have several labels, are left out.  Without labels every score is a half.
    """
    ok = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (remainder() != HELD_OUT))
    ok = ok.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    n = ok.count()
    if not n:
        return np.zeros((1 << BITS) + 3, np.float32)
    share = min(1.0, rows / n)
    some = ok.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))  # of a known, bounded size: broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id", F.col("quality").cast("int").alias("y"))), "doc_id")

    def featurise(batches):
        for b in C.pieces(batches):
            f = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([i.astype(np.int32).tobytes() for i, _ in f], pa.binary()), pa.array([v.tobytes() for _, v in f], pa.binary())], ["doc_id", "y", "i", "v"])

    def learn(batches):
        got = []
        for b in batches:
            got += [(d, np.frombuffer(i, np.int32), np.frombuffer(v, np.float32), y) for d, y, i, v in zip(*(b.column(c).to_pylist() for c in ("doc_id", "y", "i", "v")))]
        got.sort(key=lambda r: (r[0], len(r[1]), r[2].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([fit([r[1:] for r in got]).tobytes()], pa.binary())], ["w"])

    made = C.save(sample.mapInArrow(featurise, "doc_id long, y int, i binary, v binary"), "op6-sample")
    (row,) = made.coalesce(1).mapInArrow(learn, "w binary").collect()
    C.drop(made)
    return np.frombuffer(row["w"], np.float32)


def remainder() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def predict(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """All columns of ``docs`` with score and predicted; columns of these names are replaced.  Null and empty texts are
    scored by the bias alone."""
    carried = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = StructType([*docs.select(*carried).schema, *StructType.fromDDL("score double, predicted int")])

    def run(batches):
        for b in C.pieces(batches):
            s = score(weights, b.column("text"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*carried, "score", "predicted"])

    return docs.select(*carried).mapInArrow(run, schema)
