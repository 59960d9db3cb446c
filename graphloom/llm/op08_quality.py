"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Training reads a bounded sample of labelled documents: their features are made on the cluster, and the
sparse rows are collected for FTRL-proximal, which is sequential. Scoring is one pass without a
shuffle: tokens to hashes, a sparse dot product with the weights, which have a fixed size and are broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_sample, held_out, keep_columns, slices, table

MADE = ["held_out", "score", "predicted"]
BITS = 20
#: Labelled documents that the model is trained on, at most, the smallest by a hash of the id; and the code points of all of them.
TRAIN_ROWS, TRAIN_CHARS = 4000, 64_000_000
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class _Ids(dict):
    """Token to hash, kept for tokens that come again; emptied when full, so memory is bounded.

    Words in capitals are one token and so are numbers: how a text is written counts, not what it names.
    """

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        kind = "<caps>" if len(token) > 1 and token.isupper() else "<number>" if token[0].isdigit() else token.lower()
        self[token] = h = xxhash.xxh32_intdigest(kind.encode("utf-8", "surrogatepass"))
        return h


_ids = _Ids()
_AGAIN = xxhash.xxh32_intdigest(b"<again>")


def ngrams(text: str | None) -> np.ndarray:
    """Hashed unigrams and bigrams of the whole text, repeats included. A token that is the same as one or two before it is <again>."""
    found = _TOKEN.findall(text or "")
    ids = np.fromiter(map(_ids.__getitem__, found), dtype=np.uint64, count=len(found))
    again = np.zeros(len(ids), bool)
    for back in (1, 2):
        again[back:] |= ids[back:] == ids[:-back]
    ids = np.where(again, np.uint64(_AGAIN), ids)
    pairs = ids[1:] * np.uint64(0x9E3779B1) + ids[:-1] * np.uint64(0x85EBCA77)
    return np.concatenate([ids * np.uint64(0xC2B2AE3D27D4EB4F), pairs * np.uint64(0x165667B19E3779F9)]) >> np.uint64(64 - BITS)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        i = ngrams(text)
        dot = float(self.weights[i].sum(dtype=np.float64)) / len(i) if len(i) else 0.0
        return float(1 / (1 + np.exp(-np.clip(SCALE * dot + self.bias, -30, 30))))


#: Features are shares of a text's n-grams, times this.
SCALE = 8.0


def train(rows, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> Model:
    """FTRL-proximal with a step size for each weight. rows: (indices, counts, label), in the order of training.

    The rarer label counts as much as the other. Without rows the score is 0.5; with one label, its side.
    """
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    of = [sum(y == k for *_, y in rows) for k in (0, 1)]
    weight = [len(rows) / (2 * k) if k else 0.0 for k in of]

    def now(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for i, c, y in rows:
            i = np.append(i, size - 1)
            x = np.append(SCALE * c / max(c.sum(), 1), 1.0)
            w = now(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x * weight[y]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = now(np.arange(size))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, chars: int) -> DataFrame:
    """doc_id, text, y of labelled documents outside the held-out fold, in a fixed order: at most `most` rows and `chars` code points.

    Which and in what order is a hash of the id (and text, label for ties). Rows without an id, or with a label other than 0 and 1, are not used.
    """
    some = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("y"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    return bounded_sample(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), most, chars)  # `most` rows of two numbers


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, chars: int = TRAIN_CHARS, label: str = "quality") -> Model:
    def run(batches):
        for b in slices(batches):
            each = [np.unique(ngrams(t), return_counts=True) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([i.astype(np.int32) for i, _ in each], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in each], pa.list_(pa.int32())), b.column("y")], names=["i", "c", "y"])

    rows = labelled(docs, labels, label, most, chars).mapInArrow(run, "i array<int>, c array<int>, y int").toArrow()
    return train([(np.asarray(i.values), np.asarray(c.values), y.as_py()) for i, c, y in zip(rows["i"], rows["c"], rows["y"], strict=True)])


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs with held_out, score, predicted (1 from `threshold` on).

    Only the whole text counts. Null, empty and blank texts have no n-grams and get the score of the bias;
    repeated rows score alike. A null doc_id is not held out. Columns of the names made are replaced.
    """
    base = keep_columns(docs, MADE)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = base.withColumn("score", F.lit(0.0)).schema

    def run(batches):
        for b in slices(batches):
            found = pa.array([shared.value.score(t) for t in b.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, "score"])

    scored = base.mapInArrow(run, schema)
    return scored.select(*base.columns, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", *MADE)
