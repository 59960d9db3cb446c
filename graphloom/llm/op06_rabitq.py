"""Nearest neighbours by randomly rotated one-bit codes, with error bounds that choose what is reranked.

Each vector is made a unit vector, padded with zeros to LEAST_BITS components (more, if it has more), rotated by
a fixed random rotation, and kept as the signs of its components in packed bits with two correction scalars: its norm and
the inner product c of the unit vector with its own code. For a query, quantised to four bits a component, the inner
product with all codes of a block comes from bit planes and bit counts; divided by c and scaled by the norms it is
an unbiased estimate, off by at most EPSILON standard errors sqrt((1 - c^2) / c^2 / (D - 1)) for all but few.
Every row has a code. The 4 k rows of a block with the best estimates are scored first, and their k-th score is the bar; of all
others only rows whose upper bound reaches the bar are reranked with their original vectors, in double precision.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import table
from graphloom.llm.vectors import clean, matrix, query_columns, result, search, top

#: Standard errors within which estimates count as bounded: 3 loses one pair in about 700 near the bar.
EPSILON = 3.0
SEED, PLANES = 11, 4
#: Bits of a code at least: bounds are as wide as one over the root of the bits.
LEAST_BITS = 512
#: Rows of a block at least (if there are as many) and at most: the k best of each block meet in the end, so large blocks hand on few.
LEAST_ROWS, MOST_ROWS = 4096, 65536


@functools.lru_cache(maxsize=2)
def rotation(dim: int) -> np.ndarray:
    """A random rotation of `dim` components padded to LEAST_BITS and whole 64-bit words: the same everywhere."""
    wide = max(LEAST_BITS, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((wide, wide)))
    return (q * np.sign(np.diag(r)))[:, :dim]


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 as 64-bit words."""
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (n x words), norms, and inner products of the rotated unit vectors with their codes."""
    norm = np.linalg.norm(x, axis=1)
    y = (x / norm[:, None]) @ rotation(x.shape[1]).T
    return _pack((y > 0).astype(np.uint8)), norm, np.abs(y).sum(axis=1) / np.sqrt(y.shape[1])


def coded(rows: DataFrame) -> DataFrame:
    """rows with code, norm, own: one pass, no shuffle."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                code, norm, own = encode(matrix(pa.Table.from_batches([b])))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(own)], names=[*b.schema.names, "code", "norm", "own"])

    schema = rows.withColumns({"code": F.lit(b""), "norm": F.lit(0.0), "own": F.lit(0.0)}).schema
    return rows.mapInArrow(run, schema)


def estimates(code: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products (queries x codes) of rotated unit queries with the codes' unit vectors, from bit planes."""
    wide = queries.shape[1]
    low, high = queries.min(axis=1, keepdims=True), queries.max(axis=1, keepdims=True)
    step = np.maximum((high - low) / ((1 << PLANES) - 1), 1e-12)
    level = np.rint((queries - low) / step).astype(np.uint8)
    inner = np.zeros((len(queries), len(code)))
    for p in range(PLANES):
        plane, both = _pack((level >> p) & 1), np.zeros(inner.shape, np.uint32)
        for w in range(code.shape[1]):
            both += np.bitwise_count(plane[:, w, None] & code[None, :, w])
        inner += both * float(1 << p)
    ones = np.bitwise_count(code).sum(axis=1).astype(np.float64)
    whole = level.sum(axis=1, keepdims=True) * step + wide * low
    return (2 * (step * inner + low * ones[None, :]) - whole) / np.sqrt(wide)


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with a query in double precision, summed in the order of the components."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * q[d]
    return total


def chosen(guess: np.ndarray, error: np.ndarray, x: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Positions of the rows whose estimate and error reach the k-th best exact score of the 4 k best estimates; -inf is no row."""
    first = np.argpartition(guess, -min(4 * k, len(guess)))[-min(4 * k, len(guess)) :]
    first = first[np.isfinite(guess[first])]
    bar = np.partition(x[first] @ q, len(first) - k)[len(first) - k] if len(first) >= k else -np.inf
    return np.flatnonzero((guess + error >= bar - 1e-9 * abs(bar)) & np.isfinite(guess))


def nearest(data: pa.Table, asked: pa.Table, k: int, epsilon: float = EPSILON) -> pa.Table:
    """The k nearest of a block for each of a block of queries."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    if not data.num_rows or not asked.num_rows:
        return result(*out)
    x, ids, own_row = matrix(data), data.column("vec_id").to_numpy(), data.column("row").to_numpy()
    code = np.frombuffer(b"".join(data.column("code").to_pylist()), dtype=np.uint64).reshape(len(x), -1)
    norm, own = data.column("norm").to_numpy(), data.column("own").to_numpy()
    error = norm * np.sqrt(np.maximum(1 - own**2, 0)) / own * epsilon / np.sqrt(max(code.shape[1] * 64 - 1, 1))
    qx, qid, qrow = matrix(asked, "query_vector"), asked.column("query_id").to_numpy(), asked.column("query_row").to_numpy()
    qnorm = np.linalg.norm(qx, axis=1)
    turned = (qx / qnorm[:, None]) @ rotation(x.shape[1]).T
    for at in range(0, len(qx), 32):
        guess = estimates(code, turned[at : at + 32]) * (norm / own)[None, :] * qnorm[at : at + 32, None]
        guess[qrow[at : at + 32, None] == own_row[None, :]] = -np.inf
        for j, g in enumerate(guess, at):
            some = chosen(g, error * qnorm[j], x, qx[j], k)
            scores = exact(x[some], qx[j])
            best = top(scores, ids[some], k)
            for part, value in zip(out, (np.full(len(best), qrow[j]), np.full(len(best), qid[j]), ids[some[best]], scores[best]), strict=True):
                part.append(value)
    return result(*out)


def nearest_neighbours(vectors: DataFrame, every: int = 20, k: int = 20, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest by inner product of each row whose vec_id is divisible by `every`.

    All rows but the query's own are candidates. Rows that take part: see clean(), zero vectors don't.
    Repeated rows are rows of their own: each is a candidate, and a query if its id is. score is
    the inner product of the original vectors in double precision. Fewer than k candidates: all.
    """
    rows = coded(clean(vectors, zero=False))
    queries = rows.where(F.col("vec_id") % every == 0).select(*query_columns())
    return search(rows, queries, k, lambda data, asked: nearest(data, asked, k, epsilon), "double", LEAST_ROWS, MOST_ROWS)


def query(spark, sf_dir) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


SQL = r"""
WITH v AS (SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.row, q.vec_id AS query_id, v.vec_id, list_inner_product(v.e, q.e) AS score
      FROM v q JOIN v ON q.row <> v.row WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
