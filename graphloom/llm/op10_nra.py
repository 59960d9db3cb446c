"""Exact top-k search by no-random-access aggregation over sorted lists.

Vectors are integers: floor(256 x). A block of rows has a sorted list for each component. A query reads all lists together
from the ends that its own components' signs make the best, a fixed number of places a round. What a row has shown
adds up; a list that has not shown it adds at most the list's frontier and at least its far end, so each row has an
upper and a lower bound. The k-th best lower bound is the bar. A query stops reading when few rows but its k best have an upper
bound that reaches the bar: no other can qualify. Only then are rows looked up: the few that are left are resolved, and the k best scores are exact.
Sorted lists are shared by all queries of a block, so a round is array work for the queries that still read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import table
from graphloom.llm.vectors import clean, matrix, query_columns, result, search, top

SCALE = 256
#: Places that a round reads of each list, queries that read together, and rows for each of the k best that may be left to resolve.
PLACES, TOGETHER, LEFT = 128, 64, 32
#: Rows of a block at least (if there are as many) and at most: rounds grow with a block's rows, and so does a round's work.
LEAST_ROWS, MOST_ROWS = 2048, 8192


class Lists:
    """A block's rows as integers, and a sorted list for each component."""

    def __init__(self, v: np.ndarray):
        self.n, self.dim = v.shape
        self.order = np.argsort(v, axis=0, kind="stable").T.copy()  # ascending; read from either end
        self.sorted = np.take_along_axis(v, self.order.T, axis=0).T.copy()


class Reading:
    """What some queries (rows of q) have read of the lists, all to the same depth."""

    def __init__(self, lists: Lists, q: np.ndarray):
        self.lists, self.depth = lists, 0
        #: The positive components, which read from the high end, and the negative ones, which read from the low end.
        self.parts = np.concatenate([np.maximum(q, 0).T, np.minimum(q, 0).T])
        # which rows each list has shown from its high end and from its low end, and the values
        self.seen = np.zeros((lists.n, 2 * lists.dim), dtype=q.dtype)
        self.shown = np.zeros_like(self.seen)

    def further(self, places: int) -> None:
        """Reads so many places more of each list, from either end."""
        x = self.lists
        lo, hi = self.depth, min(self.depth + places, x.n)
        for side, at in ((0, slice(x.n - hi, x.n - lo)), (1, slice(lo, hi))):
            place = x.order[:, at], side * x.dim + np.arange(x.dim)[:, None]
            self.seen[place] = 1
            self.shown[place] = x.sorted[:, at]
        self.depth = hi

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores: what rows have shown, and for each list that hasn't shown them its far end, or its frontier."""
        x, sums, ends = self.lists, self.shown @ self.parts, []
        if self.depth >= x.n:
            return sums, sums
        for high, low in ((x.sorted[:, 0], x.sorted[:, -1]), (x.sorted[:, x.n - self.depth], x.sorted[:, self.depth - 1])):
            rest = np.concatenate([high, low])[:, None] * self.parts
            ends.append(sums + rest.sum(axis=0)[None, :] - self.seen @ rest)
        return ends[0], ends[1]

    def only(self, queries: np.ndarray) -> None:
        """Goes on with some of the queries."""
        self.parts = self.parts[:, queries]


def read(lists: Lists, q: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, int]]:
    """For each query (rows of q) the rows that can be among its k best when it stops reading, and the depth at which it did. own: rows that a query may not find.

    While far more rows can qualify than may be left, the next rounds read without a look at the bounds.
    """
    found: list[tuple[np.ndarray, int]] = [(np.empty(0, np.int64), 0)] * len(q)
    reading, left, blind = Reading(lists, q), np.arange(len(q)), 0
    while len(left):
        reading.further(PLACES)
        if blind and reading.depth < lists.n:
            blind -= 1
            continue
        lower, upper = reading.bounds()
        stay, fewest = [], lists.n
        for j, query in enumerate(left):
            free = ~own[:, query]
            some = lower[free, j]
            bar = np.partition(some, len(some) - k)[len(some) - k] if len(some) >= k else None
            able = np.flatnonzero(free & (upper[:, j] >= bar)) if bar is not None else np.flatnonzero(free)
            if len(able) <= LEFT * k or reading.depth >= lists.n:
                found[query] = (able, reading.depth)
            else:
                stay.append(j)
                fewest = min(fewest, len(able))
        blind = max(0, (fewest // (LEFT * k)).bit_length() - 1)
        if len(stay) < len(left):
            reading.only(np.array(stay, dtype=np.int64))
            left = left[stay]
    return found


def best_scores(data: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The k best of a block for each of a block of queries."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    if not data.num_rows or not asked.num_rows:
        return result(*out, pa.int64())
    v, qv = integers(np.floor(SCALE * matrix(data)), np.floor(SCALE * matrix(asked, "query_vector")))
    ids, rows = data.column("vec_id").to_numpy(), data.column("row").to_numpy()
    qid, qrow = asked.column("query_id").to_numpy(), asked.column("query_row").to_numpy()
    lists = Lists(v)
    for a in range(0, len(qv), TOGETHER):
        q = qv[a : a + TOGETHER]
        for j, (some, _) in enumerate(read(lists, q, rows[:, None] == qrow[None, a : a + TOGETHER], k)):
            scores = v[some] @ q[j]
            best = top(scores, ids[some], k)
            for part, value in zip(out, (np.full(len(best), qrow[a + j]), np.full(len(best), qid[a + j]), ids[some[best]], scores[best].astype(np.int64)), strict=True):
                part.append(value)
    return result(*out, pa.int64())


def integers(v: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as the narrowest type in which all sums of products are exact; Python's integers, if no other is."""
    most = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * v.shape[1] * 2
    if most < 2**53:
        kind = np.float32 if most < 2**24 else np.float64
        return v.astype(kind), q.astype(kind)
    return tuple(np.array([[int(c) for c in r] for r in x], dtype=object) for x in (v, q))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each row whose vec_id is divisible by `every`.

    All rows but the query's own are candidates. Rows that take part: see clean(), zero vectors do.
    Repeated rows are rows of their own: each is a candidate, and a query if its id is. Ties go to the
    smaller vec_id. A score over 64 bits is an error. Fewer than k candidates: all.
    """
    rows = clean(vectors, zero=True)
    queries = rows.where(F.col("vec_id") % every == 0).select(*query_columns())
    return search(rows, queries, k, lambda data, asked: best_scores(data, asked, k), "long", LEAST_ROWS, MOST_ROWS)


def query(spark, sf_dir) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = r"""
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.row, q.vec_id AS query_id, v.vec_id, list_inner_product(v.e, q.e)::BIGINT AS score
      FROM v q JOIN v ON q.row <> v.row WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
