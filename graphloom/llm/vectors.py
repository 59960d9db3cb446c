"""Vector tables for the searches: rows that take part, and queries against all rows in blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import written

#: Blocks that vectors are cut into if these have enough rows then (so work spreads), bytes of a block's vectors at most, queries of a block at most.
PARTS, MOST_BYTES, MOST_QUERIES = 24, 64 << 20, 4096


def clean(vectors: DataFrame, zero: bool) -> DataFrame:
    """row, vec_id, embedding of the rows that take part, written out so that row stays what it is.

    Left out: rows without an id, vectors that are null or empty or hold null, NaN or infinity, and with
    zero=False those of zeros only. Vectors of several lengths have no inner products: an error.
    """
    e = F.col("embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0))
    kept = kept.where(F.forall(e, lambda x: F.coalesce(finite(x), F.lit(False))))
    if not zero:
        kept = kept.where(F.exists(e, lambda x: x != 0))
    rows = written(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")
    length = rows.agg(F.min(F.size(e)).alias("least"), F.max(F.size(e)).alias("most")).first()
    if length.least != length.most:
        raise ValueError(f"vectors have {length.least} to {length.most} components")
    return rows


def matrix(table: pa.Table, name: str = "embedding") -> np.ndarray:
    """The list column as an array in double precision."""
    if not table.num_rows:
        return np.empty((0, 0))
    return np.asarray(table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(table.num_rows, -1)


def query_columns() -> list:
    """query_row, query_id, query_vector of rows: new names, as both sides of a cogroup must not share columns."""
    return [F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")]


def search(rows: DataFrame, queries: DataFrame, k: int, best: Callable[[pa.Table, pa.Table], pa.Table], score_type: str, least_rows: int, most_rows: int) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best of all rows but its own.

    Rows and queries are dealt to blocks by a hash of row, and each block of queries meets each block of
    rows (of least_rows or more, if there are as many, and most_rows at most) in a task of its own: best(data, queries) gives the pair's k best a query as q (row), query_id,
    vec_id, score. A row is sent once for each block of queries, and the k best of the blocks are all
    that meets in the end. Ties go to the smaller vec_id.
    """
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    most = max(1, min(most_rows, MOST_BYTES // (8 * (size.dim or 1))))
    db, qb = max(1, min(PARTS, size.n // least_rows), -(-size.n // most)), max(1, -(-queries.count() // min(most, MOST_QUERIES)))
    part = lambda row, n: F.pmod(F.xxhash64(row), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select("*", part("row", db).alias("d"), every(qb).alias("q"))
    asked = queries.select("*", part("query_row", qb).alias("q"), every(db).alias("d"))
    found = data.groupBy("d", "q").cogroup(asked.groupBy("d", "q")).applyInArrow(best, f"q long, query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def result(q, query_id, vec_id, score, kind=pa.float64()) -> pa.Table:
    cat = lambda xs, dtype: np.concatenate(xs) if xs else np.empty(0, dtype)
    return pa.table({"q": pa.array(cat(q, np.int64), pa.int64()), "query_id": pa.array(cat(query_id, np.int64), pa.int64()), "vec_id": pa.array(cat(vec_id, np.int64), pa.int64()), "score": pa.array(cat(score, np.float64), kind)})


def top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, best first, ties to the smaller id."""
    if len(score) > 4 * k:
        bar = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= bar)
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]
