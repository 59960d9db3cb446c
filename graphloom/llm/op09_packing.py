"""Packing: optimal length buckets, and token-budget batches inside each bucket.

The global histogram of lengths is counted on the cluster (combined before the shuffle) and only the
histogram, bounded by `Bins`, goes to the driver. Dynamic programming over it chooses the bucket
boundaries with the least padding. Batches need a dense numbering of each bucket's documents; it comes
from many small shards of a bucket (a hash of the row), each numbered alone, plus the counts of the
shards before it, so no bucket meets in one task however many rows it has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import count_words, keep_columns, row_keys, table, written

MADE = ["n_tokens", "bucket", "bucket_tokens", "batch", "slot"]


@dataclass(frozen=True)
class Bins:
    """Lengths up to `exact` have a bin each, longer ones `per_octave` bins a doubling (relative width 1 / per_octave).

    At most exact + 64 * per_octave bins exist, so the histogram fits the driver for any input.
    """

    exact: int = 4096
    per_octave: int = 1024

    def of(self, n):
        """The bin of a length, as a column: the length itself, or the length cut to the octave's step."""
        octave = F.greatest(F.floor(F.log2(F.greatest(n, F.lit(1)) / F.lit(float(self.exact)))).cast("int"), F.lit(0))
        step = F.pow(F.lit(2.0), octave) * F.lit(self.exact / self.per_octave)
        return F.when(n <= self.exact, n).otherwise((F.floor(n / step) * step).cast("long"))


def boundaries(lengths, counts, sums, buckets: int) -> list[int]:
    """The upper ends of at most `buckets` buckets with the least padding.

    lengths: the longest of each bin, ascending; counts and sums: its documents and tokens. Putting the
    bins i+1..j in one bucket pads to lengths[j]: lengths[j] * count - sum. The cost has the quadrangle
    property, so the best split moves right with j and each layer is solved by divide and conquer,
    a whole level of it at a time.
    """
    x = np.asarray(lengths, dtype=np.float64)
    if not len(x):
        return []
    c = np.concatenate([[0.0], np.cumsum(np.asarray(counts, dtype=np.float64))])
    s = np.concatenate([[0.0], np.cumsum(np.asarray(sums, dtype=np.float64))])
    n = len(x)
    cost = lambda i, j: x[j - 1] * (c[j] - c[i]) - (s[j] - s[i])  # noqa: E731  bins i..j-1
    best = np.concatenate([[0.0], [cost(0, j) for j in range(1, n + 1)]])
    back = []
    for _ in range(1, min(buckets, n)):
        new, arg = best.copy(), np.full(n + 1, -1)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, left, right = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(left, min(right, j - 1) + 1)
            tried = best[i] + cost(i, j)
            k = int(np.argmin(tried))
            if tried[k] < new[j]:
                new[j], arg[j] = tried[k], i[k]
            at = int(i[k])
            todo += [(lo, j - 1, left, at), (j + 1, hi, at, right)]
        back.append(arg)
        best = new
    ends, j = [], n
    for arg in reversed(back):
        if arg[j] >= 0:
            ends.append(j)
            j = int(arg[j])
    ends.append(j)
    return sorted({int(x[e - 1]) for e in ends if e > 0})


def histogram(sized: DataFrame, bins: Bins) -> list:
    """Rows (longest, count, sum) of the bins in order; bounded by `bins`."""
    return sized.groupBy(bins.of(F.col("n_tokens")).alias("bin")).agg(F.max("n_tokens").alias("longest"), F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("sum")).orderBy("bin").collect()


def pack(docs: DataFrame, buckets: int = 12, budget: int = 16384, bins: Bins = Bins(), shard_rows: int = 2048, shard_tokens: int = 1 << 20, tokens: str | None = None) -> DataFrame:
    """docs with n_tokens, bucket (from 0, shortest first), bucket_tokens (padded length), batch, slot.

    n_tokens is the column `tokens`, or else the number of words (null text: 0). A batch of a bucket
    holds max(1, budget // bucket_tokens) documents, padded to bucket_tokens; all batches of a bucket
    but its last are full. A document longer than the budget is alone in its batch; nothing is cut or
    dropped. (bucket, batch, slot) is unique. Numbers follow a hash of the row and, among rows that are alike in
    id and text, any order, which gives the same batches. Columns of the names made are replaced.
    """
    base = keep_columns(docs, MADE)
    n = F.coalesce(F.col(tokens).cast("long"), F.lit(0).cast("long")) if tokens else count_words(F.col("text"))
    r1, r2 = row_keys(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))
    # inline() keeps the optimizer from counting the words again wherever n_tokens is used
    rows = base.select("*", F.inline(F.array(F.struct(n.alias("n_tokens"), r1.alias("__r1"), r2.alias("__r2")))))
    sized = written(rows.select("n_tokens", "__r1"), "pack-lengths")  # counted once, read for the histogram and for the shards
    found = histogram(sized, bins)
    ends = boundaries([r.longest for r in found], [r.n for r in found], [r["sum"] for r in found], buckets)
    if not ends:
        return rows.drop("__r1", "__r2").selectExpr("*", "0 AS bucket", "0L AS bucket_tokens", "0L AS batch", "0L AS slot")
    docs_in, tokens_in = [0] * len(ends), [0] * len(ends)
    for r in found:
        k = int(np.searchsorted(ends, r.longest))
        docs_in[k] += r.n
        tokens_in[k] += r["sum"]
    # a shard is a task's share: about shard_rows documents, fewer where they are long
    shards = [max(1, -(-k // shard_rows), -(-t // shard_tokens)) for k, t in zip(docs_in, tokens_in, strict=True)]
    fits = [max(1, budget // max(e, 1)) for e in ends]
    at = lambda xs, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in xs]), F.col("bucket") + 1)

    def placed(df: DataFrame) -> DataFrame:
        """bucket, and shard of it"""
        bucket = sum((F.col("n_tokens") > e).cast("int") for e in ends[:-1]) + F.lit(0)
        return df.withColumn("bucket", bucket).withColumn("__shard", F.pmod(F.col("__r1"), at(shards, "long")))

    counts = placed(sized).groupBy("bucket", "__shard").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("bucket").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.select("bucket", "__shard", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("__start")), "pack-shards")
    inside = Window.partitionBy("bucket", "__shard").orderBy("__r1", "__r2")
    numbered = placed(rows).withColumn("__row", F.row_number().over(inside) - 1).join(starts, ["bucket", "__shard"])
    number = F.col("__row") + F.col("__start")
    fit = at(fits, "long")
    return numbered.select(*base.columns, "n_tokens", "bucket", at(ends, "long").alias("bucket_tokens"), F.floor(number / fit).cast("long").alias("batch"), (number % fit).cast("long").alias("slot"))


def query(spark, sf_dir) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", *MADE)
