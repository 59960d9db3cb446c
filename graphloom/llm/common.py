"""What the operators share: tables, the shared folder, row keys and Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.shared import Written, shared_dir, written

__all__ = ["SPACE", "WORD", "Written", "ascii_lower", "bounded_sample", "count_words", "hashed", "held_out", "keep_columns", "row_keys", "shared_dir", "slices", "table", "written"]

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay, unlike lower(), which is quicker and does for text without any."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_keys(*cols: Column) -> tuple[Column, Column]:
    """A 128-bit key of the values, never null."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(0x9E3779B9), *cols)


#: Bytes on disk of a join's side that a task may hold in a hash table; in memory they are several times as many.
HASHED = 32 << 20


def hashed(side: Written) -> DataFrame:
    """A written frame with the hint to meet the other side in hash tables, so that the other need not be sorted, if a task's share of it is small; a larger one is left to a sort, which can spill."""
    tasks = int(side.spark.conf.get("spark.sql.shuffle.partitions"))
    return side.df.hint("shuffle_hash") if side.size() <= HASHED * tasks else side.df


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model may learn from; a null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def bounded_sample(rows: DataFrame, most: int, chars: int) -> DataFrame:
    """rows (with text) cut to the first `most` by a hash of all columns, and of these to `chars` code points in all: a text that does not fit any more is left out.

    Sizes and hashes alone are put in order; texts are read again and don't meet before they are chosen. Rows that are alike count once. The result is in the hash's order.
    """
    r1, r2 = row_keys(*[F.col(c) for c in rows.columns])
    keyed = rows.withColumns({"__s1": r1, "__s2": r2})
    first = keyed.select("__s1", "__s2", F.coalesce(F.char_length("text"), F.lit(0)).alias("n")).distinct().orderBy("__s1", "__s2").limit(most).collect()
    chosen, left = [], chars
    for r in first:
        if r.n <= left:
            chosen.append((r[0], r[1]))
            left -= r.n
    few = rows.sparkSession.createDataFrame(chosen, "__s1 long, __s2 long")  # `most` rows of two numbers
    return keyed.join(F.broadcast(few), ["__s1", "__s2"]).dropDuplicates(["__s1", "__s2"]).orderBy("__s1", "__s2").select(*rows.columns)


def keep_columns(df: DataFrame, made: list[str]) -> DataFrame:
    """df without columns that have the name of a result (the result replaces them)."""
    return df.drop(*[c for c in df.columns if c.lower() in {m.lower() for m in made}])


def slices(batches, rows: int = 256):
    """Arrow batches cut into small ones, so that few texts at a time become Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
