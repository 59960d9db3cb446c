"""Line dedup: drop lines that other documents hold too, except in the document with the smallest id.

Plan: explode normalised lines to 128-bit hashes, count distinct documents per hash (combined before
the shuffle), keep the hashes at or over the threshold, and join them back to line positions. Only
hashes and positions are shuffled by key; texts are shuffled once, to meet their dropped positions.
The hash table is written out first, so the join reads two plain exchanges: a hash that a third of
all documents hold is then split by adaptive execution, and a small table is broadcast by its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import SPACE, Written, ascii_lower, hashed, keep_columns, row_keys, table, written

MADE = ["n_lines", "n_dropped"]


def _keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """r1, r2 (row), doc_id, pos, h1, h2 (line) for each line whose key is long enough."""
    text = F.coalesce(F.col("text"), F.lit(""))
    r1, r2 = row_keys(F.col("doc_id"), text)
    # the trimmed line is a column of the generator, so it is made once, not for each use
    keys = F.transform(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)))
    keyed = docs.select(F.col("doc_id"), r1.alias("r1"), r2.alias("r2"), F.posexplode(keys).alias("pos", "key")).where(F.char_length("key") >= min_chars)
    h1, h2 = row_keys(ascii_lower(F.col("key")))
    return keyed.select("r1", "r2", "doc_id", "pos", h1.alias("h1"), h2.alias("h2"))


def shared_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """h1, h2, owner (smallest doc_id) of each line key that min_docs or more documents hold.

    Rows with the same doc_id are one document; all rows without an id are one more, after all others.
    """
    keys = _keys(docs, min_chars)
    if min_docs == 2:  # two distinct ids: smallest and largest differ, no need to list them
        found = keys.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.bool_or(F.col("doc_id").isNull()).alias("nameless"))
        return found.where((F.col("owner") < F.col("last")) | (F.col("nameless") & F.col("owner").isNotNull())).select("h1", "h2", "owner")
    found = keys.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("owner"))
    return found.where(F.col("n") >= min_docs).select("h1", "h2", "owner")


def dedup_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    r"""docs with shared lines taken out of text, and n_lines (before) and n_dropped.

    A text is cut at \n. A line's key is the line without white space (space, \t to \r) at its ends,
    A-Z in lower case. Keys of min_chars code points or more that min_docs or more documents hold lose
    all their lines but those in the smallest doc_id that holds them; other lines stay as they are, in
    order. A null or empty text is one empty line and comes back as "". Repeated rows (same id and text)
    each come back, alike. A null doc_id ranks after all ids. Columns of the names made are replaced.
    """
    shared = written(shared_lines(docs.select("doc_id", "text"), min_docs, min_chars), "shared-lines")
    dropped = _keys(docs.select("doc_id", "text"), min_chars).join(shared, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("owner"))).groupBy("r1", "r2").agg(F.collect_set("pos").alias("__drop")).withColumnsRenamed({"r1": "__d1", "r2": "__d2"})
    dropped = hashed(Written(dropped, "dropped-lines"))  # positions are few beside texts, which then stream past them unsorted
    text = F.coalesce(F.col("text"), F.lit(""))
    r1, r2 = row_keys(F.col("doc_id"), text)
    kept = keep_columns(docs, MADE)
    got = kept.withColumns({"__r1": r1, "__r2": r2}).join(dropped, (F.col("__r1") == F.col("__d1")) & (F.col("__r2") == F.col("__d2")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    new = F.when(F.col("__drop").isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("__lines"), i)), "\n"))
    got = got.withColumn("__lines", F.split(text, "\n", -1))
    return got.select(*[new.alias(c) if c == "text" else F.col(c) for c in kept.columns], F.size("__lines").cast("long").alias("n_lines"), F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"))


def query(spark, sf_dir) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
f AS (SELECT k.r, k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.owner AS gone
      FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY r, doc_id
"""
