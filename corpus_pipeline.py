"""The corpus pipeline: documents are filtered, lose repeated lines, lose near copies, are mixed by source and packed.

Each stage takes all that the one before kept, written as Parquet and read again, and returns the columns
of documents; the last adds the packing to them. run() gives the last stage's rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import op02_lines, op03_simhash, op07_mixing, op08_quality, op09_packing
from graphloom.llm.common import table, written


#: Columns that stages read; all others go through them under names that no stage uses, so none is lost to a result of the same name.
READ = ("doc_id", "text", "source")


def _through(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], more: tuple[str, ...] = ()) -> DataFrame:
    """The columns of docs of what a stage makes of them, and `more` of its own, which replace columns of docs of the same name."""
    held = {c: f"__held{k}" for k, c in enumerate(docs.columns) if c not in READ}
    out = stage(docs.withColumnsRenamed(held))
    own = [c for c in docs.columns if c.lower() not in more]
    return out.select(*[F.col(held.get(c, c)).alias(c) for c in own], *more)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labels outside the held-out fold, predicts to be good.

    Null and empty texts score alike, by the model's bias. Repeated rows stay or go together. Without labels
    every score is 0.5, which is good. No documents: none.
    """
    model = op08_quality.fit(docs, table(spark, sf_dir, "labels"))
    return _through(docs, lambda d: op08_quality.score(d, model).where(F.col("predicted") == 1))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; lines that two or more documents hold stay in the one with the smallest id, and n_chars is the new text's length.

    A null text becomes "", an empty one stays. Repeated rows (same id) are one document and lose the same lines. A null id
    ranks after all ids.
    """
    out = _through(docs, op02_lines.dedup_lines)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are similar (0.8): that with the smallest id, a null id being the largest.

    Null, empty and blank texts are one group. Of rows that are alike in id and text one stays.
    """
    return _through(docs, op03_simhash.one_of_each)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 times, documents without words not at all.

    A null source is a source of its own. Rows that are alike in id and text are taken alike.
    """

    def taken(d: DataFrame) -> DataFrame:
        times = F.floor(F.col("taken") / F.nullif("size", F.lit(0))).cast("int")
        copies = F.explode(F.array_repeat(F.lit(0), F.coalesce(times, F.lit(0))))
        return op07_mixing.mix(d).select("*", copies.alias("__copy"))

    return _through(docs, taken)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with n_tokens, bucket, bucket_tokens, batch and slot, which replace columns of these names. Null and empty texts have no tokens; repeated rows have slots of their own."""
    return _through(docs, op09_packing.pack, tuple(op09_packing.MADE))


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", without_near_copies),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]

#: The classifier, the fingerprints and the packing can't be said in SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents, with all their columns. An empty table gives none."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
