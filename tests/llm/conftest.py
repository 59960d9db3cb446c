import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, source)."""

    def make(*rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls, empty and blank texts, a long text, ties, and rows that repeat."""
    long_ = " ".join(f"word{k % 977}" for k in range(60_000))
    return docs_of((1, None), (2, ""), (3, " \n\t "), (4, long_), (5, "same text here now and again"), (5, "same text here now and again"), (6, "same text here now and again"), (None, "same text here now and again"), (None, None), (7, "one"), (8, "a\nb\n\nc", None))


@pytest.fixture(scope="session")
def clashing(spark):
    """A frame with columns that have the names of results and of helpers, some null."""

    def make(df, *names):
        from pyspark.sql import functions as F

        for n in names:
            df = df.withColumn(n, F.lit("old") if n != "row" else F.lit(None).cast("string"))
        return df

    return make
