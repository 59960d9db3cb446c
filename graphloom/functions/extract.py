"""From text to entities and relations by rules: defaults where no language model is at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters between words in dictionary matching; letters and digits of any script are words.
_BREAK = r"[^\p{L}\p{N}#_]+"


def mentions(texts: DataFrame, nodes: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_words: int = 3) -> DataFrame:
    """id, mention: the distinct node names that a text has as a run of up to most_words words, without case.

    Runs of words are hashed and met with names in an equi-join, so neither side is tried against the other.
    """
    parts = lambda c: F.filter(F.split(F.lower(c), _BREAK), lambda w: w != "")
    names = nodes.select(F.col("name").alias("mention"), parts("name").alias("n")).where((F.size("n") > 0) & (F.size("n") <= most_words))
    names = names.select("mention", F.size("n").alias("k"), F.array_join("n", " ").alias("run")).distinct()
    counts = sorted(r.k for r in names.select("k").distinct().collect())  # most_words numbers: runs that no name is as long as are not made
    held = texts.select(id_col, F.coalesce(parts(text_col), F.array().cast("array<string>")).alias("w"))
    none = F.array().cast("array<string>")
    of = lambda k: F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: F.array_join(F.slice("w", i, k), " "))).otherwise(none)
    runs = F.array_distinct(F.concat(none, *[F.col("w") if k == 1 else of(k) for k in counts]))
    each = held.select(id_col, F.explode(runs).alias("run")).withColumn("h", F.xxhash64("run"))
    named = names.select("mention", F.col("run").alias("named"), F.xxhash64("run").alias("h"))
    return each.join(named, "h").where(F.col("run") == F.col("named")).select(id_col, "mention").distinct()


#: A capitalised word in any script: a capital and letters, with apostrophes and hyphens inside.
_NAME = r"\p{Lu}\p{M}*(?:['’-]?\p{L}\p{M}*)+"
_NAMES = rf"(?<![\p{{L}}\p{{M}}'’-])({_NAME}(?: {_NAME})*)"


def capitalised(text: Column) -> Column:
    """Runs of capitalised words, distinct and in order of first place: names by form, in any script with capitals."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_NAMES), 1))


def subject_verb_object(text: Column, verbs: list[str] | None = None) -> Column:
    """source, relation, target of "Subject verb Object" with capitalised ends and a verb of the list; without a list any one word in small letters counts as the verb."""
    any_verb = "|".join(verbs) if verbs else r"\p{Ll}[\p{L}\p{M}]*"
    pattern = rf"{_NAMES} ({any_verb}) (?={_NAMES})"
    at = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    return F.transform(F.arrays_zip(at(1).alias("a"), at(2).alias("b"), at(3).alias("c")), lambda x: F.struct(x["a"].alias("source"), x["b"].alias("relation"), x["c"].alias("target")))
