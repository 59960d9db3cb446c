"""Scoring candidates and keeping the best of each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_index_scores(candidates: DataFrame, scores: DataFrame, key: str, default: float | None = None) -> DataFrame:
    """Scores of a reply (key, scores: map of 1-based index text to number) joined to candidates (key, idx); indexes outside the list fall away, others get the default."""
    each = scores.select(key, F.explode("scores").alias("k", "score")).select(key, F.col("k").try_cast("int").alias("idx"), "score").where(F.col("idx").isNotNull())
    one = each.groupBy(key, "idx").agg(F.max("score").alias("score"))
    found = candidates.join(one, [key, "idx"], "left")
    return found if default is None else found.withColumn("score", F.coalesce("score", F.lit(default)))


def with_name_scores(candidates: DataFrame, scores: Column, name: Column, default: float = 0.0) -> DataFrame:
    """The score of the first map entry whose key has the name in it, without case; default if none has."""
    hits = F.filter(F.map_entries(scores), lambda e: F.contains(F.lower(e["key"]), F.lower(name)))
    return candidates.withColumn("score", F.coalesce(F.get(hits, 0)["value"], F.lit(default)))


def top_n(candidates: DataFrame, by: list[str], n: int, score: str = "score", idx: tuple[str, ...] = ("idx",)) -> DataFrame:
    """Per source the n best: highest score first (none counts as 0), then discovery order. Adds rank.

    Each task keeps its n best of a source before the shuffle, so a hub's candidates never meet.
    """
    order = Window.partitionBy(*by).orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), *idx)
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def first_n(candidates: DataFrame, by: list[str], n: int, idx: tuple[str, ...] = ("idx",)) -> DataFrame:
    """Per source the first n in discovery order, unscored."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*idx))).where(F.col("rank") <= n)


def bounded(paths: DataFrame, n: int, score: str = "confidence", seq: str = "seq", faithful: bool = False) -> DataFrame:
    """The n paths with the highest score (ties: first come).

    faithful: those with the lowest score (ties: last come), which is what a heap of negated scores that
    drops its minimum keeps.
    """
    came = [seq, *[c for c in ("path_id",) if c in paths.columns]]
    if faithful:
        return paths.orderBy(F.col(score).asc(), *[F.col(c).desc() for c in came]).limit(n)
    return paths.orderBy(F.col(score).desc(), *[F.col(c).asc() for c in came]).limit(n)


def numbered(rows: DataFrame, by: list[str], line: Column, idx: str = "idx") -> DataFrame:
    """by, text: lines of a group as "1. ..." joined by line feeds, in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), line.alias("t"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(pairs, lambda p: F.concat(p["i"].cast("string"), F.lit(". "), p["t"])), "\n").alias("text"))
