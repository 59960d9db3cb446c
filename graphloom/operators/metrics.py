"""Figures and tables over the paths of an answer. Paths are rows with triples (schema.TRIPLE) and confidence."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.columns import as_share


class Timings:
    """Seconds of the steps of a run, in order: with timings.step("linking"): ..."""

    def __init__(self) -> None:
        self.steps: list[tuple[str, float]] = []

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.steps.append((name, time.perf_counter() - began))

    def table(self, spark: SparkSession) -> DataFrame:
        """n, step, seconds, and the whole run as the last row."""
        rows = [*self.steps, ("total", sum(s for _, s in self.steps))]
        return spark.createDataFrame([(n, *r) for n, r in enumerate(rows, 1)], "n int, step string, seconds double")


def unique_entities(paths: DataFrame) -> DataFrame:
    """name: the distinct subjects and objects of all triples."""
    each = paths.select(F.explode("triples").alias("t")).select(F.explode(F.array("t.subject", "t.object")).alias("name"))
    return each.where(F.col("name").isNotNull()).distinct()


def average_confidence(paths: DataFrame) -> DataFrame:
    """avg_confidence over paths that have one above 0 (percentages as shares); 0 if none has."""
    c = as_share(F.col("confidence"))
    return paths.agg(F.coalesce(F.avg(F.when(c > 0, c)), F.lit(0.0)).alias("avg_confidence"))


def panel(paths: DataFrame) -> DataFrame:
    """success, n_paths, n_entities, avg_confidence in one row, from one scan of the paths."""
    c = as_share(F.col("confidence"))
    names = F.explode_outer(F.flatten(F.transform(F.coalesce("triples", F.array()), lambda t: F.array(t["subject"], t["object"]))))
    each = paths.withColumn("__c", c).select("path_id", "__c", names.alias("name"))
    per = each.groupBy("path_id").agg(F.first("__c").alias("c"), F.collect_set("name").alias("names"))
    counts = per.agg(F.count(F.lit(1)).alias("n_paths"), F.coalesce(F.avg(F.when(F.col("c") > 0, F.col("c"))), F.lit(0.0)).alias("avg_confidence"))
    distinct = per.select(F.explode("names").alias("name")).agg(F.count_distinct("name").alias("n_entities"))
    return counts.join(F.broadcast(distinct)).select((F.col("n_paths") > 0).alias("success"), "n_paths", "n_entities", "avg_confidence")  # one row each


def triple_table(paths: DataFrame) -> DataFrame:
    """path_id, step, subject, relation, object with defaults for what is missing; a path without triples is one row."""
    each = paths.select("path_id", F.posexplode_outer("triples").alias("step", "t"))
    return each.select("path_id", F.coalesce("step", F.lit(0)).alias("step"), F.coalesce("t.subject", F.lit("Unknown")).alias("subject"), F.coalesce("t.predicate", F.lit("relates to")).alias("relation"), F.coalesce("t.object", F.lit("Unknown")).alias("object"))


def log_view(logs: DataFrame, level: str = "ALL") -> DataFrame:
    return logs if level == "ALL" else logs.where(F.col("level") == level)


def log_levels(logs: DataFrame) -> DataFrame:
    return logs.select("level").distinct().orderBy("level")


def history_view(history: DataFrame) -> DataFrame:
    """Newest first."""
    return history.orderBy(F.desc("timestamp"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree of nodes with an edge, from one shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))
