"""Steps from a frontier over a graph's edges. All are equi-joins; ids alone move, properties are joined at the end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.columns import not_visited, relation_label
from graphloom.graph import PropertyGraph
from graphloom.shared import written


#: The order in which candidates are found: outgoing edges, then incoming ones, by id.
DISCOVERY = ("is_incoming", "edge_id")


def candidates(graph: PropertyGraph, frontier: DataFrame, visited: Column | None = None, ids: list[str] | None = None, numbered: bool = True) -> DataFrame:
    """frontier (with last_id) x its edges: edge_id, type, there, is_incoming, and idx, the 1-based place in discovery order.

    Outgoing edges come first, then incoming, each by edge id. visited: an array column of the frontier whose
    nodes are not stepped to. The frontier's key for idx is its path_id, or last_id where it has none.
    ids: the frontier's last_ids, where they are few and known, so that only their edges are read. numbered=False
    leaves idx out: it sorts all edges of a node, which a hub's are too many for; prune by DISCOVERY instead.
    """
    found = frontier.join(graph.both_ways() if ids is None else graph.around(ids), F.col("last_id") == F.col("here")).drop("here")
    if visited is not None:
        found = found.where(not_visited(visited, F.col("there")))
    if not numbered:
        return found
    key = "path_id" if "path_id" in frontier.columns else "last_id"
    return found.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy(*DISCOVERY)))


def by_relation_ids(graph: PropertyGraph, frontier: DataFrame, relation_ids: list[str], visited: Column | None = None, faithful: bool = False) -> DataFrame:
    """Distinct (last_id, edge_id, next_id, is_incoming) over given edges, either direction.

    faithful: over an incoming edge the step stays where it is, as if the start node were what the edge leads to.
    """
    found = frontier.join(graph.both_ways().where(F.col("edge_id").isin(relation_ids)), F.col("last_id") == F.col("here"))
    if visited is not None:
        found = found.where(not_visited(visited, F.col("there")))
    there = F.when(F.col("is_incoming"), F.col("here")).otherwise(F.col("there")) if faithful else F.col("there")
    return found.select("last_id", "edge_id", there.alias("next_id"), "is_incoming").distinct()


def simple_paths(graph: PropertyGraph, start: DataFrame, hops: int, limit: int | None = None) -> DataFrame:
    """Directed paths of 1..hops edges from the ids of start, no edge twice in a path: start_id, end_id, edge_ids, types, length.

    limit keeps that many of the shortest, by (length, edge ids): a total order. Longer paths are then made only
    where there are too few shorter ones. Edges are made once, however many hops there are.
    """
    e = graph.edges.select(F.col("id").alias("e"), F.col("src").alias("s"), F.col("dst").alias("d"), F.col("type").alias("t"))
    e = written(e, "edges") if hops > 1 and limit is None else e
    now = start.select(F.col("id").alias("start_id")).join(e, F.col("start_id") == F.col("s")).select("start_id", F.col("d").alias("end_id"), F.array("e").alias("edge_ids"), F.array("t").alias("types"))
    kept: list[DataFrame] = []
    left = limit
    for hop in range(1, hops + 1):
        if hop > 1:
            now = now.join(e, F.col("end_id") == F.col("s")).where(~F.array_contains("edge_ids", F.col("e")))
            now = now.select("start_id", F.col("d").alias("end_id"), F.array_append("edge_ids", F.col("e")).alias("edge_ids"), F.array_append("types", F.col("t")).alias("types"))
        if left is None:
            kept.append(now)
            continue
        best = written(now.orderBy(F.array_join("edge_ids", "_")).limit(left), "paths")
        kept.append(best)
        left -= best.count()
        if left <= 0:
            break
    found = reduce(DataFrame.unionByName, kept).withColumn("length", F.size("edge_ids"))
    return found.orderBy("length", F.array_join("edge_ids", "_")) if limit is not None else found


def composite_relations(paths: DataFrame) -> DataFrame:
    """Each path as one relation: id (edge ids joined by _), type (types joined by ->)."""
    return paths.select("start_id", "end_id", F.array_join("edge_ids", "_").alias("relation_id"), relation_label(F.col("types")).alias("relation_type"), "length")


def known_or_new(found: DataFrame, known: DataFrame) -> DataFrame:
    """found (edge_id, type) with the relation of the same id from known (edge_id, known_type; the first by type), or made anew."""
    first = known.groupBy("edge_id").agg(F.min("known_type").alias("known_type"))
    joined = found.join(first, "edge_id", "left")
    return joined.withColumn("is_new", F.col("known_type").isNull()).withColumn("type", F.coalesce("known_type", "type")).drop("known_type")
