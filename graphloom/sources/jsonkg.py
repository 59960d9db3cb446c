"""Graphs as JSON: {"entities": [...], "relationships": [...]}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.graph import PropertyGraph, upsert_nodes


def read(spark: SparkSession, path: str) -> DataFrame:
    """entities and relationships (arrays of objects as maps of text) of each file at path, and the file's path; missing lists are null."""
    shape = "entities array<map<string,string>>, relationships array<map<string,string>>"
    return spark.read.schema(shape).option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("file"))


def load(files: DataFrame) -> PropertyGraph:
    """The graph of read(): entities by name (one that repeats adds to the first, later values win), then relationships, which stay apart.

    name is required of an entity, source and target of a relationship; ends that no entity has become nodes with a name only.
    Files are in the order of their paths (column file); frames without that column in the order in which they are read.
    """
    if "file" in files.columns:
        numbers = files.select("file").distinct().select("file", (F.row_number().over(Window.orderBy("file")) - 1).alias("__file"))  # a row for each file
        rows = files.join(numbers, "file")
    else:
        rows = files.withColumn("__file", F.monotonically_increasing_id())
    e = rows.select("__file", F.posexplode("entities").alias("i", "e"))
    name = F.when(F.col("e")["name"].isNull(), F.raise_error(F.lit("an entity has no name"))).otherwise(F.col("e")["name"])
    kind = F.col("e")["type"]
    nodes = e.select(name.alias("id"), name.alias("name"), kind.alias("type"), F.array_compact(F.array(kind)).alias("labels"), F.map_filter("e", lambda k, v: ~k.isin("name") & v.isNotNull()).alias("props"), F.struct("__file", "i").alias("at"))
    r = rows.select("__file", F.posexplode("relationships").alias("i", "r"))
    edges = r.select(F.concat(F.lit("r"), F.col("__file").cast("string"), F.lit("-"), F.col("i").cast("string")).alias("id"), F.col("r")["source"].alias("src"), F.col("r")["target"].alias("dst"), F.coalesce(F.col("r")["type"], F.col("r")["relationship_types"]).alias("type"), F.map_filter("r", lambda k, v: ~k.isin("source", "target") & v.isNotNull()).alias("props"))
    return PropertyGraph(upsert_nodes(nodes, "at"), files.sparkSession.createDataFrame([], schema.EDGE)).add_edges(edges)


def entity_objects(graph: PropertyGraph) -> DataFrame:
    """json: one object for each node, its name first."""
    return graph.nodes.select(F.to_json(F.map_concat(F.create_map(F.lit("name"), F.col("name")), F.map_filter("props", lambda k, _: k != "name"))).alias("json"))


def relationship_objects(graph: PropertyGraph) -> DataFrame:
    return graph.edges.select(F.to_json(F.map_concat(F.create_map(F.lit("source"), F.col("src"), F.lit("target"), F.col("dst")), F.map_filter("props", lambda k, _: ~k.isin("source", "target")))).alias("json"))


def export(graph: PropertyGraph, folder: str) -> None:
    """Writes objects, one a line, in parts: folder/entities and folder/relationships. Graphs of any size."""
    entity_objects(graph).write.mode("overwrite").text(f"{folder}/entities")
    relationship_objects(graph).write.mode("overwrite").text(f"{folder}/relationships")


def document(graph: PropertyGraph, most: int = 100_000) -> str:
    """One JSON document of a graph of at most `most` nodes and as many edges; a larger one is an error: export() it."""
    parts = [[r.json for r in df.limit(most + 1).collect()] for df in (entity_objects(graph), relationship_objects(graph))]
    if max(map(len, parts)) > most:
        raise ValueError(f"over {most} entities or relationships: use export()")
    return '{"entities": [' + ", ".join(parts[0]) + '], "relationships": [' + ", ".join(parts[1]) + "]}"
