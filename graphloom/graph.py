"""A property graph as two frames: reading it, expanding from nodes, and changing it.

A graph is immutable: changes give a new graph. Edges have ids of their own, so parallel edges and
self-loops stay apart.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions.columns import merge_maps
from graphloom.shared import written


class PropertyGraph:
    """nodes: id, name, type, labels, props; edges: id, src, dst, type, props."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, adjacency: DataFrame | None = None):
        self.nodes, self.edges, self.adjacency = nodes, edges, adjacency
        self.spark: SparkSession = nodes.sparkSession

    @classmethod
    def empty(cls, spark: SparkSession) -> PropertyGraph:
        return cls(spark.createDataFrame([], schema.NODE), spark.createDataFrame([], schema.EDGE))

    def query(self, text: str, **params) -> DataFrame:
        """SQL over {nodes} and {edges} with named parameters (:name)."""
        return self.spark.sql(text, args=params or None, nodes=self.nodes, edges=self.edges)

    # reading

    def size(self) -> DataFrame:
        """n_nodes, in one row."""
        return self.nodes.agg(F.count(F.lit(1)).alias("n_nodes"))

    def type_counts(self) -> DataFrame:
        return self.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))

    def by_property(self, name: str, value: str | None) -> DataFrame:
        """Nodes with a property of that value; None finds nodes where it is null or missing."""
        held = F.col(name) if name in ("id", "name", "type") else F.col("props")[name]
        return self.nodes.where(held.eqNullSafe(F.lit(value)))

    def by_ids(self, ids: Iterable[str]) -> DataFrame:
        return self.nodes.where(F.col("id").isin(list(ids)))

    def edges_from(self, ids: list[str], end: str = "src") -> DataFrame:
        """Edges whose src (or dst) is one of a few nodes."""
        return self.edges.where(F.col(end).isin(ids))

    def out_edges(self, node_id: str) -> DataFrame:
        return self.edges_from([node_id])

    def in_edges(self, node_id: str) -> DataFrame:
        return self.edges_from([node_id], "dst")

    def edges_of(self, node_id: str) -> DataFrame:
        """Edges with is_incoming; a self-loop is both. A node that does not exist has none."""
        flag = lambda df, v: df.withColumn("is_incoming", F.lit(v))
        return flag(self.out_edges(node_id), False).unionByName(flag(self.in_edges(node_id), True))

    def indexed(self) -> PropertyGraph:
        """The same graph with nodes sorted by id and edges kept from both of their ends sorted by it, in the shared folder.

        A step from a few nodes then reads the row groups that hold them, not all edges: worth it for a graph
        that is asked more than once, or whose frames are costly to make.
        """
        adjacency = written(self.both_ways().repartitionByRange("here").sortWithinPartitions("here"), "adjacency")
        nodes = written(self.nodes.repartitionByRange("id").sortWithinPartitions("id"), "nodes")
        return PropertyGraph(nodes, self.edges, adjacency)

    def around(self, ids: list[str]) -> DataFrame:
        """both_ways() from a few nodes: their ids reach the scan as a filter, from whichever end they are."""
        if self.adjacency is not None:
            return self.adjacency.where(F.col("here").isin(ids))
        seen = lambda here, there, flag: self.edges_from(ids, here).select(F.col("id").alias("edge_id"), F.col(here).alias("here"), F.col(there).alias("there"), "type", F.lit(flag).alias("is_incoming"))
        return seen("src", "dst", False).unionByName(seen("dst", "src", True))

    def both_ways(self) -> DataFrame:
        """edge_id, here, there, type, is_incoming: each edge seen from both of its ends, in one scan."""
        if self.adjacency is not None:
            return self.adjacency
        ends = F.array(F.struct(F.col("src").alias("here"), F.col("dst").alias("there"), F.lit(False).alias("is_incoming")), F.struct(F.col("dst").alias("here"), F.col("src").alias("there"), F.lit(True).alias("is_incoming")))
        return self.edges.select(F.col("id").alias("edge_id"), "type", F.explode(ends).alias("e")).select("edge_id", "e.here", "e.there", "type", "e.is_incoming")

    def touching(self, *types: str) -> PropertyGraph:
        """The graph with the edges, at least, that nodes of these types may have: kinds that are known to have none of them need not be made."""
        return self

    def neighbors(self, ids: DataFrame) -> DataFrame:
        """id, neighbor: distinct, either direction, without the node itself; for frames of id."""
        return ids.select("id").join(self.both_ways(), F.col("id") == F.col("here")).where(F.col("there") != F.col("id")).select("id", F.col("there").alias("neighbor")).distinct()

    def known_subject_edges(self) -> DataFrame:
        """Edges whose object is the source of an edge too."""
        return self.edges.join(self.edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")

    def enrich(self, df: DataFrame, id_col: str = "id", without: tuple[str, ...] = ("id", "name")) -> DataFrame:
        """df with name, type and props (less the keys `without`) of its node; ids that are unknown keep nulls."""
        kept = F.map_filter("props", lambda k, _: ~k.isin(*without))
        return df.join(self.nodes.select(F.col("id").alias(id_col), "name", "type", kept.alias("props")), id_col, "left")

    def sample(self, n: int = 10, start: str | None = None) -> DataFrame:
        """src_name, type, dst_name of n edges, the first by id; start: of those whose source's name begins so. A look at what a graph holds."""
        name = lambda side: self.nodes.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name"))
        sources = name("src") if start is None else name("src").where(F.col("src_name").startswith(start))
        some = self.edges.join(sources, "src").orderBy("id").limit(n)
        return some.join(name("dst"), "dst", "left").select(F.col("id").alias("edge_id"), "src_name", "type", "dst_name")

    # changes

    def add_nodes(self, more: DataFrame, upsert: bool = True, order: str | None = None) -> PropertyGraph:
        """With upsert, rows of the same id become one: the last name, type and value of each key stay (more after the present ones); without, all rows stay.

        order: a column of more (a number, not below 0) that says which of its rows are later; without it that is the order in which
        they are read, which is the files' own only within a file.
        """
        at = F.monotonically_increasing_id() if order is None else F.col(order).cast("long")
        nodes = self.nodes.withColumn("__at", F.lit(0).cast("long")).unionByName(more.withColumn("__at", at + 1).select(*self.nodes.columns, "__at"))
        if not upsert:
            return PropertyGraph(nodes.drop("__at"), self.edges)
        return PropertyGraph(upsert_nodes(nodes, "__at"), self.edges)

    def add_edges(self, more: DataFrame) -> PropertyGraph:
        """Parallel edges stay apart; ends without a node get one with a name only."""
        edges = self.edges.unionByName(more)
        ends = more.select(F.explode(F.array("src", "dst")).alias("id")).where(F.col("id").isNotNull()).distinct()
        missing = ends.join(self.nodes.select("id"), "id", "left_anti")
        made = missing.select("id", F.col("id").alias("name"), F.lit(None).cast("string").alias("type"), F.array().cast("array<string>").alias("labels"), F.create_map().cast("map<string,string>").alias("props"))
        return PropertyGraph(self.nodes.unionByName(made), edges)

    def relate(self, pairs: DataFrame) -> PropertyGraph:
        """Edges for rows of src_label, src_name, dst_label, dst_name, type: from each node of the first label and name to each of the second, so n x m of them.

        Two equi-joins; pairs without a node on either side give no edge.
        """
        end = lambda side: self.nodes.select(F.explode("labels").alias(f"{side}_label"), F.col("name").alias(f"{side}_name"), F.col("id").alias(side))
        made = pairs.join(end("src"), ["src_label", "src_name"]).join(end("dst"), ["dst_label", "dst_name"])
        empty = F.create_map().cast("map<string,string>")
        return PropertyGraph(self.nodes, self.edges.unionByName(made.select(F.concat_ws("|", "type", "src", "dst").alias("id"), "src", "dst", "type", empty.alias("props"))))

    def delete_nodes(self, where: Column, detach: bool = False) -> PropertyGraph:
        """Without detach, a node that still has edges is an error; with it, its edges go too."""
        gone = self.nodes.where(where).select("id")
        touching = self.both_ways().join(gone.withColumnRenamed("id", "here"), "here", "left_semi")
        if not detach and touching.limit(1).count():
            raise ValueError("nodes to delete still have edges; delete them first or detach")
        dead = touching.select("edge_id").distinct()
        edges = self.edges.join(dead, F.col("id") == F.col("edge_id"), "left_anti") if detach else self.edges
        return PropertyGraph(self.nodes.where(~F.coalesce(where, F.lit(False))), edges)

    def update_nodes(self, where: Column, **props: str) -> PropertyGraph:
        """Sets properties of the nodes that match; other keys stay."""
        new = F.create_map(*[F.lit(x) for kv in props.items() for x in kv]).cast("map<string,string>")
        return PropertyGraph(self.nodes.withColumn("props", F.when(where, merge_maps(F.col("props"), new)).otherwise(F.col("props"))), self.edges)


def upsert_nodes(rows: DataFrame, order: str) -> DataFrame:
    """One row per id: by `order`, the last name, type and labels that aren't null, and the last value of each key."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    fixed = rows.groupBy("id").agg(last("name"), last("type"), last("labels"))
    keys = rows.select("id", order, F.explode("props").alias("k", "v")).groupBy("id", "k").agg(F.max_by("v", order).alias("v"))
    props = keys.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    empty = F.create_map().cast("map<string,string>")
    return fixed.join(props, "id", "left").withColumn("props", F.coalesce("props", empty)).select("id", "name", "type", "labels", "props")
