"""A property graph from the relational tables: keys become nodes, foreign keys edges."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cache, cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: type: table, key, name (None: Order#key), properties.
NODES = {
    "region": ("region", "r_regionkey", "r_name", ()),
    "nation": ("nation", "n_nationkey", "n_name", ()),
    "customer": ("customer", "c_custkey", "c_name", ("c_mktsegment",)),
    "supplier": ("supplier", "s_suppkey", "s_name", ()),
    "part": ("part", "p_partkey", "p_name", ("p_brand", "p_type")),
    "order": ("orders", "o_orderkey", None, ("o_orderstatus", "o_orderpriority")),
}
#: type: table, source type and key, target type and key, whether pairs repeat in the table.
EDGES = {
    "IN_REGION": ("nation", "nation", "n_nationkey", "region", "n_regionkey", False),
    "LIVES_IN": ("customer", "customer", "c_custkey", "nation", "c_nationkey", False),
    "BASED_IN": ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", False),
    "PLACED_BY": ("orders", "order", "o_orderkey", "customer", "o_custkey", False),
    "CONTAINS": ("lineitem", "order", "l_orderkey", "part", "l_partkey", True),
    "SUPPLIES": ("lineitem", "supplier", "l_suppkey", "part", "l_partkey", True),
}


def node_id(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def keys_of(ids: Iterable[str]) -> dict[str, list[int]]:
    """The keys of each kind in ids (kind:key); other ids name nothing in the tables."""
    found: dict[str, list[int]] = {}
    for i in ids:
        kind, _, key = i.partition(":")
        if kind in NODES and key.lstrip("-").isdigit():
            found.setdefault(kind, []).append(int(key))
    return found


def _node_part(read: Callable[[str], DataFrame], kind: str, keys: list[int] | None = None) -> DataFrame:
    name, key, label, props = NODES[kind]
    rows = read(name)
    rows = rows if keys is None else rows.where(F.col(key).isin(keys))
    held = F.create_map(*[x for p in props for x in (F.lit(p), F.col(p))]) if props else F.create_map()
    return rows.select(node_id(kind, key).alias("id"), (F.col(label) if label else F.concat(F.lit("Order#"), F.col(key).cast("string"))).alias("name"), F.lit(kind).alias("type"), F.array(F.lit(kind)).alias("labels"), held.cast("map<string,string>").alias("props"))


def _edge_part(read: Callable[[str], DataFrame], kind: str, side: str = "", keys: list[int] | None = None) -> DataFrame:
    """Edges of a kind; with keys, those whose source (side s) or target (d) has one of them: a filter that the scan gets."""
    name, s, sk, d, dk, repeats = EDGES[kind]
    pairs = read(name).select(F.col(sk).alias("s"), F.col(dk).alias("d")).where(F.col("s").isNotNull() & F.col("d").isNotNull())
    pairs = pairs if keys is None else pairs.where(F.col(side).isin(keys))
    pairs = pairs.groupBy("s", "d").agg(F.count(F.lit(1)).alias("n")) if repeats else pairs.withColumn("n", F.lit(1))
    src, dst = node_id(s, "s"), node_id(d, "d")
    return pairs.select(F.concat_ws("|", F.lit(kind), src, dst).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.create_map(F.lit("n"), F.col("n").cast("string")).alias("props"))


class TableGraph(PropertyGraph):
    """The graph of tables: a few ids become filters on the tables' own keys, and tables that nothing needs are not opened.

    Pairs that repeat in their table are one edge: the number of rows stays as the property n.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, node_kinds=tuple(NODES), edge_kinds=tuple(EDGES)):
        self.spark, self.adjacency, self._kinds, self._dir = spark, None, (node_kinds, edge_kinds), sf_dir
        self._read = cache(lambda name: table(spark, sf_dir, name))

    @cached_property
    def nodes(self) -> DataFrame:
        return _union([_node_part(self._read, kind) for kind in self._kinds[0]])

    @cached_property
    def edges(self) -> DataFrame:
        return _union([_edge_part(self._read, kind) for kind in self._kinds[1]])

    def touching(self, *types: str) -> PropertyGraph:
        """Only kinds of edges with an end of one of the types: tables that none of these needs are not read."""
        kinds = tuple(k for k in self._kinds[1] if {EDGES[k][1], EDGES[k][3]} & set(types))
        return TableGraph(self.spark, self._dir, self._kinds[0], kinds) if kinds else PropertyGraph(self.nodes, self.edges.limit(0))

    def by_ids(self, ids: Iterable[str]) -> DataFrame:
        keys = keys_of(ids)
        parts = [_node_part(self._read, kind, keys[kind]) for kind in self._kinds[0] if kind in keys]
        return _union(parts) if parts else self.nodes.limit(0)

    def edges_from(self, ids: list[str], end: str = "src") -> DataFrame:
        keys, place = keys_of(ids), 1 if end == "src" else 3
        parts = [_edge_part(self._read, kind, end[0], keys[EDGES[kind][place]]) for kind in self._kinds[1] if EDGES[kind][place] in keys]
        return _union(parts) if parts else self.edges.limit(0)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def project(spark: SparkSession, sf_dir: str, node_kinds=tuple(NODES), edge_kinds=tuple(EDGES)) -> PropertyGraph:
    """The graph of the tables, or of some kinds of nodes and edges: tables that no kind needs are not read."""
    return TableGraph(spark, sf_dir, node_kinds, edge_kinds)
