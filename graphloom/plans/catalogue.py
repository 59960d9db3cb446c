"""The query catalogue: each operator applied to whole tables, with SQL that gives the same rows where SQL can.

Queries have no row limits but those that are the operator (top-k). Ids of nodes are kind:key, of edges type|src|dst.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import extract, models, parse, similarity
from graphloom.functions.columns import as_share, clock, combined_score, entity_id, first_confidence, local_name, name_similarity, percent_text, score_text, timestamp_text, uri_name
from graphloom.graph import PropertyGraph
from graphloom.operators import expand, link, metrics, prune, resolve
from graphloom.plans import assisted, explore
from graphloom.shared import written
from graphloom.sources import html, jsonkg, ntriples
from graphloom.sources.tables import project, table
from graphloom.streaming import triples as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_NODES = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, r_name AS name, 'region' AS type FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'customer' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'part' FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'Order#' || o_orderkey, 'order' FROM orders)"""
_PAIRS = """pairs AS (
  SELECT 'IN_REGION' AS type, 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 1 AS n FROM nation
  UNION ALL SELECT 'LIVES_IN', 'customer:' || c_custkey, 'nation:' || c_nationkey, 1 FROM customer
  UNION ALL SELECT 'BASED_IN', 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 1 FROM supplier
  UNION ALL SELECT 'PLACED_BY', 'order:' || o_orderkey, 'customer:' || o_custkey, 1 FROM orders
  UNION ALL SELECT 'CONTAINS', 'order:' || l_orderkey, 'part:' || l_partkey, count(*) FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'SUPPLIES', 'supplier:' || l_suppkey, 'part:' || l_partkey, count(*) FROM lineitem GROUP BY l_suppkey, l_partkey),
edges AS (SELECT type || '|' || src || '|' || dst AS id, src, dst, type, n FROM pairs)"""
_BOTH = """both_ways AS (SELECT id AS edge_id, src AS here, dst AS there, type, false AS is_incoming FROM edges
  UNION ALL SELECT id, dst, src, type, true FROM edges)"""
GRAPH = f"WITH {_NODES}, {_PAIRS}, {_BOTH} "


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, and the SQL for it."""

    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return register


def _ids(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


# reading a graph


@query(GRAPH + "SELECT count(*) AS n_nodes FROM nodes")
def graph_size(spark, d):
    return project(spark, d).size()


@query(GRAPH + "SELECT type, count(*) AS n FROM nodes GROUP BY type")
def node_type_counts(spark, d):
    return project(spark, d).type_counts()


@query(GRAPH + "SELECT type, count(*) AS n, sum(n)::BIGINT AS n_rows FROM edges GROUP BY type")
def edge_type_counts(spark, d):
    return project(spark, d).edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("props")["n"].cast("long")).alias("n_rows"))


@query("SELECT 'part:' || p_partkey AS id, p_name AS name FROM part WHERE p_brand = 'Brand#2'")
def nodes_by_property(spark, d):
    return project(spark, d).by_property("p_brand", "Brand#2").select("id", "name")


@query(GRAPH + "SELECT id, name, type FROM nodes WHERE id NOT LIKE 'part:%'")
def nodes_by_missing_property(spark, d):
    return project(spark, d).by_property("p_brand", None).select("id", "name", "type")


@query(GRAPH + "SELECT id, name, type FROM nodes WHERE id IN ('nation:3', 'part:7', 'order:11', 'none:1')")
def nodes_by_id_list(spark, d):
    return project(spark, d).by_ids(["nation:3", "part:7", "order:11", "none:1"]).select("id", "name", "type")


@query("SELECT 'c' AS kind, 'customer:' || c_custkey AS id FROM customer WHERE c_mktsegment = 'MACHINERY'")
def graph_query_with_parameters(spark, d):
    return project(spark, d).query("SELECT 'c' AS kind, id FROM {nodes} WHERE type = :kind AND props['c_mktsegment'] = :segment", kind="customer", segment="MACHINERY")


@query(GRAPH + "SELECT id, src, dst, type FROM edges WHERE src = 'supplier:1'")
def out_edges(spark, d):
    return project(spark, d).out_edges("supplier:1").select("id", "src", "dst", "type")


@query(GRAPH + "SELECT id, src, dst, type FROM edges WHERE dst = 'nation:3'")
def in_edges(spark, d):
    return project(spark, d).in_edges("nation:3").select("id", "src", "dst", "type")


@query(GRAPH + "SELECT edge_id AS id, here, there, type, is_incoming FROM both_ways WHERE here = 'customer:10'")
def edges_both(spark, d):
    e = project(spark, d).edges_of("customer:10")
    return e.select("id", F.when(F.col("is_incoming"), F.col("dst")).otherwise(F.col("src")).alias("here"), F.when(F.col("is_incoming"), F.col("src")).otherwise(F.col("dst")).alias("there"), "type", "is_incoming")


@query(GRAPH + "SELECT DISTINCT here AS id, there AS neighbor FROM both_ways WHERE there <> here")
def neighbors_distinct(spark, d):
    g = project(spark, d)
    return g.neighbors(g.nodes.select("id"))


@query(GRAPH + "SELECT DISTINCT here AS id, there AS neighbor FROM both_ways WHERE there <> here AND (here LIKE 'nation:%' OR here LIKE 'customer:%')")
def neighbors_of_types(spark, d):
    """From nodes of two types: kinds of edges that these never have are not made."""
    g = project(spark, d).touching("nation", "customer")
    return g.neighbors(g.nodes.where(F.col("type").isin("nation", "customer")).select("id"))


@query(GRAPH + "SELECT id, src, dst FROM edges WHERE dst IN (SELECT src FROM edges)")
def edges_to_known_subjects(spark, d):
    return project(spark, d).known_subject_edges().select("id", "src", "dst")


@query(GRAPH + ", s AS (SELECT e.id AS edge_id, n.name AS src_name, e.type, dst FROM edges e JOIN nodes n ON n.id = src AND n.name LIKE 'Customer#%' ORDER BY e.id LIMIT 10) SELECT edge_id, src_name, s.type, n.name AS dst_name FROM s LEFT JOIN nodes n ON n.id = dst")
def sample_edges(spark, d):
    return project(spark, d).touching("customer").sample(10, "Customer#")


@query("SELECT 'LIVES_IN|customer:' || c_custkey || '|nation:' || c_nationkey AS edge_id, c_name AS name, 'customer' AS type, c_mktsegment AS segment, 1 AS n_props FROM customer")
def metadata_enrich(spark, d):
    g = project(spark, d)
    lives = g.edges.where(F.col("type") == "LIVES_IN").select(F.col("id").alias("edge_id"), F.col("src").alias("id"))
    return g.enrich(lives).select("edge_id", "name", "type", F.col("props")["c_mktsegment"].alias("segment"), F.size("props").alias("n_props"))


# expanding


@query(GRAPH + "SELECT here AS last_id, edge_id, type, there, is_incoming, row_number() OVER (PARTITION BY here ORDER BY is_incoming, edge_id)::INTEGER AS idx FROM both_ways WHERE here LIKE 'supplier:%'")
def expand_candidates(spark, d):
    g = project(spark, d).touching("supplier")
    frontier = g.nodes.where(F.col("type") == "supplier").select(F.col("id").alias("last_id"))
    return expand.candidates(g, frontier).select("last_id", "edge_id", "type", "there", "is_incoming", "idx")


@query(
    GRAPH
    + """, f AS (SELECT 'customer:' || c_custkey AS last_id, 'nation:' || c_nationkey AS seen FROM customer)
SELECT last_id, edge_id, there, is_incoming, row_number() OVER (PARTITION BY last_id ORDER BY is_incoming, edge_id)::INTEGER AS idx
FROM f JOIN both_ways ON last_id = here WHERE there <> last_id AND there <> seen"""
)
def expand_excluding_visited(spark, d):
    frontier = table(spark, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("last_id"), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("seen"))
    frontier = frontier.select("last_id", F.array("last_id", "seen").alias("visited"))
    return expand.candidates(project(spark, d).touching("customer"), frontier, F.col("visited")).select("last_id", "edge_id", "there", "is_incoming", "idx")


_BY_IDS = ["IN_REGION|nation:3|region:3", "IN_REGION|nation:0|region:0", "LIVES_IN|customer:0|nation:2", "none"]
_BY_IDS_SQL = GRAPH + ", f AS (SELECT id AS last_id FROM nodes WHERE type IN ('nation', 'region')) SELECT DISTINCT last_id, edge_id, {next} AS next_id, is_incoming FROM f JOIN both_ways ON last_id = here WHERE edge_id IN ('IN_REGION|nation:3|region:3', 'IN_REGION|nation:0|region:0', 'LIVES_IN|customer:0|nation:2', 'none')"


def _by_ids(spark, d, faithful):
    g = project(spark, d).touching("nation", "region")
    frontier = g.nodes.where(F.col("type").isin("nation", "region")).select(F.col("id").alias("last_id"))
    return expand.by_relation_ids(g, frontier, _BY_IDS, faithful=faithful)


@query(_BY_IDS_SQL.format(next="there"))
def expand_by_relation_ids(spark, d):
    return _by_ids(spark, d, False)


@query(_BY_IDS_SQL.format(next="CASE WHEN is_incoming THEN here ELSE there END"))
def incoming_faithful(spark, d):
    return _by_ids(spark, d, True)


_PATHS = GRAPH + """, p1 AS (SELECT src AS start_id, dst AS end_id, id AS relation_id, type AS relation_type, 1 AS length FROM edges WHERE src LIKE 'customer:%' OR src LIKE 'supplier:%'),
p2 AS (SELECT start_id, dst AS end_id, relation_id || '_' || id AS relation_id, relation_type || ' -> ' || type AS relation_type, 2 AS length FROM p1 JOIN edges ON end_id = src AND id <> relation_id),
p AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2) """


def _two_hops(spark, d, limit=None):
    g = project(spark, d)
    return expand.composite_relations(expand.simple_paths(g, g.nodes.where(F.col("type").isin("customer", "supplier")).select("id"), 2, limit))


@query(_PATHS + "SELECT start_id, end_id, relation_id, relation_type, length FROM p")
def composite_relations(spark, d):
    return _two_hops(spark, d)


@query(_PATHS + "SELECT start_id, end_id, relation_id, relation_type, length FROM p ORDER BY length, relation_id LIMIT 100")
def khop_paths_2(spark, d):
    return _two_hops(spark, d, 100)


@query(
    GRAPH
    + ", f AS (SELECT id AS edge_id, type FROM edges WHERE type IN ('LIVES_IN', 'IN_REGION')) SELECT edge_id, CASE WHEN type = 'IN_REGION' THEN 'KNOWN' ELSE type END AS type, type <> 'IN_REGION' AS is_new FROM f"
)
def relation_lookup_or_new(spark, d):
    e = project(spark, d).edges
    found = e.where(F.col("type").isin("LIVES_IN", "IN_REGION")).select(F.col("id").alias("edge_id"), "type")
    known = e.where(F.col("type") == "IN_REGION").select(F.col("id").alias("edge_id"), F.explode(F.array(F.lit("KNOWN"), F.lit("LATER"))).alias("known_type"))
    return expand.known_or_new(found, known)


# linking

_MENTIONS = ["NATION_3", "nation_4", "Customer#000000007", "small ring", "RING", "Red wid", "supplier#00000001", "smal rings", "Customer#00000007", "nothing like it", ""]
_MENTIONS_SQL = "m AS (SELECT unnest([" + ", ".join(f"'{m}'" for m in _MENTIONS) + "]) AS mention)"
_SIM = "CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1 - levenshtein(lower({a}), lower({b})) / greatest(length({a}), length({b})) END"


def _mentions(spark):
    return spark.createDataFrame([(m,) for m in _MENTIONS], "mention string")


@query(GRAPH + f", {_MENTIONS_SQL} SELECT mention, min({{'id': id, 'name': name, 'type': type}}).id AS id, min({{'id': id, 'name': name, 'type': type}}).name AS name, min({{'id': id, 'name': name, 'type': type}}).type AS type FROM m JOIN nodes ON lower(mention) = lower(name) GROUP BY mention")
def link_exact(spark, d):
    return link.exact(_mentions(spark), project(spark, d).nodes)


@query(
    GRAPH
    + f", {_MENTIONS_SQL}, c AS (SELECT mention, id, name, type, {_SIM.format(a='name', b='mention')} AS similarity FROM m JOIN nodes ON contains(lower(name), lower(mention))), "
    + "r AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY similarity DESC, id)::INTEGER AS rank FROM c) SELECT mention, id, name, type, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 10"
)
def link_contains_top10(spark, d):
    return link.containing(_mentions(spark), project(spark, d).nodes).select("mention", "id", "name", "type", F.round("similarity", 6).alias("similarity"), "rank")


@query(
    GRAPH
    + f", {_MENTIONS_SQL}, c AS (SELECT mention, id, name, type, {_SIM.format(a='name', b='mention')} AS similarity FROM m JOIN nodes ON length(mention) > 0 AND {_SIM.format(a='name', b='mention')} >= 0.7), "
    + "r AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY similarity DESC, id) AS k FROM c) SELECT mention, id, name, type, round(similarity, 6) AS similarity FROM r WHERE k = 1"
)
def link_levenshtein_best(spark, d):
    return link.edit_distance(_mentions(spark), project(spark, d).nodes).withColumn("similarity", F.round("similarity", 6))


@query()
def link_with_fallback(spark, d):
    return link.with_fallback(_mentions(spark), project(spark, d).nodes)


@query()
def fuzzy_ratios(spark, d):
    """Both similarities of each part's name with its brand and type."""
    text = F.concat_ws(" ", "p_brand", "p_type", "p_name")
    return table(spark, d, "part").select("p_partkey", similarity.ratio(F.lower("p_name"), F.lower(text)).alias("ratio"), similarity.weighted_ratio("p_name", text).alias("weighted_ratio"))


@query(
    """WITH c AS (SELECT label, list_transform(range(64), lambda i: 0.0) AS z, array_agg(embedding ORDER BY vec_id) AS v FROM embeddings GROUP BY label),
q AS (SELECT label, embedding FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) WHERE k = 1),
s AS (SELECT q.label, e.vec_id, list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))) AS cosine FROM q, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id::VARCHAR)::INTEGER AS rank FROM s)
SELECT label::VARCHAR AS mention, vec_id::VARCHAR AS id, round(cosine, 6) AS cosine, rank FROM r WHERE rank <= 3"""
)
def semantic_match(spark, d):
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).select(F.col("label").cast("string").alias("mention"), "vector")
    return link.semantic(first, e.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector")), 3).withColumn("cosine", F.round("cosine", 6))


# scoring and pruning


@query(
    GRAPH
    + """, c AS (SELECT here AS last_id, edge_id, row_number() OVER (PARTITION BY here ORDER BY is_incoming, edge_id)::INTEGER AS idx FROM both_ways WHERE here LIKE 'nation:%'),
s AS (SELECT 'nation:' || n_nationkey AS last_id, unnest([1, 3, 99]) AS idx, unnest([0.5, 0.25, 1.0]) AS score FROM nation)
SELECT c.last_id, edge_id, c.idx, coalesce(score, 0.0)::DOUBLE AS score FROM c LEFT JOIN s ON c.last_id = s.last_id AND c.idx = s.idx"""
)
def score_by_index(spark, d):
    g = project(spark, d).touching("nation")
    nations = g.nodes.where(F.col("type") == "nation").select(F.col("id").alias("last_id"))
    found = expand.candidates(g, nations).select("last_id", "edge_id", "idx")
    replies = nations.select("last_id", parse.scores(F.lit('Here: {"1": 0.5, "3": 0.25, "99": 1.0, "x": 2} done')).alias("scores"))
    return prune.with_index_scores(found, replies, "last_id", 0.0)


@query("SELECT 'part:' || p_partkey AS id, CASE WHEN contains('all about small ring parts', lower(p_name)) THEN 0.75 WHEN contains('red widget', lower(p_name)) THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM part")
def score_by_name_substring(spark, d):
    parts = table(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), "p_name")
    reply = parse.scores(F.lit('{"All about SMALL ring parts": 0.75, "Red Widget": 0.5}'))
    return prune.with_name_scores(parts, reply, F.col("p_name")).select("id", "score")


_SCORED = GRAPH + f""", c AS (SELECT here AS last_id, edge_id, type, there, is_incoming, row_number() OVER (PARTITION BY here ORDER BY is_incoming, edge_id) AS idx FROM both_ways WHERE here LIKE 'customer:%'),
s AS (SELECT c.*, {_SIM.format(a="c.type", b="'who lives in'")} AS rel, {_SIM.format(a="n.name", b="'NATION_7'")} AS ent FROM c JOIN nodes n ON n.id = c.there)"""


def _customer_candidates(spark, d):
    g = project(spark, d).touching("customer")
    found = expand.candidates(g, g.nodes.where(F.col("type") == "customer").select(F.col("id").alias("last_id")), numbered=False)
    return found.join(g.nodes.select(F.col("id").alias("there"), "name"), "there")


@query(_SCORED + ", r AS (SELECT *, row_number() OVER (PARTITION BY last_id ORDER BY rel DESC, idx)::INTEGER AS rank FROM s) SELECT last_id, edge_id, round(rel, 6) AS score, rank FROM r WHERE rank <= 9")
def prune_relations_topn(spark, d):
    scored = _customer_candidates(spark, d).withColumn("score", name_similarity(F.col("type"), F.lit("who lives in")))
    return prune.top_n(scored, ["last_id"], 9, idx=expand.DISCOVERY).select("last_id", "edge_id", F.round("score", 6).alias("score"), "rank")


@query(_SCORED + ", r AS (SELECT *, row_number() OVER (PARTITION BY last_id, type ORDER BY ent DESC, idx)::INTEGER AS rank FROM s) SELECT last_id, edge_id, there, round(ent, 6) AS score, rank FROM r WHERE rank <= 3")
def prune_entities_topn(spark, d):
    scored = _customer_candidates(spark, d).withColumn("score", name_similarity(F.col("name"), F.lit("NATION_7")))
    return prune.top_n(scored, ["last_id", "type"], 3, idx=expand.DISCOVERY).select("last_id", "edge_id", "there", F.round("score", 6).alias("score"), "rank")


@query(_SCORED + ", r AS (SELECT *, row_number() OVER (PARTITION BY last_id ORDER BY idx)::INTEGER AS rank FROM s) SELECT last_id, edge_id, rank FROM r WHERE rank <= 9")
def prune_relations_faithful(spark, d):
    return prune.first_n(_customer_candidates(spark, d), ["last_id"], 9, expand.DISCOVERY).select("last_id", "edge_id", "rank")


@query(_SCORED + " SELECT last_id, edge_id, round((CASE WHEN is_incoming THEN 0.5 ELSE rel END + ent) / 2, 6) AS score FROM s")
def combined_scores(spark, d):
    found = _customer_candidates(spark, d)
    rel = F.when(~F.col("is_incoming"), name_similarity(F.col("type"), F.lit("who lives in")))
    return found.select("last_id", "edge_id", F.round(combined_score(rel, name_similarity(F.col("name"), F.lit("NATION_7"))), 6).alias("score"))


_EVENTS_PATHS = "SELECT event_id::VARCHAR AS path_id, value AS confidence, event_id AS seq FROM events"


def _event_paths(spark, d):
    return table(spark, d, "events").select(F.col("event_id").cast("string").alias("path_id"), F.col("value").alias("confidence"), F.col("event_id").alias("seq"))


@query(f"SELECT * FROM ({_EVENTS_PATHS}) ORDER BY confidence DESC, seq LIMIT 9")
def topn_intended(spark, d):
    return prune.bounded(_event_paths(spark, d), 9)


@query(f"SELECT * FROM ({_EVENTS_PATHS}) ORDER BY confidence, seq DESC LIMIT 9")
def topn_faithful(spark, d):
    return prune.bounded(_event_paths(spark, d), 9, faithful=True)


@query(
    GRAPH
    + ", c AS (SELECT here AS last_id, type, there, row_number() OVER (PARTITION BY here ORDER BY is_incoming, edge_id) AS idx FROM both_ways WHERE here LIKE 'customer:%') SELECT last_id, string_agg(idx || '. ' || type || ' ' || there, chr(10) ORDER BY idx) AS text FROM c GROUP BY last_id"
)
def prompt_lines(spark, d):
    g = project(spark, d).touching("customer")
    found = expand.candidates(g, g.nodes.where(F.col("type") == "customer").select(F.col("id").alias("last_id")))
    return prune.numbered(found, ["last_id"], F.concat_ws(" ", "type", "there"))


# beam search

_QUESTION = "Which Customer#000000042 lives near NATION_11"
_SEEDS = ["nation_11", "NATION_2", "Customer#000000042", "REGION NONE"]
_Q = f"'{_QUESTION}'"
_HOP = """, {out}r AS (SELECT p.*, b.edge_id, b.type, b.there, b.is_incoming, {rel} AS rel_score, row_number() OVER (PARTITION BY p.path_id ORDER BY {rel} DESC, b.is_incoming, b.edge_id) AS rel_rank
  FROM {src} p JOIN both_ways b ON b.here = p.last_id WHERE NOT list_contains(p.visited, b.there)),
{out}e AS (SELECT r.path_id || '>' || edge_id AS path_id, text || ' → ' || last_name || ' -' || r.type || '→ ' || n.name AS text, list_append(visited, there) AS visited, there AS last_id, n.name AS last_name,
  (rel_score + {ent}) / 2 AS confidence, {hop} AS seq FROM {out}r r JOIN nodes n ON n.id = r.there WHERE rel_rank <= 9),
{out} AS (SELECT * FROM {out}e ORDER BY confidence DESC, path_id LIMIT 9)"""
_BEAM = (
    GRAPH
    + ", seeds AS (SELECT DISTINCT lower(unnest(["
    + ", ".join(f"'{s}'" for s in _SEEDS)
    + "])) AS k), s AS (SELECT k, min({'id': id, 'name': name}) AS n FROM seeds JOIN nodes ON lower(name) = k GROUP BY k), p0 AS (SELECT n.id AS path_id, n.name AS text, [n.id] AS visited, n.id AS last_id, n.name AS last_name, 1.0::DOUBLE AS confidence, 0 AS seq FROM s)"
)
_REL, _ENT = _SIM.format(a="b.type", b=_Q), _SIM.format(a="n.name", b=_Q)
_TOLD = ("n.name AS text", "text || ' → ' || last_name || ' -' || r.type || '→ ' || n.name AS text")
_JSON = ("""'[{"subject":"' || n.name || '","object":"' || n.name || '"}' AS text""", """text || ',{"subject":"' || last_name || '","predicate":"' || r.type || '","object":"' || n.name || '"}' AS text""")
_ONE = _BEAM + _HOP.format(out="p1", src="p0", rel=_REL, ent=_ENT, hop=1)
_TWO = _ONE + _HOP.format(out="p2", src="p1", rel=_REL, ent=_ENT, hop=2) + ", k AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 ORDER BY confidence DESC, seq, path_id LIMIT 9)"
#: Relations unscored, steps against an edge that stay, all paths of a hop kept until the lowest scores are, and those the next frontier.
_FAITHFUL_HOP = """, {out}r AS (SELECT p.*, b.edge_id, b.there, b.is_incoming, row_number() OVER (PARTITION BY p.path_id ORDER BY b.is_incoming, b.edge_id) AS rel_rank
  FROM {src} p JOIN both_ways b ON b.here = p.last_id WHERE NOT list_contains(p.visited, b.there)),
{out}e AS (SELECT r.path_id || '>' || edge_id AS path_id, CASE WHEN is_incoming THEN visited ELSE list_append(visited, there) END AS visited, CASE WHEN is_incoming THEN last_id ELSE there END AS last_id, {ent} AS confidence, {hop} AS seq
  FROM {out}r r JOIN nodes n ON n.id = r.there WHERE rel_rank <= 9),
{out} AS (SELECT * FROM ({held}SELECT * FROM {out}e) ORDER BY confidence, seq DESC, path_id DESC LIMIT 9)"""
_FAITHFUL = _BEAM + _FAITHFUL_HOP.format(out="p1", src="p0", ent=_ENT, hop=1, held="") + _FAITHFUL_HOP.format(out="p2", src="p1", ent=_ENT, hop=2, held="SELECT * FROM p1 UNION ALL ")


def _beam(spark, d, hops, **more):
    g = project(spark, d)
    mentions = spark.createDataFrame([(s,) for s in _SEEDS], "mention string")
    seeds = link.exact(mentions, g.nodes).select("id", "name").distinct()
    return explore.explore(g, seeds, _QUESTION, explore.ExploreConfig(max_iterations=hops, **more))


@query(_ONE + " SELECT path_id, last_id, round(confidence, 6) AS confidence FROM p1")
def beam_1hop(spark, d):
    return _beam(spark, d, 1).select("path_id", "last_id", F.round("confidence", 6).alias("confidence"))


@query(_TWO + " SELECT path_id, last_id, round(confidence, 6) AS confidence FROM k")
def beam_2hop(spark, d):
    return _beam(spark, d, 2).select("path_id", "last_id", F.round("confidence", 6).alias("confidence"))


@query(_TWO + " SELECT path_id, text FROM k")
def render_paths(spark, d):
    return explore.render(_beam(spark, d, 2))


@query(_FAITHFUL + " SELECT path_id, last_id, round(confidence, 6) AS confidence FROM p2")
def beam_faithful(spark, d):
    return _beam(spark, d, 2, faithful=True).select("path_id", "last_id", F.round("confidence", 6).alias("confidence"))


@query(_TWO.replace(_TOLD[1], _JSON[1]).replace(_TOLD[0], _JSON[0]) + " SELECT path_id, round(confidence, 6) AS confidence, text || ']' AS json FROM k")
def format_result_triples(spark, d):
    return explore.formatted(_beam(spark, d, 2)).select("path_id", F.round("confidence", 6).alias("confidence"), "json")


@query(
    _TWO
    + f""", n AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, seq, path_id) AS i FROM k)
SELECT count(*) > 0 AS success, {_Q} || chr(10) || string_agg(i || '. ' || text, chr(10) ORDER BY i) AS answer, string_agg(text, chr(10) ORDER BY i) AS paths FROM n"""
)
def explore_and_answer(spark, d):
    mentions = spark.createDataFrame([(s,) for s in _SEEDS], "mention string")
    return explore.answer(project(spark, d), mentions, _QUESTION, explore.ExploreConfig(max_iterations=2)).withColumn("paths", F.array_join("paths", "\n"))


# replies of models, as columns


@query("SELECT event_id, (props->>'$.k')::DOUBLE AS k, 1 AS n FROM events")
def parse_scores_json(spark, d):
    s = parse.scores(F.concat(F.lit("Scores: "), F.col("props"), F.lit(" end")))
    return table(spark, d, "events").select("event_id", s["k"].alias("k"), F.size(s).alias("n"))


@query("SELECT p_partkey, p_brand || '|' || p_type || '|' || p_name AS names, 3 AS n FROM part")
def parse_entity_list(spark, d):
    reply = F.concat(F.lit("Sure.\n``` "), F.concat_ws(" , ", "p_brand", F.lit(" "), "p_type", "p_name"), F.lit(",\n```\nDone."))
    names = parse.entity_list(reply)
    return table(spark, d, "part").select("p_partkey", F.array_join(names, "|").alias("names"), F.size(names).alias("n"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN 0 ELSE 1 END AS n_entities, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE p_name END AS first_name, 0 AS n_relationships FROM part")
def robust_json(spark, d):
    body = F.concat(F.lit('{"entities": [{"name": "'), F.col("p_name"), F.lit('", "type": "PART"}]}'))
    k = F.col("p_partkey") % 4
    reply = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here you are: "), body, F.lit(" I hope it helps."))).otherwise(F.lit("no graph today"))
    g = parse.graph(reply)
    return table(spark, d, "part").select("p_partkey", F.size(g["entities"]).alias("n_entities"), F.get(g["entities"], 0)["name"].alias("first_name"), F.size(g["relationships"]).alias("n_relationships"))


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN round(l_discount, 2) + round(l_tax, 2) + 0.88 BETWEEN 0.99 AND 1.01 THEN NULL ELSE 'scores must sum to 1' END AS error FROM lineitem"
)
def validate_score_sum(spark, d):
    reply = F.concat(F.lit('```json {"a": '), F.col("l_discount").cast("string"), F.lit(', "b": '), F.col("l_tax").cast("string"), F.lit(', "c": 0.88} ```'))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", parse.scores_error(parse.pruning_scores(reply)).alias("error"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN true WHEN 'error' THEN false END AS verdict FROM events")
def yes_no(spark, d):
    reply = F.when(F.col("event_type") == "click", " Yes, it is known. ").when(F.col("event_type") == "error", "No.").otherwise("maybe")
    return table(spark, d, "events").select("event_id", parse.says_yes(reply).alias("verdict"))


@query("SELECT event_id, event_type = 'click' AS intended, event_type IN ('click', 'error') AS faithful FROM events")
def sufficiency_verdicts(spark, d):
    reply = F.when(F.col("event_type") == "click", "SUFFICIENT. It is not INSUFFICIENT.").when(F.col("event_type") == "error", "Insufficient: more is needed.").otherwise("Unclear")
    return table(spark, d, "events").select("event_id", parse.is_sufficient(reply).alias("intended"), parse.is_sufficient(reply, faithful=True).alias("faithful"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS answer FROM events")
def clean_answers(spark, d):
    return table(spark, d, "events").select("event_id", parse.answer(F.when(F.col("event_type") == "view", " A: ").otherwise(F.concat(F.lit("\nA:  "), F.col("event_type"), F.lit(" ")))).alias("answer"))


# graphs from extracted documents

_LINES = """l AS (SELECT l_orderkey::VARCHAR AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::BIGINT AS seq,
  p_name, p_brand, p_type, p_size, l_returnflag, l_discount, l_linestatus FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _extracted(spark, d):
    """A document for each order: the order and its parts as entities, and a relation to each part."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    docs = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*order, "p_name", "p_brand", "p_type", "p_size", "l_returnflag", "l_discount", "l_linestatus"))).alias("x"))
    name = F.concat(F.lit("Order#"), F.col("l_orderkey").cast("string"))
    entity = lambda n, t, a, s, at: F.struct(n.alias("name"), t.alias("type"), a.alias("aliases"), s.alias("description"), at.alias("attributes"))
    first = entity(name, F.lit("order"), F.array().cast("array<string>"), F.lit(""), F.create_map().cast("map<string,string>"))
    parts = F.transform("x", lambda p: entity(p["p_name"], F.lit("part"), F.array(p["p_brand"]), F.when(p["p_size"] > 25, p["p_type"]).otherwise(""), F.create_map(F.lit("size"), p["p_size"].cast("string"))))
    rels = F.transform("x", lambda p: F.struct(name.alias("source_name"), p["p_name"].alias("target_name"), F.array(p["l_returnflag"]).alias("types"), p["l_discount"].alias("strength"), p["l_linestatus"].alias("description")))
    return docs.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.struct(F.concat(F.array(first), parts).alias("entities"), rels.alias("relationships")).alias("graph"))


@query(f"WITH {_LINES} SELECT doc_id, seq, md5(p_name || '_part') AS id, p_name AS name, 'part' AS type FROM l UNION ALL SELECT DISTINCT doc_id, 0, md5('Order#' || doc_id || '_order'), 'Order#' || doc_id, 'order' FROM l")
def entity_ids_md5(spark, d):
    return resolve.entities(_extracted(spark, d)).select("doc_id", "seq", "id", "name", "type")


@query(
    f"WITH {_LINES} SELECT doc_id, seq - 1 AS seq, md5('Order#' || doc_id || '_' || p_name || '_RELATIONSHIP') AS id, md5('Order#' || doc_id || '_order') AS source_id, md5(p_name || '_part') AS target_id, l_returnflag AS types, l_discount AS strength, l_linestatus AS description FROM l"
)
def resolve_endpoints(spark, d):
    return resolve.relations(_extracted(spark, d)).withColumn("types", F.array_join("types", ","))


@query(
    f"""WITH {_LINES}, k AS (SELECT *, CASE WHEN l_returnflag <> lag(l_returnflag) OVER w THEN 1 ELSE 0 END AS turn FROM l WINDOW w AS (PARTITION BY doc_id, p_name ORDER BY seq)),
g AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id, p_name ORDER BY seq) AS run FROM k),
m AS (SELECT *, max(run) OVER (PARTITION BY doc_id, p_name) AS last, count(*) OVER (PARTITION BY doc_id, p_name) AS n FROM g)
SELECT doc_id, md5('Order#' || doc_id || '_' || p_name || '_RELATIONSHIP') AS id, min(l_returnflag) AS types, max(l_discount) AS strength, string_agg(l_linestatus, ' | ' ORDER BY seq) AS description, min(n)::INTEGER AS n_rows
FROM m WHERE run = last GROUP BY doc_id, p_name"""
)
def rel_merge_fold(spark, d):
    return resolve.merge_relations(resolve.relations(_extracted(spark, d))).select("doc_id", "id", F.array_join("types", ",").alias("types"), "strength", "description", "n_rows")


@query(
    f"""WITH {_LINES} SELECT doc_id, min(seq) AS leader_seq, md5(p_name || '_part') AS id, p_name AS name, list_aggregate(list_sort(list_distinct(list(p_brand))), 'string_agg', ',') AS aliases,
coalesce(arg_min(p_type, seq) FILTER (WHERE p_size > 25), '') AS description, arg_max(p_size, seq)::VARCHAR AS size, count(*)::INTEGER AS n_rows FROM l GROUP BY doc_id, p_name"""
)
def entity_merge(spark, d):
    """Entities of a document with the same name merged; similar names are dedup_entities."""
    found = resolve.entities(_extracted(spark, d)).where(F.col("type") == "part")
    first = found.groupBy("doc_id", "name").agg(F.min("seq").alias("leader_seq"))
    led = found.join(first, ["doc_id", "name"]).withColumn("leader_doc", F.col("doc_id")).withColumn("leader_id", F.col("id"))
    return resolve.merge_entities(led).select(F.col("leader_doc").alias("doc_id"), "leader_seq", "id", "name", F.array_join("aliases", ",").alias("aliases"), "description", F.col("attributes")["size"].alias("size"), "n_rows")


@query()
def dedup_entities(spark, d):
    """Entities of a document with similar names merged, in order: the fold that SQL has no words for."""
    return resolve.merge_entities(resolve.assign_leaders(resolve.entities(_extracted(spark, d)))).select("leader_doc", "leader_seq", "id", "name", F.array_join("aliases", ",").alias("aliases"), "n_rows")


@query(
    f"""WITH {_LINES} SELECT doc_id, md5('Order#' || doc_id || '_' || p_name || '_RELATIONSHIP') AS id, md5('Order#' || doc_id || '_order') AS source_id, md5(p_name || '_part') AS target_id, l_returnflag AS types,
max(l_discount) AS strength, string_agg(l_linestatus, ' | ' ORDER BY seq) AS description FROM l GROUP BY doc_id, p_name, l_returnflag"""
)
def built_relations(spark, d):
    """Relations of documents whose entities of the same name are merged, each with the ends that stand for its own."""
    return _built(spark, d, 1.0)


@query()
def built_relations_similar(spark, d):
    """The same with entities of similar names merged: the fold that SQL has no words for."""
    return _built(spark, d, resolve.THRESHOLD)


def _built(spark, d, threshold):
    return resolve.build(_extracted(spark, d), threshold)[1].select("doc_id", "id", "source_id", "target_id", F.array_join("types", ",").alias("types"), "strength", "description")


def _said(prompt: str) -> str:
    """Stands for a model that reads "a is a b of c"."""
    name, _, rest = prompt.rsplit("Text:\n", 1)[1].partition(" is a ")
    kind, _, brand = rest.partition(" of ")
    entities = [{"name": name, "type": kind, "description": ""}, {"name": brand, "type": "brand", "description": "a brand"}]
    return "```json\n" + json.dumps({"entities": entities, "relationships": [{"source": name, "target": brand, "description": "", "relationship_types": ["MADE_BY"], "strength": "strong"}]}) + "\n```"


@query("SELECT p_partkey AS doc_id, p_name || '|' || p_brand AS names, p_type || '|brand' AS types, p_name || '>MADE_BY>' || p_brand || '>strong' AS relation FROM part")
def text_to_graph(spark, d):
    """Graphs from sentences by a model (here a rule in a model's place), in the plainer form."""
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat("p_name", F.lit(" is a "), "p_type", F.lit(" of "), "p_brand").alias("text"))
    g = F.col("graph")
    r = F.get(g["relationships"], 0)
    found = assisted.graphs(docs, lambda: models.Function(_said), attributes=False)
    return found.select("doc_id", F.array_join(g["entities"]["name"], "|").alias("names"), F.array_join(g["entities"]["type"], "|").alias("types"), F.concat_ws(">", r["source"], F.array_join(r["relationship_types"], ","), r["target"], r["strength"]).alias("relation"))


# changing a graph


def _customers(spark, d):
    return project(spark, d, ("customer", "nation"), ("LIVES_IN",))


@query("SELECT 'customer:' || c_custkey AS id, c_name AS name, 'VIP' AS type, 'BUILDING' AS segment, c_mktsegment AS was FROM customer WHERE c_mktsegment = 'MACHINERY' UNION ALL SELECT 'customer:' || c_custkey, c_name, 'customer', c_mktsegment, NULL FROM customer WHERE c_mktsegment <> 'MACHINERY' OR c_mktsegment IS NULL UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation', NULL, NULL FROM nation")
def node_upsert(spark, d):
    g = _customers(spark, d)
    segment = F.col("props")["c_mktsegment"]
    again = g.nodes.where(segment == "MACHINERY").select("id", F.lit(None).cast("string").alias("name"), F.lit("VIP").alias("type"), F.lit(None).cast("array<string>").alias("labels"), F.create_map(F.lit("c_mktsegment"), F.lit("BUILDING"), F.lit("was"), segment).alias("props"))
    return g.add_nodes(again).nodes.select("id", "name", "type", segment.alias("segment"), F.col("props")["was"].alias("was"))


@query("SELECT 'customer:' || c_custkey AS id, c_name AS name, 'customer' AS type FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'nation:' || n_nationkey, NULL FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def edge_autocreate(spark, d):
    g = _customers(spark, d)
    return PropertyGraph(g.nodes.where(F.col("type") == "customer"), g.edges.limit(0)).add_edges(g.edges).nodes.select("id", "name", "type")


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'LIVES_IN|customer:' || c_custkey || '|nation:' || c_nationkey FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'nation:' || n_nationkey FROM nation WHERE n_nationkey <> 3")
def delete_node(spark, d):
    g = _customers(spark, d)
    in_three = g.edges.where(F.col("dst") == "nation:3").select(F.col("src").alias("id"))
    g = g.delete_nodes(F.col("id") == "nation:3", detach=True)
    return PropertyGraph(g.nodes.join(in_three, "id", "left_anti"), g.edges).query("SELECT id FROM {nodes} UNION ALL SELECT id FROM {edges}")


@query("SELECT 'customer:' || c_custkey AS id, c_mktsegment AS segment, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'gold' END AS tier FROM customer")
def update_node(spark, d):
    g = _customers(spark, d).update_nodes(F.col("props")["c_mktsegment"] == "MACHINERY", tier="gold")
    return g.nodes.where(F.col("type") == "customer").select("id", F.col("props")["c_mktsegment"].alias("segment"), F.col("props")["tier"].alias("tier"))


@query("SELECT 'KNOWN_AS|nation:' || n_nationkey || '|region:' || r_regionkey AS id, 'nation:' || n_nationkey AS src, 'region:' || r_regionkey AS dst, 'KNOWN_AS' AS type FROM nation, region WHERE r_name IN ('REGION_1', 'REGION_3')")
def relate_by_name(spark, d):
    """An edge from each nation of a name to each region of a name: two equi-joins by label and name."""
    g = project(spark, d, ("nation", "region"), ("IN_REGION",))
    pairs = table(spark, d, "nation").select(F.lit("nation").alias("src_label"), F.col("n_name").alias("src_name"), F.lit("region").alias("dst_label"), F.explode(F.array(F.lit("REGION_1"), F.lit("REGION_3"), F.lit("NONE"))).alias("dst_name"), F.lit("KNOWN_AS").alias("type"))
    g = PropertyGraph(g.nodes, g.edges.limit(0)).relate(pairs)
    return g.edges.select("id", "src", "dst", "type")


# N-Triples, JSON and drawing

_E, _P = ntriples.ENTITY, ntriples.PROPERTY


def _statements(spark, d):
    c = table(spark, d, "customer")
    uri = lambda kind, key: F.concat(F.lit(f"<{_E}{kind}:"), F.col(key).cast("string"), F.lit(">"))
    say = lambda s, p, o: F.concat(s, F.lit(f" <{_P}{p}> "), o, F.lit(" ."))
    own = F.array(say(uri("customer", "c_custkey"), "name", F.concat(F.lit('"'), F.col("c_name"), F.lit('"'))), say(uri("customer", "c_custkey"), "type", F.lit('"customer"')), say(uri("customer", "c_custkey"), "segment", F.concat(F.lit('"'), F.col("c_mktsegment"), F.lit('"'))), say(uri("customer", "c_custkey"), "LIVES_IN", uri("nation", "c_nationkey")), F.lit("# a comment"))
    lines = c.select(F.posexplode(own).alias("k", "value"), "c_custkey").select((F.col("c_custkey") * 8 + F.col("k")).alias("line"), "value")
    n = table(spark, d, "nation").select((F.col("n_nationkey") - 100).cast("long").alias("line"), say(uri("nation", "n_nationkey"), "label", F.concat(F.lit('"'), F.col("n_name"), F.lit('"'))).alias("value"))
    return lines.union(n)


_ST = f"""t AS (SELECT (c_custkey * 8)::BIGINT AS line, '{_E}customer:' || c_custkey AS s, '{_P}name' AS p, c_name AS o, false AS o_is_iri FROM customer
UNION ALL SELECT c_custkey * 8 + 1, '{_E}customer:' || c_custkey, '{_P}type', 'customer', false FROM customer
UNION ALL SELECT c_custkey * 8 + 2, '{_E}customer:' || c_custkey, '{_P}segment', c_mktsegment, false FROM customer
UNION ALL SELECT c_custkey * 8 + 3, '{_E}customer:' || c_custkey, '{_P}LIVES_IN', '{_E}nation:' || c_nationkey, true FROM customer
UNION ALL SELECT n_nationkey - 100, '{_E}nation:' || n_nationkey, '{_P}label', n_name, false FROM nation)"""


@query(f"WITH {_ST} SELECT * FROM t")
def nt_parse(spark, d):
    return ntriples.parse(_statements(spark, d))


@query(f"SELECT '{_E}customer:' || c_custkey AS id, c_name AS name, 'customer' AS type, c_mktsegment AS segment FROM customer UNION ALL SELECT '{_E}nation:' || n_nationkey, n_name, 'Unknown', NULL FROM nation")
def nt_build_nodes(spark, d):
    return ntriples.nodes(ntriples.parse(_statements(spark, d))).select("id", "name", "type", F.col("props")["segment"].alias("segment"))


@query(f"SELECT '{_E}customer:' || c_custkey AS id, 'Unknown' AS type, 'customer' AS type_property FROM customer UNION ALL SELECT '{_E}nation:' || n_nationkey, 'Unknown', NULL FROM nation")
def nt_build_nodes_faithful(spark, d):
    return ntriples.nodes(ntriples.parse(_statements(spark, d)), faithful=True).select("id", "type", F.col("props")["type"].alias("type_property"))


@query(f"SELECT 'e' || (row_number() OVER (ORDER BY c_custkey) - 1) AS id, '{_E}customer:' || c_custkey AS src, '{_E}nation:' || c_nationkey AS dst, 'LIVES_IN' AS type FROM customer")
def nt_edge_ids(spark, d):
    return ntriples.edges(ntriples.parse(_statements(spark, d))).select("id", "src", "dst", "type")


@query(
    f"""SELECT '<{_E}' || p_partkey || '> <{_P}name> "' || p_name || '" .' AS value FROM part UNION ALL SELECT '<{_E}' || p_partkey || '> <{_P}type> "' || p_type || '" .' FROM part
UNION ALL SELECT '<{_E}' || p_partkey || '> <{_P}description> "a \\"' || p_brand || '\\" part" .' FROM part UNION ALL SELECT '<{_E}' || p_partkey || '> <{_P}alias> "' || p_brand || '" .' FROM part
UNION ALL SELECT '<{_E}' || l_orderkey || '> <{_P}has_a_part> <{_E}' || l_partkey || '> .' FROM lineitem"""
)
def nt_emit(spark, d):
    e = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.concat(F.lit('a "'), F.col("p_brand"), F.lit('" part')).alias("description"), F.array(F.lit(""), F.col("p_brand")).alias("aliases"))
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("source_id"), F.col("l_partkey").cast("string").alias("target_id"), F.lit("has a (part)").alias("type"))
    return ntriples.entity_statements(e).unionByName(ntriples.relation_statements(r))


@query(f"SELECT '<{_E}' || c_custkey || '> <{_P}likes> <{_E}n' || c_nationkey || '> .' AS value FROM customer")
def nt_from_prose(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    e = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("seq")).unionByName(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("seq")))
    said = c.select(F.concat(F.lit(" "), F.lower("c_name"), F.lit(" likes nation_"), F.col("c_nationkey").cast("string"), F.lit(". ")).alias("description"))
    return ntriples.prose_statements(e, said)


@query("""SELECT '{"name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}' AS json FROM customer UNION ALL SELECT '{"name":"' || n_name || '"}' FROM nation""")
def json_export_entities(spark, d):
    return jsonkg.entity_objects(_customers(spark, d))


@query("""SELECT '{"source":"customer:' || c_custkey || '","target":"nation:' || c_nationkey || '","n":"1"}' AS json FROM customer""")
def json_export_relationships(spark, d):
    return jsonkg.relationship_objects(_customers(spark, d))


_SEGMENTS = "s AS (SELECT c_mktsegment AS k, c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _json_files(spark, d):
    """A file for each customer: the customer with a segment, its nation by name only, and the relationship."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    text = lambda *kv: F.create_map(*[F.lit(x) if k % 2 == 0 else x for k, x in enumerate(kv)])
    return c.select(
        F.array(text("name", F.col("c_name"), "type", F.lit("customer"), "segment", F.col("c_mktsegment"))).alias("entities"),
        F.array(text("source", F.col("c_name"), "target", F.col("n_name"), "type", F.lit("LIVES_IN"))).alias("relationships"), F.format_string("%012d", "c_custkey").alias("file"),
    )


@query(f"WITH {_SEGMENTS} SELECT c_name AS id, 'customer' AS type, k AS segment FROM s UNION ALL SELECT DISTINCT n_name, NULL, NULL FROM s")
def json_load_nodes(spark, d):
    return jsonkg.load(_json_files(spark, d)).nodes.select("id", "type", F.col("props")["segment"].alias("segment"))


@query(f"WITH {_SEGMENTS} SELECT c_name AS src, n_name AS dst, 'LIVES_IN' AS type FROM s")
def json_load_edges(spark, d):
    return jsonkg.load(_json_files(spark, d)).edges.select("src", "dst", "type")


@query("SELECT 'customer:' || c_custkey AS id, c_name AS label, CASE c_mktsegment WHEN 'MACHINERY' THEN '#111111' WHEN 'BUILDING' THEN '#222222' ELSE '#D3D3D3' END AS color FROM customer UNION ALL SELECT 'nation:' || n_nationkey, n_name, '#D3D3D3' FROM nation")
def render_colors(spark, d):
    return html.mapped_nodes(_customers(spark, d), "c_mktsegment", {"MACHINERY": "#111111", "BUILDING": "#222222"})


_PAL = "[" + ", ".join(f"'{c}'" for c in html.PALETTE) + "]"


@query(GRAPH + f", t AS (SELECT type, {_PAL}[((row_number() OVER (ORDER BY type) - 1) % 10 + 1)::INTEGER] AS color FROM (SELECT DISTINCT type FROM nodes)) SELECT src, dst, e.type AS label, color FROM edges e JOIN nodes n ON n.id = dst JOIN t ON t.type = n.type")
def palette_edge_colors(spark, d):
    return html.palette_edges(project(spark, d))


# figures over paths


def _order_paths(spark, d):
    """A path for each order: order, customer, nation; its confidence a share or a percentage."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    step = lambda h, s, p, t: F.struct(F.lit(h).alias("hop"), s.alias("subject"), F.lit(p).alias("predicate"), t.alias("object"))
    name = F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string"))
    conf = F.when(F.col("o_orderstatus") == "P", F.lit(0.0)).when(F.col("o_orderstatus") == "F", F.lit(75.0)).otherwise(F.lit(0.5))
    return o.select(F.col("o_orderkey").cast("string").alias("path_id"), F.array(step(1, name, "PLACED_BY", F.col("c_name")), step(2, F.col("c_name"), "LIVES_IN", F.col("n_name"))).alias("triples"), conf.alias("confidence"))


_OP = "p AS (SELECT o_orderkey::VARCHAR AS path_id, 'Order#' || o_orderkey AS a, c_name AS b, n_name AS c, CASE o_orderstatus WHEN 'P' THEN 0.0 WHEN 'F' THEN 0.75 ELSE 0.5 END::DOUBLE AS conf FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


@query(f"WITH {_OP} SELECT round(coalesce(avg(conf) FILTER (WHERE conf > 0), 0), 6) AS avg_confidence FROM p")
def avg_confidence(spark, d):
    return metrics.average_confidence(_order_paths(spark, d)).select(F.round("avg_confidence", 6).alias("avg_confidence"))


@query(f"WITH {_OP} SELECT a AS name FROM p UNION SELECT b FROM p UNION SELECT c FROM p")
def unique_entities(spark, d):
    return metrics.unique_entities(_order_paths(spark, d))


@query(f"WITH {_OP} SELECT true AS success, (SELECT count(*) FROM p) AS n_paths, (SELECT count(DISTINCT x) FROM (SELECT unnest([a, b, c]) AS x FROM p)) AS n_entities, round((SELECT avg(conf) FROM p WHERE conf > 0), 6) AS avg_confidence")
def metric_panel(spark, d):
    return metrics.panel(_order_paths(spark, d)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(f"WITH {_OP} SELECT path_id, 0 AS step, a AS subject, 'PLACED_BY' AS relation, b AS object FROM p UNION ALL SELECT path_id, 1, b, 'LIVES_IN', c FROM p")
def triple_table(spark, d):
    return metrics.triple_table(_order_paths(spark, d))


@query("SELECT event_id, CASE WHEN value > 1 THEN value / 100 ELSE value END AS share, CASE WHEN (props->>'$.k')::DOUBLE > 1 THEN (props->>'$.k')::DOUBLE / 100 ELSE (props->>'$.k')::DOUBLE END AS first_share FROM events")
def confidence_shares(spark, d):
    return table(spark, d, "events").select("event_id", as_share(F.col("value")).alias("share"), first_confidence(F.get_json_object("props", "$.confidence"), F.get_json_object("props", "$.k"), F.col("value").cast("string")).alias("first_share"))


@query("SELECT o_orderkey, printf('%.1f%%', (o_orderkey % 1000) / 10.0) AS percent, printf('%.3f', (o_orderkey % 1000) / 1000.0) AS score FROM orders")
def figures_as_text(spark, d):
    share = (F.col("o_orderkey") % 1000) / 1000
    return table(spark, d, "orders").select("o_orderkey", percent_text(share).alias("percent"), score_text(share).alias("score"))


@query("SELECT event_id, event_type AS level FROM events WHERE event_type = 'error'")
def log_view(spark, d):
    return metrics.log_view(table(spark, d, "events").select("event_id", F.col("event_type").alias("level")), "error")


@query("SELECT DISTINCT event_type AS level FROM events")
def log_levels(spark, d):
    return metrics.log_levels(table(spark, d, "events").select(F.col("event_type").alias("level")))


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, event_type AS query, props AS result FROM events")
def history_newest_first(spark, d):
    return metrics.history_view(table(spark, d, "events").select(timestamp_text(F.col("ts")).alias("timestamp"), F.col("event_type").alias("query"), F.col("props").alias("result")))


@query("SELECT event_id, strftime(ts, '%H:%M:%S') AS clock, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events")
def time_texts(spark, d):
    return table(spark, d, "events").select("event_id", clock(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("clock"), timestamp_text(F.col("ts")).alias("stamp"))


@query("SELECT p_partkey, md5(p_name || '_' || p_type) AS id, replace(replace(p_brand, '#', ''), ' ', '_') AS uri, p_type AS local FROM part")
def text_functions(spark, d):
    return table(spark, d, "part").select("p_partkey", entity_id(F.col("p_name"), F.col("p_type")).alias("id"), uri_name(F.col("p_brand")).alias("uri"), local_name(F.concat(F.lit("http://x/y/"), F.col("p_type"))).alias("local"))


# text, and extensions


_SPLIT = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}#_]+'), lambda w: w <> '')"


@query(
    GRAPH
    + f""", t AS (SELECT doc_id, {_SPLIT.format("text")} AS w FROM documents WHERE text IS NOT NULL), k AS (SELECT unnest([1, 2, 3]) AS k),
x AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS run FROM t, k),
m AS (SELECT DISTINCT name AS mention, array_to_string({_SPLIT.format("name")}, ' ') AS run FROM nodes)
SELECT DISTINCT doc_id, mention FROM x JOIN m ON x.run = m.run WHERE m.run <> ''"""
)
def doc_mentions(spark, d):
    """Names of all nodes, of up to three words, in all documents."""
    return extract.mentions(table(spark, d, "documents"), project(spark, d).nodes)


@query("SELECT c_custkey, 'Ada Lovelace>founded>Acme|Bob>runs>Big Co' AS svo, 'Ada Lovelace,Acme,Later,Eve,Bob,Big Co' AS names FROM customer")
def svo_rules(spark, d):
    text = F.concat(F.lit("Ada Lovelace founded Acme in "), F.col("c_custkey").cast("string"), F.lit(". Later, with Eve, then Bob runs Big Co."))
    svo = F.transform(extract.subject_verb_object(text, ["founded", "runs"]), lambda x: F.concat_ws(">", x["source"], x["relation"], x["target"]))
    return table(spark, d, "customer").select("c_custkey", F.array_join(svo, "|").alias("svo"), F.array_join(extract.capitalised(text), ",").alias("names"))


@query(GRAPH + ", e AS (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM e GROUP BY id")
def degree_summary(spark, d):
    return metrics.degrees(project(spark, d).edges)


@query(GRAPH + "SELECT e.type, n.type AS target_type, count(*) AS n FROM edges e JOIN nodes n ON n.id = e.dst GROUP BY ROLLUP (e.type, n.type)")
def rollup_summary(spark, d):
    g = project(spark, d)
    return g.edges.select("type", "dst").join(g.nodes.select(F.col("id").alias("dst"), F.col("type").alias("target_type")), "dst").rollup("type", "target_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'event:' || event_id AS id, 'customer:' || user_id AS src, 'key:' || coalesce(props->>'$.k', 'none') AS dst, upper(event_type) AS type FROM events")
def stream_edges(spark, d):
    return stream.edges(table(spark, d, "events")).select("id", "src", "dst", "type")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, upper(event_type) AS type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, d):
    found = stream.windowed(stream.edges(table(spark, d, "events")))
    return found.select(timestamp_text(F.col("start")).alias("start"), "type", "n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine best neighbours of a named nation, either direction, scored and ranked."""
    g = project(spark, sf_dir)
    seed = written(link.exact(spark.createDataFrame([("nation_3",)], "mention string"), g.nodes).select("id"), "seed")
    ids = explore.few_ids(seed, "id")
    found = expand.candidates(g, seed.select(F.col("id").alias("last_id")), ids=ids, numbered=False)
    met = explore.few_ids(found, "there")
    named = found.join((g.nodes if met is None else g.by_ids(met)).select(F.col("id").alias("there"), "name", F.col("type").alias("node_type")), "there")
    scored = named.withColumn("score", name_similarity(F.col("name"), F.lit("Which Customer lives in nation 3")))
    return prune.top_n(scored, ["last_id"], 9, idx=expand.DISCOVERY).select("last_id", "edge_id", "type", "there", "name", "node_type", "is_incoming", "score", "rank")


QUERIES["top9_neighbours"] = flagship
SQL["top9_neighbours"] = (
    GRAPH
    + f""", c AS (SELECT here AS last_id, edge_id, b.type, there, n.name, n.type AS node_type, is_incoming, row_number() OVER (PARTITION BY here ORDER BY is_incoming, edge_id) AS idx, {_SIM.format(a="n.name", b="'Which Customer lives in nation 3'")} AS score FROM both_ways b JOIN nodes n ON n.id = there WHERE here = 'nation:3'),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, idx)::INTEGER AS rank FROM c) SELECT last_id, edge_id, type, there, name, node_type, is_incoming, score, rank FROM r WHERE rank <= 9"""
)
