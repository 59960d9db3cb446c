"""Beam search over a graph: from linked seeds, hop by hop, to the best paths for a question.

A hop is a few joins over the whole frontier, whatever its number of paths. Frontiers after the first hold at
most max_paths rows: their ids are filters that reach the scans of edges and nodes (with PropertyGraph.indexed() a
hop reads only what it meets), and they are broadcast. Each hop's paths are written to the shared folder, so plans do not grow. Scoring is a column expression; Judge and Answerer see at most max_paths rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.columns import combined_score, name_similarity
from graphloom.graph import PropertyGraph
from graphloom.operators.expand import DISCOVERY, candidates
from graphloom.operators.metrics import Timings
from graphloom.operators.prune import bounded, first_n, top_n
from graphloom.shared import written

Scorer = Callable[[Column, str], Column]
#: Nodes that are looked up by id rather than joined, at most.
FEW = 1000


def few_ids(df: DataFrame, column: str) -> list[str] | None:
    """The distinct ids of a column if they are FEW at most."""
    ids = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(FEW + 1).collect()]
    return ids if len(ids) <= FEW else None


def lexical(name: Column, question: str) -> Column:
    """How similar a name is to the question by edit distance: the default, in the JVM and reproducible."""
    return name_similarity(name, F.lit(question))


@dataclass(frozen=True)
class ExploreConfig:
    """Limits of a search. faithful keeps the quirks: lowest scores kept, unscored relations, steps against an edge that stay, all paths kept as frontier."""

    max_iterations: int = 5
    max_paths: int = 9
    max_relations: int = 9
    max_entities: int = 9
    relation_scorer: Scorer = lexical
    entity_scorer: Scorer = lexical
    faithful: bool = False


def initial_paths(seeds: DataFrame) -> DataFrame:
    """A path for each seed (id, name): a place holder triple, the seed visited, confidence 1."""
    hop0 = F.struct(F.lit(0).alias("hop"), F.col("id").alias("subject_id"), F.col("name").alias("subject"), F.lit(None).cast("string").alias("predicate"), F.col("id").alias("object_id"), F.col("name").alias("object"), F.lit(False).alias("is_incoming"))
    return seeds.select(F.col("id").alias("path_id"), F.array(hop0).alias("triples"), F.array("id").alias("visited"), F.col("id").alias("last_id"), F.col("name").alias("last_name"), F.lit(1.0).alias("confidence"), F.lit(0).cast("long").alias("seq"))


def relation_step(graph: PropertyGraph, paths: DataFrame, question: str, config: ExploreConfig) -> DataFrame:
    """paths x their best relations: edge_id, type, there, is_incoming, rel_score, rel_rank."""
    found = candidates(graph, paths, F.col("visited"), few_ids(paths, "last_id"), numbered=False)
    if config.faithful:
        return first_n(found, ["path_id"], config.max_relations, DISCOVERY).withColumn("rel_score", F.lit(None).cast("double")).withColumnRenamed("rank", "rel_rank")
    scored = found.withColumn("rel_score", config.relation_scorer(F.col("type"), question))
    return top_n(scored, ["path_id"], config.max_relations, "rel_score", DISCOVERY).withColumnRenamed("rank", "rel_rank")


def entity_step(graph: PropertyGraph, related: DataFrame, question: str, config: ExploreConfig) -> DataFrame:
    """Paths longer by a triple, with the mean of relation and entity score as confidence; the best max_entities of each path and relation."""
    related = written(related, "related")
    ids = few_ids(related, "there")
    nodes = graph.nodes if ids is None else graph.by_ids(ids)
    names = nodes.select(F.col("id").alias("there"), F.col("name").alias("there_name"))
    met = related.join(names, "there").withColumn("ent_score", config.entity_scorer(F.col("there_name"), question))
    kept = top_n(met, ["path_id", "edge_id"], config.max_entities, "ent_score", ("rel_rank",))
    stays = F.col("is_incoming") if config.faithful else F.lit(False)
    next_id = F.when(stays, F.col("last_id")).otherwise(F.col("there"))
    next_name = F.when(stays, F.col("last_name")).otherwise(F.col("there_name"))
    rel = F.col("ent_score") if config.faithful else F.col("rel_score")  # the shared object ends up with the entity's score
    triple = F.struct(F.size("triples").alias("hop"), F.col("last_id").alias("subject_id"), F.col("last_name").alias("subject"), F.col("type").alias("predicate"), next_id.alias("object_id"), next_name.alias("object"), F.col("is_incoming").alias("is_incoming"))
    return kept.select(
        F.concat("path_id", F.lit(">"), "edge_id").alias("path_id"), F.array_append("triples", triple).alias("triples"), F.array_union("visited", F.array(next_id)).alias("visited"),
        next_id.alias("last_id"), next_name.alias("last_name"), combined_score(rel, F.col("ent_score")).alias("confidence"), "seq", "rel_rank", F.col("path_id").alias("parent"),
    )


def explore(graph: PropertyGraph, seeds: DataFrame, question: str, config: ExploreConfig = ExploreConfig(), judge: Callable[[list[str]], bool] | None = None, timings: Timings | None = None) -> DataFrame:  # noqa: B008
    """The best paths (schema.PATH): at most max_paths, best first by confidence, then arrival.

    After each hop judge, if given, sees the kept paths as text and may say that they suffice. Without a step
    from any seed there are no paths.
    """
    step = (timings or Timings()).step
    with step("seeds"):
        frontier = written(initial_paths(seeds), "seeds")
    kept: DataFrame | None = None
    for hop in range(1, config.max_iterations + 1):
        with step(f"hop {hop}"):
            new = entity_step(graph, relation_step(graph, frontier, question, config), question, config)
            columns = [c for c in new.columns if c not in ("rel_rank", "parent")]
            came = _numbered(new, hop).select(*columns)
            best = written(came if config.faithful else bounded(came, config.max_paths), "beam")
            everything = best if kept is None else kept.unionByName(best)
            kept = written(bounded(everything, config.max_paths, faithful=config.faithful), "kept")
            ended = not best.limit(1).count()
        if ended:
            break
        with step(f"judge {hop}"):
            enough = bool(judge) and judge([r.text for r in render(kept).collect()])  # max_paths rows
        if enough:
            break
        frontier = F.broadcast(kept if config.faithful else best)  # max_paths rows
    return kept.orderBy(F.desc("confidence"), "seq", "path_id")


def _numbered(new: DataFrame, hop: int) -> DataFrame:
    """seq: the hop that a path came from; within one, path ids are the order of arrival."""
    return new.withColumn("seq", F.lit(hop).cast("long"))


def render(paths: DataFrame) -> DataFrame:
    """path_id, text: names and relations joined by arrows; the place holder is its name alone."""
    part = lambda t: F.when(t["predicate"].isNull(), t["subject"]).otherwise(F.concat(t["subject"], F.lit(" -"), t["predicate"], F.lit("→ "), t["object"]))
    return paths.select("path_id", F.array_join(F.transform("triples", part), " → ").alias("text"))


def formatted(paths: DataFrame) -> DataFrame:
    """path_id, confidence, json: the triples as subject, predicate (left out where null) and object."""
    each = F.transform("triples", lambda t: F.struct(t["subject"].alias("subject"), t["predicate"].alias("predicate"), t["object"].alias("object")))
    return paths.select("path_id", "confidence", F.to_json(each).alias("json"))


def template_answer(question: str, texts: list[str]) -> str:
    """The default answer: the paths themselves."""
    return f"{question}\n" + "\n".join(f"{i}. {t}" for i, t in enumerate(texts, 1)) if texts else "No path was found."


def answer(graph: PropertyGraph, mentions: DataFrame, question: str, config: ExploreConfig = ExploreConfig(), judge=None, answerer: Callable[[str, list[str]], str] = template_answer, timings: Timings | None = None) -> DataFrame:  # noqa: B008
    """success, answer, paths (array) in one row, from mentions (mention) of a question; linking goes by exact name, then fuzzy. timings gets the seconds of each step."""
    from graphloom.operators.link import with_fallback

    timings = timings or Timings()
    with timings.step("linking"):
        seeds = written(with_fallback(mentions, graph.nodes).select("id", "name").distinct(), "linked")
    paths = explore(graph, seeds, question, config, judge, timings)
    rows = render(paths).collect()  # max_paths rows
    spark = graph.spark
    with timings.step("answer"):
        text = answerer(question, [r.text for r in rows])
    return spark.createDataFrame([(bool(rows), text, [r.text for r in rows])], "success boolean, answer string, paths array<string>")
