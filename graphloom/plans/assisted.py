"""Steps that ask a language model, over whole frames: prompts are built in the JVM, asked in batches of a partition, and replies read in the JVM.

make() gives each task its model (functions.models); a stub makes every step testable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import models, parse, prompting
from graphloom.operators import prune, resolve
from graphloom.schema import GRAPH_V1, GRAPH_V2

Make = Callable[[], models.ChatModel]


def make_by_name(model: str | None, client: dict | None = None, default: str = "gpt-4o") -> Make:
    """What makes a hosted model by its name, at the service that the name speaks of: the default where a caller has a name and no extractor."""
    return lambda: models.hosted(model or default, client=client)


def question_entities(questions: DataFrame, make: Make | str, on_error: str = "raise") -> DataFrame:
    """question, mention: the entities that a model (make, or a hosted one's name) finds in each question (column question); questions without one give no row."""
    make = make_by_name(make) if isinstance(make, str) else make
    asked = questions.select("question", prompting.entities_of(F.col("question")).alias("prompt"))
    replies = models.distributed(asked, make, on_error=on_error, temperature=models.TEMPERATURES["extract_entities"])
    return replies.select("question", F.explode(parse.entity_list(F.col("reply"))).alias("mention"))


def _scored(candidates: DataFrame, key: list[str], prompts: DataFrame, make: Make, n: int, step: str) -> DataFrame:
    replies = models.distributed(prompts, make, on_error="empty", temperature=models.TEMPERATURES[step])
    one = F.to_json(F.array(*[F.col(k).cast("string") for k in key]))
    scores = replies.select(one.alias("__key"), parse.scores(F.col("reply")).alias("scores"))
    found = prune.with_index_scores(candidates.withColumn("__key", one), scores, "__key")
    return prune.top_n(found.drop("__key"), key, n)


def relations(candidates: DataFrame, make: Make, question: str, n: int) -> DataFrame:
    """candidates (path_id, last_name, idx, type, source_name, target_name) with score and rank: the n best of each path by a model.

    A reply that can't be read leaves its candidates without scores, in discovery order.
    """
    line = prompting.relation_line(F.col("type"), F.col("source_name"), F.col("target_name"))
    lines = prune.numbered(candidates, ["path_id", "last_name"], line)
    prompts = lines.select("path_id", prompting.score_relations(F.lit(question), F.col("last_name"), F.col("text"), n).alias("prompt"))
    return _scored(candidates, ["path_id"], prompts, make, n, "score_relations")


def entities(candidates: DataFrame, make: Make, question: str, n: int) -> DataFrame:
    """candidates (path_id, edge_id, idx, source_name, source_type, type, target_name, target_type) with score and rank: the n best of each path and relation."""
    line = prompting.triple_line(F.col("source_name"), F.col("source_type"), F.col("type"), F.col("target_name"), F.col("target_type"))
    lines = prune.numbered(candidates, ["path_id", "edge_id"], line)
    prompts = lines.select("path_id", "edge_id", prompting.score_entities(F.lit(question), F.col("text")).alias("prompt"))
    return _scored(candidates, ["path_id", "edge_id"], prompts, make, n, "score_entities")


def judge(model: models.ChatModel, question: str) -> Callable[[list[str]], bool]:
    """For explore(): whether a model finds the kept paths sufficient. No paths never are."""

    def ask(texts: list[str]) -> bool:
        if not texts:
            return False
        reply = model.generate([{"role": "user", "content": prompting.judge(question, texts)}], temperature=models.TEMPERATURES["sufficiency"])
        words = reply.strip().split()
        return bool(words) and words[0].strip(".,:;!*").upper() == "SUFFICIENT"

    return ask


def answerer(model: models.ChatModel) -> Callable[[str, list[str]], str]:
    """For answer(): a model's answer from the paths."""
    return lambda question, texts: model.generate([{"role": "user", "content": prompting.answer(question, texts)}], temperature=models.TEMPERATURES["answer"])


def graphs(docs: DataFrame, make: Make, attributes: bool = True, on_error: str = "empty") -> DataFrame:
    """doc_id, graph of documents (doc_id, text) by a model; one that fails or can't be read is empty."""
    asked = docs.select("doc_id", prompting.graph_of(F.coalesce("text", F.lit("")), attributes).alias("prompt"))
    replies = models.distributed(asked, make, on_error=on_error, temperature=models.TEMPERATURES["graph_v2" if attributes else "graph_v1"])
    return replies.select("doc_id", parse.graph(F.coalesce("reply", F.lit("")), GRAPH_V2 if attributes else GRAPH_V1).alias("graph"))


def knowledge_graph(docs: DataFrame, make: Make, threshold: float = resolve.THRESHOLD, scope: str = "document") -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of documents: extracted by a model, resolved and merged."""
    return resolve.build(graphs(docs, make), threshold, scope)
