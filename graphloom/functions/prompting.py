"""Prompts for language models as columns: candidates become numbered lines, and lines a question to score or answer.

Replies are read by functions.parse: scores by 1-based number, a verdict in the first word, an answer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.columns import or_default


def relation_line(type_: Column, source: Column, target: Column) -> Column:
    return F.concat(F.lit("Relation: "), type_, F.lit(", Direction: "), or_default(source, "Unknown"), F.lit(" → "), or_default(target, "Unknown"))


def _described(name: Column, description: Column) -> Column:
    return F.when(or_default(description, "") == "", name).otherwise(F.concat(name, F.lit(": "), description))


def triple_line(source: Column, source_type: Column, relation: Column, target: Column, target_type: Column, source_text: Column | None = None, relation_text: Column | None = None, target_text: Column | None = None) -> Column:
    """name (type) -[relation]-> name (type), each with its description, if it has one."""
    none = F.lit(None).cast("string")
    end = lambda n, t, d: _described(F.concat(n, F.lit(" ("), or_default(t, "Unknown"), F.lit(")")), none if d is None else d)
    return F.concat(end(source, source_type, source_text), F.lit(" -["), _described(relation, none if relation_text is None else relation_text), F.lit("]-> "), end(target, target_type, target_text))


def score_relations(question: Column, entity: Column, lines: Column, n: int) -> Column:
    ask = f"Choose up to {n} of the relations that help to answer the question. Reply with a JSON object from their numbers to weights between 0 and 1 that add up to 1, and nothing else."
    return F.concat(F.lit(ask + "\nQuestion: "), question, F.lit("\nEntity: "), entity, F.lit("\nRelations:\n"), lines)


def score_entities(question: Column, lines: Column) -> Column:
    ask = "Rate how much each statement helps to answer the question, from 0 (not at all) to 1. Reply with a JSON object from the statements' numbers to ratings, and nothing else."
    return F.concat(F.lit(ask + "\nQuestion: "), question, F.lit("\nStatements:\n"), lines)


def judge(question: str, paths: list[str]) -> str:
    return "Do these facts suffice to answer the question? Begin with SUFFICIENT or INSUFFICIENT, then say why.\nQuestion: " + question + "\nFacts:\n" + "\n".join(f"{i}. {p}" for i, p in enumerate(paths, 1))


def answer(question: str, paths: list[str]) -> str:
    return "Answer the question from these facts alone.\nQuestion: " + question + "\nFacts:\n" + "\n".join(f"{i}. {p}" for i, p in enumerate(paths, 1))


def entities_of(question: Column) -> Column:
    return F.concat(F.lit("List the entities that the question names, separated by commas, between triple backticks.\nQuestion: "), question)


def graph_of(text: Column, attributes: bool = True) -> Column:
    """A request for a graph as JSON: with names, aliases, attributes and numeric strengths (schema.GRAPH_V2), or the plainer schema.GRAPH_V1."""
    entity = '{"name": "", "type": "", "aliases": [], "description": "", "attributes": {}}' if attributes else '{"name": "", "type": "", "description": ""}'
    relation = '{"source_name": "", "target_name": "", "types": [], "strength": 0.5, "description": ""}' if attributes else '{"source": "", "target": "", "description": "", "relationship_types": [], "strength": "weak, medium or strong"}'
    ask = f'Find the entities in the text and how they are related. Reply with JSON of this form alone: {{"entities": [{entity}], "relationships": [{relation}]}}\nText:\n'
    return F.concat(F.lit(ask), text)
