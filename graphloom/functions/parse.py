"""Replies of language models as columns: lists, scores, verdicts, answers and graphs.

Parsers give null (or empty) for what cannot be read; validators give whether it holds and why not, so
a batch is never stopped by one reply.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.schema import GRAPH_V1

#: Sums of scores within which they count as 1.
LEAST_SUM, MOST_SUM = 0.99, 1.01
_SPACE = " \t\n\r\x0b\x0c"


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACE))


def fenced(reply: Column, language: str = "") -> Column:
    """What the first pair of triple backticks holds, or else the whole reply."""
    tag = f"(?:{language})?" if language else ""
    inner = F.regexp_extract(reply, rf"(?s)```{tag}\s*(.*?)\s*```", 1)
    return F.when(reply.rlike(rf"(?s)```{tag}\s*(.*?)\s*```"), inner).otherwise(reply)


def entity_list(reply: Column) -> Column:
    """Names of a comma-separated reply, fenced or not, without blank ones."""
    return F.filter(F.transform(F.split(fenced(reply), ","), _strip), lambda x: x != "")


def scores(reply: Column) -> Column:
    """The JSON object between the first { and the last } as a map of numbers; {} if there is none or it can't be read."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.coalesce(F.from_json(body, "map<string,double>"), F.create_map().cast("map<string,double>"))


def pruning_scores(reply: Column) -> Column:
    """Scores of a fenced or bare JSON object; null if it can't be read."""
    return F.from_json(_strip(fenced(reply, "json")), "map<string,double>")


def scores_error(found: Column) -> Column:
    """Null if scores hold: some, summing to 1 within 0.01; else what is wrong."""
    total = F.aggregate(F.map_values(found), F.lit(0.0), lambda a, x: a + x)
    return F.when(found.isNull(), "not a JSON object of numbers").when(F.size(found) == 0, "no score").when(~total.between(LEAST_SUM, MOST_SUM), "scores must sum to 1")


def entities_error(names: Column) -> Column:
    return F.when(F.size(names) <= 0, "no entity")


def says_yes(reply: Column) -> Column:
    """True where the reply has yes in it, false where it has no; null where neither is."""
    low = F.lower(_strip(reply))
    return F.when(low.contains("yes"), True).when(low.contains("no"), False)


def is_sufficient(reply: Column, faithful: bool = False) -> Column:
    """Whether the verdict is SUFFICIENT: the reply's first word says so. faithful: the word occurs anywhere, as it does in INSUFFICIENT."""
    up = F.upper(reply)
    return up.contains("SUFFICIENT") if faithful else F.regexp_extract(up, r"^\W*(\w+)", 1) == "SUFFICIENT"


def answer(reply: Column) -> Column:
    """The reply without space around it and without a leading A:; null if nothing is left."""
    return F.nullif(F.regexp_replace(_strip(reply), r"^A:\s*", ""), F.lit(""))


def graph(reply: Column, schema=GRAPH_V1) -> Column:
    """A graph from JSON: as it is without fences, or from the first { to the last }; else an empty graph. Missing lists are empty."""
    plain = F.replace(F.replace(_strip(reply), F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    inner = F.regexp_extract(plain, r"(?s)\{.*\}", 0)

    read = lambda c: F.when(F.get_json_object(c, "$").startswith("{"), F.from_json(c, schema))  # noqa: E731  null where c is no object
    found = F.coalesce(read(plain), read(inner))
    lists = [F.coalesce(found[f.name], F.array().cast(f.dataType)).alias(f.name) for f in schema.fields]
    return F.struct(*lists)
