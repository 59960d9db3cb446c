"""Column expressions that the operators are made of; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_maps(a: Column, b: Column) -> Column:
    """Keys of both; b's value wins. Works whatever the session's policy for duplicate keys; null counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    x, y = F.coalesce(a, empty), F.coalesce(b, empty)
    return F.map_concat(F.map_filter(x, lambda k, _: ~F.array_contains(F.map_keys(y), k)), y)


def without_keys(props: Column, *keys: str) -> Column:
    return F.map_filter(props, lambda k, _: ~k.isin(*keys))


def not_visited(visited: Column, node: Column) -> Column:
    """False for a null node; an empty list holds nothing."""
    return node.isNotNull() & ~F.coalesce(F.array_contains(visited, node), F.lit(False))


def name_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, without case; two empty strings are alike."""
    x, y = F.lower(a), F.lower(b)
    longest = F.greatest(F.char_length(x), F.char_length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longest)


def combined_score(relation: Column, entity: Column, default: float = 0.5) -> Column:
    """The mean of two scores; a missing one counts as `default`."""
    return (F.coalesce(relation, F.lit(default)) + F.coalesce(entity, F.lit(default))) / 2


def as_share(confidence: Column) -> Column:
    """Confidences over 1 are percentages; null is 0."""
    c = F.coalesce(confidence.cast("double"), F.lit(0.0))
    return F.when(c > 1, c / 100).otherwise(c)


def first_confidence(*shapes: Column) -> Column:
    """The first of several places that a confidence may be in, as a share."""
    return as_share(F.coalesce(*[c.try_cast("double") for c in shapes]))


def entity_id(name: Column, type_: Column) -> Column:
    """md5 of name_type. The underscore makes ("a_b", "c") and ("a", "b_c") the same; kept, as ids must match."""
    return F.md5(F.concat(F.coalesce(name, F.lit("")), F.lit("_"), F.coalesce(type_, F.lit("UNKNOWN"))).cast("binary"))


def or_default(text: Column, default) -> Column:
    """text, or the default where it is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def uri_name(text: Column) -> Column:
    """Letters, digits, _, - and white space (Unicode) stay; a space becomes _."""
    return F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^\w\s\-]", ""), F.lit(" "), F.lit("_"))


def local_name(uri: Column) -> Column:
    return F.element_at(F.split(uri, "/"), -1)


def clock(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "HH:mm:ss")


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def relation_label(types: Column) -> Column:
    """Types of a chain of relations."""
    return F.array_join(types, " -> ")


def palette(rank: Column, colors: list[str]) -> Column:
    """The colour of a 0-based rank, going round."""
    return F.element_at(F.array(*[F.lit(c) for c in colors]), (rank % len(colors) + 1).cast("int"))


def looked_up(key: Column, colors: dict[str, str], default: str) -> Column:
    if not colors:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for kv in colors.items() for x in kv])
    return F.coalesce(table[F.coalesce(key, F.lit(""))], F.lit(default))


def percent_text(share: Column) -> Column:
    """A share as a percentage with a decimal: 0.815 is 81.5%."""
    return F.format_string("%.1f%%", share.cast("double") * 100)


def score_text(score: Column) -> Column:
    """A score with three decimals."""
    return F.format_string("%.3f", score.cast("double"))
