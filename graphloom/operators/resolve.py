"""From extracted graphs to one graph: ids, endpoints, and merging of entities and relations that are the same.

Documents are rows with doc_id and graph (see schema.GRAPH_V2). Merging relations is an ordered fold per id in the
JVM. Merging entities goes by the first leader of the same type whose name is similar enough, in order:
it is sequential by definition, so it runs per block of (scope, type), which loses nothing as types must be
equal. Within a block a leader is compared only if its length allows the similarity.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.columns import entity_id
from graphloom.shared import written

#: Similarity from which two names of a type are one entity.
THRESHOLD = 0.8


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, seq, id, name, type, aliases, description, attributes of each entity, in order of its document; defaults for what is missing."""
    each = docs.select("doc_id", F.posexplode("graph.entities").alias("seq", "e"))
    name, kind = F.coalesce("e.name", F.lit("")), F.coalesce("e.type", F.lit("UNKNOWN"))
    return each.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("seq").cast("long").alias("seq"), entity_id(name, kind).alias("id"), name.alias("name"), kind.alias("type"),
        F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("e.description", F.lit("")).alias("description"), F.coalesce("e.attributes", F.create_map().cast("map<string,string>")).alias("attributes"),
    )


def relations(docs: DataFrame) -> DataFrame:
    """doc_id, seq, id, source_id, target_id, types, strength, description of relations whose both ends are names of entities of the document.

    A name's first entity is the end. The id is of the two names, whatever the types. A strength that is no number is 0.5.
    Ends are found within the row, among its own entities: a document's graph is one reply, so its lists are short, and nothing is shuffled.
    """
    entity = lambda e: F.struct(F.coalesce(e["name"], F.lit("")).alias("name"), entity_id(F.coalesce(e["name"], F.lit("")), F.coalesce(e["type"], F.lit("UNKNOWN"))).alias("id"))
    held = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.transform("graph.entities", entity).alias("es"), F.col("graph.relationships").alias("rs")).where(F.size("es") > 0)
    each = held.select("doc_id", F.col("es.name").alias("names"), F.col("es.id").alias("ids"), F.posexplode("rs").alias("seq", "r"))
    end = lambda side: F.get("ids", F.array_position("names", F.col(f"r.{side}_name")).cast("int") - 1).alias(f"{side}_id")  # noqa: E731  the first of a name; none is place -1, which is null
    made = entity_id(F.concat("r.source_name", F.lit("_"), "r.target_name"), F.lit("RELATIONSHIP"))
    rows = each.select("doc_id", F.col("seq").cast("long").alias("seq"), made.alias("id"), end("source"), end("target"), F.coalesce("r.types", F.array().cast("array<string>")).alias("types"), F.coalesce("r.strength", F.lit(0.5)).alias("strength"), F.coalesce("r.description", F.lit("")).alias("description"))
    return rows.where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull())


def merge_relations(rows: DataFrame, scope: list[str] = ["doc_id"], keep_both: bool = False) -> DataFrame:  # noqa: B006
    """One row per scope and id: in order, a relation that shares a type with what is held is merged into it, one that shares none takes its place.

    Merged: types united, the greater strength, descriptions joined by " | " without those characters at
    the ends. keep_both: relations without a common type stay apart instead, with their types in the id's place among the keys.
    """
    held = F.struct("seq", "source_id", "target_id", "types", "strength", "description")
    key = [*scope, "id"]
    if keep_both:
        rows = rows.withColumn("kind", F.array_join(F.array_sort("types"), "|"))
        key = [*key, "kind"]
    sorted_ = F.array_sort(F.collect_list(held))

    def step(a, r):
        joined = F.btrim(F.concat(a["description"], F.lit(" | "), r["description"]), F.lit(" |"))
        merged = F.struct(a["seq"].alias("seq"), a["source_id"].alias("source_id"), a["target_id"].alias("target_id"), F.array_union(a["types"], r["types"]).alias("types"), F.greatest(a["strength"], r["strength"]).alias("strength"), joined.alias("description"))
        return F.when(F.arrays_overlap(a["types"], r["types"]), merged).otherwise(r)

    folded = rows.groupBy(*key).agg(sorted_.alias("rs")).withColumn("r", F.aggregate(F.slice("rs", 2, F.greatest(F.size("rs") - 1, F.lit(0))), F.get("rs", 0), step))
    return folded.select(*scope, "id", "r.source_id", "r.target_id", F.array_sort("r.types").alias("types"), "r.strength", "r.description", F.size("rs").alias("n_rows"))


def _same(a: str, b: str, least: int) -> bool:
    """Rounded similarity in percent reaches `least`; lengths and letters that rule it out are tried first."""
    m = SequenceMatcher(None, a, b)
    need = (least - 0.5) / 100
    return m.real_quick_ratio() >= need and m.quick_ratio() >= need and round(100 * m.ratio()) >= least


def assign_leaders(found: DataFrame, threshold: float = THRESHOLD, scope: str = "document") -> DataFrame:
    """found with leader_doc, leader_seq and leader_id: the first earlier entity of the block that stands for others and is similar, or itself.

    scope: "document" compares within a document, "corpus" within all (order: doc_id, seq). Empty names are alike.
    A name that comes again, without case, meets the same leaders in the same order, so only the first place of
    each distinct name of a block is folded; blocks come sorted through a partition and are folded one after the other.
    """
    least = round(threshold * 100)
    block = ["doc_id", "type"] if scope == "document" else ["type"]
    low = F.lower("name").alias("low")
    first = found.groupBy(*block, low).agg(F.min(F.struct("doc_id", "seq", "id")).alias("at"))
    first = first.select(F.concat_ws("\x00", *block).alias("block"), "low", F.col("at.doc_id").alias("leader_doc"), F.col("at.seq").alias("leader_seq"), F.col("at.id").alias("leader_id"))
    columns = ["block", "low", "leader_doc", "leader_seq", "leader_id"]

    def run(frames):
        now, leaders = None, []
        for pdf in frames:
            out = []
            for row in pdf[columns].itertuples(index=False, name=None):
                if row[0] != now:
                    now, leaders = row[0], []
                hit = next((x for x in leaders if _same(row[1], x[1], least)), None)
                if hit is None:
                    leaders.append(row)
                    hit = row
                out.append((row[0], row[1], *hit[2:]))
            yield pd.DataFrame(out, columns=columns)

    folded = first.repartition("block").sortWithinPartitions("block", "leader_doc", "leader_seq").mapInPandas(run, "block string, low string, leader_doc string, leader_seq long, leader_id string")
    return found.withColumns({"block": F.concat_ws("\x00", *block), "low": low}).join(folded, ["block", "low"]).drop("block", "low")


def merge_entities(led: DataFrame) -> DataFrame:
    """leader_doc, leader_seq, id, name, type, aliases, description, attributes: each leader with what its members add.

    Aliases are united (sorted), the first description that is not empty stays, later attributes win. All of it combines
    before the shuffle, so a leader's members never meet as a list.
    """
    key, order = ["leader_doc", "leader_seq"], F.struct("doc_id", "seq")
    described = F.when(F.col("description") != "", order)
    rows = led.groupBy(*key).agg(F.min(F.struct("doc_id", "seq", "id", "name", "type")).alias("first"), F.collect_set("aliases").alias("sets"), F.min_by("description", described).alias("description"), F.max(described.isNotNull()).alias("has"), F.count(F.lit(1)).cast("int").alias("n_rows"))
    each = led.select(*key, order.alias("o"), F.explode("attributes").alias("k", "v")).groupBy(*key, "k").agg(F.max_by("v", "o").alias("v"))
    props = each.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))
    out = rows.select(*key, "first.id", "first.name", "first.type", F.array_sort(F.array_distinct(F.flatten("sets"))).alias("aliases"), F.when(F.col("has"), F.col("description")).otherwise("").alias("description"), "n_rows")
    return out.join(props, key, "left").withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))


def remap_ends(rows: DataFrame, led: DataFrame) -> DataFrame:
    """Relations with their ends replaced by the leaders that stand for them, so that none dangles."""
    to = led.groupBy("doc_id", "id").agg(F.min_by("leader_id", "seq").alias("leader_id"))
    for side in ("source_id", "target_id"):
        rows = rows.join(to.select("doc_id", F.col("id").alias(side), F.col("leader_id").alias("__to")), ["doc_id", side], "left").withColumn(side, F.coalesce("__to", side)).drop("__to")
    return rows


def build(docs: DataFrame, threshold: float = THRESHOLD, scope: str = "document", faithful: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of documents with graphs, which are made once. faithful: relations keep ends that merging took away."""
    docs = written(docs.select("doc_id", "graph"), "graphs")
    found = entities(docs)
    led = assign_leaders(found, threshold, scope)
    rows = relations(docs)
    return merge_entities(led), merge_relations(rows if faithful else remap_ends(rows, led), keep_both=not faithful)
