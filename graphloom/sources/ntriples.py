"""N-Triples: reading lines, building a graph from triples, and writing graphs.

Line numbers order first-wins and last-wins rules. They go by the files' paths and the places in them: parts are read in
parallel, each line counts within its part, and the parts' sizes give what comes before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.columns import local_name, uri_name
from graphloom.graph import PropertyGraph

# fixed values: the name spaces that graphs are written with
ENTITY, PROPERTY = "http://example.org/entity/", "http://example.org/property/"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line, value of text files: lines are numbered from 0 in the order of the files' paths and their own, however the files are cut and dealt out."""
    part = ["__file", "__start"]
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"))
    sizes = rows.groupBy(*part).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))  # a row for each part of a file
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select(*part, "__first", before.alias("__before")), part).select((F.col("__before") + F.col("__at") - F.col("__first")).alias("line"), "value")


def parse(rows: DataFrame) -> DataFrame:
    """line, s, p, o, o_is_iri of lines (line, value): the first two spaces part them, a last " ." goes, < > and quotes around go.

    Blank lines, comments and lines of fewer than three parts are left out.
    """
    v = F.btrim("value", F.lit(" \t\r\n"))
    parts = F.split(v, " ", 3)
    kept = rows.select("line", v.alias("v"), parts.alias("x")).where((F.col("v") != "") & ~F.col("v").startswith("#") & (F.size("x") >= 3))
    o = F.regexp_replace(F.get("x", 2), r"(?s)^(.*) \..*$", "$1")
    iri = o.startswith("<")
    return kept.select("line", F.btrim(F.get("x", 0), F.lit("<>")).alias("s"), F.btrim(F.get("x", 1), F.lit("<>")).alias("p"), F.when(iri, F.btrim(o, F.lit("<>"))).otherwise(F.btrim(o, F.lit('"'))).alias("o"), iri.alias("o_is_iri"))


def _role(faithful: bool) -> Column:
    """type, name or other by predicate: a type's local name is type (faithful: has type in it but does not end so)."""
    low = F.lower("p")
    is_type = low.contains("type") & ~F.col("p").endswith("type") if faithful else F.lower(local_name(F.col("p"))) == "type"
    return F.when(is_type, "type").when(low.contains("name") | low.contains("label"), "name").otherwise("other")


def nodes(triples: DataFrame, faithful: bool = False) -> DataFrame:
    """id, name, type, labels, props of each subject: the first type and name win, of other predicates the last of each.

    Without a name it is the id's last part, without a type Unknown.
    """
    rows = triples.withColumn("role", _role(faithful))
    key = lambda role, value: F.min_by(value, F.when(F.col("role") == role, F.col("line")))
    fixed = rows.groupBy("s").agg(key("name", F.col("o")).alias("n"), F.max(F.col("role") == "name").alias("has_n"), key("type", local_name(F.col("o"))).alias("t"), F.max(F.col("role") == "type").alias("has_t"))
    each = rows.where(F.col("role") == "other").groupBy("s", local_name(F.col("p")).alias("k")).agg(F.max_by("o", "line").alias("v"))
    props = each.groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    kind = F.when(F.col("has_t"), F.col("t")).otherwise("Unknown")
    return fixed.join(props, "s", "left").select(F.col("s").alias("id"), F.when(F.col("has_n"), F.col("n")).otherwise(local_name(F.col("s"))).alias("name"), kind.alias("type"), F.array(kind).alias("labels"), F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"))


def edges(triples: DataFrame) -> DataFrame:
    """id, src, dst, type, props of triples whose object is a subject too; ids e0, e1, ... in file order.

    The running number comes from counts of ranges of lines, so it needs no single task.
    """
    known = triples.select(F.col("s").alias("o")).distinct()
    found = triples.join(known, "o", "left_semi")
    return numbered(found).select(F.concat(F.lit("e"), F.col("n").cast("string")).alias("id"), F.col("s").alias("src"), F.col("o").alias("dst"), local_name(F.col("p")).alias("type"), F.create_map(F.lit("predicate"), F.col("p")).alias("props"))


def numbered(rows: DataFrame, by: str = "line", span: int = 1 << 20) -> DataFrame:
    """rows with n, their 0-based place by `by`: places within ranges of `by`, plus the rows of the ranges before."""
    rows = rows.withColumn("__r", F.floor(F.col(by) / span))
    run = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("__r").agg(F.count(F.lit(1)).alias("c")).select("__r", F.coalesce(F.sum("c").over(run), F.lit(0)).alias("b"))  # a row for each range
    inside = Window.partitionBy("__r").orderBy(by)
    return rows.withColumn("n", F.row_number().over(inside) - 1).join(before, "__r").withColumn("n", F.col("n") + F.col("b")).drop("__r", "b")


def load(spark: SparkSession, path: str, faithful: bool = False) -> PropertyGraph:
    triples = parse(lines(spark, path))
    return PropertyGraph(nodes(triples, faithful), edges(triples))


def literal(c: Column) -> Column:
    """A quoted literal with backslash, quote and line ends escaped."""
    escaped = F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def _statement(s: Column, p: Column, o: Column) -> Column:
    return F.concat(F.lit("<"), s, F.lit("> <"), p, F.lit("> "), o, F.lit(" ."))


def entity_statements(entities: DataFrame) -> DataFrame:
    """value: statements of name, type, description and each alias that is not empty, of entities (id, name, type, description, aliases); nulls give none."""
    uri = F.concat(F.lit(ENTITY), F.col("id"))
    say = lambda key, c: _statement(uri, F.lit(f"{PROPERTY}{key}"), literal(c))
    aliases = F.transform(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a != ""), lambda a: say("alias", a))
    known = F.array(*[say(k, F.col(k)) for k in ("name", "type", "description")])
    return entities.where(F.col("id").isNotNull()).select(F.explode(F.concat(F.array_compact(known), aliases)).alias("value"))


def relation_statements(relations: DataFrame) -> DataFrame:
    """value: a statement for each relation (source_id, target_id, type)."""
    return relations.select(_statement(F.concat(F.lit(ENTITY), F.col("source_id")), F.concat(F.lit(PROPERTY), uri_name(F.col("type"))), F.concat(F.lit(f"<{ENTITY}"), F.col("target_id"), F.lit(">"))).alias("value"))


def prose_statements(entities: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Statements read from descriptions (description) by position: first word the subject, second the predicate, the rest without a last full stop the object.

    Subject and object are entities whose names they are, without case (the first by seq); others give none.
    """
    first = entities.where(F.col("name").isNotNull()).groupBy(F.lower("name").alias("k")).agg(F.min_by("id", "seq").alias("i"))
    x = F.split(F.btrim("description", F.lit(" \t\r\n")), " ", 3)
    rows = descriptions.select(x.alias("x")).where(F.size("x") >= 3).select(F.lower(F.get("x", 0)).alias("s"), F.get("x", 1).alias("p"), F.lower(F.regexp_replace(F.get("x", 2), r"\.+$", "")).alias("o"))
    rows = rows.join(first.select(F.col("k").alias("s"), F.col("i").alias("source_id")), "s").join(first.select(F.col("k").alias("o"), F.col("i").alias("target_id")), "o")
    return relation_statements(rows.select("source_id", "target_id", F.col("p").alias("type")))


def write(graph: PropertyGraph, path: str) -> None:
    """Writes a graph in parts: names, types, and edges with their types as predicates."""
    aliases = F.array().cast("array<string>")
    entities = entity_statements(graph.nodes.select("id", "name", "type", F.col("props")["description"].alias("description"), aliases.alias("aliases")))
    relations = relation_statements(graph.edges.select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "type"))
    entities.unionByName(relations).write.mode("overwrite").text(path)
