"""Linking mentions to nodes: by exact name, by a name that contains the mention, by fuzzy or edit-distance similarity, by vectors.

Exact linking is an equi-join. Containment is a theta join; it is cut down first: a name that contains a mention has all of
the mention's runs of three characters, so mentions meet names by that of their runs which fewest names have, and only mentions under
three characters are tried on all names, from the side that is small. What must meet all names (or all of a length) meets
them in SALTS parts, so that no key holds them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.columns import name_similarity
from graphloom.functions.similarity import weighted_ratio

#: Candidates of a mention that fuzzy linking looks at, and the least score it accepts.
CANDIDATES, LEAST = 10, 70
#: Parts that the rows of one key are dealt to; mentions, the few, go to all of them.
SALTS = 64


def _spread(mentions: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt: rows have one by a hash of their key, mentions have each."""
    return mentions.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), rows.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))


def _grams(text: Column) -> Column:
    """The distinct runs of three characters."""
    n = F.char_length(text)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def exact(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """mention, id, name, type: the node whose name is the mention without case; of several, that with the smallest id."""
    named = nodes.select(F.lower("name").alias("key"), F.struct("id", "name", "type").alias("node"))
    first = named.join(mentions.select(F.lower("mention").alias("key")).distinct(), "key", "left_semi").groupBy("key").agg(F.min("node").alias("node"))
    return mentions.withColumn("key", F.lower("mention")).join(first, "key").select("mention", "node.*")


def containing(mentions: DataFrame, nodes: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """mention, id, name, type, similarity, rank: the nodes whose names contain the mention, most similar first (ties: smaller id)."""
    named = nodes.select("id", "name", "type", F.lower("name").alias("n"))
    asked = mentions.select("mention", F.lower("mention").alias("m")).distinct()
    # each mention's run that fewest names have: counted for the mentions' runs alone
    runs = asked.select("mention", "m", F.explode(_grams(F.col("m"))).alias("gram"))
    name_runs = named.select("*", F.explode(_grams(F.col("n"))).alias("gram")).join(runs.select("gram").distinct(), "gram", "left_semi")
    often = name_runs.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    rarest = runs.join(often, "gram", "left").groupBy("mention", "m").agg(F.min_by("gram", F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram")).alias("gram"))
    columns = ["mention", "m", "id", "name", "type", "n"]
    found = rarest.join(name_runs, "gram").where(F.contains("n", "m")).select(*columns)
    found = found.unionByName(asked.where(F.char_length("m") < 3).join(named, F.contains("n", "m")).select(*columns))
    found = found.withColumn("similarity", name_similarity(F.col("name"), F.col("mention")))
    order = Window.partitionBy("mention").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("m", "n")


def fuzzy(mentions: DataFrame, nodes: DataFrame, least: int = LEAST, limit: int = CANDIDATES) -> DataFrame:
    """mention, id, name, type, score: of the nodes whose names contain the mention, the best by weighted ratio (ties: first in order), if it reaches `least`."""
    scored = containing(mentions, nodes, limit).withColumn("score", weighted_ratio("mention", "name"))
    best = scored.groupBy("mention").agg(F.max_by(F.struct("id", "name", "type", "score"), F.struct("score", -F.col("rank"))).alias("best"))
    return best.select("mention", "best.*").where(F.col("score") >= least)


def edit_distance(mentions: DataFrame, nodes: DataFrame, least: float = 0.7) -> DataFrame:
    """mention, id, name, type, similarity: the node whose name is nearest by edit distance (ties: smaller id), if it reaches `least`.

    A similarity s needs lengths within a factor s, so mentions meet only names of such lengths, and share
    of the pairs that survive is what edit distance is computed for.
    """
    asked = mentions.select("mention", F.char_length("mention").alias("l")).distinct()
    lengths = F.sequence(F.ceil(F.col("l") * least).cast("int"), F.floor(F.col("l") / least).cast("int"))
    asked = asked.where(F.col("l") > 0).select("mention", F.explode(lengths).alias("len"))
    asked, named = _spread(asked, nodes.select("id", "name", "type", F.char_length("name").alias("len")), "id")
    found = asked.join(named, ["len", "salt"]).withColumn("similarity", name_similarity(F.col("name"), F.col("mention"))).where(F.col("similarity") >= least)
    best = found.groupBy("mention").agg(F.min_by(F.struct("id", "name", "type", "similarity"), F.struct(-F.col("similarity"), F.col("id"))).alias("best"))
    return best.select("mention", "best.*")


def with_fallback(mentions: DataFrame, nodes: DataFrame, least: int = LEAST) -> DataFrame:
    """mention, id, name, type, how: exact links, and fuzzy ones of the mentions that have none."""
    first = exact(mentions, nodes).withColumn("how", F.lit("exact"))
    rest = mentions.join(first.select("mention").distinct(), "mention", "left_anti")
    return first.unionByName(fuzzy(rest, nodes, least).drop("score").withColumn("how", F.lit("fuzzy")))


def semantic(mentions: DataFrame, vectors: DataFrame, k: int = 1) -> DataFrame:
    """mention, id, cosine, rank: the k nodes whose vectors (id, vector) are nearest to the mention's (mention, vector).

    Every mention meets every vector of its length, in SALTS parts; a part keeps the k best of a mention before they meet.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    asked = mentions.select("mention", F.col("vector").alias("v"), F.sqrt(dot(F.col("vector"), F.col("vector"))).alias("vn"))
    held = vectors.select("id", "vector", F.sqrt(dot(F.col("vector"), F.col("vector"))).alias("n"))
    asked, held = _spread(asked, held, "id")
    found = asked.join(held, "salt").where(F.size("v") == F.size("vector")).where((F.col("vn") > 0) & (F.col("n") > 0)).withColumn("cosine", dot(F.col("v"), F.col("vector")) / (F.col("vn") * F.col("n")))
    order = Window.partitionBy("mention").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("mention", "id", "cosine", "rank")
