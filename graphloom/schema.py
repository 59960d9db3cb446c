"""The shapes of a property graph, of paths over it and of extracted graphs."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING = T.StringType()
PROPS = T.MapType(_STRING, _STRING)
NODE = T.StructType().add("id", _STRING).add("name", _STRING).add("type", _STRING).add("labels", T.ArrayType(_STRING)).add("props", PROPS)
EDGE = T.StructType().add("id", _STRING).add("src", _STRING).add("dst", _STRING).add("type", _STRING).add("props", PROPS)
#: A step of a path: hop 0 is the place holder that every path begins with, with a null predicate.
TRIPLE = T.StructType().add("hop", T.IntegerType()).add("subject_id", _STRING).add("subject", _STRING).add("predicate", _STRING).add("object_id", _STRING).add("object", _STRING).add("is_incoming", T.BooleanType())
PATH = (
    T.StructType().add("path_id", _STRING).add("triples", T.ArrayType(TRIPLE)).add("visited", T.ArrayType(_STRING)).add("last_id", _STRING).add("last_name", _STRING).add("confidence", T.DoubleType()).add("seq", T.LongType())
)
RDF = T.StructType().add("line", T.LongType()).add("s", _STRING).add("p", _STRING).add("o", _STRING).add("o_is_iri", T.BooleanType())

#: Graph JSON as extractors first give it: strength is a word.
GRAPH_V1 = (
    T.StructType()
    .add("entities", T.ArrayType(T.StructType().add("name", _STRING).add("type", _STRING).add("description", _STRING)))
    .add("relationships", T.ArrayType(T.StructType().add("source", _STRING).add("target", _STRING).add("description", _STRING).add("relationship_types", T.ArrayType(_STRING)).add("strength", _STRING)))
)
#: Graph JSON with aliases and attributes: strength is a number from 0 to 1.
GRAPH_V2 = (
    T.StructType()
    .add("entities", T.ArrayType(T.StructType().add("name", _STRING).add("type", _STRING).add("aliases", T.ArrayType(_STRING)).add("description", _STRING).add("attributes", PROPS)))
    .add("relationships", T.ArrayType(T.StructType().add("source_name", _STRING).add("target_name", _STRING).add("types", T.ArrayType(_STRING)).add("strength", T.DoubleType()).add("description", _STRING).add("attributes", PROPS)))
)
