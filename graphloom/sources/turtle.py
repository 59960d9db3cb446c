"""Turtle: the plain part of it, which most files are written in.

Prefixes and a base, names and addresses, literals of all forms, numbers and truth values, ";" and "," lists, blank nodes by
label, comments. Blank nodes in brackets and lists in parentheses are an error that names the place. A statement may go over
many lines and names hang on prefixes before, so a file is read whole, by one task; many files are read side by side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.sources import ntriples

# fixed values: the address that "a" stands for
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_TOKEN = re.compile(
    r"""(?P<space>(?:\s|\#[^\n]*)+)
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<long>\"\"\"(?:[^"\\]|\\.|"{1,2}(?!"))*\"\"\"|'''(?:[^'\\]|\\.|'{1,2}(?!'))*''')
    |(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<word>@?(?:prefix|base)(?=\s))
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<kind>\^\^)
    |(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<name>(?:[^\W\d_][\w.-]*(?<!\.))?:(?:[\w:%-](?:[\w:%.-]*[\w:%-])?)?|_:[\w-]+)
    |(?P<bare>true\b|false\b|a\b)
    |(?P<mark>[.;,])""",
    re.VERBOSE | re.IGNORECASE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.DOTALL)
_CONTROL = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _tokens(text: str) -> Iterator[tuple[str, str, int]]:
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"line {text.count(chr(10), 0, at) + 1}: {text[at : at + 20]!r} is not in the part of Turtle that can be read")
        if m.lastgroup != "space":
            yield m.lastgroup, m[0], at
        at = m.end()


def _plain(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _CONTROL.get(m[1], m[1]), text)


def statements(text: str) -> Iterator[tuple[str, str, str, bool]]:
    """(subject, predicate, object, whether the object is an address or a blank node) of a file, in order. Languages and kinds of literals are left out."""
    tokens = list(_tokens(text))
    prefixes, base, at = {}, "", 0

    def fail(k: int, want: str):
        place = tokens[k][2] if k < len(tokens) else len(text)
        raise ValueError(f"line {text.count(chr(10), 0, place) + 1}: expected {want}")

    def term(k: int) -> tuple[str, bool]:
        kind, value, _ = tokens[k] if k < len(tokens) else ("", "", 0)
        if kind == "iri":
            inner = value[1:-1]
            return (inner if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", inner) else base + inner), True
        if kind == "name":
            head, _, local = value.partition(":")
            if head == "_":
                return value, True
            if head not in prefixes:
                fail(k, f"a prefix that is declared, not {head}:")
            return prefixes[head] + local, True
        if kind in ("text", "long"):
            cut = 3 if kind == "long" else 1
            return _plain(value[cut:-cut]), False
        if kind in ("number", "bare") and value != "a":
            return value, False
        return fail(k, "a name, an address or a literal")

    while at < len(tokens):
        kind, value, _ = tokens[at]
        if kind == "word":
            name = value.lstrip("@").lower()
            if name == "prefix":
                if at + 2 >= len(tokens) or tokens[at + 1][0] != "name" or tokens[at + 2][0] != "iri":
                    fail(at + 1, "a prefix and an address")
                prefixes[tokens[at + 1][1][:-1]] = term(at + 2)[0]
                at += 3
            else:
                base = term(at + 1)[0]
                at += 2
            if value.startswith("@"):
                if at >= len(tokens) or tokens[at][1] != ".":
                    fail(at, "a full stop")
                at += 1
            continue
        subject, named = term(at)
        if not named:
            fail(at, "a subject")
        at += 1
        while True:
            if at < len(tokens) and tokens[at][1] == "a":
                predicate = TYPE
            else:
                predicate, named = term(at)
                if not named:
                    fail(at, "a predicate")
            at += 1
            while True:
                obj, named = term(at)
                at += 1
                if at < len(tokens) and tokens[at][0] == "lang":
                    at += 1
                elif at < len(tokens) and tokens[at][0] == "kind":
                    term(at + 1)
                    at += 2
                yield subject, predicate, obj, named
                if at < len(tokens) and tokens[at][1] == ",":
                    at += 1
                    continue
                break
            while at < len(tokens) and tokens[at][1] == ";":
                at += 1
            if at >= len(tokens) or tokens[at][1] == ".":
                break
        if at >= len(tokens):
            fail(at, "a full stop")
        at += 1


def triples(spark: SparkSession, path: str) -> DataFrame:
    """line, s, p, o, o_is_iri of the files at path, in the order of their paths: line is the place of a statement, not of its text."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for file, text in zip(pdf["file"], pdf["value"], strict=True):
                found = pd.DataFrame(statements(text or ""), columns=["s", "p", "o", "o_is_iri"])
                yield found.assign(file=file, k=range(len(found)))

    each = files.mapInPandas(run, "s string, p string, o string, o_is_iri boolean, file string, k long")
    sizes = each.groupBy("file").agg(F.count(F.lit(1)).alias("n"))  # a row for each file
    before = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return each.join(before, "file").select((F.col("k") + F.col("before")).alias("line"), "s", "p", "o", "o_is_iri")


def load(spark: SparkSession, path: str, faithful: bool = False) -> PropertyGraph:
    found = triples(spark, path)
    return PropertyGraph(ntriples.nodes(found, faithful), ntriples.edges(found))
