import json

import pytest

from graphloom.graph import PropertyGraph
from graphloom.sources import files, html, jsonkg, ntriples, turtle
from graphloom.streaming import triples


def rows(spark, *lines):
    return spark.createDataFrame(list(enumerate(lines)), "line long, value string")


def test_parse_lines(spark):
    got = ntriples.parse(rows(spark, "# c", "", "<a> <p> <b> .", '<a> <q> "x y . z" .', "<a> <only>", '  <a> <r> "v" .  ', None)).orderBy("line").collect()
    assert [(r.s, r.p, r.o, r.o_is_iri) for r in got] == [("a", "p", "b", True), ("a", "q", "x y . z", False), ("a", "r", "v", False)]


def test_nodes_and_edges(spark):
    t = ntriples.parse(rows(spark, '<e/a> <p/type> "X" .', '<e/a> <p/type> "Y" .', '<e/a> <p/name> "A" .', '<e/a> <p/k> "1" .', '<e/a> <p/k> "2" .', "<e/a> <p/knows> <e/b> .", '<e/b> <p/label> "B" .', "<e/a> <p/far> <e/z> ."))
    got = {r.id: r for r in ntriples.nodes(t).collect()}
    assert got["e/a"].type == "X" and got["e/a"].name == "A" and got["e/a"].props == {"k": "2", "knows": "e/b", "far": "e/z"}
    assert got["e/b"].type == "Unknown"
    assert {r.id: r.type for r in ntriples.nodes(t, faithful=True).collect()}["e/a"] == "Unknown"
    assert [(r.id, r.src, r.dst, r.type) for r in ntriples.edges(t).collect()] == [("e0", "e/a", "e/b", "knows")]


def test_numbers_over_ranges(spark):
    df = spark.range(100).selectExpr("id * 3 AS line")
    assert sorted((r.line, r.n) for r in ntriples.numbered(df, span=16).collect()) == [(3 * k, k) for k in range(100)]


def test_literals_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b"\nc', "t", None, ["", "x"])], "id string, name string, type string, description string, aliases array<string>")
    lines = [r.value for r in ntriples.entity_statements(df).collect()]
    assert len(lines) == 3 and all("\n" not in x for x in lines)


def test_files_by_name(spark, tmp_path):
    (tmp_path / "g.nt").write_text("<a> <p> <b> .\n<b> <p> <a> .\n")
    (tmp_path / "h.ttl").write_text("@prefix e: <http://e/> . e:a e:p e:b . e:b e:p e:a .")
    (tmp_path / "i.rdf").write_text("")
    f = files.GraphFiles(spark, str(tmp_path))
    assert f.names() == ["g", "h", "i"]
    assert f.get("g").edges.count() == f.get("h").edges.count() == 2
    with pytest.raises(FileNotFoundError):
        f.get("none")
    with pytest.raises(ValueError, match="N-Triples"):
        f.get("i")


TURTLE = """@prefix ex: <http://ex/> .  # a comment
PREFIX x-2: <http://x2/>
@base <http://base/> .
ex:a a ex:Person ; ex:name "Ada \\"L\\" \\u00e9"@en-GB, 'A' ;
  ex:born 1815 ; ex:score -1.5e3 ; ex:ok true ; ex:note \"\"\"two
lines; "quoted" . \"\"\" ;
.
<rel> x-2:knows ex:a.b , _:n1 .
_:n1 <http://ex/at> "2020"^^<http://www.w3.org/2001/XMLSchema#gYear> .
"""


def test_turtle_statements():
    got = list(turtle.statements(TURTLE))
    ex, x2 = "http://ex/", "http://x2/"
    assert got == [
        (ex + "a", turtle.TYPE, ex + "Person", True), (ex + "a", ex + "name", 'Ada "L" é', False), (ex + "a", ex + "name", "A", False), (ex + "a", ex + "born", "1815", False), (ex + "a", ex + "score", "-1.5e3", False),
        (ex + "a", ex + "ok", "true", False), (ex + "a", ex + "note", 'two\nlines; "quoted" . ', False), ("http://base/rel", x2 + "knows", ex + "a.b", True), ("http://base/rel", x2 + "knows", "_:n1", True), ("_:n1", ex + "at", "2020", False),
    ]
    assert list(turtle.statements(" # nothing\n")) == []
    for bad, where in (("<a> <b> [ <c> <d> ] .", "line 1"), ("<a>\n<b> ( 1 2 ) .", "line 2"), ("\n\ne:a <b> <c> .", "line 3.*prefix"), ("<a> <b> <c>", "full stop"), ('"x" <b> <c> .', "subject")):
        with pytest.raises(ValueError, match=where):
            list(turtle.statements(bad))


def test_turtle_files_are_in_the_order_of_their_paths(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('<http://e/x> <http://e/k> "first" ; <http://e/name> "A" .')
    (tmp_path / "b.ttl").write_text("".join(f'<http://e/y{k}> <http://e/k> "{k}" .\n' for k in range(300)) + '<http://e/x> <http://e/k> "last" ; <http://e/to> <http://e/y7> .')
    g = turtle.load(spark, str(tmp_path))
    got = {r.id: r for r in g.nodes.collect()}
    assert got["http://e/x"].name == "A" and got["http://e/x"].props["k"] == "last" and len(got) == 301
    assert [(r.id, r.dst) for r in g.edges.collect()] == [("e0", "http://e/y7")]


def test_json_graph(spark, tmp_path):
    data = {"entities": [{"name": "A", "type": "Person"}, {"name": "A", "age": "3"}], "relationships": [{"source": "A", "target": "B", "strength": "strong"}, {"source": "A", "target": "B"}]}
    (tmp_path / "g.json").write_text(json.dumps(data, indent=1))
    g = jsonkg.load(jsonkg.read(spark, str(tmp_path / "g.json")))
    got = {r.id: r for r in g.nodes.collect()}
    assert set(got) == {"A", "B"} and got["A"].type == "Person" and got["A"].props["age"] == "3"
    assert g.edges.count() == 2
    out = json.loads(jsonkg.document(g))
    assert len(out["entities"]) == 2 and len(out["relationships"]) == 2
    jsonkg.export(g, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/relationships")).count() == 2


def test_entity_without_name(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"entities": [{"type": "x"}]}')
    with pytest.raises(Exception, match="no name"):
        jsonkg.load(jsonkg.read(spark, str(tmp_path / "g.json"))).nodes.collect()


def test_page(spark, tmp_path):
    (tmp_path / "g.nt").write_text('<a> <p> <b> .\n<b> <name> "</script>" .\n')
    g = ntriples.load(spark, str(tmp_path / "g.nt"))
    text = open(html.write_page(g, str(tmp_path / "g.html"))).read()
    assert "<\\/script>" in text and "Unknown" in text and "2 of 2 nodes, 1 of 1 edges" in text and "type: Unknown" in text
    assert "1 of 2 nodes, 0 of 1 edges" in html.page(html.palette_nodes(g), html.palette_edges(g), most=1)


def test_lines_are_in_the_order_of_files_and_places(spark, tmp_path):
    """Whatever the files' sizes, which decide how the reader deals them out: the last value of the last file wins."""
    (tmp_path / "a.nt").write_text('<e/x> <p/k> "first" .\n<e/x> <p/name> "A" .\n')
    (tmp_path / "b.nt").write_text("".join(f'<e/y{k}> <p/k> "{k}" .\n' for k in range(3000)) + '<e/x> <p/k> "last" .\n<e/x> <p/name> "B" .\n')
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for most in (held, "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            got = {r.id: r for r in ntriples.load(spark, str(tmp_path)).nodes.collect()}
            lines = ntriples.lines(spark, str(tmp_path)).orderBy("line").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", held)
        assert got["e/x"].props == {"k": "last"} and got["e/x"].name == "A"
        assert [r.line for r in lines] == list(range(3004)) and lines[2].value.startswith("<e/y0>") and lines[1500].value.startswith("<e/y1498>")


def test_json_files_are_in_the_order_of_their_paths(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"entities": [{"name": "A", "v": "1"}], "relationships": []}))
    (tmp_path / "b.json").write_text(json.dumps({"entities": [{"name": "A", "v": "2"}, *({"name": f"N{k}"} for k in range(500))], "relationships": [{"source": "A", "target": "N1"}]}))
    g = jsonkg.load(jsonkg.read(spark, str(tmp_path)))
    assert g.nodes.where("id = 'A'").first().props == {"v": "2"}
    assert [r.id for r in g.edges.collect()] == ["r1-0"]


def test_settings(tmp_path):
    s = files.Settings(tmp_path / "x" / "s.yaml")
    assert s.read() == {} and s.get("a.b") == {}
    s.update({"a": {"b": 1, "c": 2}})
    assert s.update({"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}} and s.get("a.b") == 3 and s.get("a.z") == {}
    (tmp_path / "p.yaml").write_text("system: s\nuser: 'ask {{query}} {n}'\n")
    (tmp_path / "q.yaml").write_text("system: s\n")
    p = files.Prompts(tmp_path)
    assert p.names() == ["p", "q"] and p.filled("p", query="x", n="3")["user"] == "ask x 3"
    with pytest.raises(ValueError, match="user"):
        p.get("q")
    with pytest.raises(FileNotFoundError):
        p.get("z")


def test_logs_and_history(spark, tmp_path):
    for level in ("INFO", "ERROR"):
        files.append_log(spark, str(tmp_path / "log"), level, "n", "m")
    assert spark.read.parquet(str(tmp_path / "log")).where("level = 'ERROR'").count() == 1
    files.append_history(spark.createDataFrame([(True, "a")], "success boolean, answer string"), str(tmp_path / "h"), "q")
    assert json.loads(spark.read.parquet(str(tmp_path / "h")).first().result)["answer"] == "a"


def test_stream(spark, tmp_path, sf):
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    found = triples.edges(triples.read(spark, str(tmp_path / "in")))
    q = found.writeStream.format("memory").queryName("edges").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = triples.edges(spark.read.parquet(f"{sf}/events.parquet")).drop("ts")
    assert spark.table("edges").drop("ts").exceptAll(batch).count() == 0


def test_empty_sources(spark):
    t = ntriples.parse(rows(spark, "# nothing"))
    assert ntriples.nodes(t).count() == ntriples.edges(t).count() == 0
    assert PropertyGraph(ntriples.nodes(t), ntriples.edges(t)).size().first().n_nodes == 0


def test_table_graph_looks_up_what_it_holds(spark, sf):
    from pyspark.sql import functions as F

    from graphloom.sources.tables import project

    g = project(spark, sf)
    ids = ["nation:3", "supplier:1", "part:7", "region:0", "none:1", "nation:x", "order:-5", "nation:999"]
    assert sorted(r.id for r in g.by_ids(ids).collect()) == sorted(r.id for r in g.nodes.where(F.col("id").isin(ids)).select("id").collect())
    want = g.both_ways().where(F.col("here").isin(ids))
    got = g.around(ids)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    assert g.around(["none:1"]).count() == g.by_ids([]).count() == 0
