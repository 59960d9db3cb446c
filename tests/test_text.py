import pytest
from pyspark.sql import functions as F

from graphloom.functions import extract, models, parse, similarity
from graphloom.functions.columns import as_share, entity_id, merge_maps, not_visited, uri_name
from graphloom.operators import link, resolve
from graphloom.schema import GRAPH_V2


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "t string").select(*columns).first())


@pytest.mark.parametrize(
    ("reply", "names"),
    [("``` a, b ,, c ```", ["a", "b", "c"]), ("a,b", ["a", "b"]), ("x ```\none,\ntwo\n``` y ```z```", ["one", "two"]), (" , ", []), ("", [])],
)
def test_entity_list(spark, reply, names):
    assert one(spark, reply, parse.entity_list(F.col("t"))) == (names,)


@pytest.mark.parametrize(
    ("reply", "found"),
    [('{"1": 0.9, "2": 1}', {"1": 0.9, "2": 1.0}), ('text {"1": 0.5} more', {"1": 0.5}), ("no json", {}), ("{broken", {}), ("{broken}", {}), ("", {}), (None, {})],
)
def test_scores(spark, reply, found):
    assert one(spark, reply, parse.scores(F.col("t"))) == (found,)


@pytest.mark.parametrize(("total", "ok"), [(0.98, False), (0.991, True), (1.0, True), (1.009, True), (1.02, False)])
def test_score_sums(spark, total, ok):
    assert (one(spark, f'{{"a": {total - 0.5}, "b": 0.5}}', parse.scores_error(parse.pruning_scores(F.col("t"))))[0] is None) == ok


@pytest.mark.parametrize(("reply", "value"), [("Yes.", True), ("no", False), ("No, yes", True), ("hm", None), (" NO ", False)])
def test_says_yes(spark, reply, value):
    assert one(spark, reply, parse.says_yes(F.col("t"))) == (value,)


@pytest.mark.parametrize(("reply", "intended", "faithful"), [("SUFFICIENT: x", True, True), ("INSUFFICIENT: x", False, True), ("insufficient, not sufficient", False, True), ("who knows", False, False)])
def test_sufficiency(spark, reply, intended, faithful):
    assert one(spark, reply, parse.is_sufficient(F.col("t")), parse.is_sufficient(F.col("t"), True)) == (intended, faithful)


@pytest.mark.parametrize(
    ("reply", "names"),
    [('{"entities": [{"name": "A"}]}', ["A"]), ('```json\n{"entities": [{"name": "A"}]}\n```', ["A"]), ('Sure: {"entities": [{"name": "A"}]} bye', ["A"]), ("{not json}", []), ("nothing", []), ("[1]", []), (None, [])],
)
def test_robust_graph(spark, reply, names):
    g = parse.graph(F.col("t"))
    got, rel = one(spark, reply, F.transform(g["entities"], lambda e: e["name"]), F.size(g["relationships"]))
    assert got == names and rel == 0


def test_answer(spark):
    assert one(spark, " A:  it is ", parse.answer(F.col("t"))) == ("it is",)
    assert one(spark, "A: ", parse.answer(F.col("t"))) == (None,)


def test_columns(spark):
    df = spark.range(1).select(F.expr("map('a','1','b','2')").alias("x"), F.expr("map('b','3')").alias("y"), F.expr("array()").cast("array<string>").alias("v"))
    r = df.select(merge_maps(F.col("x"), F.col("y")).alias("m"), not_visited(F.col("v"), F.lit("q")).alias("n"), not_visited(F.array(F.lit("q")), F.lit("q")).alias("s"), as_share(F.lit(85)).alias("c"), as_share(F.lit(None)).alias("z"), uri_name(F.lit("a b-ç (x)!")).alias("u"), entity_id(F.lit("a"), F.lit("b")).alias("i")).first()
    import hashlib

    assert r.m == {"a": "1", "b": "3"} and r.n is True and r.s is False and r.c == 0.85 and r.z == 0.0 and r.u == "a_b-ç_x" and r.i == hashlib.md5(b"a_b").hexdigest()


@pytest.mark.parametrize(("a", "b", "score"), [("abcd", "abcd", 100), ("", "", 100), ("abcd", "", 0), ("new york mets", "new york meats", 96), ("abcdef", "uvwxyz", 0)])
def test_ratio(a, b, score):
    assert similarity.ratio_of(a, b) == score


@pytest.mark.parametrize(("a", "b", "score"), [("new york mets", "new york mets!", 100), ("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear", 95), ("", "x", 0), ("!!", "x", 0), ("mets", "new york mets", 90)])
def test_weighted_ratio(a, b, score):
    assert similarity.weighted_ratio_of(a, b) == score


def nodes(spark, *names):
    return spark.createDataFrame([(f"n{k}", n, "t") for k, n in enumerate(names)], "id string, name string, type string")


def mentions(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "mention string")


def test_linking(spark):
    n = nodes(spark, "Big Red Dog", "big red dog", "Red Cat House", "Reddog")
    assert [(r.mention, r.id) for r in link.exact(mentions(spark, "BIG RED DOG", "x"), n).collect()] == [("BIG RED DOG", "n0")]
    got = {(r.mention, r.id) for r in link.containing(mentions(spark, "red", "big red d", "g re", "ed cat ho"), n).collect()}
    assert got == {("red", "n0"), ("red", "n1"), ("red", "n2"), ("red", "n3"), ("big red d", "n0"), ("big red d", "n1"), ("g re", "n0"), ("g re", "n1"), ("ed cat ho", "n2")}
    how = {r.mention: (r.id, r.how) for r in link.with_fallback(mentions(spark, "reddog", "red cat", "zzz"), n).collect()}
    assert how == {"reddog": ("n3", "exact"), "red cat": ("n2", "fuzzy")}
    assert {r.mention: r.id for r in link.edit_distance(mentions(spark, "redog", "", "unlike"), n).collect()} == {"redog": "n3"}


def docs(spark, *graphs):
    return spark.createDataFrame([(f"d{k}", g) for k, g in enumerate(graphs)], f"doc_id string, graph {GRAPH_V2.simpleString()}")


def entity(name, kind="T", **more):
    return {"name": name, "type": kind, "aliases": more.get("aliases"), "description": more.get("description"), "attributes": more.get("attributes")}


def relation(a, b, types, strength=None, description=None):
    return {"source_name": a, "target_name": b, "types": types, "strength": strength, "description": description, "attributes": None}


def test_merging_entities(spark):
    g = {"entities": [entity("Jon Smith", aliases=["J"], attributes={"a": "1"}), entity("Jon Smyth", aliases=["S", "J"], description="x", attributes={"a": "2"}), entity("Jon Smith", "OTHER"), entity("Zed")], "relationships": []}
    got = {(r.name, r.type): r for r in resolve.merge_entities(resolve.assign_leaders(resolve.entities(docs(spark, g)))).collect()}
    assert set(got) == {("Jon Smith", "T"), ("Jon Smith", "OTHER"), ("Zed", "T")}
    r = got[("Jon Smith", "T")]
    assert r.aliases == ["J", "S"] and r.description == "x" and r.attributes == {"a": "2"}


def test_leaders_are_greedy_and_in_order(spark):
    """The later name is like the second, but the second is no leader: order matters, and is kept."""
    g = {"entities": [entity("abcdefghij"), entity("abcdefghXY"), entity("abcdefQWXY")], "relationships": []}
    led = {r.name: r.leader_seq for r in resolve.assign_leaders(resolve.entities(docs(spark, g))).collect()}
    assert led == {"abcdefghij": 0, "abcdefghXY": 0, "abcdefQWXY": 2}


def test_corpus_scope_joins_documents(spark):
    g = {"entities": [entity("Acme Corp")], "relationships": []}
    found = resolve.entities(docs(spark, g, g))
    assert resolve.merge_entities(resolve.assign_leaders(found)).count() == 2
    assert resolve.merge_entities(resolve.assign_leaders(found, scope="corpus")).count() == 1


def test_relation_fold(spark):
    e = [entity("A"), entity("B"), entity("A", "U")]
    g = {"entities": e, "relationships": [relation("A", "B", ["x"], 0.2, "one"), relation("A", "B", ["x", "y"], 0.9, ""), relation("A", "B", ["z"], 0.1, "three"), relation("A", "none", ["x"])]}
    d = docs(spark, g)
    rows = resolve.relations(d)
    assert rows.count() == 3
    last = resolve.merge_relations(rows).collect()
    assert [(r.types, r.strength, r.description, r.n_rows) for r in last] == [(["z"], 0.1, "three", 3)]
    kept = resolve.merge_relations(rows, keep_both=True).collect()
    assert len(kept) == 3
    two = resolve.merge_relations(rows.where("seq < 2")).first()
    assert (two.types, two.strength, two.description) == (["x", "y"], 0.9, "one")


def test_dangling_ends_are_remapped(spark):
    g = {"entities": [entity("Jon Smith"), entity("Jon Smyth"), entity("Zed")], "relationships": [relation("Jon Smyth", "Zed", ["x"])]}
    ents, rels = resolve.build(docs(spark, g))
    assert {rels.first().source_id} <= {r.id for r in ents.collect()}
    ents, rels = resolve.build(docs(spark, g), faithful=True)
    assert rels.first().source_id not in {r.id for r in ents.collect()}


def test_empty_documents(spark):
    d = docs(spark)
    ents, rels = resolve.build(d)
    assert ents.count() == rels.count() == 0
    d = docs(spark, {"entities": None, "relationships": None}, None)
    ents, rels = resolve.build(d)
    assert ents.count() == rels.count() == 0


def test_models():
    m = models.Function(str.upper)
    assert m.generate([{"role": "user", "content": "ab c"}]) == "AB C"
    assert "".join(m.generate_stream([{"role": "user", "content": "ab c"}])).strip() == "AB C"
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert models.retried(flaky, wait=waits.append) == "ok" and len(waits) == 2
    with pytest.raises(OSError):
        models.retried(lambda: (_ for _ in ()).throw(OSError()), wait=lambda s: None)


def test_distributed_model(spark):
    df = spark.createDataFrame([("a",), ("b",)], "prompt string")
    assert sorted(r.reply for r in models.distributed(df, lambda: models.Function(str.upper)).collect()) == ["A", "B"]


def test_mentions(spark):
    texts = spark.createDataFrame([(1, "The Big Red Dog ate. red cat"), (2, None), (3, "")], "doc_id long, text string")
    n = spark.createDataFrame([("Red dog",), ("red",), ("BIG RED",)], "name string")
    assert sorted((r.doc_id, r.mention) for r in extract.mentions(texts, n).collect()) == [(1, "BIG RED"), (1, "Red dog"), (1, "red")]
