import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.graph import PropertyGraph
from graphloom.operators import expand, prune
from graphloom.plans.explore import ExploreConfig, explore, initial_paths, render


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(i, i.upper(), t, [t], p) for i, t, p in nodes], schema.NODE)
    e = spark.createDataFrame([(i, s, d, t, {}) for i, s, d, t in edges], schema.EDGE)
    return PropertyGraph(n, e)


@pytest.fixture
def small(spark):
    return graph(spark, [("a", "x", {"k": "1"}), ("b", "y", {}), ("c", "y", {"k": None})], [("e1", "a", "b", "r"), ("e2", "a", "b", "s"), ("e3", "a", "a", "loop"), ("e4", "c", "a", "r")])


def test_parallel_edges_and_loops(small):
    assert small.edges_of("a").count() == 5  # the loop is seen from both ends
    assert sorted(r.neighbor for r in small.neighbors(small.by_ids(["a"])).collect()) == ["b", "c"]
    assert small.edges_of("none").count() == 0


def test_property_none_matches_missing(small):
    assert sorted(r.id for r in small.by_property("k", None).collect()) == ["b", "c"]
    assert [r.id for r in small.by_property("k", "1").collect()] == ["a"]


def test_empty_graph(spark):
    g = PropertyGraph.empty(spark)
    assert g.size().first().n_nodes == 0
    assert g.add_edges(g.edges).nodes.count() == 0
    assert explore(g, spark.createDataFrame([], "id string, name string"), "q", ExploreConfig(max_iterations=2)).count() == 0


def test_delete_needs_detach(small):
    with pytest.raises(ValueError, match="edges"):
        small.delete_nodes(F.col("id") == "a")
    left = small.delete_nodes(F.col("id") == "a", detach=True)
    assert left.nodes.count() == 2 and left.edges.count() == 0
    assert small.nodes.count() == 3


def test_upsert_merges_later_wins(spark, small):
    more = spark.createDataFrame([("a", None, "z", None, {"k": "2", "m": "3"}), ("d", "D", "w", ["w"], {})], schema.NODE)
    got = {r.id: r for r in small.add_nodes(more).nodes.collect()}
    assert got["a"].name == "A" and got["a"].type == "z" and got["a"].props == {"k": "2", "m": "3"}
    assert len(got) == 4
    assert small.add_nodes(more, upsert=False).nodes.count() == 5


def test_update_keeps_other_keys(small):
    got = {r.id: r.props for r in small.update_nodes(F.col("id") == "a", value="v").nodes.collect()}
    assert got["a"] == {"k": "1", "value": "v"} and got["b"] == {}


def test_bounded_like_a_heap(spark):
    """faithful keeps what a heap of negated scores keeps that drops its minimum."""
    import heapq
    import random

    rng = random.Random(3)
    for _ in range(5):
        scores = [rng.choice([0.1, 0.2, 0.3, 0.4]) for _ in range(12)]
        heap = []
        for k, s in enumerate(scores):
            heapq.heappush(heap, (-s, k))
            if len(heap) > 4:
                heapq.heappop(heap)
        df = spark.createDataFrame([(k, s) for k, s in enumerate(scores)], "seq long, confidence double")
        assert {r.seq for r in prune.bounded(df, 4, faithful=True).collect()} == {k for _, k in heap}
        best = sorted(range(12), key=lambda k: (-scores[k], k))[:4]
        assert {r.seq for r in prune.bounded(df, 4).collect()} == set(best)


def test_faithful_incoming_stays(spark, small):
    f = spark.createDataFrame([("a",)], "last_id string")
    got = expand.by_relation_ids(small, f, ["e4"], faithful=True).collect()
    assert [(r.next_id, r.is_incoming) for r in got] == [("a", True)]
    assert expand.by_relation_ids(small, f, ["e4"]).first().next_id == "c"


def test_no_edge_twice(spark, small):
    got = expand.simple_paths(small, small.by_ids(["c"]), 3).collect()
    assert all(len(set(r.edge_ids)) == len(r.edge_ids) for r in got)
    assert {tuple(r.edge_ids) for r in got} == {("e4",), ("e4", "e1"), ("e4", "e2"), ("e4", "e3"), ("e4", "e3", "e1"), ("e4", "e3", "e2")}


def test_beam_bounds_and_visits(spark):
    n = [(f"n{k}", "t", {}) for k in range(8)]
    e = [(f"e{i}{j}", f"n{i}", f"n{j}", "r") for i in range(8) for j in range(i)]
    g = graph(spark, n, e)
    got = explore(g, g.nodes.where("id = 'n0'").select("id", "name"), "N5", ExploreConfig(max_iterations=3, max_paths=4)).collect()
    assert 0 < len(got) <= 4
    for r in got:
        assert len(set(r.visited)) == len(r.visited)
        assert [t.hop for t in r.triples] == list(range(len(r.triples)))
        assert r.triples[0].predicate is None
    assert [r.confidence for r in got] == sorted((r.confidence for r in got), reverse=True)


def test_judge_stops(spark, small):
    seen = []
    got = explore(small, small.by_ids(["c"]).select("id", "name"), "B", ExploreConfig(max_iterations=3), judge=lambda texts: bool(seen.append(texts) or True))
    assert len(seen) == 1 and got.count() == 1
    assert render(got).first().text == "C → C -r→ A"


def test_initial_paths(small):
    r = initial_paths(small.by_ids(["a"]).select("id", "name")).first()
    assert r.confidence == 1.0 and r.visited == ["a"] and r.triples[0].object == "A"


def test_indexed_graph_is_the_same(spark, small):
    g = small.indexed()
    assert sorted(map(str, g.both_ways().collect())) == sorted(map(str, small.both_ways().collect()))
    for ids in (["a"], ["b", "c"], []):
        assert sorted(map(str, g.around(ids).collect())) == sorted(map(str, small.around(ids).collect()))
    whole = [r for r in small.both_ways().collect() if r.here in ("b", "c")]
    assert sorted(map(str, small.around(["b", "c"]).collect())) == sorted(map(str, whole))
    seeds = small.by_ids(["c"]).select("id", "name")
    one, two = (explore(x, seeds, "B", ExploreConfig(max_iterations=2)).collect() for x in (small, g))
    assert one == two and len(one) > 1


def test_later_rows_by_a_column(spark):
    """add_nodes(order=...): which rows are later does not hang on how they are dealt out."""
    g = PropertyGraph(spark.createDataFrame([("a", "x", "t", ["t"], {"k": "0"})], schema.NODE), spark.createDataFrame([], schema.EDGE))
    more = spark.createDataFrame([("a", "second", "t", ["t"], {"k": "2"}, 2), ("a", "first", "t", ["t"], {"k": "1"}, 1)], "id string, name string, type string, labels array<string>, props map<string,string>, at int").repartition(2)
    got = g.add_nodes(more, order="at").nodes.first()
    assert (got.name, got.props) == ("second", {"k": "2"})


def test_touching_leaves_out_kinds_of_edges(spark, sf):
    """Steps from some types are the same without the kinds of edges that these never have, whose tables are not read."""
    from graphloom.sources.tables import project

    g = project(spark, sf)
    ids = g.nodes.where("type IN ('nation', 'customer')").select("id")
    few = g.touching("nation", "customer").neighbors(ids)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, g.neighbors(ids).collect()))
    assert "lineitem" not in few._jdf.queryExecution().toString() and "lineitem" in g.neighbors(ids)._jdf.queryExecution().toString()
    assert g.touching("none").edges.count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_containment_is_that_of_all_pairs(spark, seed):
    """By the rarest run of three characters, and short mentions from all names."""
    import random

    from graphloom.operators import link

    rng = random.Random(seed)
    names = ["".join(rng.choice("abAB #é") for _ in range(rng.randrange(9))) for _ in range(80)]
    asked = ["", "a", "ab", *{n[1:5] for n in names[:20]}, "zzz", "abab"]
    n = spark.createDataFrame([(str(k), x, "t", ["t"], {}) for k, x in enumerate(names)], schema.NODE)
    got = link.containing(spark.createDataFrame([(m,) for m in asked], "mention string"), n, 1000)
    want = {(m, str(k)) for m in asked for k, x in enumerate(names) if m.lower() in x.lower()}
    assert {(r.mention, r.id) for r in got.collect()} == want
