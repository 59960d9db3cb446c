import json
import sys
import time
import types

import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions import extract, models
from graphloom.graph import PropertyGraph
from graphloom.operators import metrics
from graphloom.plans import assisted
from graphloom.plans.explore import ExploreConfig, answer


def test_question_entities(spark):
    q = spark.createDataFrame([("Who knows Ada and Bob?",), ("none",)], "question string")
    make = lambda: models.Function(lambda p: "``` Ada, Bob ```" if "Ada" in p else " , ")
    assert sorted(r.mention for r in assisted.question_entities(q, make).collect()) == ["Ada", "Bob"]


def test_relation_scores(spark):
    rows = [("p1", "Ada", k, f"T{k}", "Ada", f"N{k}") for k in (1, 2, 3)] + [("p2", "Bob", 1, "U", "Bob", None)]
    c = spark.createDataFrame(rows, "path_id string, last_name string, idx int, type string, source_name string, target_name string")

    def reply(prompt):
        assert "Entity: " in prompt and "1. Relation: " in prompt
        return 'Sure {"3": 0.6, "1": 0.4, "9": 1}' if "Entity: Ada" in prompt else "no idea"

    got = assisted.relations(c, lambda: models.Function(reply), "q", 2).orderBy("path_id", "rank").collect()
    assert [(r.path_id, r.type, r.score) for r in got] == [("p1", "T3", 0.6), ("p1", "T1", 0.4), ("p2", "U", None)]


def test_entity_scores(spark):
    rows = [("p", "e", k, "A", "x", "R", f"N{k}", None) for k in (1, 2)]
    c = spark.createDataFrame(rows, "path_id string, edge_id string, idx int, source_name string, source_type string, type string, target_name string, target_type string")
    make = lambda: models.Function(lambda p: '{"2": 0.9}' if "2. A (x) -[R]-> N2 (Unknown)" in p else "{}")
    assert [r.target_name for r in assisted.entities(c, make, "q", 1).collect()] == ["N2"]


def test_failing_calls_leave_order(spark):
    c = spark.createDataFrame([("p", "e", 1, "A", "x", "R", "N", "y")], "path_id string, edge_id string, idx int, source_name string, source_type string, type string, target_name string, target_type string")

    def fail(_):
        raise OSError

    assert assisted.entities(c, lambda: models.Function(fail), "q", 1).count() == 1


def test_knowledge_graph(spark):
    docs = spark.createDataFrame([(1, "Ada knows Bob"), (2, "broken"), (3, None)], "doc_id long, text string")
    data = {"entities": [{"name": "Ada", "type": "P"}, {"name": "Bob", "type": "P"}], "relationships": [{"source_name": "Ada", "target_name": "Bob", "types": ["KNOWS"], "strength": 0.9}]}
    make = lambda: models.Function(lambda p: "```json\n" + json.dumps(data) + "\n```" if "Ada knows" in p else "sorry")
    ents, rels = assisted.knowledge_graph(docs, make)
    assert sorted(r.name for r in ents.collect()) == ["Ada", "Bob"]
    assert [(r.types, r.strength) for r in rels.collect()] == [(["KNOWS"], 0.9)]
    assert assisted.graphs(docs, make, attributes=False).where(F.size("graph.entities") > 0).count() == 1


def test_answer_with_a_model(spark):
    n = spark.createDataFrame([(k, k.upper(), "t", ["t"], {}) for k in "abc"], schema.NODE)
    e = spark.createDataFrame([("e1", "a", "b", "r", {}), ("e2", "b", "c", "r", {})], schema.EDGE)
    model = models.Function(lambda p: "INSUFFICIENT: SUFFICIENT is not" if p.startswith("Do ") else "A: it is C")
    m = spark.createDataFrame([("A",)], "mention string")
    got = answer(PropertyGraph(n, e), m, "What is C?", ExploreConfig(max_iterations=3), assisted.judge(model, "What is C?"), assisted.answerer(model)).first()
    assert got.success and got.answer == "A: it is C" and len(got.paths) == 2
    assert assisted.judge(model, "q")([]) is False
    none = answer(PropertyGraph(n, e), spark.createDataFrame([("zzz",)], "mention string"), "q").first()
    assert not none.success and none.paths == []


def test_relate_makes_all_pairs(spark):
    n = spark.createDataFrame([("1", "A", "x", ["x"], {}), ("2", "A", "x", ["x"], {}), ("3", "B", "y", ["y"], {})], schema.NODE)
    g = PropertyGraph(n, spark.createDataFrame([], schema.EDGE))
    pairs = spark.createDataFrame([("x", "A", "y", "B", "KNOWS"), ("x", "A", "y", "none", "KNOWS")], "src_label string, src_name string, dst_label string, dst_name string, type string")
    assert sorted((r.src, r.dst) for r in g.relate(pairs).edges.collect()) == [("1", "3"), ("2", "3")]


class Client:
    """A client that fails the first times, and remembers what it was asked."""

    def __init__(self, fails=0, **made_with):
        self.fails, self.made_with, self.asked = fails, made_with, []
        self.chat = self.completions = self

    def create(self, **what):
        self.asked.append(what)
        if len(self.asked) <= self.fails:
            raise OSError("later")
        part = lambda t: types.SimpleNamespace(choices=[types.SimpleNamespace(message=types.SimpleNamespace(content=t), delta=types.SimpleNamespace(content=t))])
        text = what["messages"][-1]["content"].upper()
        return [part(c) for c in text] if what.get("stream") else part(text)


def test_hosted_models_by_name(monkeypatch):
    assert [models.service_of(m) for m in ("GPT-4o", "llama3-70b", "other", None)] == ["azure", "groq", "azure", "azure"]
    for package, kind in (("openai", "AzureOpenAI"), ("groq", "Groq")):
        monkeypatch.setitem(sys.modules, package, types.SimpleNamespace(**{kind: Client}))
    m = models.hosted("llama3-70b", client={"api_key": "k"}, temperature=0.1)
    assert m.generate([{"role": "user", "content": "hi"}]) == "HI" and m.client.made_with == {"api_key": "k"}
    assert m.client.asked == [{"model": "llama3-70b", "messages": [{"role": "user", "content": "hi"}], "temperature": 0.1}]
    assert assisted.make_by_name("gpt-4o")().model_info() == {"name": "gpt-4o"} and assisted.make_by_name(None)().model == "gpt-4o"
    with pytest.raises(ValueError, match="no service x"):
        models.hosted("m", "x")
    monkeypatch.setitem(sys.modules, "openai", None)
    with pytest.raises(ImportError, match="openai needs"):
        models.hosted("m", "openai")


def test_streams_begin_again_and_batches_keep_their_order(monkeypatch):
    monkeypatch.setattr(models.time, "sleep", lambda s: None)
    monkeypatch.setattr(models.retried, "__defaults__", (models.TRIES, lambda s: None))
    m = models.ChatCompletions(Client(2), "m")
    assert list(m.generate_stream([{"role": "user", "content": "abc"}])) == ["A", "B", "C"] and len(m.client.asked) == 3
    batch = [[{"role": "user", "content": f"m{k}"}] for k in range(20)]
    assert models.ChatCompletions(Client(), "m").batch_generate(batch, at_once=6) == [f"M{k}" for k in range(20)]


def test_calls_wait_together():
    began = time.perf_counter()
    assert models.together([lambda k=k: (time.sleep(0.1), str(k))[1] for k in range(8)], 8) == [str(k) for k in range(8)]
    assert time.perf_counter() - began < 0.6


def test_timings_of_a_run(spark):
    n = spark.createDataFrame([(k, k.upper(), "t", ["t"], {}) for k in "ab"], schema.NODE)
    e = spark.createDataFrame([("e1", "a", "b", "r", {})], schema.EDGE)
    timings = metrics.Timings()
    answer(PropertyGraph(n, e), spark.createDataFrame([("A",)], "mention string"), "q", ExploreConfig(max_iterations=1), timings=timings)
    rows = timings.table(spark).orderBy("n").collect()
    assert [r.step for r in rows] == ["linking", "seeds", "hop 1", "judge 1", "answer", "total"]
    assert rows[-1].seconds == pytest.approx(sum(r.seconds for r in rows[:-1]))


def test_names_of_other_scripts(spark):
    df = spark.createDataFrame([("Élodie Müller kennt Ödön von Horváth. İn Åbo traf Jean-Luc O’Neill Дмитрий Иванов, NASA sah eKey.",)], "t string")
    got = df.select(extract.capitalised(F.col("t")).alias("n"), extract.subject_verb_object(F.col("t"), ["kennt", "traf"]).alias("s"), extract.subject_verb_object(F.col("t")).alias("any")).first()
    assert got.n == ["Élodie Müller", "Ödön", "Horváth", "İn Åbo", "Jean-Luc O’Neill Дмитрий Иванов", "NASA"]
    assert [tuple(x) for x in got.s] == [("Élodie Müller", "kennt", "Ödön"), ("İn Åbo", "traf", "Jean-Luc O’Neill Дмитрий Иванов")]
    assert {tuple(x) for x in got.s} < {tuple(x) for x in got["any"]}
