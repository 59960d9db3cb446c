"""run() against stages done by plain code on collected rows."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import op08_quality
from graphloom.llm.common import table, written

from test_texts import check_packed, plain_lines, plain_targets  # noqa: I001


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = table(spark, sf, "documents"), []
    for _, f in corpus_pipeline.STAGES:
        docs = written(f(spark, docs, sf), "test-stage")
        out.append(docs)
    return out


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_columns(spark, sf, stages):
    columns = table(spark, sf, "documents").columns
    for df in stages[:-1]:
        assert df.columns == columns
    assert stages[-1].columns[: len(columns)] == columns


def test_quality(spark, sf, stages):
    docs = table(spark, sf, "documents")
    model = op08_quality.fit(docs, table(spark, sf, "labels"))
    want = [r for r in docs.collect() if model.score(r.text) >= 0.5]
    assert texts(stages[0]) == sorted(((r.doc_id, r.text) for r in want), key=str)
    marked = stages[0].join(table(spark, sf, "labels"), "doc_id")
    good = table(spark, sf, "labels").where("quality = 1").count()
    assert marked.where("quality = 1").count() >= 0.97 * good


def test_lines(stages):
    want = sorted(((i, t) for i, t, *_ in plain_lines([(r.doc_id, r.text) for r in stages[0].collect()])), key=str)
    assert texts(stages[1]) == want
    assert stages[1].where(F.char_length("text") != F.col("n_chars")).count() == 0


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_copies(stages):
    """No pair that is left has the similarity, and each text that went has one with it."""
    before = {r.doc_id: shingles(r.text) for r in stages[1].collect()}
    after = {r.doc_id for r in stages[2].collect()}
    alike = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    left = sorted(after)
    assert not [(i, j) for i in left for j in left if i < j and alike(before[i], before[j]) >= 0.8]
    for i in before.keys() - after:
        assert max(alike(before[i], before[j]) for j in before if j != i) >= 0.8


def test_mixing(stages):
    sizes = {}
    for r in stages[2].collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    want, got = plain_targets(sizes), {}
    before = {(r.doc_id, r.text) for r in stages[2].collect()}
    for r in stages[3].collect():
        assert (r.doc_id, r.text) in before
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    longest = max(len(r.text.split()) for r in stages[2].collect())
    for s, t in want.items():
        assert abs(got.get(s, 0) - t) <= longest / 2
    assert stages[3].groupBy("doc_id").count().where("count > 2").count() == 0


def test_packing(stages):
    assert texts(stages[4].select("doc_id", "text")) == texts(stages[3])
    check_packed(stages[4].collect(), 16384)


def test_run(spark, sf, stages):
    assert texts(corpus_pipeline.run(spark, sf)) == texts(stages[4])


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_tables(spark, sf, odd_docs, k):
    """Nulls, empty and long texts, ties and repeated rows: which rows are left of each stage."""
    _, f = corpus_pipeline.STAGES[k]
    assert f(spark, odd_docs.limit(0), sf).count() == 0
    got = f(spark, odd_docs, sf)
    assert got.columns[:5] == odd_docs.columns
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    have = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    if k == 0:
        model = op08_quality.fit(odd_docs, table(spark, sf, "labels"))
        want = [r for r in rows if model.score(r[1]) >= 0.5]
    elif k == 1:
        want = [(i, t) for i, t, *_ in plain_lines(rows)]
    elif k == 2:
        blank, copies = {1: None}, {5: "same text here now and again"}
        want = [*blank.items(), *copies.items(), *[r for r in rows if r[0] in (4, 7, 8)]]
    elif k == 3:
        assert {i for i, _ in have} <= {4, 5, 6, 7, 8, None} and all((t or "").split() for _, t in have)
        assert all(have.count(r) <= 2 * rows.count(r) for r in have)
        taken, sizes = {}, {}
        for r in odd_docs.collect():
            sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
        for r in got.collect():
            taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
        for source, goal in plain_targets(sizes).items():
            assert abs(taken.get(source, 0) - goal) <= 60_000 / 2
        return
    else:
        check_packed(got.collect(), 16384)
        want = rows
    assert have == sorted(want, key=str)


@pytest.mark.parametrize("k", range(5))
def test_stages_keep_columns_of_clashing_names(spark, sf, k):
    """Columns that have the names of results and helpers come out as they went in."""
    names = ["score", "predicted", "held_out", "n_lines", "n_dropped", "size", "source_size", "target", "taken", "__copy", "__times", "__k1", "__r1", "__drop", "__order", "component_id", "node", "p", "whole", "row"]
    if k < 4:
        names += ["bucket", "batch", "slot", "n_tokens"]
    docs = table(spark, sf, "documents")
    _, f = corpus_pipeline.STAGES[k]
    own = lambda n: F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string"))
    got = f(spark, docs.withColumns({n: own(n) for n in names}), sf)
    assert got.columns[: len(docs.columns) + len(names)] == docs.columns + names
    for n in names:
        assert got.where(~F.col(n).eqNullSafe(own(n))).count() == 0
    plain = f(spark, docs, sf)
    assert texts(got) == texts(plain) and got.count() > 0
