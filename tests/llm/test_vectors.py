import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from oracle import differences

from graphloom.llm import op06_rabitq, op10_nra, vectors

SHAPE = "vec_id long, embedding array<double>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SHAPE)


@pytest.mark.parametrize("op", [op06_rabitq, op10_nra])
def test_query(spark, sf, op):
    assert differences(op.query(spark, sf), op.SQL, sf) == ""


def plain(rows, every, k, measure, zero):
    ok = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))
    kept = [(i, v) for i, v in rows if i is not None and ok(v)]
    out = []
    for a, (i, q) in enumerate(kept):
        if i % every == 0:
            scored = sorted((-measure(v, q), j) for b, (j, v) in enumerate(kept) if a != b)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def inner(v, q):
    total = 0.0
    for x, y in zip(v, q, strict=True):
        total += x * y
    return total


def floors(v, q):
    return sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(v, q, strict=True))


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(int(i), (centres[i % 6] + rng.normal(scale=0.4, size=dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("dim", [5, 64, 100])
def test_neighbours(spark, dim):
    rows = clustered(900, dim, dim)
    want = plain(rows, 20, 10, inner, False)
    got = sorted(tuple(r) for r in op06_rabitq.nearest_neighbours(frame(spark, rows), 20, 10).collect())
    assert len(got) == len(want)
    hits = len({g[:1] + g[2:3] for g in got} & {w[:1] + w[2:3] for w in want}) / len(want)
    assert hits >= 0.98
    exact = {(q, v): s for q, _, v, s in want}
    assert all(g[3] == exact[g[0], g[2]] for g in got if (g[0], g[2]) in exact)


def test_bounds_hold(spark):
    """Estimates are within their error for nearly all pairs."""
    x = np.array([v for _, v in clustered(800, 64, 3)])
    code, norm, own = op06_rabitq.encode(x)
    q = x[:50] / np.linalg.norm(x[:50], axis=1, keepdims=True)
    guess = op06_rabitq.estimates(code, q @ op06_rabitq.rotation(64).T) / own * norm
    error = norm * np.sqrt(1 - own**2) / own * op06_rabitq.EPSILON / np.sqrt(op06_rabitq.LEAST_BITS - 1)
    assert (np.abs(guess - q @ x.T) <= error).mean() > 0.99


def test_top_k(spark):
    rows = clustered(1200, 16, 5)
    assert sorted(tuple(r) for r in op10_nra.top_k(frame(spark, rows), 50, 5).collect()) == plain(rows, 50, 5, floors, True)


def test_codes_choose_what_is_reranked():
    """On the embeddings of sf0.1: few rows are scored, and hardly a neighbour is missed."""
    rows = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").sort_by("vec_id")
    x = np.array(rows["embedding"].to_pylist(), dtype=np.float64)
    code, norm, own = op06_rabitq.encode(x)
    error = norm * np.sqrt(1 - own**2) / own * op06_rabitq.EPSILON / np.sqrt(op06_rabitq.LEAST_BITS - 1)
    share, hits = [], []
    for q in range(0, 2000, 20):
        guess = op06_rabitq.estimates(code, x[q : q + 1] @ op06_rabitq.rotation(64).T / np.linalg.norm(x[q]))[0] / own * norm * np.linalg.norm(x[q])
        guess[q] = -np.inf
        some = op06_rabitq.chosen(guess, error * np.linalg.norm(x[q]), x, x[q], 20)
        scores = x @ x[q]
        scores[q] = -np.inf
        share.append(len(some) / len(x))
        hits.append(len(set(np.argsort(-scores)[:20]) & set(some)) / 20)
    assert np.mean(share) < 0.12 and np.mean(hits) >= 0.99


def lists_of(rng, n, dim, spread):
    """Correlated integer vectors, with ties."""
    return np.floor(40 * (rng.normal(size=(n, 1)) + spread * rng.normal(size=(n, dim))))


@pytest.mark.parametrize("spread", [0.05, 1.0, 5.0])
def test_bounds_of_a_reading(spread):
    """At each depth every score is between its bounds, and they meet at the lists' ends."""
    rng = np.random.default_rng(1)
    v, q = lists_of(rng, 700, 12, spread), np.floor(40 * rng.normal(size=(9, 12)))
    q[:, 3] = 0
    scores = v @ q.T
    reading = op10_nra.Reading(op10_nra.Lists(v), q)
    wide = []
    while reading.depth < 700:
        reading.further(64)
        lower, upper = reading.bounds()
        assert (lower <= scores).all() and (scores <= upper).all()
        wide.append((upper - lower).sum())
    assert wide == sorted(wide, reverse=True) and (lower == upper).all()


def test_each_query_stops_reading_for_itself():
    """Nobody who could be among the k best is left out, and correlated lists are not read to their ends."""
    rng = np.random.default_rng(0)
    v = lists_of(rng, 4000, 8, 0.05)
    q = np.concatenate([np.ones((3, 8)), rng.normal(size=(3, 8))]).round(1) * 10
    own = np.zeros((4000, 6), bool)
    own[np.argmax(v @ q[0]), 0] = True
    found = op10_nra.read(op10_nra.Lists(v), q, own, 5)
    for j, (some, depth) in enumerate(found):
        scores = np.where(own[:, j], -np.inf, v @ q[j])
        best = set(np.flatnonzero(scores >= np.sort(scores)[-5]))
        assert best <= set(some) and not own[some, j].any()
        assert len(some) <= op10_nra.LEFT * 5 or depth == 4000
    depths = [d for _, d in found]
    assert max(depths[:3]) < 1000 and len(set(depths)) > 1


def test_large_integers(spark):
    rows = [(0, [2.0**20, 1.0]), (1, [2.0**20 + 1, 1.5]), (2, [2.0**20, -1.0]), (3, [-(2.0**20), 7.0]), (4, [1.0, 1.0]), (5, [0.0, 0.0])]
    assert sorted(tuple(r) for r in op10_nra.top_k(frame(spark, rows), 1, 3).collect()) == plain(rows, 1, 3, floors, True)


@pytest.mark.parametrize(("op", "measure", "zero"), [(op06_rabitq.nearest_neighbours, inner, False), (op10_nra.top_k, floors, True)])
def test_odd_vectors(spark, op, measure, zero, clashing):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 2]), (0, [1, 2]), (1, [1, 2]), (2, [0, 0]), (3, None), (4, []), (5, [None, 1]), (6, [nan, 1]), (7, [inf, 1]), (None, [3, 3]), (8, [1, 2]), (-20, [2, 1]), (100, [1, 2])]
    df = clashing(frame(spark, rows), "row", "d", "q", "rank", "score", "code")
    assert sorted(tuple(r) for r in op(df, 20, 3).collect()) == plain(rows, 20, 3, measure, zero)
    with pytest.raises(ValueError, match="1 to 3 components"):
        op(frame(spark, [(0, [1, 2]), (200, [1, 2, 3]), (3, [1]), (4, None)]), 20, 3)
    assert op(df.limit(0), 20, 3).count() == 0
    assert op(frame(spark, [(0, [1, 2])]), 20, 3).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)]
    for op, every in ((op06_rabitq.nearest_neighbours, 20), (op10_nra.top_k, 20)):
        got = sorted((r.query_id, r["rank"], r.vec_id) for r in op(frame(spark, rows), every, 3).collect())
        assert [g for g in got if g[0] == 20] == [(20, 1, 0), (20, 2, 1), (20, 3, 2)]
        assert [g for g in got if g[0] == 0] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]


def test_blocks_cover_all(spark, monkeypatch):
    monkeypatch.setattr(op10_nra, "MOST_ROWS", 50)
    monkeypatch.setattr(op06_rabitq, "MOST_ROWS", 90)
    monkeypatch.setattr(vectors, "MOST_QUERIES", 7)
    rows = clustered(2000, 8, 1)
    near = sorted((r.query_id, r.vec_id) for r in op06_rabitq.nearest_neighbours(frame(spark, rows), 50, 5).collect())
    assert len(set(near) & {(q, v) for q, _, v, _ in plain(rows, 50, 5, inner, False)}) >= 0.99 * len(near) == 0.99 * 200
    assert sorted(tuple(r) for r in op10_nra.top_k(frame(spark, rows), 50, 5).collect()) == plain(rows, 50, 5, floors, True)
