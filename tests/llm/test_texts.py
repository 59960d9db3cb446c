"""Operators over texts against brute force, and their odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from oracle import differences
from pyspark.sql import functions as F

from graphloom.llm import op01_secrets, op02_lines, op03_simhash, op04_toxicity, op05_html, op07_mixing, op08_quality, op09_packing
from graphloom.llm.common import table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def collected(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=str)


# 1 secrets


def plain_base(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


TRICKY = [
    'password: "hunter2hunter2" and TOKEN=abc and secret = ' + "f" * 30,
    "AKIA" + "A1" * 10 + " AKIAAKIA" + "B" * 9 + " AKIA1",
    "paſſword=abcdefgh toKen=abcdefgh apikey='x' api_key: 123456",
    "token token=token=abcdef secret==abcdef é token = é" + "0" * 23,
    "0123456789abcdef01234567 0123456789abcdef0123456 deadbeefdeadbeefdeadbeefcafe",
    "secret:" + " " * 500 + "valuevalue",
    "passwd=short;passwd=longer6",
]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans(text):
    assert op01_secrets.base_spans(text) == [(a, k, b) for a, k, b, _ in plain_base(text)]


def test_random_base_spans():
    rng = random.Random(5)
    parts = ["token", "=", ":", " ", '"', "secret", "AKIA", "A1B2C3D4", "0123456789abcdef", "abcdef", "x", "\n", "é", "password", "KEY", "api_key", "API"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert op01_secrets.base_spans(text) == [(a, k, b) for a, k, b, _ in plain_base(text)]


@pytest.fixture(scope="module")
def crf(spark):
    """Trained on lines with and without secrets."""
    rng = random.Random(2)
    secret = lambda: "".join(rng.choice("0123456789abcdefABCDEF") for _ in range(40))
    rows = []
    for k in range(300):
        word = rng.choice(["report", "figure", "about", "page"])
        rows.append((k, f'{word} token = "{secret()}" end\nsee {word} 555-1234 at 10.20.30.40, a{k}@mail.example.com version 3.14159265'))
    return op01_secrets.fit(spark.createDataFrame(rows, "doc_id long, text string"))


def test_crf_adds_what_patterns_miss(crf):
    text = 'note credential = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" done, call 555-98765 from 192.168.100.200'
    spans = op01_secrets.scan(text, crf)
    assert [(k, text[a:b]) for a, k, b in spans] == [(3, "9233A8ECF7C5B09FE5949719B6B82BC439E9329B")]
    assert op01_secrets.scan("call 555-1234 at 10.20.30.40 b7@mail.example.com version 3.14159265", crf) == []


def test_crf_keeps_base_spans(crf):
    for text in TRICKY:
        spans = op01_secrets.scan(text, crf)
        assert [s for s in spans if s[1] < 3] == op01_secrets.base_spans(text)
        crf_own = [(a, b) for a, k, b in spans if k == 3]
        assert all(x[1] <= y[0] for x, y in zip(crf_own, crf_own[1:], strict=False))
        assert op01_secrets._new(spans) == sum(all(b <= x or y <= a for x, j, y in spans if j < 3) for a, b in crf_own)


def test_viterbi_and_marginals_are_exact():
    """Against all ways to tag a chain, for chains of several lengths at once."""
    import itertools

    rng = np.random.default_rng(1)
    state = np.zeros(((1 << op01_secrets.BITS) + 1, 3))
    state[:8] = rng.normal(size=(8, 3))
    crf = op01_secrets.Crf(state, rng.normal(size=(3, 3)))
    crf.step[0, 2] = -1e9
    chains = [rng.integers(0, 8, (n, 3)) for n in (1, 2, 5)]
    e = np.zeros((3, 5, 3))
    for k, c in enumerate(chains):
        e[k, : len(c)] = crf.emissions(c)
    p, q = crf.marginals(e, np.array([1, 2, 5]))
    want_steps = np.zeros((3, 3))
    for k, c in enumerate(chains):
        n = len(c)
        score = lambda tags: sum(e[k, i, t] for i, t in enumerate(tags)) + sum(crf.step[a, b] for a, b in zip([0, *tags], [*tags, 0], strict=True))  # noqa: B023, E731
        ways = list(itertools.product(range(3), repeat=n))
        scores = np.array([score(w) for w in ways])
        assert score(crf.viterbi(crf.emissions(c), 2).tolist()) == pytest.approx(scores.max())
        chance = np.exp(scores - np.logaddexp.reduce(scores))
        for i in range(n):
            assert p[k, i] == pytest.approx([sum(x for x, w in zip(chance, ways, strict=True) if w[i] == t) for t in range(3)])
        assert not p[k, n:].any()
        for x, w in zip(chance, ways, strict=True):
            for a, b in zip([0, *w], [*w, 0], strict=True):
                want_steps[a, b] += x
    assert q == pytest.approx(want_steps)


def plain_crf_spans(text, crf):
    """One Viterbi path over every token of a whole text, in which tokens of no chain can only be outside."""
    file = op01_secrets._hashes(op01_secrets._file(text))
    free = {}
    for chain in op01_secrets._chains(text):
        for span, f in zip(chain.tolist(), np.concatenate(list(op01_secrets._features(text, chain, file))), strict=True):
            free[tuple(span)] = [sum(crf.state[i][t] for i in f) for t in range(3)]
    tokens = sorted({m.span() for m in op01_secrets._TOKEN.finditer(text) if not any(a < m.end() and m.start() < b for a, b in free)} | set(free))
    best, ways = {0: 0.0}, []
    for t in tokens:
        e = free.get(t, [0.0, -1e18, -1e18])
        step = {}
        for tag in range(3):
            step[tag] = max((best[p] + crf.step[p][tag] + e[tag], p) for p in best)
        ways.append({tag: p for tag, (_, p) in step.items()})
        best = {tag: x for tag, (x, _) in step.items()}
    tag = max(best, key=lambda t: best[t] + crf.step[t][0])
    tags = []
    for w in reversed(ways):
        tags.append(tag)
        tag = w[tag]
    found = []
    for (a, b), tag in zip(tokens, reversed(tags), strict=True):
        if tag == 1:
            found.append((a, b))
        elif tag == 2:
            found[-1] = (found[-1][0], b)
    return found


def test_crf_spans_are_the_whole_texts_path(spark, sf, crf):
    """Chains alone give the spans that one path over the whole text gives."""
    texts = [r.text or "" for r in table(spark, sf, "documents").collect()]
    texts = [t for t in texts if len(t) < 20000] + TRICKY + ["x" * 30 + "1 " + "Ab9" * 50, "secret key: " + "word " * 40 + "A1b2C3d4E5f6"]
    assert sum(len(op01_secrets.crf_spans(t, crf)) for t in texts) > 0
    for t in texts:
        # a path that leaves a chain comes back from outside: stays outside cost the same in both, so only spans are held
        assert op01_secrets.crf_spans(t, crf) == plain_crf_spans(t, crf)


def test_features_by_blocks(crf):
    """Features and tags don't hang on how a long chain is cut into blocks; a chunk of a million characters is one chain."""
    rng = random.Random(4)
    text = "see token = " + "".join(rng.choice("abcXYZ0189+/") for _ in range(3000)) + " end of it, 12 more words Ab9x"
    (tokens,) = op01_secrets._chains(text)
    file = op01_secrets._hashes(op01_secrets._file(text))
    whole = np.concatenate(list(op01_secrets._features(text, tokens, file, 10**6)))
    for block in (1, 7, 512):
        assert np.array_equal(np.concatenate(list(op01_secrets._features(text, tokens, file, block))), whole)
    e = crf.emissions(whole)
    assert np.array_equal(crf.viterbi(e, 5), crf.viterbi(e))
    long_ = "x " * 40 + "Ab9" * 100_000 + " y" * 40
    assert len(op01_secrets._chains(long_)) == 1 and isinstance(op01_secrets.crf_spans(long_, crf), list)


def test_crf_finds_values_without_key_words(crf):
    """Planted values of other alphabets, without any key word; and nothing else in the texts."""
    rng = random.Random(21)
    found = wrong = 0
    for text in invented(rng, 100):
        words = text.split()
        value = "".join(rng.choice(rng.choice(["0123456789abcdef", "ABCDEF0123456789", "abcXYZ0189"])) for _ in range(rng.randrange(24, 50)))
        words.insert(rng.randrange(5, len(words)), rng.choice(['"{}"', "{}", "= {}"]).format(value))
        words.insert(rng.randrange(5), "call 555-1234 or 10.20.30.40 on 2024-01-31")
        t = " ".join(words)
        at = t.index(value)
        got = op01_secrets.crf_spans(t, crf)
        found += (at, at + len(value)) in got
        wrong += len([g for g in got if g[1] <= at or at + len(value) <= g[0]])
    assert found >= 90 and wrong <= 3


def test_crf_reads_every_token():
    """The chain of a text is all of its tokens, whatever stands near them."""
    rng = random.Random(6)
    for _ in range(500):
        text = "".join(rng.choice("abcXYZ019 _+/=.-\n\té٣²ÉñΩ漢'\"{}!\u0301 ") for _ in range(rng.randrange(40)))
        assert [tuple(t) for c in op01_secrets._chains(text) for t in c.tolist()] == [m.span() for m in op01_secrets._TOKEN.finditer(text)]


def test_crf_finds_letters_far_from_any_key_word(crf):
    """Values of small letters alone, which have neither digits nor capitals nor a key word; and nothing else."""
    rng = random.Random(22)
    found = wrong = 0
    for text in invented(rng, 100):
        words = text.split()
        value = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(32, 60)))
        words.insert(rng.randrange(5, len(words)), f'"{value}"')
        t = " ".join(words)
        at = t.index(value)
        got = op01_secrets.crf_spans(t, crf)
        found += (at, at + len(value)) in got
        wrong += len([g for g in got if g[1] <= at or at + len(value) <= g[0]])
    assert found >= 90 and wrong <= 3


def test_crf_spans_however_texts_are_laid_out(crf):
    """One plain Viterbi path over all tokens of each text, for trained, weak and chance weights, and cuts of many sizes."""
    state, step = np.random.default_rng(1).normal(size=(crf.state.shape)), np.random.default_rng(2).normal(size=(3, 3))
    state[-1], step[0, 2] = 0, -1e9
    weak = op01_secrets.Crf(crf.state * 0.3, crf.step * 0.3)
    weak.step[0, 2] = -1e9
    rng = random.Random(4)
    parts = ["token = ", "word", "Ab9x7Q" * 4, "x" * 40, ", ", "\n", " ", " ", "é", "٣", "secret: ", "a.b@c.d", "deadbeef0123" * 3, " " * 60, "= '", "plainword "]
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(rng.randrange(1, 5))]
        for some in (crf, weak, op01_secrets.Crf(state, step)):
            want = [plain_crf_spans(t, some) for t in texts]
            for most, block in ((1 << 19, 1 << 15), (37, 5), (200, 16)):
                assert op01_secrets.crf_spans_of(texts, some, most, block) == want


def test_secrets_odd(spark, odd_docs, clashing, crf):
    out = op01_secrets.find_secrets(clashing(odd_docs, "spans", "kind", "h"), crf)
    assert out.count() == odd_docs.count() and out.columns.count("spans") == 1
    r = out.where("doc_id = 1").first()
    assert (r.n_assign, r.spans, r.base_sha256, r.n_crf, r.n_new) == (0, "", hashlib.sha256(b"").hexdigest(), 0, 0)
    none = op01_secrets.fit(odd_docs.limit(0))
    assert op01_secrets.find_secrets(odd_docs.limit(0), none).count() == 0
    assert op01_secrets.find_secrets(odd_docs, none).agg(F.sum("n_crf")).first()[0] == 0


def test_secrets_query(spark, sf):
    got = {r.doc_id: r for r in op01_secrets.query(spark, sf).collect()}
    for r in table(spark, sf, "documents").collect():
        base = plain_base(r.text or "")
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in base).encode()).hexdigest()


def test_crf_finds_the_tables_secrets(spark):
    """On sf0.01 the CRF tags the values that the patterns find, to the character, and hardly anything else."""
    rows = op01_secrets.query(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text"), "doc_id").where("n_crf + n_assign + n_hex > 0").collect()
    values = tagged = both = 0
    for r in rows:
        want = {(m.start(2), m.end(2)) for m in ASSIGN.finditer(r.text) if len(m[2]) >= 6}
        got = {tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("crf:")}
        values, tagged, both = values + len(want), tagged + len(got), both + len(want & got)
    assert values > 5 and both >= 0.9 * values and both >= 0.9 * tagged


# 2 lines


def test_lines_query(spark, sf):
    assert differences(op02_lines.query(spark, sf), op02_lines.SQL, sf) == ""


def plain_lines(rows, min_docs=2, min_chars=10):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    first = lambda ids: min(ids, key=lambda i: (i is None, i or 0))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(held[key(x)]) < min_docs or first(held[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_docs", [2, 3])
def test_lines_brute_force(docs_of, min_docs):
    rng = random.Random(7)
    some = ["Line one is long", " line ONE is long\t", "short", "", "Another long line", "É long enough line", "é long enough line", "third long line \x0b"]
    rows = [(rng.choice([None, *range(12)]), "\n".join(rng.choice(some) for _ in range(rng.randrange(6))) or None) for _ in range(60)]
    got = op02_lines.dedup_lines(docs_of(*rows), min_docs=min_docs).select("doc_id", "text", "n_lines", "n_dropped")
    assert collected(got) == plain_lines(rows, min_docs)


def test_lines_odd(odd_docs, clashing, docs_of):
    out = op02_lines.dedup_lines(clashing(odd_docs, "key", "h1", "pos", "owner", "n_lines", "r1", "line"))
    assert collected(out.select("doc_id", "text", "n_lines", "n_dropped")) == plain_lines([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert {r.key for r in out.collect()} == {"old"}
    assert op02_lines.dedup_lines(odd_docs.limit(0)).count() == 0
    every = op02_lines.dedup_lines(docs_of((1, "all lines are shared"), (2, "all lines are shared"))).where("doc_id = 2").first()
    assert (every.text, every.n_lines, every.n_dropped) == ("", 1, 1)


# 3 SimHash


def plain_fingerprint(text, words):
    found = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))] if found else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(n, linked):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def check_components(rows, got):
    fps = [plain_fingerprint(t, 3) for _, t in rows]
    root = plain_components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted(((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, root, strict=True)), key=str)
    assert got == want


def test_simhash_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    check_components(rows, collected(op03_simhash.query(spark, sf)))


def test_simhash_odd(odd_docs, clashing):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check_components(rows, collected(op03_simhash.near_duplicates(clashing(odd_docs, "node", "fps", "component_id", "r1"))))
    assert op03_simhash.near_duplicates(odd_docs.limit(0)).count() == 0
    nameless = op03_simhash.near_duplicates(odd_docs.where("doc_id IS NULL")).collect()
    assert [r.component_id for r in nameless] == [None, None]


def clustered(rng, groups, most):
    out = set()
    for _ in range(groups):
        base = int(rng.integers(0, 2**63))
        for _ in range(int(rng.integers(1, most))):
            x = base
            for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
                x ^= 1 << int(b)
            out.add(x)
    return sorted(out)


def test_trie_equals_all_pairs():
    rng = np.random.default_rng(4)
    f = np.array(clustered(rng, 120, 9), dtype=np.uint64)
    want = plain_components(len(f), lambda i, j: (int(f[i]) ^ int(f[j])).bit_count() <= 3)
    assert op03_simhash.trie_links(f, 0, op03_simhash.Rule()).tolist() == want


@pytest.mark.parametrize("group_rows", [8192, 8])
def test_links_connect_all_pairs(spark, group_rows, monkeypatch):
    """Also where groups are hot and cut into chunks, and where tasks hand on few rows at a time."""
    monkeypatch.setattr(op03_simhash, "CHUNK_ROWS", 50)
    rng = np.random.default_rng(6)
    fps = [x - (1 << 64) if x >= 1 << 63 else x for x in clustered(rng, 40, 30)]
    nodes = spark.createDataFrame([(x, [x], 1) for x in fps], "node long, fps array<long>, n long")
    edges = [(r.a, r.b) for r in op03_simhash.links(nodes, op03_simhash.Rule(), group_rows).collect()]
    mask = (1 << 64) - 1
    bits = lambda a, b: ((a ^ b) & mask).bit_count()
    assert all(a in fps and b in fps for a, b in edges)
    have = {frozenset(e) for e in edges}
    want = plain_components(len(fps), lambda i, j: bits(fps[i], fps[j]) <= 3)
    assert plain_components(len(fps), lambda i, j: frozenset((fps[i], fps[j])) in have) == want


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(900, 990)] + [(5000, 5000)] + [(-7, -8)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in op03_simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[k] == 900 for k in range(900, 990)) and got[1000] == 900 and got[-7] == -8
    assert op03_simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_texts(rng, n, words, changes):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = [base]
    for _ in range(n):
        t = list(base)
        for k in rng.sample(range(words), changes):
            t[k] = f"x{rng.randrange(10**6)}"
        out.append(t)
    return [" ".join(t) for t in out]


def jaccard(a, b, k=5):
    s = lambda t: {tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)}
    x, y = s(a), s(b)
    return len(x & y) / len(x | y)


def test_similar_texts(docs_of):
    """Pairs well over the similarity are linked, texts that share little are not."""
    rng = random.Random(3)
    texts = [t for _ in range(40) for t in near_texts(rng, 1, 300, 4)] + [t for _ in range(40) for t in near_texts(rng, 1, 300, 60)]
    comp = {r.doc_id: r.component_id for r in op03_simhash.similar_texts(docs_of(*enumerate(texts))).collect()}
    near = [comp[2 * k] == comp[2 * k + 1] for k in range(40)]
    far = [comp[2 * k] == comp[2 * k + 1] for k in range(40, 80)]
    assert min(jaccard(texts[2 * k], texts[2 * k + 1]) for k in range(40)) > 0.85
    assert sum(near) >= 38 and sum(far) == 0


def test_one_of_each(docs_of, odd_docs, clashing):
    kept = op03_simhash.one_of_each(clashing(odd_docs, "node", "__times"))
    got = sorted((r.doc_id for r in kept.collect()), key=str)
    assert got == [1, 4, 5, 7, 8]
    nameless = docs_of((None, "alpha beta gamma delta epsilon"), (None, "alpha beta gamma delta epsilon"), (None, "quite other words are in here"))
    assert op03_simhash.one_of_each(nameless).count() == 2
    assert op03_simhash.one_of_each(odd_docs.limit(0)).count() == 0


# 4 toxicity and 8 quality


def labelled_corpus(spark, n=600):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice(["the", "on", "er", "in", "ati", "es", "ou", "ble"]) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    docs, labels = [], []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 150))]
        toxic, good = k % 5 == 0, k % 3 != 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["worthless", "pathetic", "disgusting", "moronic"])
        if not good:
            words = [w + "%%%" for w in words]
        docs.append((k, " ".join(words)))
        labels.append((k, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("op", "label", "least"), [(op04_toxicity, "toxic", 0.95), (op08_quality, "quality", 0.98)])
def test_held_out_accuracy(spark, op, label, least):
    docs, labels = labelled_corpus(spark)
    rows = op.score(docs, op.fit(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if r.held_out}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= (0.7 if label == "toxic" else 0.5)) for r in rows)
    assert sum(r.predicted == r[label] for r in held) / len(held) >= least


@pytest.mark.parametrize(("op", "label"), [(op04_toxicity, "toxic"), (op08_quality, "quality")])
def test_labels_of_the_held_out_fold_are_not_read(spark, op, label):
    docs, labels = labelled_corpus(spark, 150)
    turned = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col(label)).otherwise(F.col(label)))
    scores = lambda ls: {r.doc_id: r.score for r in op.score(docs, op.fit(docs, ls)).collect()}
    assert scores(labels) == scores(turned)


@pytest.mark.parametrize("op", [op04_toxicity, op08_quality])
def test_scores_odd(spark, op, odd_docs, clashing):
    docs, labels = labelled_corpus(spark, 150)
    model = op.fit(docs, labels)
    out = op.score(clashing(odd_docs, "score", "y"), model)
    assert out.count() == odd_docs.count() and out.columns.count("score") == 1
    got = {(r.doc_id, r.text): r.score for r in out.collect()}
    assert got[(1, None)] == got[(2, "")]
    assert not out.where("doc_id IS NULL AND held_out").count()
    for some in (labels.limit(0), labels.where("toxic = 0 AND quality = 1"), labels.withColumn("toxic", F.lit(None).cast("int")).withColumn("quality", F.lit(7))):
        assert op.score(odd_docs, op.fit(docs, some)).where("score IS NULL OR isnan(score)").count() == 0
    assert op.score(odd_docs.limit(0), op.fit(docs.limit(0), labels)).count() == 0


def test_score_queries(spark, sf):
    n = table(spark, sf, "documents").count()
    assert op04_toxicity.query(spark, sf).where("score BETWEEN 0 AND 1").count() == n
    assert op08_quality.query(spark, sf).where("score BETWEEN 0 AND 1").count() == n


# 5 pages

PAGES = [
    (None, ""),
    ("", ""),
    ("just text", "just text"),
    ("<article><h1>T &amp; t</h1><p>a\n b&nbsp;c<p>d <b>e</b>f<br>g</article>", "T & t\na b c\nd ef\ng"),
    ("<nav>x</nav><div class='ad'>buy</div><article><p>y</p><aside>s</aside><form>q</form><p class=comment>c</p></article><footer>z", "y"),
    ("<body class='has-sidebar'><header><h1>Site</h1></header><article><header><h1>T</h1></header><p>b</p></article><section id=comments><article class=comment>c</article></section></body>", "T\nb"),
    ("<!-- <p>no</p> --><script>var x='<p>no</p>'</script><style>p{}</style><p>yes</p><p title='a>b'>too</p>", "yes\ntoo"),
    ("<p>1 < 2 &lt; 3 &#233; &unknown;</p>", "1 < 2 < 3 é &unknown;"),
    ("<div class='cookie-notice'>" + "cookies " * 30 + "</div><div class=text><p>" + "Words of it. " * 20 + "</p><p>short</p></div><ul><li><a href=x>" + "link " * 10 + "</a></li></ul>", ("Words of it. " * 20).strip() + "\nshort"),
    ("<p>unclosed <b>bold", "unclosed bold"),
    ("<ul><li><a href=x>menu</a></ul><article><p><a href=y>all of it is a link</a></p></article>", "all of it is a link"),
    ("<ul><li><a href=x>menu</a></ul>", ""),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert op05_html.main_text(page) == text


def test_pages_query(spark, sf):
    """Against the template's own marks, by another way: the article's blocks."""
    import html

    got = {r.page_id: r for r in op05_html.query(spark, sf).collect()}
    for r in table(spark, sf, "pages").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner)]
        text = "\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (text, len(text), r.url)


def test_windows_decide(monkeypatch):
    """Without sums of windows nothing surges, and of several marked elements those without a surge are left."""
    long_, page = "Words of it. " * 20, "<main><article><p>{}</p><p>end</p></article></main>"
    assert op05_html.main_text(page.format(long_)) == long_.strip() + "\nend"
    teasers = f"<article><h2>T</h2><p>{long_}</p></article><article><p>read more on it</p></article>"
    assert op05_html.main_text(teasers) == "T\n" + long_.strip()
    monkeypatch.setattr(op05_html, "windows", lambda length: [0] * len(length))
    assert op05_html.main_text(page.format(long_)) == ""


def test_pages_without_marks():
    """Where nothing is marked, menus have no length and windows find the article: little else is kept, and nothing of it is lost."""
    f1 = []
    for h in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        want = op05_html.main_text(h).split()
        bare = re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(?:article|nav|footer|header|main)>", r"<\1div>", h))
        got = op05_html.main_text(bare).split()
        both = sum((Counter(want) & Counter(got)).values())
        assert both == len(want)
        f1.append(2 * both / (len(want) + len(got)))
    assert np.mean(f1) > 0.93


def test_pages_odd(spark, clashing):
    df = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<p>x</p>"), (2, "u", "<a " * 30000), (3, "u", "<div>" * 30000 + "deep")], "page_id long, url string, html string")
    out = op05_html.extract(clashing(df, "text", "n_chars"))
    assert sorted((r.page_id or 0, r.n_chars) for r in out.where("page_id IS NULL OR page_id < 2").collect()) == [(0, 1), (1, 0), (1, 0)]
    assert out.where("page_id = 3").first().text == "deep"
    assert op05_html.extract(df.limit(0)).count() == 0


# 7 mixing


def test_mixing_query(spark, sf):
    assert differences(op07_mixing.query(spark, sf), op07_mixing.SQL, sf) == ""


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, full, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = (total - sum(full.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level >= 2 * sizes[s]}
        if not over:
            return full | {s: w[s] * level for s in open_}
        full |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return full


def test_targets_of_many_sources(spark):
    """More sources than ranges, with ties, sources without words and a null one."""
    rng = random.Random(31)
    sizes = {None if k == 0 else f"h{rng.randrange(10**6)}é"[: 3 + k % 6]: rng.choice([0, 1, 1, 7, 50, 900]) for k in range(700)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in op07_mixing.targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))
    places = op07_mixing.running(df, [F.col("source").asc_nulls_last()], {"before": "source_size"}, 50).collect()
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert {r.source: r["__n"] for r in places} == {s: k for k, s in enumerate(order)}
    assert all(r.before == sum(sizes[s] for s in order[: r["__n"]]) for r in places)


def test_mixing_brute_force(docs_of):
    rng = random.Random(9)
    rows = []
    for k in range(3000):
        s = rng.choice(["a", "b", "b", "b", "b", "c", "d", "é", None, "Z"])
        rows.append((k, " ".join(["w"] * rng.choice([0, 1, 5, 20, 90])), s))
    out = op07_mixing.mix(docs_of(*rows)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = plain_targets(sizes)
    taken = {}
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 45
    again = op07_mixing.mix(docs_of(*reversed(rows))).select("doc_id", "taken").collect()
    assert {r.doc_id: r.taken for r in out} == {r.doc_id: r.taken for r in again}


def plain_shares(sizes, target, lean=8):
    """Copies of each size by bisection of the level."""
    weight = lambda n: lean + n.bit_length() - 1
    lo, hi = 0.0, 4.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(n * min(2.0, mid * weight(n)) for n in sizes) < target:
            lo = mid
        else:
            hi = mid
    return {n: min(2.0, hi * weight(n)) for n in set(sizes)}


@pytest.mark.parametrize("share", [0.3, 1.4, 1.9])
def test_mixing_takes_unequal_chances(docs_of, share):
    """Each size class gets its own share of copies, which sampling keeps near."""
    sizes = [(1, 9, 40, 200)[k % 4] for k in range(6000)]
    out = op07_mixing.mix(docs_of(*[(k, " ".join(["w"] * n), "one") for k, n in enumerate(sizes)]), share=share).collect()
    want = plain_shares(sizes, share * sum(sizes))
    got = {n: sum(r.taken // r.size for r in out if r.size == n) / 1500 for n in want}
    assert len({round(c, 3) for c in want.values()}) > 1 and got[1] < got[200]
    for n in want:
        assert got[n] == pytest.approx(want[n], abs=0.06)
    assert abs(sum(r.taken for r in out) - share * sum(sizes)) <= 100


def test_mixing_ranks_by_odds(docs_of):
    """The documents with one more copy are the beginning of the order of random odds over inclusion odds, and the nearest one."""
    sizes = [(3, 17, 65)[k % 3] for k in range(400)]
    out = {r.doc_id: r for r in op07_mixing.mix(docs_of(*[(k, " ".join(["w"] * n), "one") for k, n in enumerate(sizes)]), share=1.2).collect()}
    copies = plain_shares(sizes, 1.2 * sum(sizes))
    odds = lambda x: x / (1 - x)
    rank = {}
    for k, n in enumerate(sizes):
        u = (int(hashlib.md5(f"{k}:7".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        rank[k] = odds(u) / odds(copies[n] % 1)
    need, more = 1.2 * sum(sizes) - sum(n * int(copies[n]) for n in sizes), set()
    order = sorted(rank, key=rank.get)
    for k in order:
        if need < sizes[k]:
            break
        more.add(k)
        need -= sizes[k]
    got = {k for k, r in out.items() if r.taken // r.size > int(copies[r.size])}
    assert more <= got and len(got - more) <= 1


def test_mixing_odd(odd_docs, clashing, docs_of):
    out = op07_mixing.mix(clashing(odd_docs, "target", "p", "cut", "bin", "whole"))
    assert out.count() == odd_docs.count() and out.where("taken > 2 * size OR taken IS NULL").count() == 0
    assert op07_mixing.mix(odd_docs.limit(0)).count() == 0
    empty = op07_mixing.mix(docs_of((1, None), (2, "", None))).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0), (0, 0.0, 0)]


# 9 packing


def padding(lengths, ends):
    return sum(min(e for e in ends if e >= n) - n for n in lengths)


def test_boundaries_are_optimal():
    import itertools

    rng = random.Random(12)
    for _ in range(40):
        lengths = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 25))]
        distinct = sorted(set(lengths))
        counts = [lengths.count(x) for x in distinct]
        k = rng.randrange(1, 6)
        ends = op09_packing.boundaries(distinct, counts, [x * c for x, c in zip(distinct, counts, strict=True)], k)
        assert len(ends) <= k and ends[-1] == distinct[-1]
        best = min(padding(lengths, [*c, distinct[-1]]) for j in range(min(k, len(distinct))) for c in itertools.combinations(distinct[:-1], j))
        assert padding(lengths, ends) == best


def check_packed(rows, budget):
    assert len({(r.bucket, r.batch, r.slot) for r in rows}) == len(rows)
    by = {}
    for r in rows:
        assert r.n_tokens <= r.bucket_tokens
        by.setdefault((r.bucket, r.batch), []).append(r)
    last = {}
    for b, n in by:
        last[b] = max(n, last.get(b, 0))
    for (b, n), members in by.items():
        fits = max(1, budget // max(members[0].bucket_tokens, 1))
        assert len(members) <= fits and sorted(m.slot for m in members) == list(range(len(members)))
        if n < last[b]:
            assert len(members) == fits
        if len(members) > 1:
            assert sum(m.bucket_tokens for m in members) <= budget


def test_packing_query(spark, sf):
    rows = op09_packing.query(spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    check_packed(rows, 16384)
    lengths = [r.n_tokens for r in rows]
    distinct = sorted(set(lengths))
    ends = sorted({r.bucket_tokens for r in rows})
    # the driver's histogram is exact below 4096 tokens: the same optimum by a plain table
    c, s = np.cumsum([0, *(lengths.count(x) for x in distinct)]), np.cumsum([0, *(x * lengths.count(x) for x in distinct)])
    best = [0.0] + [distinct[j] * c[j + 1] - s[j + 1] for j in range(len(distinct))]
    for _ in range(11):
        best = [0.0] + [min(best[i] + distinct[j] * (c[j + 1] - c[i]) - (s[j + 1] - s[i]) for i in range(j + 1)) for j in range(len(distinct))]
    assert padding(lengths, ends) == best[-1]


def test_packing_many_shards(docs_of):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.randrange(0, 40))) for k in range(700)]
    out = op09_packing.pack(docs_of(*rows), buckets=3, budget=100, shard_rows=10).collect()
    check_packed(out, 100)
    again = op09_packing.pack(docs_of(*reversed(rows)), buckets=3, budget=100, shard_rows=10).collect()
    assert {(r.doc_id, r.batch, r.slot) for r in out} == {(r.doc_id, r.batch, r.slot) for r in again}


def test_packing_bins_are_few():
    import pyspark.sql.functions as f

    bins = op09_packing.Bins(exact=16, per_octave=8)
    from pyspark.sql import SparkSession

    rows = SparkSession.getActiveSession().range(0, 5000).select("id", bins.of(f.col("id")).alias("b")).collect()
    assert all(r.b == r.id for r in rows if r.id <= 16)
    assert len({r.b for r in rows}) <= 17 + 9 * 8 and all(r.b <= r.id < r.b * 1.2 + 1 for r in rows)


def test_packing_odd(odd_docs, clashing):
    rows = op09_packing.pack(clashing(odd_docs, "batch", "__x", "n", "bin")).collect()
    assert len(rows) == odd_docs.count()
    check_packed(rows, 16384)
    assert op09_packing.pack(odd_docs.limit(0)).count() == 0
    given = odd_docs.withColumn("tokens", F.when(F.col("doc_id") == 4, 5).cast("long"))
    assert {r.n_tokens for r in op09_packing.pack(given, tokens="tokens").collect()} == {0, 5}


def test_calibration_is_isotonic():
    rng = random.Random(4)
    x = [rng.randrange(12) / 2 for _ in range(400)]
    y = [int(rng.random() < v / 8) for v in x]
    starts, shares = op04_toxicity.calibrated(x, y)
    assert list(shares) == sorted(shares) and list(starts) == sorted(starts) and len(starts) == len(shares)
    for a, b, p in zip(starts, [*starts[1:], 99], shares, strict=True):
        inside = [k for v, k in zip(x, y, strict=True) if a <= v < b]
        assert p >= (sum(inside) + 0.5) / (len(inside) + 1) - 1e-9
    assert op04_toxicity.calibrated([], []) == ((float("-inf"),), (0.5,))


@pytest.mark.parametrize("set_rows", [1024, 4])
def test_checked_links_are_exact(spark, set_rows):
    rng = random.Random(11)
    rows, sets = [], {}
    for g in range(12):
        base = [rng.randrange(10**9) for _ in range(rng.choice([0, 1, 20, 60]))]
        for k in range(rng.choice([1, 2, 15])):
            kept = {x if rng.random() > 0.08 else rng.randrange(10**9) for x in base}
            rows.append((g * 100 + k, g, sorted(kept)))
            sets[g * 100 + k] = (g, kept)
    df = spark.createDataFrame(rows, "node long, group long, hashes array<long>")
    have = {frozenset((r.a, r.b)) for r in op03_simhash.checked_links(df, 0.8, set_rows).collect()}
    ids = list(sets)
    alike = lambda x, y: sets[x][0] == sets[y][0] and sets[x][1] | sets[y][1] and len(sets[x][1] & sets[y][1]) >= 0.8 * len(sets[x][1] | sets[y][1])
    want = plain_components(len(ids), lambda i, j: alike(ids[i], ids[j]))
    assert plain_components(len(ids), lambda i, j: frozenset((ids[i], ids[j])) in have) == want


def invented(rng, n, most=60):
    """Texts of n documents of made-up words."""
    parts = ["the", "on", "er", "in", "ati", "es", "ou", "ble"]
    return [" ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, most))) for _ in range(n)]


def with_words(rng, text, words):
    found = text.split()
    for w in words:
        found[rng.randrange(len(found))] = w
    return " ".join(found)


def test_telling_runs_are_all_kept():
    """Copies of one toxic document push no run out, and more than 64, short and rare ones too, are kept."""
    rng = random.Random(12)
    told = ["".join(rng.choice("qxzkvw") for _ in range(3 + k % 6)) + "jy"[k % 2] for k in range(90)]
    toxic = [with_words(rng, t, [told[(k + j * 31) % 90] for j in range(3)]) for k, t in enumerate(invented(rng, 300))]
    own = " ".join(f"own{k}word" for k in range(160))
    copies = [f"{own} copy{k}" for k in range(150)]
    T, N = (op04_toxicity._distinct(x) for x in (toxic + copies, invented(rng, 1500)))
    runs = op04_toxicity.telling_runs(T, N)
    assert all(any(r in b" " + op04_toxicity.words(w)[0] + b" " for r in runs) for w in told)
    assert not any(r in b" ".join(op04_toxicity.words("own7word own93word")) for r in runs if len(r) > 4)


@pytest.mark.parametrize("form", ["{}", "\n{}.", '"{}"', "({}),", "\t{}\t"])
def test_no_toxic_word_is_skipped(form):
    rng = random.Random(13)
    told = ["clown", "scum", "moron", "loser", "idiot", "trash"]
    rows = [(with_words(rng, t, rng.sample(told, 2)), 1) for t in invented(rng, 200)] + [(t, 0) for t in invented(rng, 900)]
    model = op04_toxicity.train(rows)
    for w in told:
        assert all(model.figure(with_words(rng, t, [form.format(w)])) > 0 for t in invented(rng, 100))
    assert sum(model.figure(t) == 0 for t in invented(rng, 100)) >= 95


def plain_toxicity(model, text):
    """The score by two compressors made here, every word compressed anew."""
    import zstandard

    def size(content, x):
        log = max(14, (len(content) + 1024).bit_length())
        how = zstandard.ZstdCompressionParameters(window_log=log, hash_log=log, chain_log=log + 1, write_content_size=0, write_checksum=0, write_dict_id=0, **op04_toxicity._SEARCH)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        return len(zstandard.ZstdCompressor(compression_params=how, dict_data=d).compress(x))

    saved = n = 0
    marks = "".join(c if c.isalnum() or ord(c) >= 128 else " " for c in (text or "").lower())
    for w in re.split("[ \t\n\x0b\x0c\r]+", marks):
        if w:
            b = w.encode()
            head = bytes(c - 32 if 97 <= c <= 122 else 128 + (c - 64) % 128 if c >= 128 else c for c in b[:4])
            window = b" " + head + b[4:] + b" " + model.common
            saved += max(0, size(model.ordinary, window) - size(model.toxic, window) - 1)
            n += 1
    x = saved / (1 + n / 500) ** 0.5
    share = max(s for a, s in zip(model.starts, model.shares, strict=True) if a <= x)
    return 0.999 * share + 0.001 * x / (x + 10)


def test_toxicity_scores_by_plain_code():
    rng = random.Random(5)
    told = ["clown", "scum", "moron", "idiot"]
    rows = [(with_words(rng, t, rng.sample(told, 2)), 1) for t in invented(rng, 200)] + [(t, 0) for t in invented(rng, 900)]
    model = op04_toxicity.train(rows)
    for t in ["", None, "Scum! the idiot, Moron's", "é" * 30, *(t for t, _ in rows[190:210])]:
        assert model.score(t) == pytest.approx(plain_toxicity(model, t), abs=1e-12)


def test_toxicity_held_out_by_language(spark):
    """On the held-out labels of sf0.1: stems of four languages, and single words."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = op04_toxicity.fit(docs, labels)
    rows = docs.join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 3 = 1").select("text", "lang", "toxic").collect()
    seen = {}
    for r in rows:
        seen.setdefault((r.lang, r.toxic), []).append(model.score(r.text) >= 0.7)
    share = lambda y: np.mean([x for (_, k), xs in seen.items() if k == y for x in xs])
    assert share(1) >= 0.8 and share(0) <= 0.01
    for lang in ("en", "fr", "de", "es"):
        assert np.mean(seen[lang, 1]) >= 0.65 and np.mean(seen[lang, 0]) <= 0.02


def plain_ftrl(rows, epochs=3, alpha=0.3, beta=1.0, l1=1e-3, l2=1e-3):
    """FTRL-proximal a weight at a time, in dictionaries."""
    z, n = {}, {}
    of = [sum(y == k for *_, y in rows) for k in (0, 1)]

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for i, c, y in rows:
            x = {int(a): op08_quality.SCALE * b / c.sum() for a, b in zip(i, c, strict=True)} | {"bias": 1.0}
            w = {a: weight(a) for a in x}
            p = 1 / (1 + math.exp(-sum(w[a] * x[a] for a in x)))
            for a, v in x.items():
                g = (p - y) * v * len(rows) / (2 * of[y])
                sigma = (math.sqrt(n.get(a, 0.0) + g * g) - math.sqrt(n.get(a, 0.0))) / alpha
                z[a] = z.get(a, 0.0) + g - sigma * w[a]
                n[a] = n.get(a, 0.0) + g * g
    return {a: weight(a) for a in z}


def test_ftrl_by_plain_code():
    rng = random.Random(3)
    texts = [(t + (" spam%%%" * 3 if k % 4 == 0 else ""), int(k % 4 != 0)) for k, t in enumerate(invented(rng, 60))]
    rows = [(*np.unique(op08_quality.ngrams(t).astype(np.int64), return_counts=True), y) for t, y in texts]
    model, want = op08_quality.train(rows), plain_ftrl(rows)
    assert model.bias == pytest.approx(want.pop("bias"))
    assert {i: float(model.weights[i]) for i in want} == pytest.approx(want, rel=1e-4, abs=1e-6)
    assert np.count_nonzero(model.weights) == sum(w != 0 for w in want.values())
    for t, _ in texts[:20]:
        grams = op08_quality.ngrams(t)
        dot = sum(float(model.weights[g]) for g in grams) / len(grams)
        assert model.score(t) == pytest.approx(1 / (1 + math.exp(-(op08_quality.SCALE * dot + model.bias))), rel=1e-6)


def test_training_samples_are_bounded(spark):
    """By rows and by code points, whatever the texts' lengths, and rows that are alike count once."""
    from graphloom.llm.common import bounded_sample

    rows = [(k, "x" * (k % 50)) for k in range(200)] + [(500, "y" * 10_000)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few = bounded_sample(df, 20, 10**6).collect()
    assert len(few) == 20 and [r.doc_id for r in few] == [r.doc_id for r in bounded_sample(df.orderBy(F.desc("doc_id")), 20, 10**6).collect()]
    short = bounded_sample(df, 1000, 3000).collect()
    assert 2000 < sum(len(r.text) for r in short) <= 3000 and all(len(r.text) < 50 for r in short)
    assert bounded_sample(df.limit(0), 5, 5).count() == 0
    assert len(bounded_sample(df, 1000, 10**6).collect()) == 201


@pytest.mark.parametrize("common", [4, 12, 64, 200])
def test_similar_texts_at_the_similarity(docs_of, common):
    """All pairs at a similarity of 0.8 exactly, one text with words appended, are linked."""
    rng = random.Random(common)
    texts = []
    for k in range(150):
        words = [f"w{k}x{rng.randrange(10**6)}" for _ in range(common + 4 + common // 4)]
        texts += [" ".join(words[: common + 4]), " ".join(words)]
    assert all(jaccard(a, b) == 0.8 for a, b in zip(texts[::2], texts[1::2], strict=True))
    comp = {r.doc_id: r.component_id for r in op03_simhash.similar_texts(docs_of(*enumerate(texts))).collect()}
    assert [comp[2 * k + 1] for k in range(150)] == [2 * k for k in range(150)]


def test_dense_groups_link_alike(monkeypatch):
    """Node pairs that are one component already are left out: the components stay those of all pairs, and few pairs are compared."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    f = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64)) for b in base]))
    rule = op03_simhash.Rule(most=4)
    near = lambda i: np.bitwise_count(f ^ f[i]) <= 4
    want = np.arange(len(f))
    for i in range(len(f)):
        hit = np.unique(want[near(i)])
        want[np.isin(want, hit)] = hit.min()
    compared = []
    plain = op03_simhash._Labels.link
    monkeypatch.setattr(op03_simhash._Labels, "link", lambda self, p, q: (compared.append(len(p)), plain(self, p, q)))
    got = op03_simhash.trie_links(f, 0, rule)
    assert got.tolist() == want.tolist()
    assert sum(compared) < len(f) ** 2 / 8


def test_set_links_are_all_pairs_links():
    """With dense groups, loose ones, empty sets and outliers, whichever sets are compared with all first."""
    rng = random.Random(17)
    sets = []
    for size, n, drop in ((50, 40, 0.03), (80, 10, 0.12), (30, 1, 0), (0, 2, 0), (200, 25, 0.06)):
        base = [rng.randrange(10**9) for _ in range(size)]
        sets += [np.unique([x if rng.random() > drop else rng.randrange(10**9) for x in base]).astype(np.int64) for _ in range(n)]
    rng.shuffle(sets)
    alike = lambda a, b: len(a) + len(b) > 0 and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    want = plain_components(len(sets), lambda i, j: alike(sets[i], sets[j]))
    for pivots in (0, 1, 16):
        assert op03_simhash.set_links(sets, 0.8, pivots).tolist() == want


def test_only_small_sides_are_hashed(spark, odd_docs, monkeypatch):
    """By their size on disk; results are the same either way."""
    from graphloom.llm import common

    side = common.Written(odd_docs, "side")
    hinted = lambda: "shuffle_hash" in common.hashed(side)._jdf.queryExecution().logical().toString()
    assert side.size() > 0 and hinted()
    monkeypatch.setattr(common, "HASHED", 1)
    assert not hinted()
    got = op02_lines.dedup_lines(odd_docs)
    assert collected(got.select("doc_id", "text", "n_lines", "n_dropped")) == plain_lines([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert sorted((r.doc_id for r in op03_simhash.one_of_each(odd_docs).collect()), key=str) == [1, 4, 5, 7, 8]
