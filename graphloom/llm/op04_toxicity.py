"""Toxicity by compression distance: windows are compressed with a toxic and an ordinary zstandard dictionary.

zstandard's trainer makes both. The ordinary one is trained on windows of ordinary texts, the toxic one begins with the
same content and ends in what the trainer makes of windows of toxic texts: those at runs of bytes that toxic documents
have oftener than chance. The ordinary one ends, as long, in the windows of ordinary text that are most like these.
So ordinary words compress alike, and a window like those of toxic texts gets shorter with the toxic dictionary.

Every word of a text is a window (a long one several), and all are compared, whatever they hold; words that come again
are not compressed again. What windows save beyond a byte adds up, in proportion to what chance saves in a text of
that length, and isotonic regression calibrates the figure's thresholds. Training reads a bounded sample of labelled
documents; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import held_out, keep_columns, slices, table
from graphloom.llm.op03_simhash import shingle_hashes
from graphloom.llm.op08_quality import labelled

MADE = ["held_out", "score", "predicted"]
#: Labelled documents that are learnt from, at most, and the code points of all of them. Scoring has no such bounds.
TRAIN_ROWS, TRAIN_CHARS = 4000, 16_000_000
#: Bytes of a long word's windows and by how many they overlap, and the first bytes of a word that are marked as such.
LONG, OVERLAP, FIRST = 64, 16, 4
#: Lengths of the runs of bytes that are tested.
RUNS = (4, 6, 8)
#: A binary search of all that is known finds the longest match of a window, so equal windows cost the same in both.
_SEARCH = {"search_log": 6, "min_match": 4, "target_length": 48, "strategy": zstandard.STRATEGY_BTLAZY2}
#: Marks and control characters of ASCII count as spaces.
_SPACES = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
#: The alphabet in which words begin: a stem at the beginning of a word is other bytes than inside of one.
_BEGIN = bytes(c - 32 if 97 <= c <= 122 else 128 + (c - 64) % 128 if c >= 128 else c for c in range(256))
#: Odd factors, each of which orders hashes anew.
_TURNS = np.random.default_rng(4).integers(0, 1 << 63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _plain(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACES)


def windows_of(word: bytes) -> list[bytes]:
    """A word with its beginning marked; a long one in overlapping parts."""
    word = word[:FIRST].translate(_BEGIN) + word[FIRST:]
    return [word] if len(word) <= LONG else [word[i : i + LONG] for i in range(0, len(word) - OVERLAP, LONG - OVERLAP)]


def words(text: str | None) -> list[bytes]:
    """The windows of a text's words, in order."""
    return [x for w in _plain(text).split() for x in windows_of(w)]


@functools.lru_cache(maxsize=4)
def _compressors(toxic: bytes, ordinary: bytes):
    made, log = [], max(14, (len(toxic) + 1024).bit_length())  # tables that hold all of a dictionary
    for content in (toxic, ordinary):
        how = zstandard.ZstdCompressionParameters(window_log=log, hash_log=log, chain_log=log + 1, write_content_size=0, write_checksum=0, write_dict_id=0, **_SEARCH)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        made.append(zstandard.ZstdCompressor(compression_params=how, dict_data=d).compress)
    return made


class _Saved(dict):
    """Bytes beyond one that the toxic dictionary saves of each of a word's windows, kept for words that come again; emptied when full, so memory is bounded."""

    def __init__(self, toxic: bytes, ordinary: bytes, common: bytes):
        self.t, self.o = _compressors(toxic, ordinary)
        self.common = common

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        each = [b" " + x + b" " + self.common for x in windows_of(word)]  # so much that is known makes zstandard compress, not store, what goes before
        found = sum(max(0, len(self.o(x)) - len(self.t(x)) - 1) for x in each)
        if len(word) <= LONG:
            self[word] = found
        return found


@functools.lru_cache(maxsize=4)
def _saved(toxic: bytes, ordinary: bytes, common: bytes) -> _Saved:
    return _Saved(toxic, ordinary, common)


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    #: Bytes that both dictionaries have at their ends.
    common: bytes = b""
    #: Figures from which each probability of label 1 holds, and those, both ascending.
    starts: tuple[float, ...] = (-math.inf,)
    shares: tuple[float, ...] = (0.5,)

    def figure(self, text: str | None) -> float:
        """What windows save beyond a byte, in all, over what grows like the chance savings of a text of so many windows."""
        if self.toxic == self.ordinary:
            return 0.0
        found = _plain(text).split()
        saved = sum(map(_saved(self.toxic, self.ordinary, self.common).__getitem__, found))
        many = len(found)
        if found and max(map(len, found)) > LONG:
            many = sum(1 if len(w) <= LONG else len(windows_of(w)) for w in found)
        return saved / math.sqrt(1 + many / 500)

    def score(self, text: str | None) -> float:
        """The share of label 1 at the text's figure; a thousandth of it orders texts of the same share."""
        x = self.figure(text)
        return 0.999 * self.shares[bisect.bisect_right(self.starts, x) - 1] + 0.001 * x / (x + 10)


def calibrated(figures: list[float], labels: list[int]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Isotonic regression: the ascending steps of the share of label 1 that fit best, each held to half a text of either label."""
    blocks: list[list[float]] = []  # start, label 1, texts
    for x, y in sorted(zip(figures, labels, strict=True)):
        if blocks and blocks[-1][0] == x:
            blocks[-1][1] += y
            blocks[-1][2] += 1
        else:
            blocks.append([x, y, 1])
    pooled: list[list[float]] = []
    for b in blocks:
        pooled.append(b)
        while len(pooled) > 1 and pooled[-2][1] * pooled[-1][2] >= pooled[-1][1] * pooled[-2][2]:
            _, k, n = pooled.pop()
            pooled[-1][1] += k
            pooled[-1][2] += n
    if not pooled:
        return (-math.inf,), (0.5,)
    shares = np.maximum.accumulate([(k + 0.5) / (n + 1) for _, k, n in pooled])
    return (-math.inf, *[b[0] for b in pooled[1:]]), tuple(float(v) for v in shares)


def _distinct(texts: list[str]) -> list[bytes]:
    """The words of each group of copies and near copies, which is one document: half of the smallest hashes of three-word shingles, or more, are the same."""
    firsts, groups = np.empty((len(texts), len(_TURNS)), np.uint64), []
    for t in texts:
        if len(h := np.unique(shingle_hashes(t, 3))):
            least = np.array([(h * x).min() for x in _TURNS])
            same = np.flatnonzero((firsts[: len(groups)] == least).sum(axis=1) * 2 >= len(_TURNS))
            found = b" ".join(words(t)) + b" "
            if len(same):
                groups[same[0]].append(found)
            else:
                firsts[len(groups)] = least
                groups.append([found])
    return [b" " + b"".join(g) for g in groups]


def _tail(k: int, n: int, p: float) -> float:
    """The chance of k or more of n at p each."""
    of = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    total = 0.0
    for i in range(k, n + 1):
        total += (x := of(i))
        if i > n * p and x < total * 1e-9:
            break
    return total


def _grams(text: bytes, n: int) -> np.ndarray:
    """The distinct runs of n bytes (8 at most) that have no space inside, as numbers."""
    b = np.frombuffer(text, np.uint8)
    if len(b) < n:
        return np.empty(0, np.uint64)
    found, inside = np.zeros(len(b) - n + 1, np.uint64), np.ones(len(b) - n + 1, bool)
    for k in range(n):
        part = b[k : len(b) - n + 1 + k]
        found = found << np.uint64(8) | part
        if 0 < k < n - 1:
            inside &= part != 32
    return np.unique(found[inside])


def _having(texts: list[bytes], n: int, among: np.ndarray) -> np.ndarray:
    """How many texts have each of the runs."""
    count = np.zeros(len(among), np.int64)
    for t in texts:
        g = _grams(t, n)
        at = np.minimum(np.searchsorted(among, g), len(among) - 1)
        count[at[among[at] == g]] += 1
    return count


def _places(text: bytes, run: bytes) -> list[int]:
    found, at = [], text.find(run)
    while at >= 0:
        found.append(at)
        at = text.find(run, at + 1)
    return found


def telling_runs(toxic: list[bytes], ordinary: list[bytes], false: float = 0.01) -> list[bytes]:
    """Runs of bytes within words that toxic documents have oftener than chance, the most telling first: as many as there are.

    Chance is the exact binomial of a run's documents falling in either class; of the runs found, a share of `false` is
    expected to be there by chance (Benjamini and Hochberg). A run that overlaps more telling ones counts
    only where it stands apart from them.
    """
    if not toxic or not ordinary:
        return []
    p = len(toxic) / (len(toxic) + len(ordinary))
    tested: list[tuple[float, int, bytes, int]] = []  # chance, longer first, run, ordinary documents
    for n in RUNS:
        each = [g for g in (_grams(t, n) for t in toxic) if len(g)]
        if not each:
            continue
        among, k = np.unique(np.concatenate(each), return_counts=True)
        o = _having(ordinary, n, among)
        pairs, which = np.unique(np.stack([k, o]), axis=1, return_inverse=True)
        chance = np.array([_tail(int(a), int(a + b), p) for a, b in pairs.T])[which.ravel()]
        tested += [(c, -n, int(g).to_bytes(n, "big"), int(b)) for c, g, b in zip(chance.tolist(), among.tolist(), o.tolist(), strict=True)]
    tested.sort()
    last = max((i for i, t in enumerate(tested, 1) if t[0] * len(tested) <= false * i), default=0)
    whole = b"\n".join(toxic)
    document = np.cumsum(np.frombuffer(whole, np.uint8) == 10)
    covered, kept = np.zeros(len(whole), bool), []
    for *_, run, others in tested[:last]:
        at = _places(whole, run)
        free = [i for i in at if not covered[i : i + len(run)].any()]
        k = len({int(document[i]) for i in free})
        if k and (len(free) == len(at) or _tail(k, k + others, p) * len(tested) <= false * last):
            kept.append(run)
            for i in free:
                covered[i : i + len(run)] = True
    return kept


def _trained(samples: list[bytes], size: int, k: int, d: int = 8) -> bytes:
    """The content of a dictionary that zstandard trains on samples; few samples that can't train one are their own content."""
    try:
        made = zstandard.train_dictionary(size, [s.ljust(d) for s in samples], k=k, d=d, split_point=1.0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]
    tables = b"".join(x.to_bytes(4, "little") for x in (1, 4, 8))  # the repeated offsets, with which a dictionary's tables end
    return made[made.find(tables) + len(tables) :]


def _toxic_windows(toxic: list[bytes], runs: list[bytes], each: int = 64) -> list[bytes]:
    """Windows of toxic texts from a word's beginning to the end of a run in it, as many for each run, so that none crowds out another."""
    whole, found = b"".join(toxic), []
    for run in runs:
        own = sorted(whole[whole.rfind(b" ", 0, at + 1) : at + len(run)] for at in _places(whole, run))
        found += [own[i * len(own) // each] for i in range(each)]
    return found


def _alike(content: bytes, known: bytes) -> list[bytes]:
    """Words of ordinary texts (`known`: all of them) that have the longest pieces that those texts share with a content, from each of its bytes on."""
    near = {}
    for i in range(len(content)):
        at, j = 0, i
        while j < len(content) and (found := known.find(content[i : j + 1], at)) >= 0:
            at, j = found, j + 1
        if j - i > 2 and content[i:j].strip():
            near |= dict.fromkeys(known[known.rfind(b" ", 0, at + 1) : known.find(b" ", at + j - i - 1)].split())
    return list(near)


def train(rows: list[tuple[str, int]], size: int = 32768) -> Model:
    """From (text, label). Without telling runs in toxic texts, or with one label only, every text scores the share of label 1 (0.5 without rows)."""
    toxic, ordinary = (_distinct([t for t, y in rows if y == k]) for k in (1, 0))
    runs = telling_runs(toxic, ordinary)
    if runs:
        # what tells toxic documents is not ordinary, though chance or a wrong label puts it into an ordinary document too
        telling = re.compile(b"|".join(map(re.escape, runs)))
        every = [w for t in ordinary for w in _windows(t) if not telling.search(w)]
        base = _trained(every[:: max(1, len(every) // 60_000)], size, 64)
        own = _trained(_toxic_windows(toxic, runs), 32 * len(runs) + 256, 16)
        known = b" " + b" ".join(sorted({w for t in ordinary for w in t.split() if not telling.search(b" " + w + b" ")})) + b" "
        tail, like = own + b" ", b" " + b" ".join(_alike(own, known)) + b" "
        long, common = max(len(tail), len(like)), base[:48]
        end = common + b" " * 32  # the last bytes of a dictionary are not searched
        model = Model(base + tail.rjust(long) + end, base + like.rjust(long) + end, common)
    else:
        model = Model(b"", b"")
    model.starts, model.shares = calibrated([model.figure(t) for t, _ in rows], [y for _, y in rows])
    return model


def _windows(text: bytes, least: int = 24) -> list[bytes]:
    """A text of words cut to windows of whole words, so many bytes or a little more."""
    found, at = [], 0
    while at < len(text) - 1:
        end = text.find(b" ", at + least)
        end = len(text) - 1 if end < 0 else end
        found.append(text[at : end + 1])
        at = end
    return found


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, chars: int = TRAIN_CHARS, label: str = "toxic") -> Model:
    """Trains on labelled documents outside the held-out fold, in the order of a hash: at most `most` rows and `chars` code points, whatever their lengths."""
    some = labelled(docs, labels, label, most, chars).toArrow()
    return train(list(zip(some["text"].to_pylist(), some["y"].to_pylist(), strict=True)))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs with held_out, score, predicted (1 from `threshold` on).

    Only the whole text counts, in lower case. Null and empty texts have no windows and get the score
    of a text without gain; repeated rows score alike. A null doc_id is not held out. Columns of the
    names made are replaced.
    """
    base = keep_columns(docs, MADE)
    schema = base.withColumn("score", F.lit(0.0)).schema

    def run(batches):
        for b in slices(batches):
            found = pa.array([model.score(t) for t in b.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, "score"])

    scored = base.mapInArrow(run, schema)
    return scored.select(*base.columns, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", *MADE)
