"""Secret scan: patterns, and a linear-chain conditional random field that adds spans to theirs.

The CRF reads tokens (runs of small letters, capitals or digits, and single marks), so a secret is many of them, and tags
each as begin, inside or outside of a secret from its shape, that of the chunk of characters it stands in, the words and marks
around it and figures of the whole text. Every token of a text is read and is in its one chain. Texts are laid out one after
another, so that features are made for all their tokens at once in numpy; a token at which every path through begin or inside
gets better by going outside is outside on the best path, which falls into the paths between such tokens, and these are exact.
The CRF is trained here on windows of a bounded sample with the patterns' matches as labels, each also without its key word and
with other values, so that shape and neighbours must tell it. The scan itself is one pass without a shuffle.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_sample, keep_columns, slices, table

MADE = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf", "n_new"]
KINDS = ("assign", "access", "hex", "crf")
# fixed values: the contract's patterns
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_CHUNK = re.compile(r"[A-Za-z0-9+/_.=-]+")
_ODD = re.compile(r"[0-9]|[a-z][A-Z]")
_KEY = re.compile("|".join(_HINTS), re.IGNORECASE | re.ASCII)
_TOKEN = re.compile(r"\d+|[A-Z]+|[^\W\d_A-Z]+|[^\w\s]|_+")
_BLANK = re.compile(r"\s")
#: Characters of a chunk (a run of those that secrets are written in) that has features of its own, at least; and between a chunk or token and the words and tokens before and after that it sees, at most.
LEAST, BEFORE, AFTER = 6, 48, 32
#: Features of a token: so many hashes of so many bits.
WIDTH, BITS, OWN, AROUND = 24, 16, 7, 12
#: Documents of each kind (with a key word, any) that the model learns from, at most, the code points of each kind, and tokens of a chain, which is cut for that.
TRAIN_ROWS, TRAIN_CHARS, TRAIN_TOKENS = 1500, 8_000_000, 256
#: Tokens around a candidate that it learns from; windows of the rest of a text hold PLAIN tokens, one of EACH is learnt from. Characters from a key word to a candidate, at most.
NEAR, PLAIN, EACH, REACH = 12, 32, 32, 24
#: Code points that are laid out together (a longer text is cut at white space); and those that a token's features may hang on, before or after its chunk: no more than a word's first or last 17 that stands as far away as it may.
LAID, SIGHT = 1 << 19, BEFORE + 17


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, by start, then kind. A match shorter than its kind allows is dropped, and what it covers stays used.

    For access and hex a run's first match takes all that could follow, so the least length can stand in the pattern.
    """
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


_SPACE, _DIGIT, _UPPER, _LETTER, _MARK, _LINE, _UNKNOWN = 0, 1, 2, 3, 4, 5, 255


def _class(c: str) -> int:
    """As in _TOKEN: a token is a run of one class, or a mark."""
    return _SPACE if c.isspace() else _DIGIT if c.isdecimal() else _UPPER if "A" <= c <= "Z" else _LETTER if c.isalnum() else _LINE if c == "_" else _MARK


#: Classes of code points (those beyond ASCII are filled in as they come); of ASCII, what a chunk's character is (a bit each, none if it is in no chunk), which one of 64 it is, and its small letter.
_CLASSES = np.full(0x110000, _UNKNOWN, np.uint8)
_CLASSES[:128] = [_class(chr(c)) for c in range(128)]
_MARKS = "+/_.=-"
_ALNUM = string.digits + string.ascii_letters
_SETS, _ONES, _LOW = np.zeros(129, np.uint16), np.zeros(129, np.uint64), np.zeros(128, np.uint8)
_NOT_HEX = 1 << 9
for _c in range(128):
    _x = chr(_c)
    _LOW[_c] = ord(_x.lower())
    if _x in _ALNUM or _x in _MARKS:
        _SETS[_c] = (1 << "9Aa".index("9" if _x.isdigit() else "A" if _x.isupper() else "a") if _x in _ALNUM else 8 << _MARKS.index(_x)) | (0 if _x in string.hexdigits else _NOT_HEX)
    if _x in _ALNUM:
        _ONES[_c] = 1 << _ALNUM.index(_x)
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mixed(slot: int, values) -> np.ndarray:
    """Hashes of BITS bits of a slot's values."""
    h = (np.asarray(values).astype(np.uint64) + np.uint64(slot * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


class _Laid:
    """Texts one after another with spaces between, before and after, so many that no text sees another: their tokens in order (first, last: start and end; of: the text's number), chunks, and hashed features of both."""

    def __init__(self, texts: list[str]):
        gap = " " * (max(BEFORE, AFTER) + 2)
        self.at = np.cumsum([len(gap), *[len(t) + len(gap) for t in texts]])[:-1].astype(np.int32)
        code = np.frombuffer((gap + gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _CLASSES[code]
        if (kind == _UNKNOWN).any():
            for c in np.unique(code[kind == _UNKNOWN]).tolist():
                _CLASSES[c] = _class(chr(c))
            kind = _CLASSES[code]
        self.code, self.kind = code, kind
        # the last bytes are never read as a word's; other letters than ASCII's are folded to a byte
        low = np.where(code < 128, _LOW[code & 127], (code ^ code >> 7) & 127 | 128).astype(np.uint8)
        self.eight = np.ndarray((len(low) - 8,), "<u8", low.data, 0, (1,))
        change, single, full = kind[1:] != kind[:-1], kind == _MARK, kind != _SPACE
        self.first = (np.flatnonzero(full[1:] & (change | single[1:])) + 1).astype(np.int32)
        self.last = (np.flatnonzero(full[:-1] & (change | single[:-1])) + 1).astype(np.int32)
        self.of = (np.searchsorted(self.at, self.first, "right") - 1).astype(np.int32)
        letter = (kind == _UPPER) | (kind == _LETTER)
        edges = np.flatnonzero(letter[1:] != letter[:-1]).astype(np.int32) + 1
        self.words = edges[::2], edges[1::2]
        self.sets = _SETS[np.minimum(code, 128)]
        edges = np.flatnonzero((self.sets[1:] != 0) != (self.sets[:-1] != 0)).astype(np.int32) + 1
        a, b = edges[::2], edges[1::2]
        # the chunk that a token's first character is in; tokens in none are one of their own
        self.begin, self.end, self.chunk = self.first, self.last, np.full(len(self.first), -1, np.int32)
        if len(a):
            k = np.maximum(np.searchsorted(a, self.first, "right") - 1, 0)
            inside = (a[k] <= self.first) & (self.first < b[k])
            self.begin, self.end = np.where(inside, a[k], self.first), np.where(inside, b[k], self.last)
            long = b - a >= LEAST
            self.chunk = np.where(inside & long[k], np.cumsum(long)[k] - 1, -1).astype(np.int32)
            a, b = a[long], b[long]
        self.chunks = a, b

    def word(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of what stands from a to b in small letters; those of more than 16 characters are alike."""
        n = np.minimum(b - a, 17)
        h = (self.eight[a] & _FIRST[np.minimum(n, 8)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= (self.eight[a + 8] & _FIRST[np.clip(n - 8, 0, 8)]) * np.uint64(0xC2B2AE3D27D4EB4F) + n.astype(np.uint64)
        return np.where(n > 16, np.uint64(17), h)

    def kinds(self, some) -> np.ndarray:
        """What tokens are: a class, or which mark."""
        k = self.kind[self.first[some]].astype(np.int64)
        return np.where(k == _MARK, 16 + self.code[self.first[some]], k)

    def own(self, at: int, to: int) -> list[np.ndarray]:
        """Features of tokens at..to: of themselves, their place in their chunk and their neighbours; and their text, in a shorter chunk."""
        lo, hi = max(0, at - 1), min(len(self.first), to + 1)
        first, last, kind = self.first[lo:hi], self.last[lo:hi], self.kinds(slice(lo, hi))
        size = kind * 8 + np.minimum(last - first, 6)
        space = first[1:] - last[:-1]
        before, after = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
        before[1:] = np.where(space <= BEFORE, size[:-1] * 2 + (space > 0), 0)
        after[:-1] = np.where(space <= AFTER, size[1:], 0)
        cut = slice(at - lo, at - lo + to - at)
        kind, size, before, after, first, last = (x[cut] for x in (kind, size, before, after, first, last))
        begin, end = self.begin[at:to], self.end[at:to]
        place = (first == begin) * 2 + (last >= end)
        text = np.where(self.chunk[at:to] < 0, _mixed(6, self.word(first, last)), 1 << BITS)
        return [_mixed(0, np.zeros(to - at)), _mixed(1, size), _mixed(2, kind * 4 + place), _mixed(3, before), _mixed(4, after << 22 | kind), _mixed(5, np.minimum(end - begin, 64) // 8 * 4 + place), text]

    def around(self) -> list[np.ndarray]:
        """Features of the chunks: their shape, and the words and marks around them. One more row, the last, is of tokens without a chunk."""
        a, b = self.chunks
        if not len(a):
            return [np.full(1, 1 << BITS)] * AROUND
        n, pairs = b - a, np.stack([a, b], 1).ravel()
        digits = np.add.reduceat(self.kind == _DIGIT, pairs, dtype=np.int32)[::2]
        sets = np.bitwise_or.reduceat(self.sets, pairs)[::2]
        distinct = np.bitwise_count(np.bitwise_or.reduceat(_ONES[np.minimum(self.code, 128)], pairs)[::2]).astype(np.int64) + np.bitwise_count(sets & (_NOT_HEX - 8))
        inside = np.flatnonzero(self.chunk >= 0)
        runs = np.bincount(self.chunk[inside], minlength=len(a))
        start = np.cumsum(runs) - runs
        shape = np.zeros(len(a), np.int64)
        for j in range(4):
            has = j < runs
            shape = shape << 8
            shape[has] |= self.kinds(inside[start[has] + j])
        begins, ends = self.words
        prior, nexts = np.searchsorted(ends, a, "right") - 1, np.searchsorted(begins, b, "left")

        def word(k, far):
            out = np.zeros(len(a), np.uint64)
            ok = np.flatnonzero((k >= 0) & (k < len(begins)))
            ok = ok[far(k[ok], ok)]
            out[ok] = self.word(begins[k[ok]], ends[k[ok]])
            return out

        back, ahead = lambda k, at: a[at] - ends[k] <= BEFORE, lambda k, at: begins[k] - b[at] <= AFTER
        mark = np.zeros(len(a), np.uint64)
        for j in range(4, 0, -1):
            c = self.code[a - j].astype(np.uint64)
            k = self.kind[a - j]
            mark = np.where((k == _SPACE) | (k == _MARK) | (k == _LINE), mark << np.uint64(16) ^ c, mark)
        long = n >= 16
        found = [
            _mixed(7, np.minimum(n, 64) // 4), _mixed(8, 8 * digits.astype(np.int64) // n), _mixed(9, 8 * runs // n), _mixed(10, sets & (_NOT_HEX - 1)), _mixed(11, shape),
            _mixed(12, (sets < _NOT_HEX) * 2 + long), _mixed(13, np.minimum(distinct, 24) // 3 * 2 + long),
            _mixed(14, word(prior, back)), _mixed(15, word(prior - 1, back)), _mixed(16, word(nexts, ahead)), _mixed(17, mark), _mixed(18, self.code[b]),
        ]
        return [np.append(x, np.int32(1 << BITS)) for x in found]

def _chains(text: str) -> list[np.ndarray]:
    """The chain of a text, if it has tokens: all of them (rows of start and end), in order."""
    laid = _Laid([text])
    return [np.stack([laid.first, laid.last], 1).astype(np.int64) - int(laid.at[0])] if len(laid.first) else []


def _file(text: str) -> list[str]:
    """What holds for the whole text: how much of it is assignments, and how it is written."""
    lines = text.count("\n") + 1
    return [f"f=:{min(4, 8 * text.count('=') // lines)}", f"f{{:{'{' in text}", f"f!:{min(3, 40 * text.count('!') // (len(text) + 1))}", f"fn:{min(4, len(text) // 2000)}"]


def _hashes(found: list[str]) -> list[int]:
    return [xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in found]


def _features(text: str, tokens: np.ndarray, file: list[int], block: int = 4096) -> Iterator[np.ndarray]:
    """Hashed features of a chain (tokens x WIDTH), a block at a time: of the token, of its chunk, of its neighbours and of the file. Places left over have the number 1 << BITS."""
    laid = _Laid([text])
    around = np.stack(laid.around(), 1)
    for at in range(0, len(tokens), block):
        to = min(len(tokens), at + block)
        out = np.full((to - at, WIDTH), 1 << BITS, dtype=np.int32)
        out[:, :OWN], out[:, OWN : OWN + AROUND], out[:, OWN + AROUND :][:, : len(file)] = np.stack(laid.own(at, to), 1), around[laid.chunk[at:to]], file
        yield out


O, B, I = 0, 1, 2  # noqa: E741
_NO = -1e9


@dataclass
class Crf:
    """Weights of features by tag (the last row is of places left over: zero), and of steps from tag to tag; a chain begins after and ends before outside."""

    state: np.ndarray
    step: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.state[features].sum(axis=-2)

    def sums(self, columns: list[np.ndarray]) -> np.ndarray:
        """Emissions, from features by columns."""
        out = self.state.take(columns[0], axis=0)
        for c in columns[1:]:
            out += self.state.take(c, axis=0)
        return out

    def outside(self, e: np.ndarray, after: float = 0.0) -> tuple[np.ndarray, float]:
        """Where the best path is outside for certain, whatever its tags before and after.

        Tags other than outside from a token on, up to the next outside, could all be outside instead; so where such a
        run loses wherever it ends, by the most that it can gain at each token, none is begun or gone on with. `after` is that
        most for runs from the token after these on, and the second result that for runs from the first.
        """
        s = self.step
        on = s[B:].max(axis=0) - s[O, O]
        most = np.maximum(e[:, B] + on[B], e[:, I] + on[I]) - e[:, O]
        ends = (s[:, B:] - s[:, O:B] - on[B:]).max() + s[B:, O].max() - s[O, O]
        total = np.cumsum(most)
        best = np.maximum(np.maximum.accumulate(total[::-1])[::-1], total[-1] + max(after, 0.0)) - (total - most)
        return best + ends < -1e-6, float(best[0])

    def viterbi(self, e: np.ndarray, block: int = 4096) -> np.ndarray:
        """The best tags of a chain with these emissions (of equal ones the smallest at each step)."""
        s = self.step.tolist()
        best, back = None, np.zeros((len(e), 3), np.int8)
        for at in range(0, len(e), block):
            for k, x in enumerate(e[at : at + block].tolist(), at):
                if best is None:
                    best = [s[O][t] + x[t] for t in (O, B, I)]
                    continue
                ways = [max((best[p] + s[p][t], -p) for p in (O, B, I)) for t in (O, B, I)]
                back[k] = [-w[1] for w in ways]
                best = [w[0] + x[t] for t, w in enumerate(ways)]
        tags = np.zeros(len(e), np.int8)
        tags[-1] = -max((best[t] + s[t][O], -t) for t in (O, B, I))[1]
        for k in range(len(e) - 1, 0, -1):
            tags[k - 1] = back[k, tags[k]]
        return tags

    def marginals(self, e: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For chains padded to a length (chains x tokens x 3, with n tokens each): probabilities of tags, zero where padded, and of steps summed over the chains with their ends (forward and backward sums)."""
        many, long = e.shape[:2]
        fwd, bwd = np.empty_like(e), np.empty_like(e)
        fwd[:, 0] = self.step[O] + e[:, 0]
        for k in range(1, long):
            fwd[:, k] = np.logaddexp.reduce(fwd[:, k - 1, :, None] + self.step, axis=1) + e[:, k]
        last = (n - 1)[:, None]
        for k in range(long - 1, -1, -1):
            further = np.logaddexp.reduce(self.step + (e[:, k + 1] + bwd[:, k + 1])[:, None, :], axis=2) if k + 1 < long else 0.0
            bwd[:, k] = np.where(k == last, self.step[:, O], further)
        z = np.logaddexp.reduce(fwd[:, 0] + bwd[:, 0], axis=1)
        inside = np.arange(long) < n[:, None]
        tags = np.where(inside[..., None], np.exp(np.minimum(fwd + bwd - z[:, None, None], 0)), 0)
        steps = np.zeros((3, 3))
        steps[O] += tags[:, 0].sum(axis=0)
        steps[:, O] += tags[np.arange(many), n - 1].sum(axis=0)
        if long > 1:
            each = fwd[:, :-1, :, None] + self.step + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]
            steps += np.where(inside[:, 1:, None, None], np.exp(np.minimum(each, 0)), 0).sum(axis=(0, 1))
        return tags, steps


def train(chains: list[tuple[np.ndarray, list[int]]], epochs: int = 12, rate: float = 0.2, decay: float = 1e-3, batch: int = 32) -> Crf:
    """Conditional likelihood by gradients with a step size for each weight, some chains at a time. Without chains, or without a secret in them, nothing is tagged."""
    state, step = np.zeros(((1 << BITS) + 1, 3)), np.zeros((3, 3))
    step[O, I] = _NO  # inside comes after begin or inside
    crf = Crf(state, step)
    if not any(t != O for _, tags in chains for t in tags):
        state[:-1, B:] = -1.0
        return crf
    seen, seen_step = np.full(state.shape, 1e-6), np.full((3, 3), 1e-6)
    chains = [(f[i : i + TRAIN_TOKENS], t[i : i + TRAIN_TOKENS]) for f, t in chains for i in range(0, len(t), TRAIN_TOKENS)]
    chains = [(f, [B if k == 0 and x == I else x for k, x in enumerate(t)]) for f, t in chains]
    order = sorted(range(len(chains)), key=lambda k: len(chains[k][1]))  # of like lengths, so that little is padded
    groups = [order[i : i + batch] for i in range(0, len(order), batch)]
    turn = np.random.default_rng(3)
    for _ in range(epochs):
        for g in turn.permutation(len(groups)):
            some = [chains[k] for k in groups[g]]
            n = np.array([len(t) for _, t in some])
            f = np.full((len(some), n.max(), WIDTH), 1 << BITS)
            want = np.zeros((len(some), n.max(), 3))
            was = np.zeros((3, 3))
            for k, (features, tags) in enumerate(some):
                f[k, : n[k]] = features
                want[k, np.arange(n[k]), tags] = 1
                np.add.at(was, ([O, *tags], [*tags, O]), 1)
            p, q = crf.marginals(crf.emissions(f), n)
            which, at = np.unique(f, return_inverse=True)
            grad = np.zeros((len(which), 3))
            np.add.at(grad, at.reshape(f.shape), (want - p)[:, :, None, :])
            grad -= decay * state[which]
            grad[which == 1 << BITS] = 0
            seen[which] += grad * grad
            state[which] += rate * grad / np.sqrt(seen[which])
            grad = was - q - decay * step
            grad[O, I] = 0
            seen_step += grad * grad
            step += rate * grad / np.sqrt(seen_step)
    return crf


def _candidates(text: str) -> list[tuple[int, int]]:
    """Chunks whose surroundings are all learnt from: with digits, with capitals inside, or after a key word."""
    found = [c.span() for c in _CHUNK.finditer(text) if c.end() - c.start() >= LEAST and _ODD.search(c[0])]
    for m in _KEY.finditer(text):
        found += [c.span() for c in _CHUNK.finditer(text, m.end(), min(len(text), m.end() + REACH)) if c.end() - c.start() >= LEAST]
    return found


def _tagged(text: str, values: list[tuple[int, int]], plain: bool = False) -> list[tuple[np.ndarray, list[int]]]:
    """Windows of a text with tags (the tokens of a value are begin, inside, inside...): around values and candidates, and with `plain` some of the rest."""
    out = []
    for tokens in _chains(text):
        use = np.zeros(len(tokens) + 1, np.int64)
        for a, b in _candidates(text) + values:
            at, to = np.searchsorted(tokens[:, 1], a, "right"), np.searchsorted(tokens[:, 0], b, "left")
            use[max(0, at - NEAR)] += 1
            use[min(len(tokens), to + NEAR)] -= 1
        use = np.cumsum(use[:-1]) > 0
        if plain:
            use |= np.arange(len(tokens)) // PLAIN % EACH == xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass")) % EACH
        tags = np.zeros(len(tokens), np.int64)
        for a, b in values:
            at, to = np.searchsorted(tokens[:, 1], a, "right"), np.searchsorted(tokens[:, 0], b, "left")
            tags[at:to] = I
            tags[at : at + 1][: to - at] = B
        at, parts = 0, []
        for f in _features(text, tokens, _hashes(_file(text))):
            parts.append(f[use[at : at + len(f)]])
            at += len(f)
        features, kept = np.concatenate(parts), np.flatnonzero(use)
        cuts = np.flatnonzero(np.diff(kept) > 1) + 1
        out += [(f, tags[k].tolist()) for f, k in zip(np.split(features, cuts), np.split(kept, cuts), strict=True) if len(k)]
    return out


#: Alphabets that secrets are written in besides those of the sample.
_ALPHABETS = ("0123456789ABCDEF", string.ascii_lowercase, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-")


def _rewritten(text: str, keyed: list[tuple[int, int, int]], keys: bool, value) -> tuple[str, list[tuple[int, int]]]:
    """A text with its matches (start, value's start and end) written anew: with their key words or without, and with value(old); and the places of the values."""
    parts, places, last, size = [], [], 0, 0
    for start, a, b in keyed:
        quote = text[a - 1 : a] if text[a - 1 : a] in ("'", '"') else ""
        new = value(text[a:b])
        before = text[last:a] if keys else text[last : max(start, last)] + quote
        parts += [before, new]
        places.append((size + len(before), size + len(before) + len(new)))
        size, last = places[-1][1], b
    return "".join([*parts, text[last:]]), places


def examples(text: str) -> list[tuple[np.ndarray, list[int]]]:
    """Chains of a text with tags by its pattern matches; and again without the key words, and with and without them for made-up values of other alphabets."""
    keyed = [(m.start(), m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    whole = [(a, b) for _, a, b in keyed] + [(a, b) for a, k, b in base_spans(text) if k]
    out = _tagged(text, sorted(v for v in set(whole) if not any(w != v and w[0] <= v[0] and v[1] <= w[1] for w in whole)), True)
    if keyed:
        turn = random.Random(xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass")))

        def other(_: str) -> str:
            alphabet = turn.choice(_ALPHABETS)
            return "".join(turn.choice(alphabet) for _ in range(turn.randrange(16, 65)))

        same = lambda old: old
        for keys, value in ((False, same), (True, other), (False, other), (False, other)):
            out += _tagged(*_rewritten(text, keyed, keys, value))
    return out


def fit(docs: DataFrame, most: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Crf:
    """Trains on at most 2 * most documents of 2 * chars code points: some with a key word of the patterns and some of all, the first by a hash."""
    some = docs.select("doc_id", "text")
    keyed = F.col("text").contains("token") | F.col("text").contains("secret") | F.col("text").contains("passw") | F.col("text").contains("key")
    texts = [r.text or "" for part in (some.where(keyed), some) for r in bounded_sample(part, most, chars).collect()]
    return train([c for t in dict.fromkeys(texts) for c in examples(t)])


def _pieces(texts: list[str], most: int) -> Iterator[list[tuple[int, int, int]]]:
    """All of the texts as (text's number, start, end), in order and in lists of about `most` code points."""
    some, size = [], 0
    for n, text in enumerate(texts):
        at = 0
        while at < len(text):
            cut = _BLANK.search(text, at + most) if len(text) - at > most else None
            to = cut.start() if cut else len(text)
            if some and size + to - at > most:
                yield some
                some, size = [], 0
            some.append((n, at, to))
            size += to - at
            at = to
    if some:
        yield some


def _open(texts: list[str], crf: Crf, most: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From the last on, the tokens that are not outside for certain (rows of their number among all tokens, their text's, start and end), and their emissions. Features are never all there at once, however long a text is."""
    file = crf.emissions(np.array([_hashes(_file(t)) for t in texts], np.int64).reshape(len(texts), -1))
    after, index = 0.0, 0
    for some in reversed(list(_pieces(texts, most))):
        laid = _Laid([texts[n][max(0, a - SIGHT) : b + SIGHT] for n, a, b in some])
        text, start, end = np.array(some, np.int32).T
        shift = np.maximum(0, start - SIGHT) - laid.at  # from places as laid out to those in the text
        around = crf.sums(laid.around())
        for at in reversed(range(0, len(laid.first), block)):
            of, first = laid.of[at : at + block], laid.first[at : at + block]
            to = at + len(of)
            use = np.flatnonzero((first + shift[of] >= start[of]) & (first + shift[of] < end[of]))
            if not len(use):
                continue
            of = of[use]
            e = (crf.sums(laid.own(at, to)) + around[laid.chunk[at:to]])[use] + file[text[of]]
            sure, after = crf.outside(e, after)
            k = np.flatnonzero(~sure)
            index -= len(use)
            of, use = of[k], use[k]
            yield np.stack([(k + index).astype(np.int32), text[of], first[use] + shift[of], laid.last[at:to][use] + shift[of]], 1), e[k]


def crf_spans_of(texts: list[str], crf: Crf, most: int = LAID, block: int = 1 << 15) -> list[list[tuple[int, int]]]:
    """(start, end) of what the CRF tags in each text: from a begin to the last inside after it."""
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    parts = list(_open(texts, crf, most, block))[::-1]
    if not parts:
        return found
    where, e = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    del parts
    # runs of such tokens: paths that come from outside and end there
    cuts = np.flatnonzero((np.diff(where[:, 0]) > 1) | (np.diff(where[:, 1]) > 0)) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(where)], strict=True):
        tags = crf.viterbi(e[i:j]) if j > i else []
        for k in np.flatnonzero(tags):
            _, n, a, b = where[i + k].tolist()
            if tags[k] == B:
                found[n].append((a, b))
            else:
                found[n][-1] = (found[n][-1][0], b)
    return found


def crf_spans(text: str, crf: Crf) -> list[tuple[int, int]]:
    return crf_spans_of([text], crf)[0]


def scan_all(texts: list[str], crf: Crf) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of all spans of each text, by start, then kind: the patterns' and the CRF's, which may cover the same text."""
    return [sorted(base_spans(t) + [(a, 3, b) for a, b in own]) for t, own in zip(texts, crf_spans_of(texts, crf), strict=True)]


def scan(text: str, crf: Crf) -> list[tuple[int, int, int]]:
    return scan_all([text], crf)[0]


def _new(spans: list[tuple[int, int, int]]) -> int:
    """How many spans of the CRF meet none of the patterns'."""
    count, far = 0, 0
    own = [s for s in spans if s[1] < 3]
    starts = [s[0] for s in own]
    reach = []
    for s in own:
        far = max(far, s[2])
        reach.append(far)
    for a, k, b in spans:
        if k == 3:
            at = bisect_left(starts, b)
            count += not (at and reach[at - 1] > a)
    return count


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, crf: Crf) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256, spans, n_crf, n_new.

    Spans are kind:start:end in code points, end exclusive, joined by commas by start, then kind as in
    KINDS. base_sha256 is of the pattern spans alone, spans has all: the CRF's (n_crf) are the values that it
    tags, of which n_new meet no pattern's span. Null and empty texts have none.
    Repeated rows are scanned alike. Columns of the names made are replaced.
    """
    base = keep_columns(docs, MADE)
    zero, none = F.lit(0).cast("long"), F.lit("")
    schema = base.select("*", *[zero.alias(c) for c in MADE[:3]], none.alias(MADE[3]), none.alias(MADE[4]), zero.alias(MADE[5]), zero.alias(MADE[6])).schema

    def run(batches):
        for b in slices(batches):
            rows = []
            for spans in scan_all([t or "" for t in b.column("text").to_pylist()], crf):
                own = [s for s in spans if s[1] < 3]
                n = [sum(s[1] == k for s in spans) for k in range(4)]
                rows.append((*n[:3], hashlib.sha256(_joined(own).encode()).hexdigest(), _joined(spans), n[3], _new(spans)))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[*b.schema.names, *MADE])

    return base.mapInArrow(run, schema)


def query(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_secrets(docs, fit(docs)).drop("text")
