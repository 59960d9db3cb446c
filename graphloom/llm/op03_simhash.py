"""SimHash near-dedup: fingerprints of word shingles, linked by a binary trie self-join.

Fingerprints that differ in at most k bits agree on one of k + 1 blocks of bits (pigeonhole), so the
join is dealt out by (block, its value), each fingerprint turned so that the block leads. In a task a
binary trie over the turned fingerprints is joined with itself from the nodes of whole blocks down: pairs of
nodes go down together, the bits in which they differ add up, and a pair over the budget is pruned.
A task gives the links of a spanning forest of its matches, not all pairs. Groups over GROUP_ROWS are
cut into salted chunks that meet pair by pair, so no group is one task and no link is lost. Components come
from rounds of joins that hook labels to the smallest in reach, written to the shared folder between rounds.

near_duplicates() links at 3 bits of one fingerprint. similar_texts() links at a Jaccard similarity of distinct
shingles: it takes several fingerprints, deals by shorter blocks of each, and counts bits over all, which
finds candidates, and joins texts of few shingles on shared ones, which finds all of theirs; within their
components the sets themselves then decide which texts are linked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Written, hashed, row_keys, slices, table, written

MADE = ["fingerprint", "component_id"]
SEED = 42
#: Rows of a chunk of a hot group, and rows that a task holds at a time besides.
GROUP_ROWS, CHUNK_ROWS = 16384, 65536
#: Texts of a chunk of a component whose sets are compared, and their hashes, about.
SET_ROWS, SET_HASHES = 1024, 1 << 22
#: Shingles up to which a text meets others by shared shingles, as few make fingerprints vary more.
FEW = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_TURNS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F)]


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words, in order, repeats included; the whole sequence if there are fewer words."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes.split() cuts at the white space of the contract
    if not found:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    h, last = xxhash.xxh64_intdigest, min(words, len(found)) - 1
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[last : last + n].tolist(), strict=True)], dtype=np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 of none."""
    if not len(hashes):
        return 0
    each = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(each[:, b], minlength=256) @ _BITS for b in range(8)])
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _more(hashes: np.ndarray, part: int) -> np.ndarray:
    """Other hashes of the same shingles, for a further fingerprint; part 0 are the hashes themselves."""
    if part:
        hashes = (hashes ^ (hashes >> np.uint64(29))) * _TURNS[(part - 1) % len(_TURNS)]
        hashes = (hashes ^ (hashes >> np.uint64(32))) * _TURNS[part % len(_TURNS)]
        hashes = hashes ^ (hashes >> np.uint64(31))
    return hashes


@dataclass(frozen=True)
class Rule:
    """What is a link: fingerprints, blocks of each that lead, bits that may differ in the fingerprint met in and in all, and the least ratio of sizes."""

    parts: int = 1
    blocks: int = 4
    most: int = 3
    total: int = 3
    ratio: float = 0.0

    @staticmethod
    def of_similarity(similarity: float, parts: int = 8, blocks: int = 6) -> Rule:
        """For a Jaccard similarity s of sets: bits differ with probability acos(2s / (1 + s)) / pi.

        total and most (bits of the fingerprint that the pair meets in) are that many and 5 standard deviations more.
        With 8 fingerprints and 6 blocks a pair at 0.8 meets in one of 48 blocks in all but 3 of 100,000 cases.
        What passes is compared by its sets, so a wide rule costs candidates only.
        """
        p = math.acos(2 * similarity / (1 + similarity)) / math.pi
        upto = lambda n, z: int(n * p + z * math.sqrt(n * p * (1 - p)))
        return Rule(parts, blocks, upto(64, 5.0), upto(64 * parts, 5.0), similarity - 1e-9)


def least_hashes(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """So many of the smallest of sorted distinct hashes that any set with the Jaccard similarity has one of them among its own; none of a text of more than FEW / similarity."""
    n = len(hashes)
    return hashes[: n - math.ceil(similarity * n - 1e-9) + 1 if 0 < n <= FEW / similarity + 1e-9 else 0]


def fingerprints(docs: DataFrame, words: int, parts: int = 1, distinct: bool = False, similarity: float | None = None) -> DataFrame:
    """doc_id, r1, r2 (row key), fps (array of `parts` longs: 64 bits each), n (shingles) of each row; with a similarity (of distinct shingles) also least (see least_hashes())."""

    def run(batches):
        for b in slices(batches):
            fps, sizes, least = [], [], []
            for t in b.column("text").to_pylist():
                h = shingle_hashes(t, words)
                h = np.unique(h) if distinct else h
                fps += [simhash(_more(h, k)) for k in range(parts)]
                sizes.append(len(h))
                least.append(least_hashes(h, similarity).view(np.int64) if similarity else None)
            flat = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * parts), flat)
            made = [b.column("doc_id"), b.column("r1"), b.column("r2"), lists, pa.array(sizes, pa.int64()), pa.array(least, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(made[: 6 if similarity else 5], names=["doc_id", "r1", "r2", "fps", "n", "least"][: 6 if similarity else 5])

    r1, r2 = row_keys(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), r1.alias("r1"), r2.alias("r2"), "text").mapInArrow(run, "doc_id long, r1 long, r2 long, fps array<long>, n long" + (", least array<long>" if similarity else ""))


class _Labels:
    """Components of what has been linked: the smallest position of each."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, p: np.ndarray, q: np.ndarray) -> None:
        while len(p):
            a, b = self.of[p], self.of[q]
            apart = a != b
            p, q, a, b = p[apart], q[apart], a[apart], b[apart]
            np.minimum.at(self.of, np.maximum(a, b), np.minimum(a, b))
            while (self.of[self.of] != self.of).any():
                self.of = self.of[self.of]

    def apart(self, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        """Which pairs of ranges of positions (a0..a1, b0..b1) are not one component yet."""
        change = np.concatenate([[0], np.cumsum(self.of[1:] != self.of[:-1])])
        return (self.of[a0] != self.of[b0]) | (change[a1 - 1] != change[a0]) | (change[b1 - 1] != change[b0])


def trie_links(turned: np.ndarray, lead: int, rule: Rule, words: np.ndarray | None = None, sizes: np.ndarray | None = None) -> np.ndarray:
    """For sorted turned fingerprints, the position of each one's component among links of those with the same `lead` first bits.

    A node of the trie is a range of the sorted array; its two children part at the next bit. The pairs
    of nodes of a level are arrays, so a level is one step: pairs split, differing bits add up, pairs
    over the budget go, as do pairs that are one component already, so a dense group costs little more than its rows. A pair of a few leaves is compared directly, over all fingerprints (`words`) and sizes if given.
    """
    n, leaf = len(turned), 32
    labels = _Labels(n)
    if n < 2:
        return labels.of
    head = turned >> np.uint64(64 - lead) if lead else np.zeros(n, np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    stops = np.append(starts[1:], n)
    for start, stop in zip(starts[stops - starts > 256], stops[stops - starts > 256], strict=True):
        for pivot in np.linspace(start, stop - 1, 8).astype(int):  # most of a dense group are near one of a few
            one = np.array([pivot]), np.array([pivot + 1])
            if labels.apart(*one, np.array([start]), np.array([stop]))[0]:
                _compare(turned, *one, np.array([start]), np.array([stop]), rule, labels, words, sizes)
    many = stops - starts > 1
    many[many] = labels.apart(starts[many], stops[many], starts[many], stops[many])
    a0, a1 = starts[many], stops[many]
    b0, b1, err = a0, a1, np.zeros(len(a0), np.int64)
    for bit in range(63 - lead, -2, -1):
        small = ((a1 - a0) <= leaf) & ((b1 - b0) <= leaf) if bit >= 0 else np.ones(len(a0), bool)
        _compare(turned, a0[small], a1[small], b0[small], b1[small], rule, labels, words, sizes)
        a0, a1, b0, b1, err = (v[~small] for v in (a0, a1, b0, b1, err))
        if not len(a0):
            break
        am, bm = _cut(turned, a0, a1, bit), _cut(turned, b0, b1, bit)
        apart = a0 != b0
        sides = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1), (am[apart], a1[apart], b0[apart], bm[apart], err[apart] + 1)]
        a0, a1, b0, b1, err = (np.concatenate(v) for v in zip(*sides, strict=True))
        keep = (a1 > a0) & (b1 > b0) & (err <= rule.most)
        a0, a1, b0, b1, err = (v[keep] for v in (a0, a1, b0, b1, err))
        keep = labels.apart(a0, a1, b0, b1)
        a0, a1, b0, b1, err = (v[keep] for v in (a0, a1, b0, b1, err))
    return labels.of


def _cut(turned: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where in each range, whose fingerprints share all bits above, the bit turns from 0 to 1."""
    shift = np.uint64(bit)
    return np.clip(np.searchsorted(turned, ((turned[lo] >> shift) | np.uint64(1)) << shift), lo, hi)


def _compare(turned, a0, a1, b0, b1, rule, labels, words, sizes, pairs: int = 1 << 16, most: int = 1 << 20) -> None:
    """Links node pairs of a few leaves as all pairs within the rule would, about `pairs` at a time and then twice as many, up to `most`.

    Nodes with themselves come first, then pairs with the first nodes; pairs of nodes that are one component by then are left out.
    """
    order = np.lexsort((b0, a0, a0 != b0))
    while len(order):
        a0, a1, b0, b1 = (v[order] for v in (a0, a1, b0, b1))
        size = (a1 - a0) * (b1 - b0)
        many = max(1, int(np.searchsorted(np.cumsum(size), pairs, side="right")))
        pairs = min(2 * pairs, most)
        count = size[:many]
        pair = np.repeat(np.arange(many), count)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
        ny = (b1 - b0)[pair]
        i, j = a0[pair] + k // ny, b0[pair] + k % ny
        near = (i != j) & (np.bitwise_count(turned[i] ^ turned[j]) <= rule.most)
        i, j = i[near], j[near]
        if words is not None:
            near = labels.of[i] != labels.of[j]
            i, j = i[near], j[near]
            ok = np.minimum(sizes[i], sizes[j]) >= rule.ratio * np.maximum(sizes[i], sizes[j])
            i, j = i[ok], j[ok]
            ok = np.bitwise_count(words[i] ^ words[j]).sum(axis=1) <= rule.total
            i, j = i[ok], j[ok]
        labels.link(i, j)
        order = many + np.flatnonzero(labels.apart(*(v[many:] for v in (a0, a1, b0, b1))))


def _forest(table_: pa.Table, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Links (node ids) of rows of one block and chunk pair."""
    turned = table_.column("turned").to_numpy().view(np.uint64)
    order = np.argsort(turned, kind="stable")
    node = table_.column("node").to_numpy()[order]
    words = sizes = None
    if rule.parts > 1:
        words = table_.column("fps").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, rule.parts)[order]
        sizes = table_.column("n").to_numpy()[order]
    return _stars(node, trie_links(turned[order], 64 // rule.blocks, rule, words, sizes))


def _stars(node: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node with the smallest of its component. A group that meets in many tasks has the same links in all, so they count once."""
    least = node.copy()
    np.minimum.at(least, root, node)
    odd = node != least[root]
    return node[odd], least[root[odd]]


def _chunked(rows: DataFrame) -> DataFrame:
    """rows (with node, and m: the chunks of its group, null for one) for each pair of chunks i <= j that their chunk is part of."""
    rows = rows.withColumn("m", F.coalesce(F.col("m").cast("int"), F.lit(1))).withColumn("s", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.struct(F.least(F.col("s"), j).alias("i"), F.greatest(F.col("s"), j).alias("j")))
    kept = [c for c in rows.columns if c not in ("m", "s")]
    return rows.select(*kept, F.explode(pairs).alias("c")).select(*kept, "c.i", "c.j")


def links(nodes: DataFrame, rule: Rule, group_rows: int = GROUP_ROWS) -> DataFrame:
    """a, b: links that connect node, fps, n (distinct nodes) as all pairs within the rule would."""
    lead = 64 // rule.blocks

    def turn(fp, k):
        return F.shiftleft(fp, k * lead).bitwiseOR(F.shiftrightunsigned(fp, 64 - k * lead)) if k else fp

    each = [F.struct(F.lit(p * rule.blocks + k).alias("block"), turn(F.get("fps", p), k).alias("turned")) for p in range(rule.parts) for k in range(rule.blocks)]
    carried = ["fps", "n"] if rule.parts > 1 else []
    dealt = nodes.select("node", *carried, F.explode(F.array(*each)).alias("k")).select("node", *carried, "k.block", "k.turned", F.shiftrightunsigned("k.turned", 64 - lead).alias("value"))
    hot = written(dealt.groupBy("block", "value").agg(F.ceil(F.count(F.lit(1)) / group_rows).alias("m")).where(F.col("m") > 1), "simhash-hot")
    salted = _chunked(dealt.join(hot, ["block", "value"], "left"))

    def run(batches):
        for whole in _whole_groups(batches, ("block", "i", "j", "value"), CHUNK_ROWS):
            yield joined(whole)

    def joined(whole: pa.Table):
        key = np.stack([whole.column(c).to_numpy().astype(np.int64) for c in ("block", "i", "j")])
        starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
        found = [_forest(whole.slice(s, e - s), rule) for s, e in zip(starts, [*starts[1:], whole.num_rows], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    return salted.repartition("block", "value", "i", "j").sortWithinPartitions("block", "i", "j", "value").mapInArrow(run, "a long, b long")


def _whole_groups(batches, keys: tuple[str, ...], rows: int):
    """Tables of whole groups (rows with the same keys, which come together), of about `rows` rows."""
    held: list[pa.Table] = []
    n = 0
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        n += b.num_rows
        if n >= rows:
            whole = pa.concat_tables(held)
            same = np.logical_and.reduce([k == k[-1] for k in (whole.column(c).to_numpy() for c in keys)])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last group may not be whole yet
            if cut:
                yield whole.slice(0, cut)
            held, n = [whole.slice(cut)], whole.num_rows - cut
    if n:
        yield pa.concat_tables(held)


def set_links(sets: list[np.ndarray], similarity: float, pivots: int = 16) -> np.ndarray:
    """For sets of distinct hashes, the position of each one's component among pairs with a Jaccard similarity from `similarity` on.

    A few sets are compared with all: of near copies most are one component then. Pairs of which one is outside of the largest
    component are compared next, by products of incidence matrices over elements that two sets have.
    """
    n = len(sets)
    labels = _Labels(n)
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), size)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    shared, columns = times[at] > 1, int((times > 1).sum())
    owner, at = owner[shared], column[at[shared]]
    alike = lambda common, a, b: (common >= similarity * (a + b - common) - 1e-6) & (a + b > 0)
    outside = np.arange(n)
    for p in np.linspace(0, n - 1, min(n, pivots)).astype(int):
        if p in outside:
            held = np.zeros(columns, bool)
            held[at[owner == p]] = True
            near = np.flatnonzero(alike(np.bincount(owner[held[at]], minlength=n), size[p], size))
            labels.link(np.full(len(near), p), near)
            outside = np.flatnonzero(labels.of != np.bincount(labels.of).argmax())
    common = np.zeros((len(outside), n), dtype=np.float32)
    for lo in range(0, columns if len(outside) else 0, 4096):
        part = (at >= lo) & (at < lo + 4096)
        held = np.zeros((n, min(4096, columns - lo)), dtype=np.float32)
        held[owner[part], at[part] - lo] = 1
        common += held[outside] @ held.T
    i, j = np.nonzero(alike(common, size[outside, None], size[None, :]))
    labels.link(outside[i], j)
    return labels.of


def checked_links(members: DataFrame, similarity: float, set_rows: int = SET_ROWS, set_hashes: int = SET_HASHES) -> DataFrame:
    """a, b: links that connect the nodes of each group (node, group, hashes) as all pairs with the similarity would.

    Groups of many texts or long ones are cut into chunks that meet pair by pair, as in links().
    """
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / set_rows), F.ceil(F.sum(F.size("hashes")) / set_hashes))
    hot = written(members.groupBy("group").agg(chunks.alias("m")).where(F.col("m") > 1), "simhash-large")
    salted = _chunked(members.join(hot, "group", "left"))

    def run(batches):
        for whole in _whole_groups(batches, ("group", "i", "j"), 1):
            key = np.stack([whole.column(c).to_numpy().astype(np.int64) for c in ("group", "i", "j")])
            starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
            node = whole.column("node").to_numpy()
            lists = whole.column("hashes").combine_chunks()
            flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
            a, b = [], []
            for s, e in zip(starts, [*starts[1:], len(node)], strict=True):
                if e - s > 1:
                    star = _stars(node[s:e], set_links([flat[(ends[k - 1] if k else 0) : ends[k]] for k in range(s, e)], similarity))
                    a.append(star[0])
                    b.append(star[1])
            none = np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x]), pa.int64()) for x in (a, b)], names=["a", "b"])

    return salted.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of each node that has an edge to another.

    Rounds of contraction: every node goes to the smallest node in its neighbourhood, and on from there to the end, and
    edges go with their ends; those whose ends meet are gone, so a round has fewer edges than the one before, and of a dense
    group hardly any. Each step is written out, and what it was made of is deleted.
    """

    between = lambda df, a, b: df.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col("a") != F.col("b")).distinct()
    now, labels = Written(between(edges, "a", "b"), "edges"), Written(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0), "labels")
    while now.df.limit(1).count():
        both = now.df.union(now.df.select("b", "a"))
        to = Written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "hooked")
        while True:  # all of a group ask for the same node: both sides are plain exchanges, which adaptive execution splits
            on = to.df.select(F.col("node").alias("root"), F.col("root").alias("further"))
            step = Written(to.df.join(on, "root").select("node", F.col("root").alias("old"), F.col("further").alias("root")), "hooked")
            more = step.df.where(F.col("old") != F.col("root")).limit(1).count()
            to.drop()
            to = step
            if not more:
                break
        on = to.df.select(F.col("node").alias("root"), F.col("root").alias("further"))
        moved = labels.df.join(on, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
        first = to.df.select("node", "root").join(labels.df.select("node"), "node", "left_anti")
        step = Written(moved.union(first), "labels")
        end = lambda side: to.df.select(F.col("node").alias(side), F.col("root").alias(f"{side}_to"))  # noqa: B023, E731
        left = Written(between(now.df.join(end("a"), "a").join(end("b"), "b"), "a_to", "b_to"), "edges")
        for old in (now, labels, to):
            old.drop()
        now, labels = left, step
    return labels.df


def classes(fps: DataFrame, found: DataFrame) -> DataFrame:
    """node, component_id (smallest doc_id of its component) for doc_id, node and the components (node, root) of nodes with links; null if a component has null ids only."""
    each = fps.groupBy("node").agg(F.min("doc_id").alias("first"))
    rooted = each.join(found, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("node", "component_id")


def shared_links(nodes: DataFrame) -> DataFrame:
    """a, b: links that connect nodes that have one of `least` in common."""
    each = nodes.select("node", F.explode("least").alias("h"))
    first = each.groupBy("h").agg(F.min("node").alias("b"), F.max("node").alias("most")).where(F.col("b") != F.col("most")).select("h", "b")
    return each.join(first, "h").where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b")


def linked(fps: DataFrame, rule: Rule) -> DataFrame:
    """node, root of the components that fingerprints within the rule make, and shared hashes of few (`least`) if there are any."""
    few = [c for c in fps.columns if c == "least"]
    each = written(fps.groupBy("node").agg(*[F.first(c).alias(c) for c in ["fps", "n", *few]]), "fingerprints")
    found = links(each, rule)
    return components(written(found.union(shared_links(each)) if few else found, "links"))


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row of docs.

    Words are runs without white space (space, \\t to \\r), A-Z in lower case. Texts of fewer than `words` words
    are one shingle; null, empty and blank texts have fingerprint zero, linked like any other. Repeated
    rows come back as often; rows with a null doc_id have a component but never name one, unless all of
    it have none: then it is null.
    """
    fps = written(fingerprints(docs, words).select("doc_id", F.get("fps", 0).alias("node"), "fps", "n"), "simhash")
    made = written(classes(fps, linked(fps, Rule(blocks=most + 1, most=most, total=most))), "simhash-classes")
    return fps.join(made, "node").select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def similar_texts(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, r1, r2 (row key), component_id of each row: texts linked where their sets of shingles have the Jaccard similarity.

    Candidates come from fingerprints (Rule.of_similarity); where one of two texts has at most FEW shingles, also from
    shared shingles, and then none is missed. In each component of candidates one text of each
    fingerprint is read again, and pairs of sets with the similarity are the links. Texts of fewer than `words`
    words are one shingle, texts without words have none and are one group. The rest is as in near_duplicates().
    """
    rule = Rule.of_similarity(similarity)
    fps = fingerprints(docs, words, rule.parts, distinct=True, similarity=similarity)
    fps = written(fps.withColumn("node", F.xxhash64("fps", "n")), "simhash")
    near = linked(fps, rule)
    read = fps.join(near, "node").groupBy("node", F.col("root").alias("group")).agg(F.min(F.struct("r1", "r2")).alias("k"))
    read = Written(read.select("node", "group", F.col("k.r1").alias("k1"), F.col("k.r2").alias("k2")), "simhash-candidates")
    r1, r2 = row_keys(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))
    texts = docs.select("text", r1.alias("k1"), r2.alias("k2")).join(hashed(read), ["k1", "k2"]).select("node", "group", "text")

    def run(batches):
        for b in slices(batches):
            sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("group"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "group", "hashes"])

    members = written(texts.mapInArrow(run, "node long, group long, hashes array<long>"), "simhash-sets")
    found = components(written(checked_links(members, similarity), "links"))
    made = written(classes(fps, found), "simhash-classes")
    return fps.select("doc_id", "r1", "r2", "node").join(made, "node").select("doc_id", "r1", "r2", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of similar texts: that of the smallest doc_id (a null is largest; ties: of the smaller key of id and text)."""
    found = written(similar_texts(docs, words, similarity), "simhash-groups")
    # groups without any id meet by row key: each key is then a group of its own text at least
    group = F.coalesce(F.col("component_id"), F.lit(None).cast("long"))
    first = found.groupBy(group.alias("component_id"), F.when(group.isNull(), F.col("r1")).alias("nameless")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")).alias("row"))
    keys = first.select(F.col("row.r1").alias("__k1"), F.col("row.r2").alias("__k2"))
    times = found.groupBy(F.col("r1").alias("__k1"), F.col("r2").alias("__k2")).agg(F.count(F.lit(1)).alias("__times"))
    keys = Written(keys.join(times, ["__k1", "__k2"]), "simhash-kept")
    r1, r2 = row_keys(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))
    held = [c for c in docs.columns if c.lower() in ("__k1", "__k2", "__times")]
    docs = docs.withColumnsRenamed({c: f"__held{c}" for c in held})
    kept = docs.withColumns({"__k1": r1, "__k2": r2}).join(hashed(keys), ["__k1", "__k2"])
    single = kept.where(F.col("__times") == 1)
    if keys.df.where(F.col("__times") > 1).limit(1).count():  # rows that are alike in id and text
        single = single.union(kept.where(F.col("__times") > 1).dropDuplicates(["__k1", "__k2"]))
    return single.select(*docs.columns).withColumnsRenamed({f"__held{c}": c for c in held})


def query(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
