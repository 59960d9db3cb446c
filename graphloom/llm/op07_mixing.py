"""Mixing sources to target weights by Pareto order sampling.

A source's target share of words fixes how many copies its documents should get on average, and longer documents get
more: a document's share of copies is in proportion to LEAN plus the octave of its size, 2 at most, at the level that
makes its source's words the target (found over a source's octaves, of which there are 63 at most). The whole part of the
copies is certain. The rest p in [0, 1) is the inclusion probability of one more copy, unequal from octave to octave:
documents are ranked by the odds of a random number over the odds of their p, and the sample is the beginning of that order that
fills the source's words, so its size is fixed.

Scale: no source is sorted as a whole. Ranks fall into `BINS` bins; words are summed per source and
bin (combined before the shuffle), running sums over that bounded table find the one bin in which the
target is reached, and only that bin's documents are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import count_words, keep_columns, row_keys, table, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: What a document's weight has besides the octave of its size: the larger, the more alike are long and short ones.
LEAN = 8
#: Bins of the ranks r, by r / (1 + r).
BINS = 4096
MADE = ["size", "source_size", "target", "taken"]


def running(rows: DataFrame, order: list[Column], sums: dict[str, str], range_rows: int = 1 << 16) -> DataFrame:
    """rows with __n, their place from 0 in a total order, and for each name in sums the sum of a column over the rows before.

    Rows are dealt out by ranges of the order, of about range_rows rows; places and sums within a range go on from what the ranges before it have. No task holds all rows.
    """
    ranges = max(1, -(-rows.count() // range_rows))
    dealt = written(rows.repartitionByRange(ranges, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n0"), *[F.sum(c).alias(f"__{name}0") for name, c in sums.items()])  # a row for each range
    back = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(back), F.lit(0)).alias(c)
    parts = parts.select("__part", start("__n0"), *[start(f"__{name}0") for name in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0))
    found = dealt.join(parts, "__part").withColumn("__n", before(F.lit(1)) + F.col("__n0"))
    return found.withColumns({name: before(c) + F.col(f"__{name}0") for name, c in sums.items()}).drop("__part", "__n0", *[f"__{name}0" for name in sums])


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from one row a source.

    Sources by code point, null last, have the weights in turn. All share `share` of all sizes; no
    target is above `most` times its source's size, and the excess goes to the others by weight. The
    level is found in one pass: sources in the order of cap over weight fill up first, so the first
    whose cap the remaining level does not reach, and all after it, get weight x level.
    """
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__n") % len(weights) + 1).cast("int"))
    named = running(sizes, [F.col("source").asc_nulls_last()], {})
    named = named.select("source", "source_size", F.col("__n").alias("n"), turn.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    named = named.withColumn("k", F.col("cap") / F.col("w"))
    found = written(running(named, [F.col("k").asc(), F.col("n").asc()], {"capped": "cap", "weighed": "w"}), "mix-sources")
    whole = found.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    if whole.w is None:
        return found.select("source", "source_size", F.col("cap").alias("target"))
    level = (F.lit(float(whole.size)) * F.lit(float(share)) - F.col("capped")) / (F.lit(float(whole.w)) - F.col("weighed"))
    at = found.withColumn("level", level).where(F.col("level") * F.col("w") < F.col("cap")).agg(F.min(F.struct("k", "n", "level")).alias("at")).first()["at"]
    full = F.lit(True) if at is None else F.struct("k", "n") < F.struct(F.lit(at.k).alias("k"), F.lit(at.n).alias("n"))
    return found.select("source", "source_size", F.when(full, F.col("cap")).otherwise(F.col("w") * F.lit(0.0 if at is None else at.level)).alias("target"))


def _ranked(docs: DataFrame, seed: int) -> DataFrame:
    """docs with size, its octave (-1: no words) and what the order needs: a random number in (0, 1) and a hash of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
    sized = docs.withColumns({"size": count_words(F.col("text")), "__u": u, "__t": row_keys(text)[0]})
    return sized.withColumn("__octave", F.when(F.col("size") > 0, F.length(F.bin("size")) - 1).otherwise(-1))


def _odds(x):
    return x / (1 - x)


def _with_rank(rows: DataFrame) -> DataFrame:
    """__order: Pareto rank (random odds over inclusion odds), then u, text hash and id for ties; null where no copy is open."""
    rank = _odds(F.col("__u")) / _odds(F.col("__p"))
    return rows.withColumn("__order", F.when((F.col("__p") > 0) & (F.col("size") > 0), F.struct(rank.alias("rank"), F.col("__u").alias("u"), F.col("__t").alias("t"), F.col("doc_id").alias("id"))))


def shares(classes: DataFrame, most: float = MOST, lean: int = LEAN) -> DataFrame:
    """classes (source, octave, words, source_size, target) with whole and p, the certain copies of a document and the chance of one more, and need, the words that the chances are to fill.

    Copies are weight x level, `most` at most. As in targets(), the level is found in one pass: octaves of the largest weights fill up first.
    """
    larger = Window.partitionBy("source").orderBy(F.desc("octave"))
    before = F.coalesce(F.sum("words").over(larger.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight = F.col("octave") + F.lit(lean)
    rest = F.sum(weight * F.col("words")).over(larger.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    found = classes.withColumn("weight", weight).withColumn("level", (F.col("target") - F.lit(float(most)) * before) / F.nullif(rest, F.lit(0)))
    every = Window.partitionBy("source")
    free = (F.col("words") > 0) & (F.col("level") * F.col("weight") < most)
    found = found.withColumn("at", F.max(F.when(free, F.struct("octave", "level"))).over(every))
    copies = F.when(F.col("at").isNull() | (F.col("octave") > F.col("at.octave")), F.lit(float(most))).otherwise(F.col("weight") * F.col("at.level"))
    found = found.withColumn("copies", F.when(F.col("words") > 0, copies).otherwise(0.0)).withColumn("whole", F.floor("copies").cast("long"))
    found = found.withColumn("need", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(every))
    return found.select("source", "octave", "source_size", "target", "whole", (F.col("copies") - F.col("whole")).alias("p"), "need")


def plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, lean: int = LEAN) -> DataFrame:
    """One row a source and octave: __s, __o, source_size, target, whole, __p, cut, best.

    Documents get `whole` copies, those before `cut` in the order (all, if cut is null) one more, and so does `best`.
    """
    rows = rows.select("doc_id", "source", "size", "__octave", "__u", "__t")
    classes = written(rows.groupBy("source", F.col("__octave").alias("octave")).agg(F.sum("size").alias("words")), "mix-classes")
    goal = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most).withColumnRenamed("source", "__s")
    classes = classes.join(goal, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    goal = written(shares(classes, most, lean).withColumnsRenamed({"source": "__s", "octave": "__o", "p": "__p"}), "mix-goals")
    of = lambda small: F.col("source").eqNullSafe(small["__s"])
    ranked = _with_rank(rows.join(goal, of(goal) & (F.col("__octave") == F.col("__o")))).where(F.col("__order").isNotNull()).drop("__s", "__o")
    ranked = ranked.withColumn("bin", F.floor(F.col("__order.rank") / (1 + F.col("__order.rank")) * BINS).cast("int"))
    run = Window.partitionBy("source").orderBy("bin")
    bins = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    bins = bins.withColumn("before", F.sum("words").over(run) - F.col("words"))
    last = bins.where((F.col("before") <= F.col("need")) & (F.col("before") + F.col("words") > F.col("need")))
    last = written(last.select(F.col("source").alias("__s"), F.col("bin").alias("__b"), "before"), "mix-edges")
    # only documents of the bin in which a source's words are reached are put in order
    edge = ranked.join(last, of(last) & (F.col("bin") == F.col("__b")))
    inside = Window.partitionBy("source", "bin").orderBy("__order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("sum", F.sum("size").over(inside) + F.col("before"))
    over = F.col("sum") > F.col("need")
    cut = edge.groupBy("source").agg(F.min(F.when(over, F.col("__order"))).alias("cut"), F.coalesce(F.max(F.when(~over, F.col("sum"))), F.first("before")).alias("got"))
    cut = written(cut.withColumnRenamed("source", "__s"), "mix-cuts")
    gap = F.col("need") - F.col("got")
    miss = F.abs(F.col("size") - gap)
    spare = ranked.join(cut, of(cut)).where((F.col("__order") >= F.col("cut")) & (miss < gap))
    spare = spare.groupBy("source").agg(F.min(F.struct(miss.alias("miss"), F.col("__order").alias("order"))).alias("best")).select(F.col("source").alias("__b"), F.col("best.order").alias("best"))
    goal = goal.select("__s", "__o", "source_size", "target", "whole", "__p")
    joined = goal.join(cut.select(F.col("__s").alias("__c"), "cut"), F.col("__s").eqNullSafe(F.col("__c")), "left")
    return joined.join(spare, F.col("__s").eqNullSafe(F.col("__b")), "left").drop("__b", "__c")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7, lean: int = LEAN) -> DataFrame:
    """docs with size, source_size, target, taken (words that the mix takes of the row, repeats counted).

    size is the number of words (null text: 0). Each document gets the whole copies of its share
    (see shares()); Pareto order sampling picks who gets one more. The order's beginning is
    taken while it stays within the source's words; then the one document outside whose size comes
    nearest to what is left is taken too, if that brings the source nearer to its target. The random
    number is a hash of doc_id and seed (ties: of the text), so reruns agree; rows that are alike in
    both are all before the cut or all not, and are all taken if they are the nearest. A null source is a source of its own;
    sources without words have target 0 and give nothing. Columns of the names made are replaced.

    The plan has one row a source and octave: its size on disk decides whether it is broadcast, and where there
    are too many sources, adaptive execution splits a hot one in the join.
    """
    base = keep_columns(docs, MADE)
    rows = written(_ranked(base.select("doc_id", "source", "text"), seed).drop("text"), "mix-sizes")
    made = plan(rows, weights, share, most, lean).withColumnsRenamed({"whole": "__whole", "cut": "__cut", "best": "__best"})
    made = written(made, "mix-plan")
    out = _with_rank(_ranked(base, seed).join(made, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__octave") == F.col("__o"))))
    more = F.col("__order").isNotNull() & (F.col("__cut").isNull() | (F.col("__order") < F.col("__cut")) | F.coalesce(F.col("__order") == F.col("__best"), F.lit(False)))
    taken = F.col("size") * (F.col("__whole") + more.cast("long"))
    return out.select(*base.columns, "size", "source_size", "target", taken.alias("taken"))


def query(spark, sf_dir) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
       (('0x' || substr(md5(doc_id::VARCHAR || ':7'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((n - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
a AS (SELECT min({'k': cap / w, 'n': n, 'level': level}) FILTER (WHERE NOT (level * w >= cap)) AS at FROM l),
t AS (SELECT source, source_size, CASE WHEN a.at IS NULL OR (cap / w, n) < (a.at.k, a.at.n) THEN cap ELSE w * a.at.level END AS target FROM l, a),
o AS (SELECT source, octave, octave + 8 AS weight, sum(size)::BIGINT AS words FROM (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) - 1 ELSE -1 END AS octave FROM d) GROUP BY source, octave),
v AS (SELECT o.*, t.source_size, t.target,
        (t.target - 2.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY o.source ORDER BY octave DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / nullif(sum(weight * words) OVER (PARTITION BY o.source ORDER BY octave DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level
      FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source),
f AS (SELECT source, max({'octave': octave, 'level': level}) AS free FROM v WHERE words > 0 AND level * weight < 2.0::DOUBLE GROUP BY source),
e AS (SELECT v.*, CASE WHEN words = 0 THEN 0.0::DOUBLE WHEN f.free IS NULL OR octave > f.free.octave THEN 2.0::DOUBLE ELSE weight * f.free.level END AS copies
      FROM v LEFT JOIN f ON v.source IS NOT DISTINCT FROM f.source),
p AS (SELECT *, floor(copies)::BIGINT AS whole, copies - floor(copies) AS p, target - sum(floor(copies)::BIGINT * words) OVER (PARTITION BY source) AS need FROM e),
r AS (SELECT d.doc_id, d.size, p.*, d.u, CASE WHEN p.p > 0 AND d.size > 0 THEN (d.u / (1 - d.u)) / (p.p / (1 - p.p)) END AS rank
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND p.octave = CASE WHEN d.size > 0 THEN length(bin(d.size)) - 1 ELSE -1 END),
c AS (SELECT *, sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, u, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM r),
i AS (SELECT *, rank IS NOT NULL AND run <= need AS inside FROM c),
x AS (SELECT *, need - coalesce(max(CASE WHEN inside THEN run END) OVER (PARTITION BY source), 0) AS gap FROM i),
b AS (SELECT source, arg_min(doc_id, {'miss': abs(size - gap), 'rank': rank, 'u': u, 'id': doc_id}) AS best FROM x
      WHERE rank IS NOT NULL AND NOT inside AND abs(size - gap) < gap GROUP BY source)
SELECT x.doc_id, x.size, x.source_size, x.target,
       (x.size * (x.whole + CASE WHEN x.inside OR coalesce(b.best = x.doc_id, false) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x LEFT JOIN b ON x.source IS NOT DISTINCT FROM b.source
"""
