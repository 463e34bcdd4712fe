"""All pairs of texts whose sets of word shingles are alike, and the choice of one text for each group of them.

Candidates come from a prefix filter: shingles are put in an order that is the same for all sets, rarest first, and a set is
indexed under its first ones, as many as any set that is alike must share some of. Nothing is left to chance: a pair that
is alike by the similarity asked for meets in the index. Candidates are verified on their whole sets.

The choice goes over the texts in the order of their ranks (ascending id, null last): no two texts stay that are alike, and each
that goes is alike to one that stays.

Scale. A key of at most FEW sets gives pairs, FEW / 2 an entry at most. A key of more sets is hot: its pairs would grow with the square
of a group of copies. Sets that could be alike to another by hot keys alone go through rounds instead: in a round those lead that
are among the first in all of their hot keys, so that a key has at most LEADERS leaders; every other set is compared to the leaders
of its keys, which is linear in the entries. Of a set's hot keys only so many are looked at that an alike set must share one of them, and a
set meets a leader only at a key that leaves both enough shingles behind it to be the first that they share. Leaders that are alike to no leader before them stay for
good, everything alike to one of them goes. Groups of copies shrink at once, and rounds take more leaders as they go. First rows of a
key are kept in each task before anything is exchanged, and joins by key or leader are salted, so no group fills one task.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _base as base

WORDS, SIMILARITY = 5, 0.8
#: Sets of a key whose pairs are formed; leaders a hot key of the rounds, the last number for all later ones.
FEW, LEADERS = 48, (1, 16, 256)
SEED = 42
#: Bits of a shingle's hash that name its bucket in counts, buckets that are counted in one row, and the multiplier that joins word hashes.
_BUCKETS, _BLOCK, _ODD = 20, 1024, np.uint64(0x9E3779B97F4A7C15)
#: Keys, or shingles of sets, that a batch holds.
_BATCH = 1 << 17
_LAST = 2**63 - 1


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text, A-Z lower-cased; of the whole word sequence if it has fewer words."""
    w = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(x, SEED) for x in w), np.uint64, len(w))
    out = np.zeros(max(1, len(w) - words + 1), np.uint64)
    for j in range(words):
        part = h[j : j + len(out)]
        out *= _ODD
        out[: len(part)] += part
    return np.unique(out)


def need(n: int) -> int:
    """How many keys of its prefix a set of n shingles shares with a larger or equal one that it is alike to."""
    return 1 + n // 20


def _need(n: Column) -> Column:
    return F.lit(1) + F.floor(n / 20).cast("int")


def prefix(s: np.ndarray, classes: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of s in the order (class, hash).

    Sets alike by similarity share o >= similarity * n shingles, n the size of the larger. The need-th of them in the order
    has o - need shared ones behind it, so in both sets it is among the first n - similarity * n + need: a pair that is alike
    shares need(m) keys, m the size of the smaller. Any order that is the same for all sets loses nothing.
    """
    n = len(s)
    order = np.argsort(classes[s >> np.uint64(64 - _BUCKETS)], kind="stable")
    return s[order[: min(n, n - math.ceil(similarity * n - 1e-9) + need(n))]]


def classes(texts: DataFrame, words: int) -> np.ndarray:
    """A class for each bucket of shingle hashes, 0 for usual ones, higher the more often its shingles occur; over all texts (text).

    Every input task sends its counts in rows of a block of buckets, so inputs of many small parts are joined first.
    """
    spark, blocks = texts.sparkSession, (1 << _BUCKETS) // _BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << _BUCKETS, np.int64)
        for b in batches:
            for t in b.column("text"):
                np.add.at(counts, (shingles(t.as_py(), words) >> np.uint64(64 - _BUCKETS)).astype(np.int64), 1)
        rows = counts.reshape(blocks, _BLOCK)
        some = np.flatnonzero(rows.any(axis=1))
        for k in range(0, len(some), 64):
            part = some[k : k + 64]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([rows[j].astype("<i8").tobytes() for j in part], pa.binary())], names=["block", "counts"])

    def total(part: pa.Table) -> pa.Table:
        sums = np.zeros(_BLOCK, np.int64)
        for c in part.column("counts"):
            sums += np.frombuffer(c.as_buffer(), "<i8")
        start = part.column("block")[0].as_py() * _BLOCK
        return pa.table({"bucket": pa.array(np.arange(start, start + _BLOCK, dtype=np.int32)), "n": pa.array(sums)})

    parts = texts.select("text").coalesce(4 * spark.sparkContext.defaultParallelism).mapInArrow(count, "block int, counts binary")
    counts = base.materialize(parts.groupBy("block").applyInArrow(total, "bucket int, n long"), "alike-counts")
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / (1 << _BUCKETS)
    # Fewer than half of the buckets can be above twice the mean.
    hot = counts.where(F.col("n") > 2 * mean + 8).select("bucket", F.least(F.lit(255), 1 + F.floor(4 * F.log2(F.col("n") / (mean + 1)))).cast("int").alias("c")).toPandas()
    out = np.zeros(1 << _BUCKETS, np.uint8)
    out[hot["bucket"].to_numpy(np.int64)] = hot["c"].to_numpy(np.uint8)
    return out


def keyed(source: DataFrame, known: np.ndarray, words: int, similarity: float, extra=None) -> DataFrame:
    """source (id, th, text) as id, th, s1, s2 (hash of the set), n (its size), keys (its prefix), fp (extra(text), or 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                ones, twos, sizes, keys, fps = [], [], [], [], []
                for t in part.column("text"):
                    t = t.as_py()
                    s = shingles(t, words)
                    d = xxhash.xxh3_128_intdigest(s.tobytes())
                    ones.append(d >> 64)
                    twos.append(d & ((1 << 64) - 1))
                    sizes.append(len(s))
                    keys.append(prefix(s, known, similarity).view(np.int64))
                    fps.append(extra(t) if extra else 0)
                signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("th"), signed(ones), signed(twos), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), signed(fps)], names=["id", "th", "s1", "s2", "n", "keys", "fp"]
                )

    return source.mapInArrow(run, "id long, th long, s1 long, s2 long, n int, keys array<bigint>, fp long")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """node, s for texts (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size, first = [], 0, 0
            for k, t in enumerate(b.column("text")):
                held.append(shingles(t.as_py(), words).view(np.int64))
                size += len(held[-1])
                if size > _BATCH or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column("node").slice(first, len(held)), pa.array(held, pa.list_(pa.int64()))], names=["node", "s"])
                    held, size, first = [], 0, k + 1

    return texts.select("node", "text").mapInArrow(run, "node long, s array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, oa, b, ob) whose sets are alike."""
    left = base.spread_join(pairs, sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), ["a"], ["b"])
    both = left.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    alike = base.let(shared, lambda c: c / (F.size("sa") + F.size("sb") - c) >= similarity)
    return base.materialize(both.where(alike).select("a", "oa", "b", "ob"), "alike-pairs")


def sets_of(nodes: DataFrame, source: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, s (the set of shingles) of the nodes in wanted (node)."""
    wanted = base.materialize(wanted.distinct().join(nodes.select("node", F.col("id").alias("i"), F.col("th").alias("t")), "node"), "alike-wanted")
    texts = source.join(wanted, source.id.eqNullSafe(wanted.i) & (source.th == wanted.t)).select("node", "text").dropDuplicates(["node"])
    return base.materialize(_sets(texts, words), "alike-sets")


def verified(nodes: DataFrame, source: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are alike, as a, oa, b, ob, a ranking before b."""
    rank = lambda c: nodes.select(F.col("node").alias(c), F.col("o").alias("o" + c))
    found, swap = pairs.join(rank("a"), "a").join(rank("b"), "b"), _before("oa", "a", "ob", "b")
    pick = lambda x, y: F.when(swap, F.col(x)).otherwise(F.col(y))
    found = found.select(pick("a", "b").alias("a"), pick("oa", "ob").alias("oa"), pick("b", "a").alias("b"), pick("ob", "oa").alias("ob")).distinct()
    found = base.materialize(found, "alike-candidates")
    return _verified(found, sets_of(nodes, source, found.select(F.col("a").alias("node")).union(found.select("b")), words), similarity)


def _before(o: str, node: str, o2: str, node2: str) -> Column:
    return F.struct(o, node) < F.struct(o2, node2)


def one_of_each_after(edges: DataFrame, nodes: DataFrame, source: DataFrame, words: int, similarity: float) -> DataFrame:
    """node, leader as of one_of_each(), where alike pairs (a, oa, b, ob) that are known already make their choice first.

    Nodes that go by those pairs aren't indexed: the index is asked about the rest alone. Where the leader of such a node goes then, the node goes with
    another one that stays, its leader's or one of the known pairs; if it is alike to none of them, it is put back and the rest is indexed anew. The
    nodes put back only grow, so that ends.
    """
    gone = base.materialize(settled(edges), "alike-gone")
    rest = base.materialize(nodes.join(gone.select("node"), "node", "left_anti"), "alike-rest")
    both = edges.select(F.col("b").alias("node"), F.col("a").alias("leader")).union(edges.select("a", "b"))
    while True:
        more = base.materialize(one_of_each(rest, source, words, similarity), "alike-more")
        left = more.select(F.col("node").alias("leader"), F.col("leader").alias("next"))
        lost = base.materialize(gone.join(left, "leader").select("node", "next"), "alike-lost")
        if lost.isEmpty():
            return gone.unionByName(more)
        stay = rest.join(more.select("node"), "node", "left_anti").select(F.col("node").alias("leader"), "o")
        tried = verified(nodes, source, lost.select(F.col("node").alias("a"), F.col("next").alias("b")), words, similarity)
        tried = tried.select(F.col("b").alias("node"), F.col("a").alias("leader")).union(tried.select("a", "b")).union(both)
        again = tried.join(lost.select("node"), "node", "left_semi").join(stay, "leader").groupBy("node").agg(F.min_by("leader", F.struct("o", "leader")).alias("leader"))
        again = base.materialize(again, "alike-again")
        back = base.materialize(lost.select("node").join(again.select("node"), "node", "left_anti"), "alike-back")
        gone = base.materialize(gone.join(lost.select("node"), "node", "left_anti").unionByName(again), "alike-gone")
        if back.isEmpty():
            return gone.unionByName(more)
        rest = base.materialize(rest.unionByName(nodes.join(back, "node", "left_semi").select(*rest.columns)), "alike-rest")


def settled(edges: DataFrame) -> DataFrame:
    """node, leader: of alike pairs (a, oa, b, ob), a ranking before b, the nodes that go and the one that stays for each.

    A node goes if a node before it that it is alike to stays.
    """
    open_, gone = base.materialize(edges.select("a", "oa", "b"), "alike-open"), None
    while not open_.isEmpty():
        leads = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        now = base.materialize(open_.join(leads, "a").groupBy(F.col("b").alias("node")).agg(F.min_by("a", F.struct("oa", "a")).alias("leader")), "alike-settled")
        gone = now if gone is None else gone.unionByName(now)
        rest = open_.join(leads, "a", "left_anti").join(now.select(F.col("node").alias("a")), "a", "left_anti")
        open_ = base.materialize(rest.join(now.select(F.col("node").alias("b")), "b", "left_anti"), "alike-open")
    return gone if gone is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("leader")).limit(0)


def one_of_each(nodes: DataFrame, source: DataFrame, words: int, similarity: float) -> DataFrame:
    """node, leader: the nodes that go and, for each, the one that stays.

    nodes: node, o (rank, then node), id, th, n, keys; written down. source: id, th, text.
    """
    fits = lambda x, y: F.least(x, y) >= F.greatest(x, y) * F.lit(similarity - 1e-9)
    entries = nodes.select("node", "o", "n", F.posexplode("keys").alias("pos", "key"))
    order = Window.partitionBy("key").orderBy("o", "node")
    some = entries.withColumn("k", F.row_number().over(order)).where(F.col("k") <= FEW + 1)
    lists = base.materialize(some.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("o", "node", "n"))).alias("m")).where(F.size("m") > 1), "alike-lists")
    hot = base.if_small(base.materialize(lists.where(F.size("m") > FEW).select("key"), "alike-hot"))
    live = entries.join(hot, "key", "left_semi").groupBy("node", "o", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "key"))).alias("hot"))
    warm = base.materialize(live.select("node", "o", "n", F.size("hot").alias("hk"), "hot"), "alike-warm")

    # Pairs of the keys of few sets. Lists of the same members are one list that counts more.
    lists = lists.where(F.size("m") <= FEW).groupBy("m").agg(F.count(F.lit(1)).alias("keys"))
    tail = F.slice("m", F.col("i") + 2, F.greatest(F.size("m") - F.col("i") - 1, F.lit(0)))
    pairs = lists.select("keys", "m", F.posexplode("m").alias("i", "x")).select("keys", "x", F.explode(F.filter(tail, lambda y: fits(F.col("x.n"), y.n))).alias("y"))
    pairs = pairs.groupBy(F.col("x.node").alias("a"), F.col("x.o").alias("oa"), F.col("y.node").alias("b"), F.col("y.o").alias("ob")).agg(F.sum("keys").alias("keys"), F.min(F.least("x.n", "y.n")).alias("n"))
    # A pair can share hot keys too, at most as many as each of the two has.
    heat = lambda c: warm.select(F.col("node").alias(c), F.col("hk").alias("h" + c))
    pairs = base.materialize(pairs, "alike-few").join(heat("a"), "a", "left").join(heat("b"), "b", "left")
    pairs = pairs.where(F.col("keys") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))) >= _need(F.col("n"))).select("a", "oa", "b", "ob")
    pairs = base.materialize(pairs, "alike-candidates")

    # Only sets with enough hot keys can be alike to one of 0.8 their size by hot keys alone.
    # They share that many, so one that is among the first of either's hot keys, all but the last of that many: only those are looked at.
    # Pairs that share another key are candidates above, so the first hot key of a pair is the first shingle it shares at all: what is
    # shared lies there and behind it in both sets, and has to be similarity / (1 + similarity) of both sizes.
    share = F.ceil(F.col("n") * F.lit(similarity) - 1e-9)
    least = _need(share)
    firsts = F.filter(F.slice("hot", F.lit(1), F.greatest(F.col("hk") - least + 1, F.lit(0))), lambda x: x.pos <= F.col("n") - share)
    warm = warm.withColumn("firsts", firsts).where(F.size("firsts") > 0)
    live = warm.select("node", "o", "n", F.size("firsts").alias("hk"), F.explode("firsts").alias("f"))
    live = base.materialize(live.select("node", "o", "n", "hk", "f.pos", "f.key"), "alike-live")
    reach = lambda x: F.least(x.n - x.pos, F.col("n") - F.col("pos")) >= (x.n + F.col("n")) * F.lit(similarity / (1 + similarity)) - 1e-6
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(warm.select("node"))
    sets = sets_of(nodes, source, wanted, words)
    edges = _verified(pairs, sets, similarity)

    gone = stay = None
    for at in itertools.count():
        if live.isEmpty():
            break
        leaders = LEADERS[min(at, len(LEADERS) - 1)]
        first = base.materialize(live.withColumn("k", F.row_number().over(order)).where(F.col("k") <= leaders), "alike-first")
        leads = base.materialize(first.groupBy("node", "o", "hk").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") == F.col("hk")).select("node", "o"), "alike-leads")
        heads = first.join(leads.select("node"), "node", "left_semi").groupBy("key").agg(F.collect_list(F.struct("node", "o", "n", "pos")).alias("l"))
        met = base.spread_join(live, base.materialize(heads, "alike-heads"), ["key"], ["node"])
        met = met.select("node", "o", "n", F.explode(F.filter("l", lambda x: (x.node != F.col("node")) & fits(x.n, F.col("n")) & reach(x))).alias("l"))
        # A leader's pair with a set that doesn't lead is kept with the leader first; the order between two leaders is by rank.
        met = base.materialize(met.select(F.col("l.node").alias("a"), F.col("l.o").alias("oa"), F.col("node").alias("b"), F.col("o").alias("ob")).distinct(), "alike-met")
        found = _verified(met, sets, similarity).unionByName(edges).unionByName(edges.select(F.col("b").alias("a"), F.col("ob").alias("oa"), F.col("a").alias("b"), F.col("oa").alias("ob")))
        found = base.materialize(found.join(leads.select(F.col("node").alias("a")), "a", "left_semi").distinct(), "alike-found")
        among = found.join(leads.select(F.col("node").alias("b")), "b", "left_semi").where(_before("oa", "a", "ob", "b")).select("a", "oa", "b", "ob")
        fell = base.materialize(settled(among), "alike-fell")
        kept = base.materialize(leads.select("node").join(fell.select("node"), "node", "left_anti"), "alike-kept")
        went = found.join(kept.select(F.col("node").alias("a")), "a").groupBy(F.col("b").alias("node")).agg(F.min_by("a", F.struct("oa", "a")).alias("leader"))
        went = base.materialize(went, "alike-went")
        done = base.materialize(kept.select("node").unionByName(went.select("node")), "alike-done")
        gone, stay = went if gone is None else gone.unionByName(went), kept if stay is None else stay.unionByName(kept)
        live = base.materialize(live.join(done, "node", "left_anti"), "alike-live")
        ends = edges.join(done.select(F.col("node").alias("a")), "a", "left_anti").join(done.select(F.col("node").alias("b")), "b", "left_anti")
        edges = base.materialize(ends.select("a", "oa", "b", "ob"), "alike-edges")
    rest = settled(edges)
    return rest if gone is None else rest.unionByName(gone)
