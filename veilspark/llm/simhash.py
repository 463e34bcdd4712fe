"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A fingerprint has 8 bytes. Two that differ in at most b bits agree in at least 8 - b of the 8 byte positions. A list for each
(position, byte) would be 1/256 of the corpus long, so the index joins positions: it has an entry for each choice of 7 - b
positions and the bytes that stand there. Fingerprints that agree in m positions share C(m, 7 - b) entries: the tally of
shared entries of a pair counts its positional bytes, and pairs that reach the guaranteed minimum, C(8 - b, 7 - b) = 8 - b
entries, are retained and verified by counting the differing bits.

Scale: equal fingerprints are one node. A list of at most CROWD members gives pairs. Members of longer lists, which large groups
of near copies have, are crowded: two of them are linked in lists of all 8 - b bytes that must agree, which have at most 2^(8b) members;
there each is linked to the smallest one that it reaches, so links stay linear in the members. A pair with a member that isn't
crowded shares no long list, so its tally is whole. Links of all pairs follow by connectivity, none is lost. Components come from alternating
large-star and small-star rounds, each written to the shared folder. Joins by fingerprint or component are salted.

Defined results: null and empty texts have fingerprint zero. Texts of any length are hashed whole, in chunks. Rows that repeat a doc_id
are rows of their own; rows of equal texts tie, and share fingerprint and component. A null doc_id counts as the largest. An empty table
gives an empty result. Extra columns are kept by drop_near_duplicates(), ignored otherwise.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _base as base
from . import alike

SEED = 42
#: Members of a list whose pairs are tallied.
CROWD = 16
#: Hashes whose bits are counted at once.
_CHUNK = 1 << 17
_LAST = 2**63 - 1


def fingerprint(text: str | None, words: int = 3, log_weights: bool = False) -> int:
    """Unsigned. words: shingle length. log_weights: distinct shingles, weighted 1 + ln(count), instead of each occurrence."""
    w = (text or "").encode().lower().split()  # bytes: A-Z alone are lowered, and the six ASCII white-space characters split
    if not w:
        return 0
    if words == 1:
        shingles = w
    else:
        whole, ends, at = b" ".join(w), [], -1
        for x in w:
            at += len(x) + 1
            ends.append(at)
        starts = [0, *[e + 1 for e in ends]]
        shingles = [whole[a:b] for a, b in zip(starts, ends[words - 1 :])] or [whole]
    weights = None
    if log_weights:
        counts = Counter(shingles)
        shingles, weights = list(counts), np.log(np.fromiter(counts.values(), float, len(counts))) + 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))
    if weights is None:
        ones = sum(np.unpackbits(h[k : k + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for k in range(0, len(h), _CHUNK))
        bits = ones * 2 > len(h)
    else:
        parts = ((np.unpackbits(h[k : k + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), weights[k : k + _CHUNK]) for k in range(0, len(h), _CHUNK))
        bits = sum(v @ b for b, v in parts) * 2 > weights.sum()
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, log_weights: bool = False) -> DataFrame:
    """id, th (hash of the text, to find the row again), fp (the fingerprint as a signed long)."""
    source = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words, log_weights) for t in b.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(fp)], names=["id", "th", "fp"])

    return source.mapInArrow(run, "id long, th long, fp long")


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _entries(nodes: DataFrame, choices: list[tuple[int, ...]]) -> DataFrame:
    """fp, c, key: an entry for each choice of byte positions, with the bytes that stand there."""
    made = F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("key")) for c, p in enumerate(choices)])
    return nodes.select("fp", F.explode(made).alias("e")).select("fp", "e.c", "e.key")


def links(nodes: DataFrame, max_bits: int = 2, crowd: int = CROWD) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all those at max_bits (1 or 2) or fewer differing bits."""
    if not 1 <= max_bits <= 2:
        raise ValueError("max_bits is 1 or 2")
    agree = 8 - max_bits
    choices = list(itertools.combinations(range(8), agree - 1))
    entries = _entries(nodes, choices)
    # The first rows of an entry are kept in each task, so that no list is longer than that anywhere.
    first = F.row_number().over(Window.partitionBy("c", "key").orderBy("fp"))
    lists = entries.withColumn("k", first).where(F.col("k") <= crowd + 1).groupBy("c", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    lists = base.materialize(lists.where(F.size("fps") > 1), "simhash-lists")
    tail = F.slice("fps", F.col("i") + 2, F.greatest(F.size("fps") - F.col("i") - 1, F.lit(0)))
    pairs = lists.where(F.size("fps") <= crowd).select("fps", F.posexplode("fps").alias("i", "a")).select("a", F.explode(tail).alias("b"))
    # The tally: m positions that agree are m over (agree - 1) entries that are shared, so the guaranteed minimum is agree of them.
    tally = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= agree)
    found = tally.where(_differ(F.col("a"), F.col("b")) <= max_bits).select("a", "b")
    crowded = base.materialize(lists.where(F.size("fps") > crowd).select("c", "key"), "simhash-crowded")
    if crowded.isEmpty():
        return base.materialize(found, "simhash-links")
    members = base.materialize(entries.join(base.if_small(crowded), ["c", "key"], "left_semi").select("fp").distinct(), "simhash-members")
    return base.materialize(found.unionByName(_crowded_links(members, max_bits)).distinct(), "simhash-links")


def _crowded_links(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Links among fingerprints that stand in long lists: under all bytes that must agree a list has at most 2^16 members, which
    are linked in memory, each to the smallest that it reaches within the list."""
    choices = list(itertools.combinations(range(8), 8 - max_bits))
    lists = _entries(nodes, choices).groupBy("c", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("c", "fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, fps in zip(b.column("c").to_pylist(), b.column("fps")):
                v = np.sort(fps.values.to_numpy())
                root = reached(v, [q for q in range(8) if q not in choices[c]], max_bits)
                some = np.flatnonzero(root != np.arange(len(v)))
                yield pa.RecordBatch.from_arrays([pa.array(v[root[some]]), pa.array(v[some])], names=["a", "b"])

    return base.materialize(lists.mapInArrow(run, "a long, b long"), "simhash-reached").distinct()


def reached(v: np.ndarray, free: list[int], max_bits: int) -> np.ndarray:
    """For sorted distinct values that differ in the free byte positions alone, the index of the smallest value that each reaches over
    steps of max_bits or fewer bits."""
    low = np.zeros(len(v), np.int64)
    for k, q in enumerate(free):
        low |= ((v.view(np.uint64) >> np.uint64(8 * q)) & np.uint64(255)).astype(np.int64) << (8 * k)
    bits = [1 << k for k in range(8 * len(free))]
    steps = [x for n in range(1, max_bits + 1) for x in map(sum, itertools.combinations(bits, n))]
    place = np.full(1 << len(bits), -1, np.int64)
    place[low] = np.arange(len(v))
    root = np.arange(len(v))
    while True:
        now = root.copy()
        for x in steps:
            other = place[low ^ x]
            there = np.flatnonzero(other >= 0)
            now[there] = np.minimum(now[there], now[other[there]])
        now = now[now]
        if np.array_equal(now, root):
            return root
        root = now


def components(edges: DataFrame) -> DataFrame:
    """node, root: each node that has an edge (a, b), and the smallest node that it reaches."""
    now, before = base.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # A hub's edges are many rows of one key: they are dealt out.
        large = base.spread_join(both, low, ["u"], ["v"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = base.materialize(large, "stars-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = base.spread_join(large, low, ["u"], ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = base.materialize(small, "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state


def grouped(marked: DataFrame, max_bits: int = 2) -> DataFrame:
    """marked (id, th, fp) with component_id, the smallest id reachable over links, and members, the rows of the component."""
    nodes = base.materialize(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), max_bits))
    labelled = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
    labelled = base.materialize(labelled, "simhash-roots")
    whole = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("members"))
    named = base.spread_join(labelled.select("fp", "root"), whole, ["root"], ["fp"])
    return base.spread_join(marked, named.select("fp", "component_id", "members", "root"), ["fp"], ["id", "th"])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2, words: int = alike.WORDS, similarity: float = alike.SIMILARITY) -> DataFrame:
    """id, th, leader: the rows that repeat another row nearly, and the id of the row that stays for them.

    Texts whose SimHashes of words link in the byte-position index, and which are verified on their five-word shingles, are thinned first. As such hashes
    can't find every pair at a given similarity, what they leave goes through an exact index of rare shingles (alike): no two rows stay
    whose sets have a Jaccard similarity of similarity or more, and each row that goes is that similar to a row that stays.
    Rows go in favour of smaller ids, null last. Rows that repeat id and text are one row: all of them stay or go.
    """
    source = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    known = alike.classes(source, words)
    marked = base.materialize(alike.keyed(source, known, words, similarity, lambda t: fingerprint(t, 1, True)), "near-marked")
    # Equal sets are one node, its row the first; partial aggregation leaves one a task.
    rank = F.struct(F.coalesce("id", F.lit(_LAST)).alias("o"), F.col("id").isNull().alias("none"), "th")
    nodes = marked.groupBy("s1", "s2").agg(F.min(rank).alias("r"), F.min_by("id", rank).alias("id"), F.min_by("fp", rank).alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = base.materialize(nodes.select(F.monotonically_increasing_id().alias("node"), F.col("r.o").alias("o"), "id", F.col("r.th").alias("th"), "fp", "n", "keys", "s1", "s2"), "near-nodes")
    # Nodes of one fingerprint link to the first of them, and fingerprints through their first nodes.
    firsts = base.materialize(nodes.groupBy("fp").agg(F.min_by("node", F.struct("o", "node")).alias("first"), F.count(F.lit(1)).alias("rows")), "near-firsts")
    near = links(firsts.select("fp"), max_bits)
    one = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias("n" + c))
    more = near.join(one("a"), "a").join(one("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    same = base.spread_join(nodes.select("fp", "node"), firsts.where("rows > 1").select("fp", "first"), ["fp"], ["node"]).where("node <> first")
    more = base.materialize(more.unionByName(same.select(F.col("first").alias("a"), F.col("node").alias("b"))), "near-linked")

    edges = alike.verified(nodes, source, more, words, similarity)
    gone = base.materialize(alike.one_of_each_after(edges, nodes, source, words, similarity), "near-gone")
    rows = base.spread_join(marked.select("id", "th", "s1", "s2"), nodes.select("s1", "s2", "node", F.col("id").alias("nid"), F.col("th").alias("nth")), ["s1", "s2"], ["id", "th"])
    leads = gone.join(nodes.select(F.col("node").alias("leader"), F.col("id").alias("lid")), "leader").select("node", "lid", F.lit(True).alias("gone"))
    told = base.spread_join(rows, leads, ["node"], ["id", "th"], "left")
    first = F.col("id").eqNullSafe(F.col("nid")) & (F.col("th") == F.col("nth"))
    return told.where(F.col("gone").isNotNull() | ~first).select("id", "th", F.when(F.col("gone").isNotNull(), F.col("lid")).otherwise(F.col("nid")).alias("leader")).distinct()


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df without the rows that near_duplicates() finds."""
    i, t = base.fresh(df, "near_id", "near_th")
    gone = near_duplicates(df, id_col, text_col, **options).select(F.col("id").alias(i), F.col("th").alias(t))
    return df.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(text_col) == F.col(t)), "left_anti")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = base.materialize(fingerprints(base.read(spark, sf_dir, "documents")), "simhash")
    return grouped(marked, 2).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
ORACLE: dict[str, str] = {}
