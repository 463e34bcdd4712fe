"""Shards of near equal bytes by histogram sort; DataFrame functions only.

Rows are ordered by (hash of the text, doc_id), so equal texts stand together and a large group can still be cut
between two rows. Splitters of this order are sought by histogram: probes between the bounds known so far
of each splitter, exact sizes counted below every probe over all partitions, bounds narrowed, until each splitter's
bytes are within tolerance of its target or no row is left between its bounds. Then the rows are exchanged once, by
the bucket that the final splitters give, and numbered in it.

Scale: a round aggregates (key, size) rows, 24 bytes a document, to a count for each probe with map-side sums; the
driver sees PROBES numbers for each splitter. The last exchange carries just the columns the caller selects.
Splitters cut a group of equal texts where it is larger than the tolerance, so no hot text makes a
large shard. Shards of many rows are divided into several buckets, whose exact row counts give the first slot of each.

Defined results: a null text has no bytes and the checksum of an empty one; a null doc_id is the smallest. Rows equal
in text and doc_id are neighbours in the order. An empty table gives an empty result. Extra columns are kept.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _base as base

SHARDS, OVERHEAD = 40, 16
#: Probes for each open splitter and round; allowed deviation of a splitter as a share of a shard; rows of a bucket.
PROBES, TOLERANCE, BUCKET_ROWS, MOST_BUCKETS = 32, 0.002, 500_000, 4096
_LOW, _HIGH = -(2**63), 2**63 - 1


def _long_array(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"cast('{v}' as bigint)" for v in values) + ")")


def below_count(h: Column, d: Column, splitters: list[tuple[int, int]]) -> Column:
    """How many of the sorted splitters are at most (h, d), by binary search."""
    if not splitters:
        return F.lit(0)
    hs, ds = _long_array([s[0] for s in splitters]), _long_array([s[1] for s in splitters])
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc.lo + acc.hi) / 2).cast("int")
        at = F.get(hs, mid)
        up = (h > at) | ((h == at) & (d >= F.get(ds, mid)))
        going = acc.lo < acc.hi
        return F.struct(F.when(going & up, mid + 1).otherwise(acc.lo).alias("lo"), F.when(going & ~up, mid).otherwise(acc.hi).alias("hi"))

    rounds = max(1, math.ceil(math.log2(len(splitters) + 1)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda acc: acc.lo)


def _between(lo: tuple[int, int], hi: tuple[int, int], n: int) -> list[tuple[int, int]]:
    """Up to n keys above lo and below hi: on the hash while the bounds differ in it, else on the id."""
    axis, other = (0, _LOW) if hi[0] - lo[0] > 1 or (hi[0] > lo[0] and hi[1] > _LOW) else (1, lo[0])
    a, b = (lo[0], hi[0] + (hi[1] > _LOW)) if axis == 0 else (lo[1], hi[1] if hi[0] == lo[0] else _HIGH)
    marks = sorted({a + (b - a) * k // (n + 1) for k in range(1, n + 1)} - {a, b}) or [a + 1]
    keys = [(m, other) if axis == 0 else (other, m) for m in marks]
    return [k for k in keys if lo < k < hi]


def find_splitters(keyed: DataFrame, targets: list[float], tolerance: float) -> list[tuple[int, int]]:
    """Keys (h, d) below which the sizes of keyed (h, d, size) sum to the targets, each within tolerance if rows allow."""
    bounds = [[(_LOW, _LOW), 0, (_HIGH, _HIGH), math.inf] for _ in targets]
    found: list[tuple[int, int] | None] = [None] * len(targets)
    while any(x is None for x in found):
        # The bounds are probed too, so that the rows between them are told from all others.
        open_ = [(lo, hi) for k, (lo, _, hi, _) in enumerate(bounds) if found[k] is None]
        probes = sorted({p for lo, hi in open_ for p in (lo, *_between(lo, hi, PROBES), hi)} - {(_LOW, _LOW), (_HIGH, _HIGH)})
        index = below_count(F.col("h"), F.col("d"), probes)
        counts = keyed.groupBy(index.alias("i")).agg(F.sum("size").alias("bytes"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("d").alias("d0"), F.max("d").alias("d1"))
        by = {r.i: r for r in counts.collect()}  # one row for each probe at most
        sums = [0]
        for i in range(len(probes) + 1):
            sums.append(sums[-1] + (by[i].bytes if i in by else 0))
        marks, totals = [(_LOW, _LOW), *probes, (_HIGH, _HIGH)], sums  # sums[i] is below marks[i]
        for k, target in enumerate(targets):
            if found[k] is not None:
                continue
            lo, lo_sum, hi, hi_sum = bounds[k]
            # The marks' sums rise, so the target's place among them is found by bisection.
            up = bisect.bisect_left(totals, target)
            last = bisect.bisect_right(totals, target) - 1
            if marks[last] > lo:
                lo, lo_sum = marks[last], totals[last]
            if up < len(marks) and lo < marks[up] < hi:
                hi, hi_sum = marks[up], totals[up]
            cell = by.get(last)
            inside = cell is not None and marks[last] >= lo and (last + 1 < len(marks) and marks[last + 1] <= hi)
            if inside and hi_sum < math.inf:  # the rows themselves bound the search
                h0, h1 = cell.h0, cell.h1
                d0, d1 = (cell.d0, cell.d1) if h0 == h1 else (_LOW, _HIGH)
                lo = max(lo, (h0, d0))
                hi = min(hi, (h1, d1 + 1) if h0 == h1 and d1 < _HIGH else (h1 + 1, _LOW) if h1 < _HIGH else hi)
            bounds[k] = [lo, lo_sum, hi, hi_sum]
            near, key = min((abs(target - lo_sum), lo), (abs(hi_sum - target), hi))
            if near <= tolerance or not inside or not _between(lo, hi, PROBES):
                found[k] = key
    return sorted(found)


def shard_documents(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """df with size, shard and slot (an underscore in front where df has the name)."""
    out = base.output_names(df, "size", "shard", "slot")
    h, d, b, first = base.fresh(df, "h", "d", "bucket", "first")
    rows = df.withColumn(h, F.xxhash64(text_col)).withColumn(d, F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW).cast("long"))).withColumn(out[0], F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + OVERHEAD)
    keyed = base.materialize(rows.select(F.col(h).alias("h"), F.col(d).alias("d"), F.col(out[0]).alias("size")), "shard-keys")
    count, total = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    per = max(1, min(MOST_BUCKETS // shards, math.ceil(count / (shards * BUCKET_ROWS))))
    splitters = find_splitters(keyed, [total * k / (shards * per) for k in range(1, shards * per)], tolerance * total / shards) if count else []
    bucket = below_count(F.col("h"), F.col("d"), splitters)
    counts = {r.b: r.n for r in keyed.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = [sum(counts.get(x, 0) for x in range(k - k % per, k)) for k in range(shards * per)]
    placed = rows.withColumn(b, below_count(F.col(h), F.col(d), splitters))
    number = F.row_number().over(Window.partitionBy(b).orderBy(h, d)) - 1
    return placed.select(*df.columns, out[0], F.floor(F.col(b) / per).cast("int").alias(out[1]), (number + F.get(_long_array(starts), F.col(b))).cast("long").alias(out[2]))


def op7_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    return shard_documents(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_histogram_shards": op7_histogram_shards}
ORACLE: dict[str, str] = {}
