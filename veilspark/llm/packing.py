"""Variable-capacity best-fit packing of token sequences.

Several sequence lengths (capacities) are permitted, each with a price: its tokens plus OVERHEAD for the sequence itself. Pieces
go by falling length into the open bin with the least room that holds them. Where none does, the bin size with the least price a
token is opened, of those that hold the piece, as far as what is left to pack can fill them. At the end each bin is downsized
to the smallest permitted capacity that holds its contents. This is done for each choice of the largest size to open,
and the cheapest packing of all is taken, so the lengths are optimised together.

Scale: lengths are counted in a narrow map, and only (document, length) rows go on. They are dealt at random to groups of about
GROUP rows, which are packed on their own: a bin holds documents of one group, memory is bounded by the group, and the cost of
that is at most the last bins of each group. The dealing is by row, so repeated rows and hot ids don't gather.

Defined results: a null text is empty; each document ends with an end token, so its length is at least 1. A document longer than
the largest capacity is cut into pieces of that capacity and a rest. Rows that repeat an id are packed as rows of their own.
Very long texts are pieces of the largest capacity. Of bins that fit equally well the one that was filled last is taken.
Columns beside id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base as base
from .dac_output import VOCABULARY, encoder

CAPACITIES, OVERHEAD, GROUP = (512, 1024, 2048, 4096, 8192), 64, 40_000


def token_lengths(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, n_tokens with the end token."""
    path = path or public_tokenizers.path(VOCABULARY)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in base.sliced(batches):
                counts = encoder(path).count([t or "" for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([n + 1 for n in counts], pa.int64())], names=["id", "n_tokens"])
        finally:  # the worker goes on to other tasks, of other stages too
            encoder(path).forget()

    return rows.mapInArrow(run, "id long, n_tokens long")


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int]]:
    """lengths, falling and none above the largest capacity -> the bin of each, and the capacity of each bin."""
    sizes = sorted(capacities)
    price = {c: c + overhead for c in sizes}
    best = None
    for largest in [c for c in sizes if not lengths or c >= lengths[0]]:
        allowed = [c for c in sizes if c <= largest]
        room: list[int] = []  # of each bin
        opened: list[int] = []
        with_room: dict[int, list[int]] = {}  # bins by room left
        mask = 0  # bit r: a bin with room r
        left, where = sum(lengths), []
        for n in lengths:
            fits = mask >> n
            if fits:
                r = n + (fits & -fits).bit_length() - 1
                k = with_room[r].pop()
                if not with_room[r]:
                    mask ^= 1 << r
            else:
                c = min((c for c in allowed if c >= n), key=lambda c: (price[c] / min(c, left), c))
                k, r = len(room), c
                room.append(c)
                opened.append(c)
            room[k] = r - n
            with_room.setdefault(r - n, []).append(k)
            mask |= 1 << (r - n)
            where.append(k)
            left -= n
        final = [next(c for c in sizes if c >= o - r) for o, r in zip(opened, room)]
        cost = sum(price[c] for c in final)
        if best is None or cost < best[0]:
            best = (cost, where, final)
    return best[1], best[2]


def pack_lengths(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, group: int = GROUP) -> DataFrame:
    """id, piece, n_tokens, bin, capacity, bin_start for the rows (id, n_tokens)."""
    largest = max(capacities)
    held = base.materialize(lengths.select("id", "n_tokens", F.monotonically_increasing_id().alias("row")), "lengths")
    pieces = held.select("id", "row", "n_tokens", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / largest) - 1, F.lit(0)).cast("int"))).alias("piece"))
    pieces = pieces.select("id", "row", "piece", F.least(F.col("n_tokens") - F.col("piece") * largest, F.lit(largest)).alias("n_tokens"))
    groups = max(1, math.ceil(pieces.count() / group))
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))

    def run(part: pa.Table) -> pa.Table:
        # Arrow columns all the way: ids may be null, or too large for a float.
        part = part.sort_by([("n_tokens", "descending"), ("row", "ascending"), ("piece", "ascending")])
        lengths = part.column("n_tokens").to_pylist()
        where, sizes = best_fit(lengths, capacities, overhead)
        filled, starts = [0] * len(sizes), []
        for k, n in zip(where, lengths):
            starts.append(filled[k])
            filled[k] += n
        first = part.column("g")[0].as_py() << 32
        more = {"bin": pa.array([first + k for k in where], pa.int64()), "capacity": pa.array([sizes[k] for k in where], pa.int64()), "bin_start": pa.array(starts, pa.int64())}
        return pa.table({c: part.column(c) for c in ("id", "piece", "n_tokens")} | more)

    return dealt.groupBy("g").applyInArrow(run, "id long, piece int, n_tokens long, bin long, capacity long, bin_start long")


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    return pack_lengths(token_lengths(df, id_col, text_col), **options).withColumnRenamed("id", id_col)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(base.read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLE: dict[str, str] = {}
