"""Target-distribution importance resampling over hashed word runs.

A document's features are its runs of 1 to n consecutive words, joined by one space; a feature's bucket is the CRC-32 of its UTF-8 bytes
modulo the number of buckets. One scan makes them: a ring holds the CRC states of the runs that began at the last n words, each new word
extends every state by a space and itself, and each extended state is a feature. No run is ever put together as text.

How often each bucket occurs in the corpus and in the target gives a bucket its gain, in thousandths of a nat. A document's weight is the
floored mean of its features' gains; a Gumbel number that its id fixes is added, and of the documents with enough words the highest sums are
drawn, which is sampling without replacement by weight. Both scans read all texts whole. What leaves a task of the first is one row a bucket.
The draw needs no global sort: scores are whole numbers, so a count for each score says where each score's ranks begin, and rows of one score are
numbered by id. The count's rows are bounded by the range of scores: gains are logarithms of ratios of counts.

Defined results: null and empty texts have no features, weight 0, and are drawn only where least_words is 0. A null id is written as the empty
text under the hash. Equal (score, id) pairs, which repeated rows give, are ranked in any order. An empty corpus or target counts as zeros.
Very long texts are scanned as a stream of words. Extra columns are kept; new ones take an underscore in front where df has the name, in any case.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _base as base

RUN, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 10_000, 10, 20, "2024"
#: The word rule by bytes: digits, letters, of which A-Z are lower-cased, and whatever isn't ASCII stay, all else parts words.
_LETTERS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
#: Bytes of a text that are looked at together, and features that are held before they are counted.
_BYTES, _CHUNK = 1 << 20, 1 << 16


def ring(text: str | None, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, the CRCs of the runs that end at them) for each piece of about _BYTES of text."""
    data, at = (text or "").encode().translate(_LETTERS), 0
    waiting: list[int] = []  # the states of the last n - 1 starts, each with its space already
    while at < len(data):
        end = data.find(b" ", at + _BYTES)
        words, at = data[at : end if end > 0 else len(data)].split(b" "), end if end > 0 else len(data)
        words = list(filter(None, words))
        begun = list(map(zlib.crc32, words))
        ended = begun[:]
        if n > 1:
            for word, state in zip(words, begun):
                waiting = [zlib.crc32(word, s) for s in waiting]
                ended += waiting
                waiting = [zlib.crc32(b" ", s) for s in [*waiting, state][1 - n :]]
        yield len(words), np.array(ended, np.int64)


def counted(texts: Iterable[str | None], n: int, buckets: int) -> np.ndarray:
    """Occurrences of each bucket in the texts."""
    out, held, size = np.zeros(buckets, np.int64), [], 0
    for text in texts:
        for _, crcs in ring(text, n):
            held.append(crcs)
            size += len(crcs)
            if size >= _CHUNK:
                out += np.bincount(np.concatenate(held) % buckets, minlength=buckets)
                held, size = [], 0
    return out + np.bincount(np.concatenate(held) % buckets, minlength=buckets) if held else out


def bucket_counts(df: DataFrame, n: int = RUN, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """Occurrences of each bucket in all texts. A task sends a row for each bucket it saw."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = counted((t.as_py() for b in batches for t in b.column(0)), n, buckets)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(out[at], pa.int64())})

    got = df.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in got:  # at most one row a bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln of the target's share of a bucket over the corpus's), both smoothed by one occurrence."""
    size = len(corpus)
    s_all, t_all = float(corpus.sum()) + size, float(target.sum()) + size
    return [math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())]


def gumbel(doc_id: object, seed: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(df: DataFrame, gain: list[int], n: int = RUN, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df, or its columns keep alone, with n_words, n_features, weight, score, all long."""
    buckets, worth = len(gain), np.array(gain, np.int64)
    kept = df.columns if keep is None else keep
    out_df = df.select(*kept)
    new = base.output_names(out_df, "n_words", "n_features", "weight", "score")
    asked = df.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).cast("string").alias("_scanned"), F.col(id_col).cast("string").alias("_drawn_by"))
    schema = ", ".join(filter(None, [out_df._jdf.schema().toDDL(), *[f"`{c}` long" for c in new]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, i in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1)):
                total = words = features = 0
                for more, crcs in ring(text.as_py(), n):
                    words, features, total = words + more, features + len(crcs), total + int(worth[crcs % buckets].sum())
                weight = total // features if features else 0
                rows.append((words, features, weight, weight + gumbel(i.as_py(), seed)))
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *columns], names=[*b.schema.names[:-2], *new])

    return asked.mapInArrow(run, schema)


def drawn(df: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id", words: str = "n_words", score: str = "score") -> DataFrame:
    """df, a written table, with rank: 1, 2, 3, ... for the highest scores, null for the rest."""
    rank = base.output_names(df, "rank")[0]
    fit = F.coalesce(F.col(words) >= least_words, F.lit(False))
    by_score = sorted(((r[score], r["count"]) for r in df.where(fit).groupBy(score).count().collect()), reverse=True)
    wanted, before, begins = sum(c for _, c in by_score) * percent // 100, 0, []
    for s, c in by_score:
        if before >= wanted:
            break
        begins.append((s, before))
        before += c
    none = F.lit(None).cast("long")
    if not begins:
        return df.withColumn(rank, none)
    lowest = begins[-1][0]
    at_s, at_b = base.fresh(df, "at_score", "before")
    table = df.sparkSession.createDataFrame(begins, f"`{at_s}` long, `{at_b}` long")
    high = fit & (F.col(score) >= lowest)
    place = F.row_number().over(Window.partitionBy(score).orderBy(id_col)).cast("long")
    ranked = df.where(high).join(base.if_small(table), F.col(score) == F.col(at_s)).withColumn(rank, place + F.col(at_b)).drop(at_s, at_b)
    ranked = ranked.withColumn(rank, F.when(F.col(rank) <= wanted, F.col(rank)))
    return ranked.unionByName(df.where(~F.coalesce(high, F.lit(False))).withColumn(rank, none))


def resample(df: DataFrame, target: DataFrame, n: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of df with n_words, n_features, weight, score and rank, where target's texts show what is wanted."""
    gain = gains(bucket_counts(df, n, buckets, text_col), bucket_counts(target, n, buckets, text_col))
    return drawn(base.materialize(scored(df, gain, n, seed, id_col, text_col, [id_col]), "resample-scores"), percent, least_words, id_col)


def op11_crc_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, wanted = base.read(spark, sf_dir, "documents").select("doc_id", "text"), base.read(spark, sf_dir, "benchmark").select("text")
    return resample(docs, wanted).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op11_crc_resample": op11_crc_resample}
ORACLE: dict[str, str] = {}
