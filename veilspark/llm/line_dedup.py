"""Line dedup by range-partitioned hashes; DataFrame functions only.

Each line of at least min_chars code points gives a row (128-bit key hash, document, position). The rows are
range-partitioned by hash with a secondary sort by document, last first; a window streams over each key: its
first document keeps the line, the others lose it if at least min_docs documents hold the key. Of the lost
positions a compressed keep bitmap is made for each document: 64-bit words, of which only those with a lost line are stored.
No text is shuffled for that; apply_bitmaps() joins the bitmaps to the texts where texts are wanted.

Scale: a key of more rows than a task's share would fill one range. There are fewer such keys than SPLIT times the partitions; they are
found by an exact, partially aggregated count of all keys, and take another way to the same rows: counted by partial
aggregation (a row for each key and task), and the counts, a row for each hot key, are broadcast to the lines. All other keys go through
the range exchange. apply_bitmaps() exchanges the texts once, by document, to bring them to their bitmaps.

Defined results: null and empty texts are one empty line. Texts of any length are split whole. Rows that share a doc_id are one document for the
counts; a null doc_id is the smallest. Repeated rows get equal results. Extra columns are kept by apply_bitmaps()
and ignored otherwise. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _base as base

MIN_CHARS, MIN_DOCS = 40, 5
#: A key is hot if it has more than this part of a task's share of the lines.
SPLIT = 4
_STRIP = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return base.ascii_lower(F.btrim(line, F.lit(_STRIP)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _occurrences(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """id, th, pos, k1, k2 of each line whose key is long enough. (id, th) finds the row again."""
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    keyed = rows.where(F.octet_length("line") >= min_chars).select("id", "th", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.length("key") >= min_chars).select("id", "th", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"))


def _hot_keys(lines: DataFrame, parts: int) -> DataFrame | None:
    """Keys of more than 1 / (SPLIT * parts) of all lines, so fewer than SPLIT * parts of them; all lines are counted."""
    total = lines.count()
    counts = lines.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * SPLIT * parts > F.lit(max(total, SPLIT * parts)))
    hot = base.materialize(counts.select("k1", "k2"), "hot-line-keys")
    return None if hot.isEmpty() else hot


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """id, th, n_dropped, keep: for documents that lose lines. keep is [(word, bits)]; bit p of word w is line 64 w + p."""
    # The rows are written once, 36 bytes a line, so that the texts are split once however often the rows are read.
    lines = base.materialize(_occurrences(df, id_col, text_col, min_chars), "line-keys")
    hot, rest, extra = _hot_keys(lines, base.partitions(df.sparkSession)), lines, None
    if hot is not None:
        hot = F.broadcast(hot)
        counts = lines.join(hot, ["k1", "k2"]).groupBy("k1", "k2").agg(F.countDistinct(F.coalesce("id", F.lit(-(2**63)))).alias("docs"), F.max("id").alias("last"))
        counts = base.materialize(counts.where(F.col("docs") >= min_docs), "hot-lines")
        extra = lines.join(F.broadcast(counts), ["k1", "k2"]).where(F.col("id").isNull() | (F.col("id") < F.col("last"))).select("id", "th", "pos")
        rest = lines.join(hot, ["k1", "k2"], "left_anti")
    ranged = rest.repartitionByRange(base.partitions(df.sparkSession), "k1", "k2")
    key = Window.partitionBy("k1", "k2")
    streamed = ranged.withColumn("nth", F.dense_rank().over(key.orderBy(F.desc_nulls_last("id")))).withColumn("docs", F.max("nth").over(key))
    lost = streamed.where((F.col("docs") >= min_docs) & (F.col("nth") > 1)).select("id", "th", "pos")
    if extra is not None:
        lost = lost.unionByName(extra)
    words = lost.repartition(base.partitions(df.sparkSession), "id", "th").groupBy("id", "th", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("drop"))
    return words.groupBy("id", "th").agg(F.sum(F.bit_count("drop")).alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("drop").alias("bits")))).alias("keep"))


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with n_lines, n_dropped and kept_text (names that df has already get an underscore in front)."""
    out = base.output_names(df, "n_lines", "n_dropped", "kept_text")
    th, i, t, n, k, m = base.fresh(df, "th", "id", "t", "n", "keep", "map")
    maps = bitmaps.select(F.col("id").alias(i), F.col("th").alias(t), F.col("n_dropped").alias(n), F.col("keep").alias(k))
    joined = df.withColumn(th, F.xxhash64(text_col)).join(maps, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(th) == F.col(t)), "left")
    lines = _lines(F.col(text_col))
    stays = lambda bits, p: F.getbit(F.coalesce(F.try_element_at(bits, F.floor(p / 64).cast("int")), F.lit(-1).cast("long")), p % 64) == 1
    kept = base.let(F.map_from_entries(k), lambda bits: F.filter(lines, lambda _, p: stays(bits, p)))
    return joined.select(
        *[F.col(c) for c in df.columns],
        F.size(lines).cast("long").alias(out[0]),
        F.coalesce(n, F.lit(0)).cast("long").alias(out[1]),
        F.when(F.col(k).isNull(), F.coalesce(text_col, F.lit(""))).otherwise(F.array_join(kept, "\n")).alias(out[2]),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLE = {
    "op3_line_dedup": """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, c.last IS NOT NULL AND k.doc_id <> c.last AS lost FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
}
