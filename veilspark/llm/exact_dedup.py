"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of a fixed number of code points. The distinct blocks are sorted and
numbered: equal blocks get one integer name, different blocks different ones. Adjacent names are then paired,
the distinct pairs are sorted and numbered in turn, and so on until one name is left of each document.
(rounds, name) is the document's identity: two documents have the same one exactly if their texts are equal.
No identity rests on a hash. Blocks travel to the join as 128-bit keys, but whether these keys tell all
distinct blocks apart is checked on the blocks themselves; if they ever did not, another seed is taken.

Scale: block texts cross the network once, after map-side removal of repeats, so a block in a third of all
documents arrives once a task. Everything later is integers, and the number of live names halves each round.
The joins that bring names back are plain equi-joins on exchanged inputs, which AQE splits where a key is hot.

Defined results: null text counts as empty, and empty texts equal each other. Rows that repeat a doc_id are
rows of their own; the row that stays of a group is that with the smallest (doc_id, row), null ids last. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _base as base

#: Code points of a block. Longer blocks mean fewer rounds and fewer rows; results don't depend on it.
BLOCK = 1024


def normalised(text: Column) -> Column:
    """White-space runs become one space. Plain replacement does most of it; only texts left with double spaces meet a pattern."""
    out = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return base.let(out, lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " +", " ")).otherwise(t))


def _blocks(text: Column, block: int) -> Column:
    """[text cut into pieces of block code points]; an empty text is one empty piece."""
    def cut(t: Column) -> Column:  # t is bound: without that its expression would be computed at each mention
        count = F.ceil(F.length(t) / F.lit(block)).cast("int")
        return F.when(F.octet_length(t) <= block, F.array(t)).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(t, i * block + 1, F.lit(block))))

    return base.let(text, cut)


def _keys(seed: int) -> Callable[[Column], Column]:
    return lambda block: F.struct(F.xxhash64(F.lit(seed), block).alias("k1"), F.xxhash64(F.lit(seed + 1), block).alias("k2"))


def _numbered(distinct: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Names for distinct rows: sorted in their partition and numbered, so that no two share a name."""
    return base.materialize(distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()), label)


def identities(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of df: _row, id_col, text_sha256, rounds, name. (rounds, name) is equal exactly for equal texts."""
    source = df.select(F.col(id_col), normalised(F.col(text_col)).alias("t"))
    for seed in range(2, 1000, 2):
        keys = _keys(seed)
        cut = source.select(id_col, "t", _blocks(F.col("t"), block).alias("blocks"))
        pieces = cut.select(F.explode("blocks").alias("block")).select(keys(F.col("block")).alias("k"), "block").select("k.*", "block")
        # The distinct blocks' texts decide; only keys and names are kept of them.
        names = base.materialize(pieces.distinct().sortWithinPartitions("block").select("k1", "k2", F.monotonically_increasing_id().alias("name")), "block-names")
        if names.groupBy("k1", "k2").count().where("count > 1").isEmpty():
            break
    docs = base.materialize(cut.select(F.monotonically_increasing_id().alias("_row"), id_col, F.sha2("t", 256).alias("text_sha256"), F.transform("blocks", keys).alias("ks")), "block-keys")
    live = docs.select("_row", F.size("ks").alias("n"), F.posexplode("ks").alias("pos", "k")).select("_row", "n", "pos", "k.*")
    live = base.materialize(base.spread_join(live, names, ["k1", "k2"], ["_row", "pos"]).select("_row", "n", "pos", "name"), "names-0")
    done, rounds = [], 0
    while True:
        # A document of one name is done; the others' names are paired, an odd last one with -1.
        done.append(live.where("n = 1").select("_row", F.lit(rounds).alias("rounds"), "name"))
        rest = live.where("n > 1")
        if rest.isEmpty():
            break
        rounds += 1
        half = F.expr("pos div 2")
        pairs = rest.groupBy("_row", "n", half.alias("pos")).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = base.materialize(pairs, f"pairs-{rounds}")
        named = _numbered(pairs.select("a", "b").distinct(), ["a", "b"], f"pair-names-{rounds}")
        live = base.materialize(base.spread_join(pairs, named, ["a", "b"], ["_row", "pos"]).select("_row", F.expr("(n + 1) div 2").cast("int").alias("n"), "pos", "name"), f"names-{rounds}")
    final = done[0]
    for part in done[1:]:
        final = final.unionByName(part)
    return docs.select("_row", id_col, "text_sha256").join(final, "_row")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """id_col, keep_id, group_size, kept, text_sha256 for each row of df."""
    named = base.materialize(identities(df, id_col, text_col, block), "identities")
    # Partial aggregation leaves a row for each identity and task, so that a hot group is no hot task.
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_row").alias("row")))
    groups = named.groupBy("rounds", "name").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    return base.spread_join(named, groups, ["rounds", "name"], ["_row"]).select(
        F.col(id_col), F.col("first.id").alias("keep_id"), "group_size", (F.col("_row") == F.col("first.row")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group of equal texts, the one that exact_duplicates() keeps."""
    key, nth = base.fresh(df, "exact_key", "exact_nth")
    mark = lambda i, sha: F.sha2(F.concat_ws(":", i.cast("string"), sha), 256)
    stay = exact_duplicates(df, id_col, text_col).where("kept").select(mark(F.col(id_col), F.col("text_sha256")).alias(key))
    kept = df.withColumn(key, mark(F.col(id_col), F.sha2(normalised(F.col(text_col)), 256))).join(stay, key, "left_semi")
    # Rows that repeat both id and text have one key: the window, on the join's own partitioning, leaves one of them.
    return kept.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key))).where(F.col(nth) == 1).select(*df.columns)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(base.read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op1_exact_dedup": op1_exact_dedup}
ORACLE = {
    "op1_exact_dedup": """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n"""
}
