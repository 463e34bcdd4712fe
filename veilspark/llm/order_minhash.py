"""Order MinHash fingerprints; DataFrame functions only.

The k-mers are runs of K words. Each occurrence is numbered among the equal k-mers of its text, so repeats count, and (k-mer,
number) is hashed. Each of the SKETCHES has an order of its own: occurrences whose hash lies in the sketch's part of the hash
range, 1 / SKETCHES of it, come before all others, and among either a hash of that hash and the sketch's number decides. That is a
uniformly random order for each sketch, the same for all texts, and two sketches share neither part nor hash. A sketch selects
the L minimal occurrences in its order. They are put back into text order and the tuple of their hashes is hashed. Two texts agree in
a sketch if the same minimal k-mers occur in the same order; the share of equal sketches is their likeness, which falls with the edit
distance.

Where a sketch's part holds L occurrences, only they are ranked, so in long texts all sketches together hash each occurrence once;
in short ones, whose parts are mostly empty, each sketch looks through all of them and ranks those with small hashes (all, if too few are small). The parts are found by sorting their bounds in among the
hashes. No row is exploded, nothing is shuffled for it, and all of it runs in the JVM as array functions.

Defined results: a null text is empty; a text of fewer than K words has one k-mer, the whole word sequence; empty
texts have equal fingerprints. In a text of more than 2^26 words neighbouring words share a position, and k-mers that share one are in the order of their hashes. Equal texts have equal fingerprints. The order of documents is ascending id, nulls
first, then text. In an empty table nothing happens; a single document is its own next one. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _base as base
from .histogram_sort import below_count

K, L, SKETCHES = 5, 2, 64
#: Bits that a word's position takes in a packed (hash, position). k-mers whose 37 bits of hash are equal count as one; of 10^5 different
#: k-mers of a text, 0.04 pairs are on average.
_POS = 26
_HASH = 63 - _POS
#: Occurrences that are expected in the share of all that is ranked first where a sketch's part holds too few.
FEW = 8
_HEX = 8
#: Buckets of neighbouring documents for each shuffle partition.
BUCKETS = 16


def _shift(x: Column, n: int) -> Column:
    return F.shiftright(x, n)


def fingerprint(text: Column, k: int = K, take: int = L, sketches: int = SKETCHES) -> Column:
    """A hex string of sketches x 8 digits."""
    low = (1 << _POS) - 1
    high = (1 << _HASH) - 1

    def packed(h: Column, pos: Column) -> Column:  # hash above position, not negative
        return F.shiftleft(h.bitwiseAND(F.lit(high)), _POS).bitwiseOR(pos.cast("long"))

    def kmers(words: Column) -> Column:  # word hashes -> sorted (k-mer hash, position)
        n = F.greatest(F.size(words) - (k - 1), F.lit(1))
        at = lambda i, j: F.coalesce(F.get(words, i + j), F.lit(j))
        # Beyond 2^26 words, neighbouring words share a position.
        coarse = F.greatest(F.ceil(F.log2(n)).cast("int") - _POS, F.lit(0))
        hashed = lambda i, by: packed(F.xxhash64(*[at(i, j) for j in range(k)]), F.call_function("shiftright", i, by))
        return base.let(coarse, lambda by: F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), lambda i: hashed(i, by))))

    def numbered(s: Column) -> Column:  # equal k-mers are neighbours: number them and hash anew
        n = F.size(s)
        new = lambda i: (i == 0) | (_shift(F.get(s, i), _POS) != _shift(F.get(s, i - 1), _POS))
        starts = F.filter(F.sequence(F.lit(0), n - 1), new)
        again = lambda x, nth: packed(F.xxhash64(_shift(x, _POS), nth), x.bitwiseAND(F.lit(low)))
        single = F.transform(s, lambda x: again(x, F.lit(0)))
        runs = lambda st: F.flatten(
            F.transform(st, lambda a, r: F.transform(F.sequence(a, F.coalesce(F.get(st, r + 1), n) - 1), lambda i: again(F.get(s, i), i - a)))
        )
        return base.let(starts, lambda st: F.sort_array(F.when(F.size(st) == n, single).otherwise(runs(st))))

    word = lambda x: F.lpad(F.hex(F.xxhash64(*x).bitwiseAND(F.lit(0xFFFFFFFF))), _HEX, "0")
    part = ((high + 1) // sketches) << _POS
    # Part j begins at j * part; its mark sorts before the occurrences in it (position -1 can't occur, so one less).
    marks = F.expr("array(" + ",".join(f"{j * part - 1}L" for j in range(sketches)) + ")")

    def sketched(a: Column) -> Column:
        n = F.size(a)
        # Signed hashes up to here are FEW of the n on average.
        most = (F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(float(FEW)) / n) - F.lit(2.0**63)).cast("long")
        is_mark = lambda x: (x + 1).bitwiseAND(F.lit(part - 1)) == 0
        merged = F.sort_array(F.concat(a, marks))
        # The t-th mark at index i of the merged array has i - t occurrences before it.
        begins = F.filter(F.transform(merged, lambda x, i: F.when(is_mark(x), i)), lambda i: i.isNotNull())

        def one(first: Column, after: Column, j: Column, bound: Column) -> Column:
            own = F.transform(F.sequence(first, after - 1), lambda i: F.get(a, i))  # slice() would copy the whole array first
            near = lambda x: _shift(x, 63 - (sketches.bit_length() - 1)) == j
            low_ = F.filter(a, lambda x: (F.xxhash64(_shift(x, _POS), j) <= bound) | near(x))
            enough = base.let(low_, lambda f: F.when(F.size(f) >= take, f).otherwise(a))
            some = F.when(after - first >= F.least(F.lit(take), n), own).when(n <= 2 * FEW, a).otherwise(enough)
            rank = lambda x: F.struct((_shift(x, 63 - (sketches.bit_length() - 1)) != j).alias("far"), F.xxhash64(_shift(x, _POS), j).alias("r"), _shift(x, _POS).alias("h"), x.bitwiseAND(F.lit(low)).alias("p"))
            chosen = F.slice(F.sort_array(F.transform(some, rank)), 1, take)
            ordered = F.array_sort(F.transform(chosen, lambda x: F.struct(x.p.alias("p"), x.h.alias("h"))))
            return base.let(ordered, lambda o: word([F.coalesce(F.get(o, q).h, F.get(o, 0).h) for q in range(take)]))

        every = lambda b, limit: F.transform(b, lambda i, t: one(i - t, F.coalesce(F.get(b, t + 1) - t - 1, n), t, limit))
        return base.let(begins, lambda b: base.let(most, lambda limit: F.array_join(every(b, limit), "")))

    words = F.transform(F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), base.SPACE + "+"), lambda w: F.xxhash64(w))
    return F.lower(base.let(words, lambda w: base.let(kmers(w), lambda s: base.let(numbered(s), sketched))))


def likeness(a: Column, b: Column, sketches: int = SKETCHES) -> Column:
    """The share of equal sketches of two fingerprints."""
    same = F.filter(F.sequence(F.lit(0), F.lit(sketches - 1)), lambda i: F.substring(a, i * _HEX + 1, F.lit(_HEX)) == F.substring(b, i * _HEX + 1, F.lit(_HEX)))
    return F.size(same) / F.lit(float(sketches))


def _bucket(key: Column, starts: list[int]) -> Column:
    return below_count(key, F.lit(0).cast("long"), [(s, -1) for s in starts[1:]])


def neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bucket, o, id, text, own, of all documents and, with own false, of the first document after each bucket.

    A bucket holds documents whose ids are neighbours, so that a window over it sees the next document. The bounds
    are ids of the table; the first document of a bucket is also sent to the bucket before. Texts cross the network once.
    """
    spark = df.sparkSession
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    want = BUCKETS * base.partitions(spark)
    marks = df.agg(F.min(order), F.percentile_approx(order, [k / want for k in range(1, want)], 10 * want)).first()
    starts = sorted({marks[0], *(marks[1] or [])}) if marks[0] is not None else [0]
    last = len(starts) - 1
    rows = df.select(order.alias("o"), F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("b", _bucket(F.col("o"), starts))
    starts_one = F.coalesce(F.get(F.expr("array(" + ",".join(f"cast('{s}' as bigint)" for s in starts) + ")"), F.col("b")) == F.col("o"), F.lit(False))
    # The first document's ghost closes the last bucket: round = 1 sorts it behind everything there.
    ghost = F.when(F.col("b") == 0, F.struct(F.lit(last).alias("bucket"), F.lit(1).alias("round"), F.lit(False).alias("own"))).otherwise(
        F.struct((F.col("b") - 1).alias("bucket"), F.lit(0).alias("round"), F.lit(False).alias("own"))
    )
    here = F.struct(F.col("b").alias("bucket"), F.lit(0).alias("round"), F.lit(True).alias("own"))
    return rows.select("o", "id", "text", F.explode(F.when(starts_one, F.array(here, ghost)).otherwise(F.array(here))).alias("p")).select("p.*", "o", "id", "text")


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next of each document."""
    near = Window.partitionBy("bucket").orderBy("round", "o", "text")
    paired = neighbours(df, id_col, text_col).withColumn("next_text", F.lead("text").over(near))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", "text"), F.lit(1), half))
    marked = paired.withColumn("edited_text", edited).withColumn("fingerprint", fingerprint(F.col("text"))).withColumn("next_fingerprint", F.lead("fingerprint").over(near))
    own = marked.where("own").withColumn("edited_fingerprint", fingerprint(F.col("edited_text")))
    return own.select(
        F.col("id").alias(id_col),
        n.cast("long").alias("n_chars"),
        "edited_text",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("next_fingerprint", "fingerprint")).alias("near_next"),
    )


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edited_fingerprints(base.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES = {"op2_order_minhash": op2_order_minhash}
ORACLE: dict[str, str] = {}
