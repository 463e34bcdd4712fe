"""Random-looking strings by a character-bigram model.

The model is fitted to words, not shipped: costs are -log2 of add-one-smoothed bigram shares over 38 symbols (start, end,
0-9, a-z; a first symbol that never occurs costs log2(37) throughout), in 1/10000 bit so that sums are exact in any order. Its
1,444 numbers reach the executors with the plan and are looked up by index, so scoring needs no join. A single string is scored by
a column function; the tokens of a table by numpy over Arrow arrays, all tokens of a batch at once, with the same sums and bounds.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import validators as V
from veilspark.functions.arrays import let, over, quoted
from veilspark.operators import spans as S

SYMBOLS = "^$0123456789abcdefghijklmnopqrstuvwxyz"
SCALE = 10_000


def costs_of(counts: dict[tuple[str, str], int]) -> list[int]:
    """Row-major costs, from bigram counts."""
    after = SYMBOLS[1:]
    out = []
    for a in SYMBOLS:
        total = sum(counts.get((a, b), 0) for b in after)
        out += [round(-math.log2((counts.get((a, b), 0) + 1) / (total + len(after))) * SCALE) if b != "^" else 12 * SCALE for b in SYMBOLS]
    return out


def bigrams(df: DataFrame, text_col: str = "text") -> DataFrame:
    """a, b, n: bigram counts of the lower-cased ASCII words of a text column, with ^ before and $ behind each."""
    words = df.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).groupBy(F.lower("w").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    marked = words.select(F.concat(F.lit("^"), "w", F.lit("$")).alias("w"), "n")
    pairs = marked.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))).alias("p"), "n")
    return pairs.groupBy(F.substring("p", 1, 1).alias("a"), F.substring("p", 2, 1).alias("b")).agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text_col: str = "text") -> list[int]:
    """Costs from a text column; 37 x 37 counts are collected."""
    return costs_of({(r.a, r.b): r.n for r in bigrams(df, text_col).collect()})


@lru_cache(1)
def english() -> list[int]:
    """Costs from the language reference that comes with Python, for callers without a corpus of their own."""
    from pydoc_data.topics import topics

    counts: dict[tuple[str, str], int] = {}
    for w in re.findall("[a-z]+", " ".join(topics.values()).lower()):
        for a, b in zip("^" + w, w + "$"):
            counts[a, b] = counts.get((a, b), 0) + 1
    return costs_of(counts)


def bigram_cost_sql(v: str, costs: list[int]) -> str:
    table = "array(" + ",".join(f"{c}L" for c in costs) + ")"
    place = lambda at: f"instr({quoted(SYMBOLS)}, substr(mk_, {at}, 1))"
    step = f"sum_ + {table}[({place('nth_')} - 1) * {len(SYMBOLS)} + {place('nth_ + 1')} - 1]"
    return let(f"concat('^', lower({v}), '$')", "mk_", f"aggregate(sequence(1, length({v}) + 1), 0L, (sum_, nth_) -> {step})")


def is_random_sql(v: str, costs: list[int]) -> str:
    # The cost before the variety: plain words fail it, and most are varied enough.
    costly = f"{bigram_cost_sql(v, costs)} / {float(SCALE)!r}D / (length({v}) + 1) > {V.random_threshold_sql(f'length({v})')}"
    varied = let(f"lower({v})", "low_", V.char_entropy_sql("low_"))
    return f"(rlike({v}, '^[A-Za-z0-9]{{9,}}$') AND NOT rlike({v}, '^[0-9]+$') AND {costly} AND {varied} >= least(2.5D, log2(length({v})) * 0.72D))"


def is_random(value: Column, costs: list[int]) -> Column:
    """Over 8 ASCII letters or digits, not all digits, varied enough, and costlier than a string of words of that length."""
    return over(value, "v_", is_random_sql("v_", costs))


#: The column of with_random(), and tokens that are scored at once.
RANDOM, _AT_ONCE = "random_", 1 << 16


def random_hits(costs: list[int]):
    """A function of a large_string array of ASCII letters and digits: the indexes of the strings that is_random() takes."""
    code = np.zeros(256, np.int64)
    for c in SYMBOLS[2:]:
        code[[ord(c), ord(c.upper())]] = SYMBOLS.index(c)
    table, wide = np.array(costs, np.int64), len(SYMBOLS)
    bounds = np.full(V.THRESHOLDS[-1][0] + 2, np.inf)
    for (a, x), (b, y) in zip(V.THRESHOLDS, V.THRESHOLDS[1:]):
        for n in range(a, b + 1):
            bounds[n] = x + (y - x) * (n - a) / float(b - a) if bounds[n] == np.inf else bounds[n]
    bounds[-1] = V.THRESHOLDS[-1][1]

    def is_hit(some: pa.Array) -> np.ndarray:
        at = np.frombuffer(some.buffers()[1], np.int64)[some.offset : some.offset + len(some) + 1]
        codes = code[np.frombuffer(some.buffers()[2], np.uint8)[at[0] : at[-1]]]
        first, last, n = at[:-1] - at[0], at[1:] - at[0] - 1, np.diff(at)
        so_far = np.concatenate([[0], np.cumsum(table[codes[:-1] * wide + codes[1:]])])
        total = table[codes[first]] + so_far[last] - so_far[first] + table[codes[last] * wide + 1]
        out = total / float(SCALE) / (n + 1) > bounds[np.minimum(n, len(bounds) - 1)]
        # Plain words fail the cost; the variety of the rest is summed in the order of the symbols.
        left = np.flatnonzero(out)
        sizes = n[left]
        rows = np.repeat(np.arange(len(left)), sizes)
        places = np.arange(sizes.sum()) + np.repeat(first[left] - np.cumsum(sizes) + sizes, sizes)
        counts = np.bincount(rows * wide + codes[places], minlength=len(left) * wide).reshape(-1, wide)
        bits = np.zeros(len(left))
        for k in range(2, wide):
            share = counts[:, k] / sizes
            bits -= share * np.log2(np.where(share > 0, share, 1))
        out[left] = (counts[:, 12:].sum(axis=1) > 0) & (bits >= np.minimum(2.5, np.log2(sizes) * 0.72))
        return out

    return lambda flat: np.flatnonzero(np.concatenate([np.zeros(0, bool), *[is_hit(flat.slice(k, _AT_ONCE)) for k in range(0, len(flat), _AT_ONCE)]]))


def random_places(costs: list[int]):
    """Of arrays of ASCII letters and digits, the indexes of the strings that is_random() takes."""
    hits = random_hits(costs)

    def run(tokens: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        hit = hits(tokens.flatten().cast(pa.large_string()))
        row = np.repeat(np.arange(len(sizes)), sizes)[hit]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hit - starts[row], pa.int32()))

    return F.arrow_udf(run, "array<int>")


def tokens_of(random: str) -> str:
    """The column of all tokens that stands beside the column random."""
    return f"{random}tokens_"


def with_random(df: DataFrame, costs: list[int], text_col: str = "text") -> DataFrame:
    """df with each text's tokens and the indexes of the random ones. Only the tokens leave the JVM."""
    tokens = df.withColumn(tokens_of(RANDOM), F.regexp_extract_all(F.col(text_col), F.lit(S.TOKEN.pattern), F.lit(0)))
    return tokens.withColumn(RANDOM, random_places(costs)(F.col(tokens_of(RANDOM))))


def random_tokens(df: DataFrame, costs: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    marked = with_random(df.select(id_col, text_col), costs, text_col)
    return S.spans(marked, S.TOKEN, id_col, text_col, among=RANDOM, values=tokens_of(RANDOM))
