"""All rules over the texts of a table in one pass.

The words that rules need are searched in the texts of a batch as one string, and Python's re gives the matches in texts that hold one their places,
which are code points there as they are here. Tokens are found and scored by numpy, all of a batch at once; checks of the matched values are columns,
the same as everywhere. The patterns mean the same to both engines: classes are spelled out, and case is that of ASCII.

Whoever uses the column takes it apart by a generator over the expression that with_candidates() gives. A filter over it would be pushed below the
projection, and the texts would be scanned once for the filter and once for the result.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators import entropy
from veilspark.operators import spans as S

MATCHED = "matched_"
_KIND = "array<struct<start:int,end:int,value:string,label:string,priority:int,check:int>>"
_FIELDS = [pa.field("start", pa.int32()), pa.field("end", pa.int32()), pa.field("value", pa.string()), pa.field("label", pa.string()), pa.field("priority", pa.int32()), pa.field("check", pa.int32())]
_LABELS, _PRIORITIES = pa.array([r.label for r in (*S.RULES, S.TOKEN)]), pa.array([r.priority for r in (*S.RULES, S.TOKEN)], pa.int32())
_CHECKS = pa.array([k if r.check else None for k, r in enumerate((*S.RULES, S.TOKEN))], pa.int32())
#: Bytes of texts that are scanned at once, a longer text on its own.
_AT_ONCE = 1 << 22
_DIGIT = frozenset("0123456789")
_IN_TOKEN = np.zeros(256, bool)
_IN_TOKEN[[ord(c) for c in entropy.SYMBOLS[2:] + entropy.SYMBOLS[12:].upper()]] = True
_SHORTEST = 9


def _holding(data: bytes, word: bytes, offsets: list[int]) -> list[int]:
    """The texts that hold a word: all are searched as one string."""
    rows, at = [], data.find(word)
    while at >= 0:
        row = bisect_right(offsets, at) - 1
        if at + len(word) <= offsets[row + 1]:
            rows.append(row)
            at = data.find(word, offsets[row + 1])
        else:
            at = data.find(word, at + 1)
    return rows


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of at least 9 ASCII letters and digits begin and end, in bytes; a text's end ends a run."""
    inside = np.concatenate([[False], _IN_TOKEN[data], [False]])
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = inside[first + 1]
    last = first[1:] - 1
    ends[last] = inside[last + 1]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = b - a >= _SHORTEST
    return a[long], b[long]


def _strings(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """The bytes from a to b, each, as a large_string array."""
    sizes = b - a
    ends = np.concatenate([[0], np.cumsum(sizes)])
    places = np.arange(ends[-1]) + np.repeat(a - ends[:-1], sizes)
    return pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[places]))


def _matcher(flags: str, costs: list[int] | None):
    """Arrow function of texts: their matches, with the number of the rule whose check a value must still pass."""
    rules = [(k, r, re.compile(r.pattern, re.ASCII)) for k, r in enumerate(S.RULES) if r.flag in flags]
    is_random = entropy.random_hits(costs) if "H" in flags and costs is not None else None

    def matched(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.Array:
        raw, at = data.tobytes(), offsets.tolist()
        low, known = raw.lower(), {}
        digits = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, S.DIGITS), False).to_numpy(zero_copy_only=False)).tolist()
        rule, row, start, end, value = [], [], [], [], []
        for k, r, pattern in rules:
            needs = r.prefilter
            for n in digits if r.name in S.IN_DIGITS else sorted({n for w in needs.words for n in _holding(low if needs.low else raw, w.encode(), at)}):
                text = known.get(n)
                if text is None:
                    text = known[n] = raw[at[n] : at[n + 1]].decode()
                for m in pattern.finditer(text):
                    a, b = m.span()
                    if r.check is None or not (text[a - 1 : a] in _DIGIT or text[b : b + 1] in _DIGIT):
                        rule.append(k)
                        row.append(n)
                        start.append(a)
                        end.append(b)
                        value.append(m[0])
        values = pa.array(value, pa.string())
        rule, row, start, end = (np.array(x, np.int64) for x in (rule, row, start, end))
        if is_random is not None:
            a, b = _tokens(data, offsets)
            tokens = _strings(data, a, b)
            hit = is_random(tokens)
            a, b, of = a[hit], b[hit], np.searchsorted(offsets, a[hit], "right") - 1
            first = a - offsets[of]
            if len(hit) and data.max() > 127:  # code points before it: all bytes that don't continue one
                more = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80, dtype=np.int32)])
                first = first - (more[a] - more[offsets[of]])
            rule, row, start, end = (np.concatenate(x) for x in ((rule, np.full(len(hit), len(S.RULES))), (row, of), (start, first), (end, first + b - a)))
            values = pa.concat_arrays([values, tokens.take(pa.array(hit)).cast(pa.string())])
        order = np.argsort(row, kind="stable")
        which = pa.array(rule[order])
        columns = [pa.array(start[order], pa.int32()), pa.array(end[order], pa.int32()), values.take(pa.array(order)), _LABELS.take(which), _PRIORITIES.take(which), _CHECKS.take(which)]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=_FIELDS))

    def run(texts: pa.Array) -> pa.Array:
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        try:
            texts.cast(pa.large_string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            texts = pa.array([x.decode("utf-8", "replace").encode() for x in texts.to_pylist()], pa.large_binary())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        every = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.zeros(0, np.uint8)
        lists, k = [matched(texts.slice(0, 0).cast(pa.large_string()), every[:0], np.zeros(1, np.int64))], 0
        while k < len(texts):
            to = min(max(int(np.searchsorted(bounds, bounds[k] + _AT_ONCE, "right")) - 1, k + 1), len(texts))
            lists.append(matched(texts.slice(k, to - k).cast(pa.large_string()), every[bounds[k] : bounds[to]], bounds[k : to + 1] - bounds[k]))
            k = to
        return pa.concat_arrays(lists)

    return F.arrow_udf(run, _KIND)


def with_candidates(df: DataFrame, flags: str = S.FLAGS, text_col: str = "text", costs: list[int] | None = None) -> tuple[DataFrame, str]:
    """(df with the matches of each text, SQL over it): the SQL is the bag union of all enabled rules' spans as one array, null text has none. costs: the bigram model that H needs."""
    checks = " ".join(f"WHEN x_.check = {k} THEN coalesce({r.check('x_.value')}, false)" for k, r in enumerate(S.RULES) if r.check)
    return df.withColumn(MATCHED, _matcher(flags, costs)(F.col(text_col))), f"filter({MATCHED}, x_ -> CASE WHEN x_.check IS NULL THEN true {checks} END)"
