"""Byte-level BPE by a pair occurrence index.

Texts are cut into pieces as the vocabulary's pattern says. The distinct new pieces of a batch are laid out as one
row of byte symbols, and each pair of neighbouring symbols is mapped to all positions where it occurs. The active
ranks are applied in ascending order, each to all its positions at once, and the lists of the pairs that appear thereby are
updated. Merges never cross pieces, and a new pair contains the new symbol, whose rank is the higher one, so the order
within each piece is the usual lowest-rank-first. Encoded pieces are remembered, up to MEMORY of them.

Scale: a narrow map without shuffle; memory is that of a batch plus the remembered pieces.

Defined results: a null text is encoded as an empty one: no ids. The special token's string in a text becomes its id. Ids
are little-endian unsigned 32-bit integers in one binary value. Very long texts are encoded whole, in the memory of one text and its
symbols. Pairs of equal rank can't occur; equal pairs merge from the left. Repeated rows get equal ids. Extra columns are kept; ids and decoded take an
underscore in front where df has the name. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base as base

VOCABULARY = "byte_bpe_50k.json"
#: Pieces remembered by a worker.
MEMORY = 350_000
#: Pairs that are looked up at once, rows that are handed on at once, and rows whose new words are learned at once (a multiple).
_CHUNK, _ROWS, _TOGETHER = 1 << 18, 256, 3072
#: Unicode white space.
_WS = "\t-\r \x85\xa0  -     　"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if it is visible, else the next from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class PairIndex:
    """Merges for many symbol sequences at once."""

    def __init__(self, merges: list[tuple[int, int, int]]) -> None:
        left, right, made = (np.array(x, dtype=np.int64) for x in zip(*merges))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made, self.left, self.right = keys[order], order, made, left, right

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], -1)

    def apply(self, symbols: np.ndarray) -> np.ndarray:
        """symbols: sequences with -1 before, between and after them; gives them merged, with -2 where a symbol went into its left neighbour."""
        s = symbols
        n = len(s)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[-1], prv[0] = n - 1, 0
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(pos: np.ndarray, ranks: np.ndarray) -> None:
            pos, ranks = pos[ranks >= 0], ranks[ranks >= 0]
            if not len(pos):
                return
            order = np.argsort(ranks, kind="stable")
            pos, ranks = pos[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.r_[0, cuts]].tolist(), np.split(pos, cuts)):
                if r in lists:
                    lists[r].append(part)
                else:
                    lists[r] = [part]
                    heapq.heappush(heap, r)

        for k in range(0, n - 1, _CHUNK):
            upto = min(k + _CHUNK, n - 1)
            file(np.arange(k, upto, dtype=np.int32), self._rank(s[k:upto], s[k + 1 : upto + 1]))
        while heap:
            r = heapq.heappop(heap)
            parts = lists.pop(r)
            pos = parts[0] if len(parts) == 1 else np.concatenate(parts)
            a, b, made = self.left[r], self.right[r], self.made[r]
            pos = pos[(s[pos] == a) & (s[nxt[pos]] == b)]
            if len(parts) > 1 or a == b:
                pos = np.unique(pos)
            if a == b and len(pos) > 1:  # of overlapping places the first counts, then every second
                kept, busy = [], -1
                for p, q in zip(pos.tolist(), nxt[pos].tolist()):
                    if p != busy:
                        kept.append(p)
                        busy = q
                pos = np.array(kept, np.int32)
            if not len(pos):
                continue
            gone = nxt[pos]
            after = nxt[gone]
            s[pos], s[gone] = made, -2
            nxt[pos], prv[after] = after, pos
            before = prv[pos]
            # Where a merged place follows another, both report the pair between them; equal entries are made one when it is its turn.
            file(np.concatenate([before, pos]), self._rank(np.concatenate([s[before], s[pos]]), np.concatenate([s[pos], s[after]])))
        return s


class Encoder:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.index = PairIndex([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.first = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.first[b] = vocab[c]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.coarse = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+").findall
        self.fine = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+").findall
        self.forget()

    def forget(self) -> None:
        self.known: defaultdict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self) -> None:
        """Encode the words that are new: words are runs between white space, with a space before."""
        new = list(self.known)[len(self.starts) :]
        pieces: defaultdict[str, int] = defaultdict()
        pieces.default_factory = pieces.__len__
        order, wsize = array("i"), np.zeros(len(new), np.int64)
        for k, w in enumerate(new):
            parts = self.fine(w)
            wsize[k] = len(parts)
            order.extend([pieces[p] for p in parts])
        order = np.array(order, np.int32)
        raw = [p.encode() for p in pieces]
        del new, pieces
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(sizes + 1) - sizes
        symbols = np.full(int(sizes.sum()) + len(raw) + 1, -1, np.int32)
        joined = np.frombuffer(b"".join(raw), np.uint8)
        inside = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(joined))
        symbols[inside] = self.first[joined]
        n_pieces = len(raw)
        del raw, joined, inside
        merged = self.index.apply(symbols)
        live = merged >= 0
        counts = np.add.reduceat(live, starts) if n_pieces else np.zeros(0, np.int64)
        flat = merged[live].astype(np.uint32)
        begin = np.cumsum(counts) - counts
        ids = gather(flat, begin, counts, order)
        edges = np.r_[0, np.cumsum(counts[order])]
        ends = np.cumsum(wsize)
        first, last = edges[ends - wsize], edges[ends]
        self.starts = np.r_[self.starts, first + len(self.flat)]
        self.sizes = np.r_[self.sizes, last - first]
        self.flat = np.r_[self.flat, ids]

    def plan(self, texts: list[str]) -> list[list[int | np.ndarray]]:
        """For each text the numbers of its words, and special ids. learn() makes them readable for ids()."""
        look, plan = self.known.__getitem__, []
        for text in texts:
            row = []
            for part in self.cut.split(text) if any(t in text for t in self.special) else [text]:
                if part in self.special:
                    row.append(self.special[part])
                elif part:
                    words = self.coarse(part)
                    row.append(np.fromiter(map(look, words), np.int32, len(words)))
            plan.append(row)
        return plan

    def ids(self, row: list[int | np.ndarray]) -> np.ndarray:
        got = [np.array([x], np.uint32) if isinstance(x, int) else gather(self.flat, self.starts, self.sizes, x) for x in row]
        return got[0] if len(got) == 1 else np.concatenate(got) if got else np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > MEMORY:
            self.forget()
        plan = self.plan(texts)
        self.learn()
        return [self.ids(row) for row in plan]


class Decoder:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.bytes: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The slices flat[starts[i] : starts[i] + sizes[i]] for i in index, end to end."""
    size = sizes[index]
    ends = np.cumsum(size)
    return flat[np.repeat(starts[index] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(1)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _added(df: DataFrame, name: str, kind: str, run: Callable[[pa.RecordBatch], Iterator[pa.Array]]) -> DataFrame:
    """df with the column name; run(batch) gives it in pieces of _ROWS rows, so that a batch's output is never held whole."""
    (out,) = base.output_names(df, name)
    schema = f"{df._jdf.schema().toDDL()}, `{out}` {kind}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, made in zip(range(0, b.num_rows, _ROWS), run(b)):
                yield pa.RecordBatch.from_arrays([*(c[k : k + _ROWS] for c in b.columns), made], names=[*b.schema.names, out])

    return df.mapInArrow(work, schema)


def encode(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """df with ids (binary)."""
    path, at = path or public_tokenizers.path(VOCABULARY), df.columns.index(text_col)

    def run(b: pa.RecordBatch) -> Iterator[pa.Array]:
        e = encoder(path)
        for first in range(0, b.num_rows, _TOGETHER):
            if len(e.known) > MEMORY:
                e.forget()
            plans = [e.plan([t or "" for t in b.column(at)[k : k + _ROWS].to_pylist()]) for k in range(first, min(first + _TOGETHER, b.num_rows), _ROWS)]
            e.learn()
            for plan in plans:
                yield pa.array([e.ids(row).astype("<u4").tobytes() for row in plan], pa.binary())

    return _added(df, "ids", "binary", run)


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """df with decoded (string)."""
    path, at = path or public_tokenizers.path(VOCABULARY), df.columns.index(ids_col)

    def run(b: pa.RecordBatch) -> Iterator[pa.Array]:
        d = decoder(path)
        for k in range(0, b.num_rows, _ROWS):
            yield pa.array([d.decode(np.frombuffer(x.as_buffer(), "<u4")) if x.is_valid else "" for x in b.column(at)[k : k + _ROWS]], pa.string())

    return _added(df, "decoded", "string", run)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.read(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encode(docs).select("doc_id", "ids")
    return decode(ids).select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op5_bpe": op5_bpe}
ORACLE: dict[str, str] = {}
