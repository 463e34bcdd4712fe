"""Token-id files of directly addressable codes.

An id is split into chunks of CHUNK bits, low chunk first. Level 0 of a file holds the low chunk of every id; a
bitmap says which ids go on, and the next level holds the next chunk of those alone, with a bitmap of its own.
A rank directory (set bits before each block of 512) turns an id's place in one level into its place in the next,
so any token is read in a few steps, without decoding what stands before it.

File, little-endian: magic "VSDAC1\\0\\0"; tokens, documents, levels, chunk bits as 4 x uint64; document ids int64; a byte
a document that is 1 where the id is null; document starts uint64, one more than documents; then for each level its length uint64, chunks uint8,
bitmap (padded to 64 bytes), directory uint64. Documents stand in ascending id order, nulls first, across and within files.

Scale: texts are range-partitioned by id once (the text is what is shuffled, ids are made behind the exchange). A task
writes files of at most FILE_TOKENS tokens, or one longer document, under names that a repeated task overwrites
with the same bytes. Files are read back in parallel, one row each; a file's first global token number is a prefix sum over file sizes.

Defined results: a null text is empty and has only the end id. Rows that repeat an id follow each other in text order. A very long text
is one document of one file, whatever its length. Empty
tables give no file and no row. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from . import _base as base
from .bpe import byte_alphabet, gather

VOCABULARY, END = "word_bpe_49k.json", 1
CHUNK, BLOCK, FILE_TOKENS = 8, 512, 8_000_000
#: Words remembered by a worker.
MEMORY = 1_000_000
#: New pieces that the library's model is given in one text.
_JOINED = 200
_MAGIC = b"VSDAC1\0\0"
#: Letters beside ASCII that no normal form changes, each with a lower case of one letter: U+00C0 to U+017F without two signs and the dotted I.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_PLAIN = re.compile(f"[!-~{_LATIN}]+").fullmatch
#: The vocabulary's pattern, for plain words in lower case.
_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}]+").findall


class _Numbers(dict):
    """Words to numbers, given in the order in which words are first asked for; new ones are listed until they are learned."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordEncoder:
    """The library's ids of a text, word by word: no token of this vocabulary holds white space, so words between ASCII
    white space are encoded alone, each once, by the library, and remembered.

    A word of visible ASCII characters and Latin letters is made of the pieces that the vocabulary's pattern cuts it into in lower case. Pieces are
    remembered as words too, and new ones go to the library's model many in one text, past its normalizer and pattern, which change nothing in
    them. Words with other characters, or with what special tokens begin with, go through the whole library.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        self.shown = {b: c for c, b in byte_alphabet().items()}
        vocab = self.library.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a piece
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known, self.used = _Numbers(), 0
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _through_library(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, end to end, and how many each has."""
        made = [m.ids for m in self.library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(chain.from_iterable(made), np.uint32, int(sizes.sum())), sizes

    def _through_model(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [" ".join([p.decode("latin-1").translate(self.shown) if not p.isascii() else p.decode() for p in pieces[k : k + _JOINED]]) for k in range(0, len(pieces), _JOINED)]
        made = [m.ids for m in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(made), np.uint32, sum(map(len, made)))
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) != len(pieces) or len(flat) != (ends[-1] if len(ends) else 0):  # a vocabulary that lacks a character
            return self._through_library(pieces)
        return flat, np.diff(ends, prepend=0)

    def _place(self, numbers: list[int], flat: np.ndarray, sizes: np.ndarray) -> None:
        """Write down the ids of words with these numbers. Arrays grow by half, so that they are seldom copied."""
        upto = self.used + len(flat)
        if upto > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(upto + upto // 2 - len(self.flat), np.uint32)])
        self.flat[self.used : upto] = flat
        self.starts[numbers], self.sizes[numbers] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used = upto

    def _learn(self) -> None:
        words, look = self.known.new, self.known.__getitem__
        first, pieces, others, made, parts = len(self.known) - len(words), [], [], [], []
        for k, w in enumerate(words, first):  # new pieces join the list as it is gone through
            text = w.decode()
            if "<|" in text or not _PLAIN(text):
                others.append(k)
                continue
            cut = _CUT(text.lower())
            if cut[0] == text:
                pieces.append(k)
            else:
                made.append(k)
                parts.append([look(p.encode()) for p in cut])
        n = len(self.known)
        if n > len(self.sizes):
            self.starts, self.sizes = (np.concatenate([x, np.zeros(n + n // 2 - len(x), np.int64)]) for x in (self.starts, self.sizes))
        self._place(pieces, *self._through_model([words[k - first] for k in pieces]))
        self._place(others, *self._through_library([words[k - first] for k in others]))
        if made:
            of = np.fromiter(chain.from_iterable(parts), np.int64)
            starts = np.cumsum([0, *map(len, parts[:-1])])
            self._place(made, gather(self.flat, self.starts, self.sizes, of), np.add.reduceat(self.sizes[of], starts))
        self.known.new = []

    def places(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's words in starts and sizes."""
        if len(self.known) > MEMORY:
            self.forget()
        split = (text.encode().split() for text in texts)
        out = [np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)) for words in split]
        if self.known.new:
            self._learn()
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [gather(self.flat, self.starts, self.sizes, p) for p in self.places(texts)]

    def count(self, texts: list[str]) -> list[int]:
        return [int(self.sizes[p].sum()) for p in self.places(texts)]


@lru_cache(1)
def encoder(path: str) -> WordEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return WordEncoder(path)


def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """The file of these documents."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    levels, rest = [], flat
    while True:
        low, rest = (rest & ((1 << CHUNK) - 1)).astype(np.uint8), rest >> CHUNK
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (BLOCK // 8)))
        ones = np.bitwise_count(bits.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint64)
        levels += [np.array([len(low)], "<u8"), low, bits, np.cumsum(ones, dtype="<u8") - ones]
        if not more.any():
            break
        rest = rest[more]
    none = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    starts = np.r_[0, np.cumsum([len(x) for x in ids])].astype("<u8")
    head = np.array([len(flat), len(doc_ids), len(levels) // 4, CHUNK], "<u8")
    return _MAGIC + b"".join(x.tobytes() for x in (head, keys, none, starts, *levels))


class Reader:
    """Random access to a file's tokens."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != _MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.at, self.data = 8, data
        self.tokens, docs, levels, self.chunk = (int(x) for x in self._take("<u8", 4))
        self.keys, self.none, self.starts = self._take("<i8", docs), self._take("u1", docs), self._take("<u8", docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(levels):
            n = int(self._take("<u8", 1)[0])
            blocks = -(-n // BLOCK)
            self.levels.append((self._take("u1", n), self._take("u1", blocks * BLOCK // 8), self._take("<u8", blocks)))

    def _take(self, kind: str, n: int) -> np.ndarray:
        x = np.frombuffer(self.data, kind, n, self.at)
        self.at += x.nbytes
        return x

    def token(self, i: int) -> int:
        """Token i, by a chunk and a rank a level."""
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (self.chunk * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            inside = np.unpackbits(bits[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i = int(ranks[block]) + int(inside.sum())
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Tokens a to b: on each level they are neighbours, and one rank finds their place in the next."""
        out, where = np.zeros(b - a, np.uint32), None
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            if b <= a:
                break
            low = chunks[a:b].astype(np.uint32) << np.uint32(self.chunk * level)
            out[where if where is not None else slice(None)] |= low
            block = a // BLOCK
            got = np.unpackbits(bits[block * BLOCK // 8 : -(-b // 8)], bitorder="little")
            go = got[a - block * BLOCK : b - block * BLOCK].astype(bool)
            where = np.flatnonzero(go) if where is None else where[go]
            a = int(ranks[block]) + int(got[: a - block * BLOCK].sum())
            b = a + int(go.sum())
        return out


def write(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, partitions: int | None = None) -> DataFrame:
    """Writes the files under folder; gives file, part, seq, n_tokens, n_docs of each, written down."""
    path, spark = path or public_tokenizers.path(VOCABULARY), df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(partitions or base.partitions(spark), F.asc_nulls_first("id"), F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("id"), F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, keys, held, size = TaskContext.get().partitionId(), 0, [], [], 0
        where, top = fs.FileSystem.from_uri(folder)
        where.create_dir(top, recursive=True)
        e = encoder(path)

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{seq:06d}.dac"
            draft = f"{top}/_{name}.{uuid.uuid4().hex}"
            with where.open_output_stream(draft) as f:
                f.write(pack(keys, held))
            where.move(draft, f"{top}/{name}")
            return pa.RecordBatch.from_pydict({"file": [name], "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_tokens": [size], "n_docs": [len(keys)]})

        for b in batches:
            ids, texts = b.column("id").to_pylist(), b.column("text")
            for k in range(0, len(ids), 256):
                for key, made in zip(ids[k : k + 256], e.encode(texts[k : k + 256].to_pylist())):
                    made = np.r_[made, np.uint32(END)].astype(np.uint32)
                    if keys and size + len(made) > FILE_TOKENS:
                        yield flush()
                        seq, keys, held, size = seq + 1, [], [], 0
                    keys.append(key)
                    held.append(made)
                    size += len(made)
        if keys:
            yield flush()

    return base.materialize(rows.mapInArrow(run, "file string, part int, seq int, n_tokens long, n_docs long"), "dac-files")


def read_back(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian uint32) of every document in the files that write() lists."""
    # Tokens before a file: those of the parts before, a row for each write task, and those of the part's own files before.
    parts = base.materialize(files.groupBy("part").agg(F.sum("n_tokens").alias("n")), "dac-parts")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a number for each write task
    parts = parts.select("part", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("part", "file", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)).alias("inside")).join(parts, "part")
    placed = placed.select("file", (F.col("ahead") + F.col("inside")).alias("first")).repartition(base.partitions(files.sparkSession), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, first in zip(b.column("file").to_pylist(), b.column("first").to_pylist()):
                with where.open_input_stream(f"{top}/{name}") as f:
                    r = Reader(f.read())
                for k in range(0, len(r.keys), 1024):
                    at = range(k, min(k + 1024, len(r.keys)))
                    ids = [r.slice(int(r.starts[j]), int(r.starts[j + 1])) for j in at]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([None if r.none[j] else int(r.keys[j]) for j in at], pa.int64()),
                        "start": pa.array([first + int(r.starts[j]) for j in at], pa.int64()),
                        "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                        "ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                    })

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op8_dac_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{base.shared_dir(spark)}/veilspark/dac-{uuid.uuid4().hex}"
    base.keep_until_exit(spark, folder)
    files = write(base.read(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    return read_back(files, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op8_dac_output": op8_dac_output}
ORACLE: dict[str, str] = {}
