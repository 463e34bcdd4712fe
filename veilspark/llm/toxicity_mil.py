"""Toxicity by multiple-instance learning.

A document is a bag of sentences; a label says only whether some sentence of it is toxic. A sentence's score is a
logistic function of its words and their beginnings, and a document's is their noisy-or over all its sentences, 1 - (1 - LEAK) prod(1 - q),
q being what of the score is above PLAIN, as a share of what can be: sentences up to PLAIN, however many, don't add up to toxicity.
Weights, of either sign, are fitted to the labels by gradient descent on the document loss, twice: over the words that tell the classes
apart most, with an L1 penalty, then over those that kept a weight. The sentences with a score of at least 0.5 are reported as the offending ones.

The fit is the one bounded part: SAMPLE labelled rows of each class at most, the first in hash order, of texts up to SAMPLE_CHARS
characters. Words are counted and sentences turned to numbers of words where the texts are; the driver gets at most FEATURES words
and the numbers. Labels are only learned from rows outside the held-out fold. Scoring is a narrow map over all rows and whole texts.

Defined results: null and empty texts score LEAK. Texts of any length are scored whole. Equal texts have equal scores. Labels that are
null or of unknown documents are not used; of repeated labels the higher one counts. Without labels of both classes every score is LEAK.
Extra columns are kept; new ones take an underscore in front where df has the name, in any case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base as base

#: Bounds of the sample that the classifier is fitted on: documents a class, characters of one, words that are weighed.
SAMPLE, SAMPLE_CHARS, FEATURES = 3000, 20_000, 6000
#: Documents of one class that a word must stand in, and how many times likelier there than in the other; share of the largest weight that
#: a word needs to be kept. L1 penalty, as a share of the documents of label 1, and in documents, of which the larger holds.
LEAST_DOCS, LEAST_ODDS, EVIDENCE, PENALTY, LEAST_PENALTY = 4, 4.0, 0.1, 0.0002, 0.1
#: Highest bias of a sentence, and the leak while fitting.
BIAS, FIT_LEAK = -7.0, 1e-6
LEAK, FOLDS = 0.001, 5
#: What a plain sentence may score: only what is above it counts for the document, so that no number of plain sentences adds up to toxicity.
PLAIN = 0.02
#: Lengths of the beginnings of words.
PREFIXES = (6,)
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _descend(word: np.ndarray, sentence: np.ndarray, doc: np.ndarray, plain: np.ndarray, y: np.ndarray, weight: np.ndarray, words: int, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """word, sentence: the entries; doc: each sentence's document; plain: sentences of each document without entries; weight: of each
    document. Adam with a proximal step."""
    w, b = np.zeros(words), BIAS
    m, v = np.zeros(words + 1), np.zeros(words + 1)
    for t in range(1, rounds + 1):
        z = b + np.bincount(sentence, w[word], len(doc))
        a = np.bincount(doc, _softplus(z), len(y)) + plain * _softplus(b) + FIT_LEAK
        slope = np.where(y > 0, -1 / np.expm1(np.clip(a, 1e-9, 50)), 1.0) * weight  # of the loss by a
        dz = slope[doc] * _sigmoid(z)
        g = np.r_[np.bincount(word, dz[sentence], words), dz.sum() + (slope * plain).sum() * _sigmoid(np.float64(b))]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.2 / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        move = step * m / (1 - 0.9**t)
        w, b = w - move[:-1], max(2 * BIAS, min(BIAS, b - move[-1]))
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(step[:-1], 1e3) * penalty, 0)
    return w, b


def _features(word: str) -> list[str]:
    """The word and its beginnings, which inflected forms share."""
    return [word, *("^" + word[:k] for k in PREFIXES if len(word) >= k)]


def _all_features(text: str) -> set[str]:
    return {f for x in set(_WORD.findall(text.lower())) for f in _features(x)}


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -3.0

    def __post_init__(self) -> None:
        """Weights of words and of beginnings apart. No word of a text is remembered: a corpus has no end of them."""
        starts = {f[1:] for f in self.weights if f.startswith("^")}
        self.starts = [(k, some) for k in PREFIXES if (some := {f for f in starts if len(f) == k})]

    def _known(self, words: list[str]) -> list[str]:
        """Those that have any weight."""
        of = self.weights
        if not self.starts:
            return [x for x in words if x in of]
        if len(self.starts) == 1:
            k, starts = self.starts[0]
            return [x for x in words if x in of or x[:k] in starts]
        return [x for x in words if x in of or any(x[:k] in starts for k, starts in self.starts)]

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, score) of all sentences; code points, end exclusive."""
        if not self.weights or not text:
            return []
        low = text.lower()
        if len(low) != len(text):  # a few letters grow when lowered: keep the places of the original
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        out, least = [], float(_sigmoid(np.float64(self.bias)))
        for s in _SENTENCE.finditer(low):
            known = self._known(_WORD.findall(s.group()))
            p = least
            if known:
                found = {f for x in known for f in _features(x) if f in self.weights}
                p = float(_sigmoid(np.float64(self.bias + sum(self.weights[f] for f in found))))
            out.append((s.start(), s.end(), p))
        return out

    def score(self, sentences: list[tuple[int, int, float]]) -> float:
        calm = 1 - LEAK
        for _, _, p in sentences:
            calm *= min(1.0, (1 - p) / (1 - PLAIN))
        return min(1.0, max(0.0, 1 - calm))


def counted(texts: list[str | None], labels: list[int]) -> dict[str, list[int]]:
    """Documents of either class that each feature stands in."""
    out: dict[str, list[int]] = {}
    for t, y in zip(texts, labels):
        for f in _all_features(t or ""):
            out.setdefault(f, [0, 0])[y] += 1
    return out


def strength(ones, zeros, n_ones: int, n_zeros: int):
    """How much a feature tells the classes apart, 0 if too little; for numbers and for columns."""
    up = (ones + 0.5) / (n_ones + 1) / ((zeros + 2) / (n_zeros + 1))
    down = (zeros + 0.5) / (n_zeros + 1) / ((ones + 2) / (n_ones + 1))
    far = ones / max(1, n_ones) - zeros / max(1, n_zeros)
    return up, down, far


def bag(text: str | None, index: dict[str, int]) -> tuple[list[list[int]], int]:
    """(numbers of the known features of each sentence that has any, number of the other sentences)."""
    every = [[index[f] for f in _all_features(s) if f in index] for s in _SENTENCE.findall((text or "").lower())]
    some = [x for x in every if x]
    return some, len(every) - len(some)


def train(names: list[str], bags: list[tuple[list[list[int]], int]], labels: list[int], share: float) -> Model:
    """share: of label 1 in what the rows are a sample of."""
    y, plain = np.array(labels, float), np.array([n for _, n in bags], float)
    weight = np.where(y > 0, share / y.sum(), (1 - share) / (1 - y).sum())
    weights, bias, kept = np.zeros(len(names)), BIAS, np.ones(len(names), bool)
    whole = max(LEAST_PENALTY, PENALTY * y.sum())
    for penalty, rounds in ((whole, 150), (whole / 10, 250)):
        place = np.cumsum(kept) - 1
        word, sentence, doc, more = [], [], [], plain.copy()
        for d, (bag_, _) in enumerate(bags):
            for s in bag_:
                if hit := [place[f] for f in s if kept[f]]:
                    word += hit
                    sentence += [len(doc)] * len(hit)
                    doc.append(d)
                else:
                    more[d] += 1
        if not doc:
            return Model()
        found, bias = _descend(np.array(word), np.array(sentence), np.array(doc), more, y, weight, int(kept.sum()), penalty * share / y.sum(), rounds)
        weights = np.zeros(len(names))
        weights[kept] = found
        kept = np.abs(weights) > EVIDENCE * np.abs(weights).max()
        if not (weights[kept] > 0).any():
            return Model()
    return Model({names[k]: float(weights[k]) for k in np.flatnonzero(kept)}, float(bias))


def fit_texts(rows: list[tuple[str, int]], share: float | None = None) -> Model:
    """The fit for (text, label) at hand."""
    labels = [y for _, y in rows]
    n_ones, n_zeros = sum(labels), len(labels) - sum(labels)
    if not n_ones or not n_zeros:
        return Model()
    chosen = []
    for f, (zeros, ones) in counted([t for t, _ in rows], labels).items():
        up, down, far = strength(ones, zeros, n_ones, n_zeros)
        if ones >= LEAST_DOCS and up >= LEAST_ODDS or zeros >= LEAST_DOCS and down >= LEAST_ODDS:
            chosen.append((-abs(far), f))
    names = sorted(f for _, f in sorted(chosen)[:FEATURES])
    index = {f: k for k, f in enumerate(names)}
    return train(names, [bag(t, index) for t, _ in rows], labels, n_ones / len(rows) if share is None else share)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from labels (doc_id, toxic) outside the held-out fold."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    known = known.withColumnRenamed("doc_id", "_label_id")
    short = docs.where(F.length(text_col) <= SAMPLE_CHARS).select(F.col(id_col).cast("long").alias("_id"))
    rows = known.join(short, F.col("_label_id") == F.col("_id"), "left_semi")
    chosen = None
    for y in (0, 1):
        some = rows.where(F.col("y") == y).orderBy(F.xxhash64("_label_id"), "_label_id").limit(SAMPLE)
        chosen = some if chosen is None else chosen.unionByName(some)
    by = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = by.get(1, 0) / max(1, by.get(0, 0) + by.get(1, 0))
    # 2 SAMPLE ids at most, so the texts need no exchange.
    picked = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    picked = base.materialize(picked.join(F.broadcast(chosen), F.col("_id") == F.col("_label_id")).groupBy("_id").agg(F.min("text").alias("text"), F.max("y").alias("y")), "toxic-sample")
    sizes = {r.y: r.n for r in picked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in base.sliced(batches):
            some = counted(b.column("text").to_pylist(), b.column("y").to_pylist())
            yield pa.RecordBatch.from_pydict({"f": pa.array(some.keys(), pa.string()), "zeros": pa.array([n[0] for n in some.values()], pa.int64()), "ones": pa.array([n[1] for n in some.values()], pa.int64())})

    counts = picked.select("text", "y").mapInArrow(count, "f string, zeros long, ones long").groupBy("f").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    up, down, far = strength(F.col("ones"), F.col("zeros"), sizes[1], sizes[0])
    told = counts.where(((F.col("ones") >= LEAST_DOCS) & (up >= LEAST_ODDS)) | ((F.col("zeros") >= LEAST_DOCS) & (down >= LEAST_ODDS)))
    names = sorted(r.f for r in told.orderBy(F.desc(F.abs(far)), "f").limit(FEATURES).select("f").collect())
    index = {f: k for k, f in enumerate(names)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in base.sliced(batches):
            made = [bag(t, index) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"_id": b.column("_id"), "y": b.column("y"), "bags": pa.array([x for x, _ in made], pa.list_(pa.list_(pa.int32()))), "plain": pa.array([n for _, n in made], pa.int32())})

    got = picked.mapInArrow(bags, "_id long, y int, bags array<array<int>>, plain int").toPandas().sort_values("_id")
    return train(names, [([list(s) for s in x], n) for x, n in zip(got["bags"], got["plain"])], got["y"].tolist(), share)


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with score, predicted and offending [(start, end, score)]."""
    new = base.output_names(df, "score", "predicted", "offending")
    at = df.columns.index(text_col)
    schema = f"{df._jdf.schema().toDDL()}, `{new[0]}` double, `{new[1]}` int, `{new[2]}` array<struct<start:int,end:int,score:double>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in base.sliced(batches):
            scores, where = [], []
            for t in b.column(at):  # the sentences of one text at a time
                found = model.sentences(t.as_py())
                scores.append(model.score(found))
                where.append([{"start": s, "end": e, "score": p} for s, e, p in found if p >= 0.5])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(where, kind)], names=[*b.schema.names, *new])

    return df.mapInArrow(run, schema)


def op10_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, base.read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "offending")


QUERIES = {"op10_toxicity_mil": op10_toxicity_mil}
ORACLE: dict[str, str] = {}
