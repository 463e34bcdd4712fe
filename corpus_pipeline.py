"""Corpus pipeline over documents: toxicity, exact dedup, near-dedup, personal data, packing.

Each stage takes what the one before it kept, as a table that is written and read again, and returns the columns of documents;
the last returns the packing: a row for each piece of a document with its bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import _base as base
from veilspark.llm import exact_dedup, packing, pii_crf, simhash, toxicity_mil


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    model = toxicity_mil.fit(docs, base.read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity_mil.score(docs, model)
    return scored.where(scored[scored.columns[len(docs.columns) + 1]] == 0).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, five-word shingles alike by 0.8 or more, one stays."""
    return simhash.drop_near_duplicates(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind in brackets; n_chars counts the new text."""
    masked = pii_crf.redact(docs, pii_crf.fit(docs))
    own = [c for c in docs.columns if c.lower() == "n_chars"]
    return masked.withColumns({c: F.length("text").cast("long") for c in own}).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go into sequences of the permitted lengths."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("personal data", mask_personal_data), ("packing", pack)]

#: The classifier, the field and the packing have no SQL form. Tests compare near-dedup with brute force over all pairs; of the
#: stages together they check columns, subsets and that no equal texts are left.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, began = base.read(spark, sf_dir, "documents"), base.held()
    for name, stage in STAGES[:-1]:
        docs = base.materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        base.release(began, but=1)  # only the stage's result is read on
    return STAGES[-1][1](spark, docs, sf_dir)
