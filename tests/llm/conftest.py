import pytest
from pyspark.sql import functions as F

#: Columns whose names the operators use themselves.
CLASHES = ["size", "shard", "slot", "score", "predicted", "offending", "ids", "decoded", "base", "spans", "keep", "n_lines", "n_dropped", "kept_text", "id", "th", "fp", "name", "k1", "_row", "_h", "_th", "n_tokens", "bin", "piece", "g", "leader", "count"]
LINE = "this very line is long enough and stands in many of the documents"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, a null id, a repeated id; clashing columns, full of nulls."""
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "same  row"), (4, "same  row"), (5, "same row"), (None, "no id"), (6, "a" * 200_000), (7, "word " * 30_000),
        (8, "Über ÄÖ\x0bx y  z\n" + LINE), (8, "other text of the same id\n" + LINE), (9, LINE.upper() + "\n\n" + LINE + " \n"), (10, LINE), (11, "x\n" + LINE),
        (12, LINE + "\nend"), (-3, "mail a.b@mail.example.com and 4111 1111 1111 1111, +1 (202) 555-0100 10.0.0.1"), (13, "😀 " * 50), (14, "one"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
