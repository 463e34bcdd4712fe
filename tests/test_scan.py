"""The pass over a table: the same spans as the rules' SQL form, and each text scanned once."""

import random

from pyspark.sql import functions as F

from veilspark.operators import entropy, masking, scan, spans
from veilspark.sources import work

BITS = [
    "a@b.org", "é", "😀", "sk-" + "aB3" * 9, "BEARER " + "x1Y" * 9, "13800138000", "4111 1111 1111 1111", "4111111111111111", "+1 (202) 555-0100", "q8Zk3Vx9Lm2Pw7",
    "-----BEGIN PRIVATE KEY-----\nab\n-----END PRIVATE KEY-----", "token = 'abcdefgh1'", "ſk-aaa", " ", "\n", "7", "_", "postgres://u:p@h/😀x", "ghp_" + "a1" * 12, "AKIA" + "A1" * 8, "K", "=",
]


def texts(spark):
    rng = random.Random(5)
    odd = [(k, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 12)))) for k in range(400)]
    return spark.createDataFrame([*odd, (400, None), (401, ""), (402, "é q8Zk3Vx9Lm2Pw7 a@b.org " * 40)], "doc_id long, text string")


def test_a_pass_gives_the_spans_of_the_sql_form(spark):
    df, costs = texts(spark), entropy.english()
    for flags in (spans.FLAGS, "PB", "H"):
        form = df.select("doc_id", F.explode(F.expr(spans.candidates_sql("text", flags, costs))).alias("s")).select("doc_id", "s.*")
        assert sorted(map(tuple, spans.candidates(df, flags, costs=costs).collect())) == sorted(map(tuple, form.collect()))


def test_tokens_end_with_their_text(spark):
    df = spark.createDataFrame([(1, "q8Zk3"), (2, "Vx9Lm2Pw7"), (3, ""), (4, "sk"), (5, "-" + "aB3" * 9), (6, "é q8Zk3Vx9Lm2Pw7")], "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.start, r.end, r.label) for r in spans.candidates(df, costs=entropy.english()).collect())
    assert (6, 2, 16, "ENTROPY") in got and all(d in (2, 5, 6) for d, *_ in got)


def test_a_text_is_scanned_once_for_masking(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(work, "written", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    found = masking.found(texts(spark), "k", F.floor(F.col("doc_id") / 64), costs=entropy.english())
    assert plans[0].count("ArrowEvalPython") == 1 and "Filter (" not in plans[0]
    assert found.count() > 100 and found.where(F.size("spans") == 0).count() == 0


def test_one_match_is_placed_where_its_value_stands_twice(spark):
    key = "sk-" + "aB3" * 9
    df = spark.createDataFrame([(1, f"x{key} {key} end"), (2, f"é {key}")], "doc_id long, text string")
    got = sorted((r.doc_id, r.start) for r in spans.spans(df, spans.BY_NAME["apikey"]).collect())
    assert got == [(1, len(key) + 2), (2, 2)]


def test_bytes_that_are_no_text(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(concat(X'61ff20', cast('a@b.org' AS binary)) AS string) AS text")
    assert [(r.start, r.label) for r in spans.candidates(df, costs=entropy.english()).collect()] == [(3, "EMAIL")]
    assert scan.with_candidates(df.where("false"))[0].count() == 0
