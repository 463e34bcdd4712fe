"""Literal cases of the rules, intervals and placeholders."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.functions import net
from veilspark.functions import validators as V
from tests.conftest import TINY
from veilspark.operators import entropy, intervals, spans, vault
from veilspark.plans import detection


def found(spark, text, flags, costs=None):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r.value, r.label) for r in spans.candidates(df, flags, costs=costs).orderBy("start").collect()]


@pytest.mark.parametrize(
    ("value", "flag", "hit"),
    [
        ("+86 138 0013 8000", "P", True), ("+1234567890123456", "P", False), ("13800138000", "P", True), ("138001380001", "P", False),
        ("4111 1111 1111 1111", "B", True), ("0000000000000000", "B", False), ("4111111111111112", "B", False), ("11010519491231002X", "I", True),
        ("110105199902310029", "I", False), ("a@b.co", "E", True), ("a@b", "E", False), ("sk-" + "a" * 20, "S", True), ("xsk-" + "a" * 20, "S", False),
        ("ésk-" + "a" * 20, "S", True), ("AKIA" + "B" * 16, "G", True), ("redis://h:1/2", "G", True), ("Bearer " + "t" * 20, "G", True), ("plain text", "PSIBEG", False),
    ],
)
def test_rule(spark, value, flag, hit):
    got = found(spark, f"see {value} now", flag)
    assert bool(got) == hit
    if hit:
        assert value.lstrip("é") in [v for v, _ in got]


def test_disabled_rules_find_nothing(spark):
    assert found(spark, "a@b.co 13800138000", "S") == []


def test_null_and_empty_texts_have_no_spans(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert spans.candidates(df).count() == 0


@pytest.mark.parametrize(
    ("lexeme", "digits"),
    [
        ("1.3800138e10", "13800138000"), ("0.00013800138e14", "13800138000"), ("13800138000.1", None), ("-13800138000", None), ("1e99999999999999999999", None),
        ("4111111111111111.000", "4111111111111111"), ("13800138000", "13800138000"), ("138001380000e-1", "13800138000"), ("123", None), ("0e5", None),
    ],
)
def test_exact_integer(spark, lexeme, digits):
    assert spark.range(1).select(V.exact_integer(F.lit(lexeme))).first()[0] == digits


def test_random_strings_and_words(spark):
    costs = entropy.english()
    values = ["a9X2m7K4pQ", "a9X2m7K4", "RequestValidationError", "configuration", "123456789012"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", entropy.is_random(F.col("v"), costs).alias("r"))
    assert {r.v: r.r for r in df.collect()} == {"a9X2m7K4pQ": True, "a9X2m7K4": False, "RequestValidationError": False, "configuration": False, "123456789012": False}


def test_random_string_quality(spark):
    rng, costs = random.Random(12345), entropy.english()
    # Distinct letters-only words of our own corpus, joined in pairs, against random strings.
    words = [w for w in dict.fromkeys("request validation error message handler service response account number configuration default option network client server session token value field parser buffer stream window table column index record update delete insert select filter order group limit offset".split())]
    joined = ["".join(rng.sample(words, 2)) for _ in range(400)]
    strings = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(200)]
    df = spark.createDataFrame([(v, 0) for v in joined] + [(v, 1) for v in strings], "v string, y int").select("y", entropy.is_random(F.col("v"), costs).cast("int").alias("r"))
    rate = {r.y: r.rate for r in df.groupBy("y").agg(F.avg("r").alias("rate")).collect()}
    assert rate[0] < 0.03 and rate[1] > 0.98


def merge_by_sweep(some):
    out = []
    for a, b, p, label in sorted(some, key=lambda s: (s[0], -s[1], -s[2], s[3])):
        if out and a < out[-1][1]:
            last = out[-1]
            out[-1] = (last[0], max(last[1], b), last[2] if last[1] >= b else "SECRET")
        else:
            out.append((a, b, label))
    return out


def test_merge_and_difference_match_a_sweep(spark):
    rng, rows, cuts = random.Random(5), [], []
    for doc in range(60):
        for _ in range(rng.randint(0, 8)):
            a = rng.randint(0, 40)
            rows.append((doc, a, a + rng.randint(1, 12), rng.choice("ABC"), rng.randint(1, 3)))
        at = 0
        while at < 50 and rng.random() < 0.8:
            a = at + rng.randint(0, 9)
            cuts.append((doc, a, a + rng.randint(1, 6)))
            at = cuts[-1][2]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, label string, priority int")
    merged = intervals.merge(df)
    got = sorted((r.doc_id, r.start, r.end, r.label) for r in merged.collect())
    want = [(d, *m) for d in range(60) for m in merge_by_sweep([(a, b, p, x) for i, a, b, x, p in rows if i == d])]
    assert got == sorted(want)
    rest = intervals.difference(merged, spark.createDataFrame(cuts, "doc_id long, start int, end int"))
    expected = []
    for d, a, b, x in want:
        free = [c for c in range(a, b) if not any(i == d and s <= c < e for i, s, e in cuts)]
        runs = [c for c in free if c - 1 not in free]
        expected += [(d, c, next(k for k in range(c, b + 1) if k not in free), x) for c in runs]
    assert sorted((r.doc_id, r.start, r.end, r.label) for r in rest.collect()) == sorted(expected)


def test_touching_spans_stay_apart(spark):
    df = spark.createDataFrame([(1, 0, 5, "A", 1), (1, 5, 9, "B", 1)], "doc_id long, start int, end int, label string, priority int")
    assert intervals.merge(df).count() == 2


def test_unknown_placeholder_stays(spark):
    df = spark.createDataFrame([(1, "{{RG_EMAIL_ABCDEFGHIJKLMNOP}} {{RG_TYPE_TOKEN}}")], "doc_id long, text string")
    none = spark.createDataFrame([], "scope int, token string, raw string")
    r = vault.restore(df, none, F.lit(1)).first()
    assert (r.restored_text, r.restored, r.unresolved) == (df.first().text, 0, 1)


def test_hosts_and_flags(spark):
    one = spark.range(1)
    assert one.select(net.normalized_hosts(F.lit(" API.Example.com. ,*.bad.com\napi.example.com"))).first()[0] == ["api.example.com"]
    for raw, want in (("EPPE", "PE"), ("GEBISPH", "HPSIBEG"), ("", ""), ("e", None)):
        assert one.select(net.canonical_flags(F.lit(raw))).first()[0] == want


def test_few_row_groups_are_dealt_out(spark):
    for made in (detection.units(spark, TINY), detection._with_samples(spark, TINY)):
        assert made.where("doc_id < 1000000").select(F.spark_partition_id()).distinct().count() > 1


def test_protected_texts_are_masked_in_their_rows(spark):
    assert "Join" not in detection.protected_redaction(spark, TINY)._jdf.queryExecution().executedPlan().toString()
