"""Masking fails closed; in-row algebra equals the one over rows; running values; long texts with many matches."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import TINY
from veilspark.functions.arrays import over, running_max, running_sum
from veilspark.operators import entropy, intervals, masking, spans, vault
from veilspark.plans import detection
from veilspark.sources import work

TOKEN = "{{RG_EMAIL_QX7ZK2VWJ4PTM3YB}}"


def masked(spark, texts, limit, flags="E"):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    scope = F.floor(F.col("doc_id") / 10).cast("long")
    found = masking.found(df, "k", scope, spans.candidates_sql("_text", flags))
    return df, found, scope


def test_a_refused_scope_never_comes_out_in_clear(spark):
    texts = [(1, "mail a@x.org and b@x.org"), (2, "no value here"), (11, "mail a@x.org"), (12, None), (21, "a@x.org a@x.org")]
    df, found, scope = masked(spark, texts, 1)
    got = {r.doc_id: r for r in masking.redact(df, found, scope, 1).collect()}
    assert got[1].redacted_text is None and got[2].redacted_text is None and {got[1].error, got[2].error} == {"request_too_large"}
    assert got[11].error == got[12].error == got[21].error == "" and got[12].redacted_text is None
    assert all("@x.org" not in (r.redacted_text or "") for r in got.values())
    assert {(r.scope, r.n_values) for r in masking.refused(found, 1).collect()} == {(0, 2)}
    assert {r.scope for r in masking.values(df, found, 1).collect()} == {1, 2}
    back = vault.restore(masking.redact(df, found, scope, 1).select("doc_id", F.col("redacted_text").alias("text")), masking.values(df, found, 1), scope)
    assert {r.doc_id: r.restored_text for r in back.collect()} == {1: None, 2: None, 11: "mail a@x.org", 12: None, 21: "a@x.org a@x.org"}


def test_nothing_written_holds_a_value_and_folders_go(spark):
    before = work.held()
    df, found, scope = masked(spark, [(k, f"mail secret{k}@hidden.org ok") for k in range(50)], 100)
    assert not any("hidden.org" in str(r) for r in found.collect())
    path = work._KEPT[-1][1].removeprefix("file:").replace("//", "/")
    assert os.path.isdir(path)
    work.release(before)
    assert not os.path.exists(path) and work.held() == before


COUNTED = ["redacted_text", "restored_text", "restored", "restored_unique", "unresolved", "degraded"]
#: E-mail addresses, under another label in texts that begin with an x.
BY_TEXT = f"transform({spans.candidates_sql('_text', 'E')}, c_ -> named_struct('start', c_.start, 'end', c_.end, 'value', c_.value, 'label', CASE WHEN _text LIKE 'x%' THEN 'OTHER' ELSE c_.label END, 'priority', c_.priority))"


def both_ways(spark, texts, limit):
    """round_trip() by id, and what redact(), values() and restore() give one after the other."""
    df, scope = spark.createDataFrame(texts, "doc_id long, text string"), F.floor(F.col("doc_id") / 10).cast("long")
    found = masking.found(df, "k", scope, BY_TEXT)
    long_way = vault.restore(masking.redact(df, found, scope, limit), masking.values(df, found, limit), scope, text_col="redacted_text")
    rows = lambda x: {r.doc_id: tuple(r)[1:] for r in x.select("doc_id", *COUNTED).collect()}
    return rows(masking.round_trip(df, "k", scope, limit, BY_TEXT)), rows(long_way)


def test_a_round_trip_in_the_row_equals_the_long_way(spark):
    texts = [
        (1, "x a@x.org b@x.org a@x.org"), (2, "a@x.org, é c@x.org"), (3, "none"), (4, None), (5, ""), (11, "a@x.org"), (12, "x a@x.org"), (13, "{a@x.org} {{b@x.org}} \\a@x.org\\"),
        (21, "a@x.org b@x.org c@x.org d@x.org"), (22, "no value"), (31, " ".join(f"a{k % 3}@x.org" for k in range(300))), (41, "x a@x.org a@x.org a@x.org a@x.org"),
    ]
    got, want = both_ways(spark, texts, 3)
    assert got == want and got[21] == got[22] == (None, None, 0, 0, 0, 0)
    assert got[1][0].startswith("x {{RG_OTHER_") and got[2][0].startswith("{{RG_OTHER_") and got[11][0].startswith("{{RG_EMAIL_") and got[12][0] == f"x {got[11][0]}"  # the label of the first place
    assert all(got[k][1] == text for k, text in texts if k not in (21, 22)) and got[31][2:4] == (300, 3) and got[41][3] == 1
    # Placeholders that stand in a text are restored too, where their scope knows them.
    own, none = got[11][0], "{{RG_EMAIL_AAAAAAAAAAAAAAAA}}"
    texts += [(14, f"{own} and {own.lower()} e@x.org {none}"), (15, f"{own[2:]}13800138000 f@x.org"), (51, f"{own} a@x.org"), (23, own), (61, " ".join(f"a{k}@x.org" for k in range(6))), (62, own)]
    got, want = both_ways(spark, texts, 5)
    assert got == want and len(got) == len(texts) and got[61] == got[62] == (None, None, 0, 0, 0, 0)
    assert got[14][1:] == (f"a@x.org and a@x.org e@x.org {none}", 3, 2, 1, 1) and got[51][1:] == (f"{own} a@x.org", 1, 1, 1, 0) and got[23][1:] == (own, 0, 0, 1, 0)


def test_exceptions_are_scopes_beyond_the_limit_and_values_with_two_labels(spark):
    found = spark.createDataFrame([(1, 0, [(0, 1, "EMAIL", "A")]), (2, 0, [(0, 1, "CARD", "B"), (3, 4, "CARD", "C")]), (3, 1, [(0, 1, "CARD", "A")]), (4, 0, [(0, 1, "PHONE", "C")])], "doc_id long, scope long, spans array<struct<start:int,end:int,label:string,hash:string>>")
    assert [(r.scope, r.refused, r.labels) for r in masking.exceptions(found, 9).collect()] == [(0, False, {"C": "CARD"})]
    assert [(r.scope, r.refused, r.labels) for r in masking.exceptions(found, 2).collect()] == [(0, True, None)]


def test_no_text_is_exchanged_to_bring_it_back(spark):
    """Documents and keys are dealt out; nothing is joined to texts but what is small."""
    for query in (detection.restored_counts, detection.roundtrip_diff):
        plan = query(spark, TINY)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(") == plan.count("REPARTITION_BY_NUM") == 2 and "SortMergeJoin" not in plan
        assert plan.count("ArrowEvalPython") == 2 and "ShuffledHashJoin" not in plan  # once for each of the two


def test_limited_tells_whom_to_refuse(spark):
    found = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "a")], "scope long, raw string")
    kept, beyond = vault.limited(found, 1)
    assert {r.scope for r in kept.collect()} == {2} and [tuple(r) for r in beyond.collect()] == [(1, 2)]


def test_placeholders_stay_as_they_are(spark):
    texts = [(1, f"postgres://root:{TOKEN}@db.example.com/app"), (2, f"{TOKEN} {TOKEN.lower()}"), (3, f"a@b.org{TOKEN}c@d.org")]
    df, found, scope = masked(spark, texts, 9, "EG")
    got = {r.doc_id: r.redacted_text for r in masking.redact(df, found, scope).collect()}
    assert got[1].count("{{RG_CONNSTR_") == 2 and TOKEN in got[1] and "root" not in got[1]
    assert got[2] == texts[1][1] and TOKEN in got[3] and got[3].count("{{RG_EMAIL_") == 3


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_running_values(spark, n):
    rng = random.Random(n)
    values = [rng.randint(0, 99) for _ in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    s, m = df.select(over(F.col("v"), "a_", running_sum("a_")), over(F.col("v"), "a_", running_max("a_"))).first()
    assert s == [sum(values[: k + 1]) for k in range(n)] and m == [max(values[: k + 1]) for k in range(n)]


def test_algebra_in_a_row_equals_that_over_rows(spark):
    rng = random.Random(3)
    spot = lambda: (a := rng.randint(0, 60), a + rng.randint(1, 9), rng.choice("XYZ"), rng.randint(1, 3))
    rows = [(d, [spot() for _ in range(rng.choice([0, 1, 3, 9, 300]))]) for d in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, f array<struct<start:int,end:int,label:string,priority:int>>")
    flat = df.select("doc_id", F.explode("f").alias("s")).select("doc_id", "s.*")
    listed = lambda x: sorted(map(tuple, x.select("doc_id", "start", "end", "label").collect()))
    opened = lambda c: df.withColumn("p", F.expr(cuts)).select("doc_id", F.explode(c).alias("s")).select("doc_id", "s.*")
    cuts = "transform(sequence(0, 9), i -> named_struct('start', cast(i * 7 + 2 AS int), 'end', cast(i * 7 + 4 AS int)))"
    assert listed(intervals.merge(flat)) == listed(opened(intervals.merged(F.col("f"))))
    protected = df.select("doc_id", F.explode(F.expr(cuts)).alias("p")).select("doc_id", "p.*")
    assert listed(intervals.difference(intervals.merge(flat), protected)) == listed(opened(intervals.without(intervals.merged(F.col("f")), F.col("p"))))


def test_one_or_two_spans_merge_as_over_rows(spark):
    rng = random.Random(8)
    spot = lambda: (a := rng.randint(0, 6), a + rng.randint(1, 5), rng.choice("XYZ"), rng.randint(1, 3))
    df = spark.createDataFrame([(d, [spot() for _ in range(rng.choice([1, 2, 2]))]) for d in range(400)], "doc_id long, f array<struct<start:int,end:int,label:string,priority:int>>")
    listed = lambda x: sorted(map(tuple, x.select("doc_id", "start", "end", "label").collect()))
    rows = intervals.merge(df.select("doc_id", F.explode("f").alias("s")).select("doc_id", "s.*"))
    assert listed(rows) == listed(df.select("doc_id", F.explode(intervals.merged(F.col("f"))).alias("s")).select("doc_id", "s.*"))


def test_an_issued_placeholder_is_told_at_once(spark):
    long = "A" * 32
    texts = [f"a {TOKEN} b", f"{{{TOKEN}}}", TOKEN + "x", f"\\{TOKEN}\\", f"{{{{RG_{long}_QX7ZK2VWJ4PTM3YB}}}}", f"{{{{RG_{long}A_QX7ZK2VWJ4PTM3YB}}}}", "{{RG_A_B_QX7ZK2VWJ4PTM3YB}}", TOKEN.lower(), TOKEN[:-1], TOKEN + TOKEN, "é😀" + TOKEN]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, vault.placeholders(df).collect()))
    want = [(0, 2, 31, TOKEN, False), (1, 1, 30, TOKEN, False), (2, 0, 29, TOKEN, False), (3, 1, 30, TOKEN, False), (4, 0, 56, texts[4], False), (6, 0, 27, "{{RG_AB_QX7ZK2VWJ4PTM3YB}}", True), (7, 0, 29, TOKEN, True), (8, 0, 28, TOKEN, True), (9, 0, 29, TOKEN, False), (9, 29, 58, TOKEN, False), (10, 2, 31, TOKEN, False)]
    assert [x for x in got if x[0] != 5] == want and [x[3] for x in got if x[0] == 5] == [None]


def test_many_matches_in_one_text(spark):
    text = " ".join(f"a{k}@x{k}.org é" for k in range(10_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans.spans(df, spans.BY_NAME["email"]).count()
    began = time.time()
    got = spans.spans(df, spans.BY_NAME["email"]).collect()
    assert len(got) == 10_000 and all(text[r.start : r.end] == r.value for r in got)
    assert time.time() - began < 30


def test_nulls_and_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "😀 x@y.org"), (4, "'\\ \" $ x@y.org")], "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.end) for r in spans.candidates(df, costs=entropy.english()).collect())
    assert got == [(3, 2, 9), (4, 7, 14)]
