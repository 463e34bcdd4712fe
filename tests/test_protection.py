"""Placeholders in texts that are masked, bodies that are restored, responses, times, the log's folders, coverage over rule sets."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from tests.conftest import TINY
from veilspark.functions import net
from veilspark.operators import entropy, intervals, jsondoc, spans, vault
from veilspark.plans import detection
from veilspark.sources import tables

TOKEN = "{{RG_EMAIL_QX7ZK2VWJ4PTM3YB}}"


def test_placeholders_are_not_masked_again(spark):
    texts = [f"see {TOKEN} ok", f"postgres://root:{TOKEN}@db.example.com/app", f"a@b.org {TOKEN} c@d.org"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = vault.unprotected(intervals.merge(spans.candidates(df, costs=entropy.english())), df)
    got = sorted((r.doc_id, texts[r.doc_id][r.start : r.end]) for r in left.collect())
    assert got == [(1, "@db.example.com/app"), (1, "postgres://root:"), (2, "a@b.org"), (2, "c@d.org")]


def test_bodies_are_restored_layer_by_layer(spark):
    raw = 'x"y\\z\n'
    v = spark.createDataFrame([(1, raw, TOKEN)], "scope long, raw string, token string")
    inner = json.dumps({"b": f"<{TOKEN}>", "n": 1.50})
    bodies = [json.dumps({"a": TOKEN, "arguments": inner}), f"no json {TOKEN}", json.dumps({"a": "plain"})]
    df = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, body string")
    got = {r.doc_id: r.body for r in jsondoc.restored(df, v, F.lit(1)).collect()}
    first = json.loads(got[0])
    assert first["a"] == raw and json.loads(first["arguments"]) == {"b": f"<{raw}>", "n": 1.5}
    assert got[1] == f"no json {raw}" and got[2] == bodies[2]


def test_responses(spark):
    rows = [(204, "text/plain", None, 1, "empty"), (200, "image/png", "gzip", 9, "untouched"), (200, "application/json", "gzip", 1, "encoded_response"), (200, "text/html", " Identity ", 1, "text"), (200, "application/problem+json", None, 1, "json"), (200, "text/plain", None, 11, "response_too_large"), (200, None, None, 1, "untouched")]
    df = spark.createDataFrame(rows, "s int, t string, e string, n int, want string")
    assert all(r.got == r.want for r in df.select("want", net.response_class(F.col("s"), F.col("t"), F.col("e"), F.col("n"), 10).alias("got")).collect())


def test_times(spark):
    rows = ["1970-01-01T00:00:00Z", "2024-02-29T23:59:59.123456+02:00", "1969-12-31T23:59:59.5Z", "2024-13-01T00:00:00Z", "yesterday", "2024-01-01t00:00:00z"]
    want = [0, 1709243999123, -500, None, None, 1704067200000]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, t string").withColumn("ms", net.epoch_ms(F.col("t"))).withColumn("back", net.rfc3339(F.col("ms")))
    got = df.orderBy("k").collect()
    assert [r.ms for r in got] == want
    assert [r.back for r in got] == ["1970-01-01T00:00:00Z", "2024-02-29T21:59:59.123Z", "1969-12-31T23:59:59.5Z", None, None, "2024-01-01T00:00:00Z"]


def test_headers_in_any_case(spark):
    df = spark.sql("SELECT map('connection', 'X-Hop1, close', 'CONNECTION', 'x-hop2', 'X-Hop1', 'a', 'x-HOP2', 'b', 'Accept', 'c') AS h")
    r = df.select(net.request_headers(F.col("h")).alias("q"), net.response_headers(F.col("h")).alias("s")).first()
    assert r.q == r.s == {"Accept": "c"}


def test_only_days_of_the_window_are_read(spark, tmp_path):
    path = str(tmp_path / "log")
    start = dt.datetime(2024, 3, 1)
    rows = spark.range(40).select("id", F.expr(f"timestamp'{start}' + make_interval(0, 0, 0, cast(id as int))").alias("ts"))
    tables.append_audit(rows, path)
    since = start + dt.timedelta(days=38)
    recent = tables.scan_audit(spark, path, since)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert recent.count() == 2 and "PartitionFilters: []" not in plan and "day" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert tables.drop_expired(spark, path, (start + dt.timedelta(days=10)).date()) == 10
    assert tables.scan_audit(spark, path).count() == 30


def test_coverage_is_monotone_over_rule_sets(spark):
    rng = random.Random(3)
    text = "mail a.b@x.org key sk-" + "a1B2" * 8 + " card 4111 1111 1111 1111 phone +12025550100 token = 'abcdefgh12345' https://u:p@h/x 13800138000 q8Zk3Vx9Lm2Pw7"
    df = spark.createDataFrame([(1, text), (2, text.replace(" ", "-")), (3, text[::-1])], "doc_id long, text string")
    costs = entropy.english()
    merged = {}

    def of(flags):
        if flags not in merged:
            merged[flags] = intervals.merge(spans.candidates(df, flags, costs=costs)).collect()
        return merged[flags]

    inside = lambda small, large: all(any(b.doc_id == a.doc_id and b.start <= a.start and b.end >= a.end for b in large) for a in small)
    for _ in range(6):
        some = "".join(f for f in spans.FLAGS if rng.random() < 0.5)
        more = "".join(f for f in spans.FLAGS if f in some or rng.random() < 0.5)
        assert inside(of(some), of(more)), (some, more)
    planted = spark.createDataFrame([(1, 3, 9)], "doc_id long, start int, end int")
    assert intervals.uncovered_by(planted, planted.select("doc_id", F.lit(4).alias("start"), "end")).count() == 1


def test_all_flags_are_checked_in_one_scan(spark):
    some = [[(0, 9, "EMAIL", 90), (4, 12, "PHONE", 88)], [(2, 5, "CARD", 85)], [], [(k * 3, k * 3 + 2, "ENTROPY", 10) for k in range(400)]]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, found array<struct<start:int,end:int,label:string,priority:int>>")
    assert detection.uncovered_flags(df).count() == 0
    parts = "array<struct<start:int,end:int,label:string>>"
    rng = random.Random(5)
    cut = lambda: [(a, a + rng.randint(1, 6), "X") for a in range(0, 2000, 7) if rng.random() < 0.6]
    pairs = [([(0, 3, "X"), (3, 9, "X")], [(0, 9, "X")]), ([(0, 3, "X")], [(0, 2, "X"), (2, 3, "X")]), ([(5, 9, "X")], []), ([], [(1, 2, "X")])] + [(cut(), cut()) for _ in range(20)]
    got = spark.createDataFrame(pairs, f"a {parts}, b {parts}").select("a", "b", F.expr(intervals.outside_sql("a", "b")).alias("c")).collect()
    assert all([(x.start, x.end) for x in r.c] == [(x.start, x.end) for x in r.a if not any(y.start <= x.start and y.end >= x.end for y in r.b)] for r in got) and any(r.c for r in got)
    plan = detection.coverage_monotone(spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 1 and "Join" not in plan


def test_tokens_are_scored_as_single_strings_are(spark):
    rng, costs = random.Random(8), entropy.english()
    made = ["".join(rng.choice(rng.choice(["abcdefghijklmnop", "0123456789abcdef", "aeiouRSTLN", "0123456789"])) for _ in range(rng.choice([9, 10, 13, 16, 31, 32, 33, 127, 128, 129, 400]))) for _ in range(800)]
    texts = [(k, " é, ".join(made[k * 4 : k * 4 + 4])) for k in range(200)] + [(900, None), (901, ""), (902, "short words")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    one = spans.spans(df, spans.TOKEN, keep=lambda v: entropy.is_random_sql(v, costs))
    want, got = (sorted(map(tuple, x.collect())) for x in (one, entropy.random_tokens(df, costs)))
    assert got == want and 100 < len(got) < 800
