"""State over time: abandoned streams, what a stream knows, caches; addresses and hosts against the standard library."""

import ipaddress
import json
import random
import time

from pyspark.sql import functions as F

from tests.conftest import TINY
from veilspark.functions import net
from veilspark.operators import sessions
from veilspark.plans import documents
from veilspark.streaming import events, sse

TOKEN = "{{RG_EMAIL_QX7ZK2VWJ4PTM3YB}}"
CHUNKS = "stream_id long, seq long, chunk string, last boolean, tokens map<string,string>"


def delta(text):
    return "data: " + json.dumps({"type": "response.output_text.delta", "output_index": 0, "delta": text}) + "\n\n"


def test_abandoned_streams_are_flushed_and_maps_are_fixed(spark, tmp_path):
    def put(name, *rows):
        spark.createDataFrame(rows, CHUNKS).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    put("0", (1, 0, delta("hi " + TOKEN[:12]), False, {TOKEN: "a@x.org"}), (2, 0, delta("to " + TOKEN[:9]), False, {TOKEN: "b@x.org"}), (3, 0, delta("end"), True, None))
    stream = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = sse.restore_stream(stream, idle_ms=30_000).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()

    def until(test, seconds=150):
        end = time.time() + seconds
        while time.time() < end:
            rows = sorted((r.stream_id, r.seq, r.text) for r in spark.table("idle").collect())
            if test(rows):
                return rows
            time.sleep(0.5)
        raise AssertionError(rows)

    try:
        until(lambda rows: len(rows) >= 3)
        put("1", (2, 1, delta(TOKEN[9:] + "!"), True, {TOKEN: "changed@x.org"}))
        rows = until(lambda rows: {(1, 1), (2, 1)} <= {r[:2] for r in rows})
    finally:
        q.stop()
    texts = {r[:2]: r[2] for r in rows}
    held = json.loads(texts[1, 1].removeprefix("data: ").strip())
    assert held["delta"] == TOKEN[:12] and TOKEN[:12] not in texts[1, 0]  # what was held goes out, as it is
    assert "b@x.org!" in texts[2, 1] and "changed" not in texts[2, 1]
    assert len(rows) == 5  # the state of stream 1 is gone: it is flushed once


def test_made_events_say_nothing_twice():
    data = {"usage": 1, "id": "x", "choices": [{"index": 0, "logprobs": {}, "delta": {"role": "a", "content": "", "tool_calls": [{"id": "c", "function": {"name": "f", "arguments": ""}}]}}, "odd"]}
    events.clear(data)
    assert data == {"id": "x", "choices": [{"index": 0, "finish_reason": None, "delta": {"content": "", "tool_calls": [{"function": {"arguments": ""}}]}}, "odd"]}


def slow_cache(uses, ttl, most):
    """(result, sessions) of each use, by looking through everything that came before."""
    held, out = {}, []  # key -> [last use, values]
    for at, key, value in uses:
        held = {k: v for k, v in held.items() if at - v[0] < ttl}
        if key not in held and len(held) >= most:
            del held[min(held, key=lambda k: held[k][0])]
        known = held.pop(key, [at, set()])[1]
        out.append(("hit" if value in known else "stored", len(held) + 1))
        held[key] = [at, known | {value}]
    return out


def test_replay_evicts_like_a_search_and_needs_no_frame(spark):
    rng = random.Random(9)
    rows = [(s, float(t), t, f"k{rng.randint(0, 9)}", f"v{rng.randint(0, 3)}") for s in range(3) for t in range(300)]
    got = {(r.id, r.key): r for r in sessions.replay(spark.createDataFrame(rows, "shard int, at double, id long, key string, value string").where("shard = 1"), sessions.Limits(ttl_s=40, sessions=4)).collect()}
    mine = [r for r in rows if r[0] == 1]
    want = slow_cache([(r[1], r[3], r[4]) for r in mine], 40, 4)
    assert [(got[r[2], r[3]].result, got[r[2], r[3]].sessions) for r in mine] == want
    whole = sessions.replay(spark.createDataFrame(rows, "shard int, at double, id long, key string, value string"), sessions.Limits(ttl_s=40, sessions=4)).collect()
    assert len(whole) == len(rows)


def test_sessions_are_evicted_in_the_query(spark):
    assert max(r.sessions for r in documents.session_lru(spark, TINY).collect()) == 3


def test_addresses_equal_the_standard_library(spark):
    rng = random.Random(1)
    texts = ["", "::", ":", ":::", "1::", "::1", "1:::2", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "::1:2:3:4:5:6:7", "1::2::3", "g::", "::ffff:1.2.3.4", "1.2.3.4", "01.2.3.4", "::1.2.3", "::01.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "FE80::", "::1%eth0", "[::1]", "1:2", None, "1::2:", ":1::2"]
    for _ in range(300):
        a = str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & (rng.getrandbits(128) if rng.random() < 0.5 else -1)))
        k = rng.randrange(len(a))
        texts += [a, a[:k] + rng.choice(":0af.") + a[k:], a[:k] + a[k + 1 :]]

    def want(t):
        try:
            return None if t is None or "%" in t else format(int(ipaddress.IPv6Address(t)), "032x")
        except ValueError:
            return None

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    got = {r.k: (r.six, r.kind) for r in df.select("k", net.ipv6(F.col("t")).alias("six"), net.address_class(F.col("t")).alias("kind")).collect()}
    assert [(t, got[k][0]) for k, t in enumerate(texts)] == [(t, want(t)) for t in texts]
    kinds = {t: got[k][1] for k, t in enumerate(texts)}
    assert [kinds[t] for t in ("::", "::1", "::ffff:1.2.3.4", "1.2.3.4", "01.2.3.4", "FE80::", "1:2")] == ["unspecified", "loopback", "public", "public", "invalid", "link_local", "invalid"]


def test_host_lists(spark):
    df = spark.createDataFrame([("a.org, B.ORG.\n::1,10.0.0.1",), ("a.org,*.b.org",), ("",), ("a.org,,b.org",), ("https://a.org",)], "raw string")
    assert [r[0] for r in df.select(net.host_list_error(F.col("raw"))).collect()] == [0, 2, 1, 0, 1]


def test_allow_list_as_a_table_is_an_equi_join(spark):
    hosts = spark.createDataFrame([("api.openai.com",), ("openai.com",), ("notopenai.com",), (None,), ("x.y.z.example.org",)], "host string")
    allowed = spark.createDataFrame([("openai.com",), ("z.example.org",), *[(f"h{k}.net",) for k in range(1000)]], "host string")
    out = net.allowed_hosts(hosts, allowed)
    assert {r.host: r.allowed for r in out.collect()} == {"api.openai.com": True, "openai.com": True, "notopenai.com": False, None: False, "x.y.z.example.org": True}
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and {r.allowed for r in net.allowed_hosts(hosts, allowed.limit(0)).collect()} == {True}


def test_short_streams_share_a_task_and_keep_apart(spark):
    n = 1500  # more than a slice in each task
    rows = [(i, k, c, k == 2, {TOKEN: f"v{i}"}) for i in range(n) for k, c in enumerate([f'data: {{"delta":"a{i} {TOKEN[:9]}', f'{TOKEN[9:]} b"}}\n', "\ndata: [DONE]\n\n" if i % 2 else "\ndata: [DONE]"])]
    random.Random(1).shuffle(rows)
    chunks = spark.createDataFrame(rows, "stream_id long, seq long, chunk string, last boolean, tokens map<string,string>")
    out = sse.restore_table(chunks)
    got = sse.frame_table(out.select("stream_id", "seq", F.col("text").alias("chunk")))
    for plan in (out, got):
        assert "FlatMapGroups" not in plan._jdf.queryExecution().toString()
    seen = sorted((r.stream_id, r.n, r.data) for r in got.collect())
    assert seen == [x for i in range(n) for x in ((i, 0, json.dumps({"delta": f"a{i} v{i} b"})), (i, 1, "[DONE]"))]
    raw = sorted((r.stream_id, r.n, r.data) for r in sse.frame_table(chunks).collect())
    assert raw == [x for i in range(n) for x in ((i, 0, f'{{"delta":"a{i} {TOKEN} b"}}'), (i, 1, "[DONE]"))]
