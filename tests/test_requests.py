"""Requests from the first check to the notice, responses by class, coverage over all choices of flags, the pack of formats."""

import json
import random

from pyspark.sql import functions as F

from veilspark.operators import credentials, entropy, intervals, jsondoc, requests, responses, vault

TOKEN = "{{RG_EMAIL_QX7ZK2VWJ4PTM3YB}}"
KINDS = "id long, scope string, content_type string, path string, anthropic boolean, flags string, body string"


def prepared(spark, rows, **more):
    df = spark.createDataFrame([(k, str(k), c, p, a, f, b) for k, (c, p, a, f, b) in enumerate(rows)], KINDS)
    return {r.id: r for r in requests.prepare(df, "k", entropy.english(), **more).collect()}


def test_each_way_out(spark):
    j, chat = "application/json", "/v1/chat/completions"
    token_body = json.dumps({"messages": [{"role": "user", "content": f"postgres://root:{TOKEN}@db.example.com/app and {TOKEN}"}]})
    rows = [
        (j, "/v1/responses", False, None, '{"input":"alice@example.com"}'), (j, "/v1/responses", False, None, '{"input":"hello"}'), (j, "/v1/responses", False, None, json.dumps({"input": "{{RG_TYPE_TOKEN}}"})),
        (j, "/v1/responses", False, None, json.dumps({"input": TOKEN})), ("text/plain", "/x", False, None, '{"a":"a@x.org"}'), (j, "/x", False, None, '{"a":13800138000,"b":"a@x.org"}'), (j, "/x", False, "E", '{"a":13800138000}'),
        (j, "/x", False, None, "[" * 70 + '"a@x.org"' + "]" * 70), (j, "/x", False, None, '{"a":"a@x.org"'), (j, "/x", False, None, ""), (None, "/x", False, None, '{"a":"a@x.org"}'), (j, None, None, None, None),
        (j, "/x", False, None, json.dumps({"a": " ".join(f"u{k}@x.org" for k in range(6))})), (j, "/x", False, None, '{"a":"' + "x" * 3000 + ' a@x.org"}'), (j, chat, False, None, token_body), (j, "/x", False, None, '{"a":"\\ud800 a@x.org"}'),
    ]
    got = prepared(spark, rows, limit=5, max_body=2500)
    errors = [got[k].error for k in range(len(rows))]
    assert errors == ["", "", "", "", "unsupported_body", "numeric_sensitive_value", "", "json_nesting_limit", "invalid_request", "", "unsupported_body", "", "request_too_large", "request_too_large", "", ""]
    assert [got[k].status for k in (4, 5, 7, 8, 12)] == [415, 400, 413, 400, 413]
    assert all(r.body is None and r.redactions is None and r.fields is None for r in got.values() if r.error)  # nothing comes out beside an error
    assert all("@x.org" not in (r.body or "") for r in got.values())
    assert [got[k].noticed for k in range(4)] == [True, False, False, False]  # placeholders that were there are no reason for a notice
    assert [got[k].body for k in (1, 2, 3)] == [rows[k][4] for k in (1, 2, 3)] and got[9].body is None and got[11].body is None
    assert got[14].hits == {"CONNSTR": 2} and got[14].body.count(TOKEN) == 2 and "root" not in got[14].body
    assert json.loads(got[6].body) == {"a": 13800138000}


def test_room_in_the_analyzer(spark):
    """All rules with a model, and half the passes that the analyzer makes before it gives up."""
    name, text = "spark.sql.analyzer.maxIterations", f"a@x.org {TOKEN} postgres://root:{TOKEN}@db.example.com/app q7Zk2vW9xJ4pTm3Y"
    spark.conf.set(name, "50")
    try:
        r = prepared(spark, [("application/json", "/x", False, None, json.dumps({"a": text, "password": "p w"}))])[0]
    finally:
        spark.conf.unset(name)
    assert r.error == "" and r.hits == {"EMAIL": 1, "CONNSTR": 2, "ENTROPY": 1, "CREDENTIAL": 1} and r.body.count(TOKEN) == 2 and r.fields == ["$.a", "$.password"]


def test_fields_hits_and_labels(spark):
    body = {"model": "a@b.org", "messages": [{"role": "user", "content": "c@d.org c@d.org"}], "api_key": "c@d.org", "x": [{"a@b.org": "e@f.org", "a b": "e@f.org"}], "arguments": json.dumps({"deep": "g@h.org"})}
    r = prepared(spark, [("application/json", "/v1/chat/completions", False, "EG", json.dumps(body))])[0]
    assert r.protocol == "openai_chat" and r.hits == {"EMAIL": 5, "CREDENTIAL": 1} and r.redactions == 6
    assert r.fields == ["$.api_key", "$.arguments", "$.messages[0].content", '$.x[0]["<redacted-key>"]', '$.x[0]["a b"]']
    out = json.loads(r.body)
    assert out["model"] == "a@b.org" and list(out["x"][0]) == ["a@b.org", "a b"]
    assert out["api_key"].startswith("{{RG_EMAIL_") and out["api_key"] in out["messages"][0]["content"]  # one value, one token, its first label
    v = vault.issue(spark.createDataFrame([("0", "c@d.org", "EMAIL", 1, 0)], "scope string, raw string, label string, doc_id long, start int"), "k").first()
    assert v.token == out["api_key"]
    assert json.loads(out["arguments"])["deep"].startswith("{{RG_EMAIL_")


def test_responses_by_class(spark):
    raw = 'x"y\\z\n'
    known = spark.createDataFrame([("s", TOKEN, raw), ("other", TOKEN, "no")], "scope string, token string, raw string")
    inner = json.dumps({"b": f"<{TOKEN}>", "n": 1.50})
    escaped = '{"a":"' + TOKEN.replace("{", "\\u007b") + '"}'
    rows = [
        (200, "application/json", "", json.dumps({"a": TOKEN, "arguments": inner})), (200, "application/json", "", f"no json {TOKEN}"), (200, "text/plain", "identity", f"{TOKEN} {TOKEN.lower()} {{{{RG_X_AAAAAAAAAAAAAAAA}}}}"), (200, "image/png", "gzip", TOKEN),
        (204, "application/json", "", "{}"), (200, "text/html", "br", TOKEN), (200, "text/html", "", TOKEN * 40), (200, "application/json", "", escaped), (200, "application/json", "", None), (200, None, None, TOKEN), (200, "application/json", "", "[" * 80 + json.dumps(TOKEN) + "]" * 80),
    ]
    df = spark.createDataFrame([(k, "s", s, c, e, 1, b) for k, (s, c, e, b) in enumerate(rows)], "id long, scope string, status int, content_type string, encoding string, redactions int, body string")
    got = {r.id: r for r in responses.restore(df, known, 1000).collect()}
    first = json.loads(got[0].body)
    assert first["a"] == raw and json.loads(first["arguments"]) == {"b": f"<{raw}>", "n": 1.5} and (got[0].restored, got[0].restored_unique) == (2, 1)
    assert got[1].body == f"no json {raw}" and got[2].body == f"{raw} {raw} {{{{RG_X_AAAAAAAAAAAAAAAA}}}}"
    assert (got[2].restored, got[2].restored_unique, got[2].unresolved, got[2].restore_status) == (2, 1, 1, "partial")
    assert got[3].body == TOKEN and got[3]["class"] == "untouched" and got[4].body is None and got[4]["class"] == "empty"
    assert [(got[k].error, got[k].body, got[k].restore_status) for k in (5, 6)] == [("encoded_response", None, "response_error"), ("response_too_large", None, "response_error")]
    assert json.loads(got[7].body) == {"a": raw} and got[8].body == "" and got[9].body == TOKEN and raw in got[10].body


def test_coverage_by_brute_force_and_a_planted_violation(spark):
    rng = random.Random(4)
    rows = [(d, a := rng.randint(0, 80), a + rng.randint(1, 12), rng.randint(0, 3), 0) for d in range(40) for _ in range(rng.choice([0, 1, 6]))]
    kinds = "doc_id long, start int, end int, bit int, hidden_by int"

    def covered(some, choice):
        return {(d, p) for d, a, b, bit, hidden in some if choice >> bit & 1 and not choice & hidden for p in range(a, b)}

    for more in ([], [(7, 500, 510, 1, 0b100), (8, 500, 505, 1, 0b100), (8, 502, 520, 2, 0)]):  # rules that look away where flag 2 is on
        some = rows + more
        got = {(r.choice, r.added): (r.before, r.after, r.lost) for r in intervals.coverage_steps(spark.createDataFrame(some, kinds), 4).collect()}
        want = {(c, f): (len(x := covered(some, c)), len(y := covered(some, c | 1 << f)), len(x - y)) for c in range(16) for f in range(4)}
        assert got == want
        assert any(lost for *_, lost in got.values()) == bool(more)


def test_formats(spark):
    h = "0123456789abcdef" * 4
    texts = [f"SG.{h[:22]}.{h[:43]} x", f'client_secret: "{h[:40]}"', 'client_secret: "changeme"', 'client_secret: "plain-words-only"', 'client_secret: "aaaaaaaaaaaaaaaaaaaa"', f"xdapi{h[:32]}", f"dapi{h[:32]}0", "lin_api_" + "a" * 40, None, "", f"É ntn_{h[:46]}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.end, r.format) for r in credentials.candidates(df).collect())
    assert got == [(0, 0, 69, "sendgrid"), (1, 16, 56, "named_value"), (10, 2, 52, "notion")]
    assert len({f.name for f in credentials.PACK}) == len(credentials.PACK) >= 30


def test_numbers_in_sql_and_fields(spark):
    df = spark.createDataFrame([(n,) for n in ("API-Key", "tokens", "client.secret")], "f string")
    assert [r[0] for r in df.select(F.expr(jsondoc.credential_sql("f"))).collect()] == [True, False, True]
