"""Queries of JSON bodies, event streams and the session cache: DataFrames and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import intervals, jsondoc, requests, responses, sessions, vault
from veilspark.plans.detection import _ID16, SECRET
from veilspark.sources import tables as T
from veilspark.streaming import events as E
from veilspark.streaming import sse

# JSON bodies ------------------------------------------------------------------------------------------------------------------


def bodies(s: SparkSession, d: str) -> DataFrame:
    """A chat request of each conversation; each user text ends with an invented address."""
    text = F.when(F.col("role") == "user", F.concat("text", F.lit(" mail c"), F.col("conv_id").cast("string"), F.lit("@x.org"))).otherwise(F.col("text"))
    turns = T.read(s, d, "conversations").select("conv_id", "turn", "role", text.alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x.role.alias("role"), x.text.alias("content")))
    return grouped.select(F.col("conv_id").alias("doc_id"), F.to_json(F.struct(F.lit("m").alias("model"), messages.alias("messages"))).alias("body"), F.lit("openai_chat").alias("protocol"))


def json_leaves_props(s: SparkSession, d: str) -> DataFrame:
    e = T.read(s, d, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("body"))
    x = jsondoc.leaves(e)
    return jsondoc.rendered_paths(x, jsondoc.sensitive_keys(x)).join(x, ["doc_id", "leaf"]).select("doc_id", "path", "field", "kind", "value")


def policy_paths(s: SparkSession, d: str) -> DataFrame:
    """How many strings of each body are protocol, and how many are text."""
    x = jsondoc.leaves(bodies(s, d), protocol_col="protocol")
    return x.groupBy("doc_id").agg(F.count_if("protected").alias("kept"), F.count_if(~F.col("protected")).alias("scanned"))


def _masked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bodies, masked bodies, vault) with the e-mail rule alone; the scope is the conversation."""
    b = bodies(s, d)
    x = jsondoc.leaves(b, protocol_col="protocol")
    texts = x.select(F.struct("doc_id", "leaf").alias("id"), "value", "doc_id")
    masked = vault.unprotected(intervals.merge(jsondoc.leaf_spans(x, "E"), "id"), texts, "id", "value")
    found = vault.with_raw(texts, masked, F.col("doc_id"), "id", "value")
    v = vault.issue(found, SECRET, "id")
    new = vault.redact(texts, found, v, "id", "value").where(F.col("redacted_text") != F.col("value"))
    return b, jsondoc.rewrite(b, new.select("id.doc_id", "id.leaf", F.col("redacted_text").alias("text"))), v


def json_redact_conversations(s: SparkSession, d: str) -> DataFrame:
    _, masked, _ = _masked(s, d)
    return masked.select("doc_id", F.sha2("body", 256).alias("body_sha256"))


_TURNS = "SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN text || ' mail c' || CAST(conv_id AS VARCHAR) || '@x.org' ELSE text END AS text FROM conversations"
_BODY = """'{"model":"m","messages":[' || string_agg('{"role":' || to_json(role) || ',"content":' || to_json(text) || '}', ',' ORDER BY turn, role, text) || ']}'"""
_TOKEN = f"""SELECT conv_id, '{{{{RG_EMAIL_' || {_ID16.format(v="CAST('0x' || h[1:10] AS BIGINT)")} || {_ID16.format(v="CAST('0x' || h[11:20] AS BIGINT)")} || '}}}}' AS token
 FROM (SELECT DISTINCT conv_id, sha256('{SECRET}' || chr(31) || CAST(conv_id AS VARCHAR) || chr(31) || 'c' || CAST(conv_id AS VARCHAR) || '@x.org') AS h FROM conversations)"""


def json_roundtrip_diff(s: SparkSession, d: str) -> DataFrame:
    """Bodies that come back changed. No rows."""
    b, masked, v = _masked(s, d)
    back = jsondoc.restored(masked, v, F.col("doc_id")).select("doc_id", F.col("body").alias("restored"))
    return b.join(back, "doc_id").where(F.col("body") != F.col("restored")).select("doc_id")


def json_tree_restore(s: SparkSession, d: str) -> DataFrame:
    """Bodies whose values hold quotes, backslashes and line ends, one of them in JSON inside a string: what the texts are once restored."""
    raw = F.concat(F.lit('a"b\\\\c\n'), F.col("c_custkey").cast("string"))
    rows = T.read(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("scope"), F.lit(0).alias("start"), F.lit("EMAIL").alias("label"), raw.alias("raw"))
    v = vault.issue(rows, SECRET)
    told = F.concat(F.lit("to "), "token", F.lit(" end"))
    body = F.to_json(F.struct(told.alias("text"), F.to_json(F.struct(told.alias("deep"), F.lit(1.5).alias("n"))).alias("arguments")))
    bodies_ = v.join(rows.select("raw", "doc_id"), "raw").select("doc_id", body.alias("body"))
    back = jsondoc.restored(bodies_, v, F.lit(1))
    shown = F.get_json_object(F.get_json_object("body", "$.arguments"), "$.deep")
    return back.select("doc_id", F.get_json_object("body", "$.text").alias("text"), shown.alias("deep"), F.get_json_object(F.get_json_object("body", "$.arguments"), "$.n").alias("n"))


def json_depth_guard(s: SparkSession, d: str) -> DataFrame:
    """A body of 1 to 80 arrays in each other for each customer."""
    c = T.read(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 80 + 1).cast("int").alias("n"))
    b = c.select("doc_id", F.concat(F.expr("repeat('[', n)"), F.lit("1"), F.expr("repeat(']', n)")).alias("body"))
    return jsondoc.leaves(b).select("doc_id", "error")


def encoded_json(s: SparkSession, d: str) -> DataFrame:
    """A document of 1 to 12 layers of JSON in strings for each customer."""
    c = T.dealt(T.read(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 12 + 1).cast("int").alias("n")), "doc_id")
    layers = c.select("doc_id", F.aggregate(F.expr("sequence(1, n)"), F.lit("x"), lambda a, i: F.to_json(F.struct(a.alias("arguments")))).alias("body"))
    return jsondoc.leaves(layers).select("doc_id", "layer", "error")


def credential_fields(s: SparkSession, d: str) -> DataFrame:
    names = F.expr("array('API-Key', 'tokens', 'client.secret', 'Access Token', 'name', 'password', 'key', 'x_password', 'Authorization')")
    c = T.read(s, d, "customer").select("c_custkey", F.get(names, (F.col("c_custkey") % 9).cast("int")).alias("field"))
    return c.select("c_custkey", "field", jsondoc.credential_field(F.col("field")).alias("is_credential"))


def credential_leaves(s: SparkSession, d: str) -> DataFrame:
    """Spans of bodies with credential fields: the whole text of such a field, and of array elements in one, whatever it holds."""
    b = T.read(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit('{"api_key":"k'), F.col("c_custkey").cast("string"), F.lit('","tags":["a"],"access_token":["t1","{\\"a\\":1}"],"note":"c@x.org"}')).alias("body"))
    x = jsondoc.leaves(b)
    return jsondoc.leaf_spans(x).select("id.doc_id", "id.leaf", "value", "label")


def numeric_blocked(s: SparkSession, d: str) -> DataFrame:
    b = T.read(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit('{"n":13'), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit(',"m":"13800138000","d":[1.5,'), F.col("c_custkey").cast("string"), F.lit("]}")).alias("body"))
    return jsondoc.blocked_numbers(jsondoc.leaves(b)).select("doc_id", "leaf", "label", F.array_join("steps", "/").alias("steps"))


def notice_injected(s: SparkSession, d: str) -> DataFrame:
    b = jsondoc.add_notice(jsondoc.add_notice(bodies(s, d), "body", "openai_chat").drop("body").withColumnRenamed("noticed_body", "body"), "body", "openai_chat")
    content = F.transform(F.from_json("noticed_body", "struct<messages:array<struct<role:string,content:string>>>").messages, lambda m: m.content)
    return b.select("doc_id", F.sha2(F.array_join(content, "\x1f"), 256).alias("contents_sha256"))


def request_masking(s: SparkSession, d: str) -> DataFrame:
    """Request bodies from the first check to the notice; five of six kinds must end in an error without a body."""
    b, kind = bodies(s, d), F.col("doc_id") % 6
    many = F.lit('{"messages":[{"role":"user","content":"' + " ".join(f"u{k}@x.org" for k in range(41)) + '"}]}')
    body = (
        F.when(kind == 1, F.concat(F.lit('{"n":13800138000,'), F.expr("substr(body, 2)"))).when(kind == 2, F.concat(F.lit('{"a":' + "[" * 70 + "1" + "]" * 70 + ","), F.expr("substr(body, 2)")))
        .when(kind == 4, F.expr("substr(body, 1, length(body) - 1)")).when(kind == 5, many).otherwise(F.col("body"))
    )
    rows = b.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("scope"), F.when(kind == 3, "text/plain").otherwise("application/json").alias("content_type"), F.lit("/v1/chat/completions").alias("path"), F.lit(False).alias("anthropic"), F.lit("EP").alias("flags"), body.alias("body"))
    out = requests.prepare(rows, SECRET, limit=40)
    return out.select(F.col("id").alias("doc_id"), "error", "status", "protocol", "noticed", F.coalesce("redactions", F.lit(0)).alias("redactions"), F.array_join("fields", ",").alias("fields"), F.sha2("body", 256).alias("body_sha256"))


def _request_sql() -> str:
    notice = jsondoc.NOTICE.replace("'", "''")
    return f"""WITH c AS ({_TURNS}), k AS ({_TOKEN}), l AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS last, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS nth FROM c),
u AS (SELECT conv_id, turn, role, nth, CASE WHEN role = 'user' AND turn = last THEN '{notice}' || chr(10) || chr(10) ELSE '' END || CASE WHEN role = 'user' THEN replace(text, 'c' || CAST(conv_id AS VARCHAR) || '@x.org', token) ELSE text END AS text FROM l JOIN k USING (conv_id)),
g AS (SELECT conv_id AS doc_id, sha256({_BODY}) AS sha, count(*) FILTER (role = 'user') AS n, coalesce(string_agg('$.messages[' || nth || '].content', ',' ORDER BY '$.messages[' || nth || '].content') FILTER (role = 'user'), '') AS fields FROM u GROUP BY conv_id),
e AS (SELECT *, ['', 'numeric_sensitive_value', 'json_nesting_limit', 'unsupported_body', 'invalid_request', 'request_too_large'][doc_id % 6 + 1] AS error, [200, 400, 413, 415, 400, 413][doc_id % 6 + 1]::INT AS status FROM g)
SELECT doc_id, error, status, CASE WHEN doc_id % 6 IN (0, 1, 5) THEN 'openai_chat' ELSE 'generic' END AS protocol, error = '' AND n > 0 AS noticed, CASE WHEN error = '' THEN n::INT ELSE 0 END AS redactions, CASE WHEN error = '' THEN fields END AS fields, CASE WHEN error = '' THEN sha END AS body_sha256 FROM e"""


def response_restoring(s: SparkSession, d: str) -> DataFrame:
    """Responses of eight kinds, by content type, status, encoding and size, each with a placeholder of its conversation."""
    own = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("@x.org"))
    t = T.read(s, d, "conversations").where("role = 'assistant'").select("conv_id", (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text", own.alias("raw"))
    v = vault.issue(t.select(F.col("conv_id").alias("scope"), "raw", F.lit(0).alias("start"), F.col("id").alias("doc_id"), F.lit("EMAIL").alias("label")), SECRET)
    told = t.join(v.select("scope", "token"), F.col("conv_id") == F.col("scope")).select("id", "scope", F.concat("text", F.lit(" to "), "token", F.lit(" end")).alias("t"))
    kind = (F.col("id") % 8).cast("int")
    pick = lambda *some: F.get(F.array(*[F.lit(x) for x in some]), kind)
    tree = F.to_json(F.struct(F.col("t").alias("text")))
    body = F.when(kind < 2, tree).when(kind == 3, F.concat(F.lit("broken { "), "t")).when(kind == 7, F.rpad("t", 50_001, "x")).otherwise(F.col("t"))
    rows = told.select(
        "id", "scope", pick(200, 400, 200, 200, 200, 200, 204, 200).alias("status"), pick("application/json", "application/problem+json; charset=utf-8", "text/plain", "application/json", "image/png", "text/plain", "text/plain", "text/html").alias("content_type"),
        pick("", "identity", "", "", "gzip", "gzip", "", "").alias("encoding"), F.lit(1).alias("redactions"), body.alias("body"),
    )
    out = responses.restore(rows, v, 50_000)
    return out.select("id", "class", "error", "restored", "unresolved", "restore_status", F.sha2("body", 256).alias("body_sha256"))


# Streams ----------------------------------------------------------------------------------------------------------------------


def _cut(text: str, n: int) -> Column:
    """The text in pieces of n characters, in one pass over it: substr() would count from the start for each."""
    return F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{n}}}"), F.lit(0))


def _pieces(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(vault, events): each assistant text and a placeholder, in pieces of 7 characters, one event each."""
    own = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("@x.org"))
    t = T.read(s, d, "conversations").where("role = 'assistant'").select("conv_id", (F.col("conv_id") * 100 + F.col("turn")).alias("stream_id"), "text", own.alias("raw"))
    marked = t.select(F.col("conv_id").alias("scope"), "raw", F.lit(0).alias("start"), F.col("stream_id").alias("doc_id"), F.lit("EMAIL").alias("label"))
    v = vault.issue(marked, SECRET)
    full = t.join(v.select("scope", "token"), F.col("conv_id") == F.col("scope")).select("conv_id", "stream_id", F.concat("text", F.lit(" to "), "token", F.lit(" end")).alias("t"))
    cut = full.select("conv_id", "stream_id", F.posexplode(_cut("t", 7)).alias("n", "piece"))
    event = F.to_json(F.struct(F.lit("response.output_text.delta").alias("type"), F.lit(0).alias("output_index"), F.col("n").alias("sequence_number"), F.col("piece").alias("delta")))
    return v, cut.select("conv_id", "stream_id", "n", F.concat(F.lit("data: "), event, F.lit("\n\n")).alias("frame"))


def stream_chunks(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(vault, chunks): the streams as text, cut again at every 50 characters, wherever that is."""
    v, events = _pieces(s, d)
    whole = events.groupBy("conv_id", "stream_id").agg(F.array_sort(F.collect_list(F.struct("n", "frame"))).alias("f"))
    text = F.concat(F.array_join(F.transform("f", lambda x: x.frame), ""), F.lit("data: [DONE]\n\n"))
    cut = whole.select("conv_id", "stream_id", text.alias("t")).select("conv_id", "stream_id", _cut("t", 50).alias("cuts")).select("conv_id", "stream_id", (F.size("cuts") - 1).alias("k"), F.posexplode("cuts").alias("seq", "chunk"))
    return v, cut.select("conv_id", "stream_id", F.col("seq").cast("long").alias("seq"), "chunk", (F.col("seq") == F.col("k")).alias("last"))


def _restored(s: SparkSession, d: str) -> DataFrame:
    v, chunks = stream_chunks(s, d)
    return sse.restore_table(sse.with_tokens(chunks, v, F.col("conv_id")))


def _joined(out: DataFrame) -> DataFrame:
    """One chunk a stream, of what came out."""
    whole = out.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("p"))
    return whole.select("stream_id", F.lit(0).cast("long").alias("seq"), F.array_join(F.transform("p", lambda x: x.text), "").alias("chunk"))


def _deltas(frames: DataFrame) -> DataFrame:
    got = frames.where("data <> '[DONE]'").select("stream_id", "n", F.get_json_object("data", "$.delta").alias("delta"), F.get_json_object("data", "$.sequence_number").cast("int").alias("number"))
    return got


def sse_frames(s: SparkSession, d: str) -> DataFrame:
    _, chunks = stream_chunks(s, d)
    return sse.frame_table(chunks).groupBy("stream_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("data") == "[DONE]").alias("done"))


def sse_restore(s: SparkSession, d: str) -> DataFrame:
    got = _deltas(sse.frame_table(_joined(_restored(s, d))))
    whole = got.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("n", "delta"))).alias("p"))
    return whole.select("stream_id", F.array_join(F.transform("p", lambda x: x.delta), "").alias("text"))


def sse_sequence(s: SparkSession, d: str) -> DataFrame:
    """Whether each stream's events are numbered from 0 without gaps."""
    got = _deltas(sse.frame_table(_joined(_restored(s, d))))
    return got.groupBy("stream_id").agg((F.min("number") == 0).alias("from_zero"), (F.max("number") + 1 == F.count(F.lit(1))).alias("gapless"), (F.count_distinct("number") == F.count(F.lit(1))).alias("distinct_numbers"))


def sse_terminal_flush(s: SparkSession, d: str) -> DataFrame:
    """Streams that end within a placeholder, by each kind of end: what is held goes out before it."""
    ends = ['{"type":"response.output_text.done","output_index":0}', '{"type":"response.completed"}', '{"type":"response.incomplete"}', '{"type":"response.failed"}', '{"type":"error"}', "[DONE]", ""]
    first = F.lit('data: {"type":"response.output_text.delta","output_index":0,"delta":"hi {{RG_EMA"}\n\n')
    c = T.read(s, d, "customer").select(F.col("c_custkey").alias("stream_id"), (F.col("c_custkey") % len(ends)).cast("int").alias("id"))
    rows = c.select("stream_id", F.lit(0).cast("long").alias("seq"), F.concat(first, F.get(F.array(*[F.lit(f"data: {e}\n\n" if e else "") for e in ends]), F.col("id").cast("int"))).alias("chunk"), F.lit(True).alias("last"), F.expr("cast(map() as map<string,string>)").alias("tokens"))
    got = sse.frame_table(_joined(sse.restore_table(rows)))
    part = got.where(F.get_json_object("data", "$.delta").isNotNull()).groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.get_json_object("data", "$.delta").alias("t")))), lambda x: x.t), "").alias("text"), F.max("n").alias("last_delta"))
    return part.select("stream_id", "text", "last_delta")


def sse_errors(s: SparkSession, d: str) -> DataFrame:
    """Error class of a stream with one bad event per event row."""
    kinds = F.expr("""CASE event_id % 5 WHEN 0 THEN '{"type":"error"}' WHEN 1 THEN '{"type":"response.failed"}' WHEN 2 THEN '{"type":"response.incomplete"}' WHEN 3 THEN '{"type":"x","response":{"status":"failed"}}' ELSE '{"type":"ok"}' END""")
    e = T.read(s, d, "events").select(F.col("event_id").alias("stream_id"), F.lit(0).cast("long").alias("seq"), F.concat(F.lit("data: "), kinds, F.lit("\n\n")).alias("chunk"), F.lit(True).alias("last"), F.expr("cast(map() as map<string,string>)").alias("tokens"))
    return sse.restore_table(e).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def sse_fields(s: SparkSession, d: str) -> DataFrame:
    """Channels of each stream's events and the characters that each carries."""
    _, events = _pieces(s, d)
    raw = events.select("stream_id", F.regexp_extract("frame", r"(?s)^data: (.*)\n\n$", 1).alias("data"))

    def run(batches):
        import json

        import pandas as pd

        for b in batches:
            rows = [(i, f.channel, len(f.text)) for i, x in zip(b["stream_id"], b["data"]) for f in E.growing(json.loads(x))]
            yield pd.DataFrame(rows, columns=["stream_id", "channel", "n"])

    return raw.mapInPandas(run, "stream_id long, channel string, n long").groupBy("stream_id", "channel").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n").alias("chars"))


def session_lru(s: SparkSession, d: str) -> DataFrame:
    e = T.read(s, d, "events")
    k = F.get_json_object("props", "$.k")
    rows = e.select(F.pmod(F.crc32(F.col("user_id").cast("string")), F.lit(4)).cast("int").alias("shard"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("key"), F.concat("event_type", k).alias("value"))
    return sessions.replay(rows, sessions.Limits(ttl_s=7 * 24 * 3600, sessions=3))


def build() -> tuple[dict, dict]:
    streams = "t AS (SELECT conv_id * 100 + turn AS stream_id, text, token, 'c' || CAST(conv_id AS VARCHAR) || '@x.org' AS raw FROM conversations JOIN (" + _TOKEN + ") USING (conv_id) WHERE role = 'assistant')"
    rows = {
        "json_leaves_props": (json_leaves_props, "SELECT event_id AS doc_id, '$.k' AS path, 'k' AS field, 'number' AS kind, json_extract_string(props, '$.k') AS value FROM events"),
        "policy_paths": (policy_paths, "SELECT conv_id AS doc_id, count(*) + 1 AS kept, count(*) AS scanned FROM conversations GROUP BY conv_id"),
        "json_redact_conversations": (json_redact_conversations, f"WITH c AS ({_TURNS}), k AS ({_TOKEN}), u AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN replace(text, 'c' || CAST(conv_id AS VARCHAR) || '@x.org', token) ELSE text END AS text FROM c JOIN k USING (conv_id)) SELECT conv_id AS doc_id, sha256({_BODY}) AS body_sha256 FROM u GROUP BY conv_id"),
        "json_roundtrip_diff": (json_roundtrip_diff, "SELECT conv_id AS doc_id FROM conversations WHERE false"),
        "json_tree_restore": (json_tree_restore, """SELECT c_custkey AS doc_id, 'to a"b' || chr(92) || chr(92) || 'c' || chr(10) || CAST(c_custkey AS VARCHAR) || ' end' AS text, 'to a"b' || chr(92) || chr(92) || 'c' || chr(10) || CAST(c_custkey AS VARCHAR) || ' end' AS deep, '1.5' AS n FROM customer"""),
        "json_depth_guard": (json_depth_guard, "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 80 + 1 > 64 THEN 'json_nesting_limit' ELSE '' END AS error FROM customer"),
        "encoded_json": (encoded_json, "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 12 > 8 THEN 0 ELSE c_custkey % 12 END::INT AS layer, CASE WHEN c_custkey % 12 > 8 THEN 'json_nesting_limit' ELSE '' END AS error FROM customer"),
        "credential_fields": (credential_fields, "WITH f AS (SELECT c_custkey, ['API-Key', 'tokens', 'client.secret', 'Access Token', 'name', 'password', 'key', 'x_password', 'Authorization'][c_custkey % 9 + 1] AS field FROM customer) SELECT c_custkey, field, field IN ('API-Key', 'client.secret', 'Access Token', 'password', 'Authorization') AS is_credential FROM f"),
        "credential_leaves": (credential_leaves, """SELECT c_custkey AS doc_id, unnest([0, 2, 3, 4]) AS leaf, unnest(['k' || CAST(c_custkey AS VARCHAR), 't1', '{"a":1}', 'c@x.org']) AS value, unnest(['CREDENTIAL', 'CREDENTIAL', 'CREDENTIAL', 'EMAIL']) AS label FROM customer"""),
        "numeric_blocked": (numeric_blocked, "SELECT c_custkey AS doc_id, 0 AS leaf, 'PHONE' AS label, 'n' AS steps FROM customer"),
        "notice_injected": (notice_injected, f"WITH c AS ({_TURNS}), l AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM c) SELECT conv_id AS doc_id, sha256(string_agg(CASE WHEN role = 'user' AND turn = last THEN '{jsondoc.NOTICE.replace(chr(39), chr(39) * 2)}' || chr(10) || chr(10) || text ELSE text END, chr(31) ORDER BY turn, role, text)) AS contents_sha256 FROM l GROUP BY conv_id"),
        "request_masking": (request_masking, _request_sql()),
        "response_restoring": (response_restoring, f"""WITH {streams}, k AS (SELECT *, stream_id % 8 AS k, text || ' to ' || raw || ' end' AS clear, text || ' to ' || token || ' end' AS told FROM t)
SELECT stream_id AS id, ['json', 'json', 'text', 'json', 'untouched', '', 'empty', ''][k + 1] AS class, ['', '', '', '', '', 'encoded_response', '', 'response_too_large'][k + 1] AS error, CASE WHEN k < 4 THEN 1 ELSE 0 END AS restored, 0 AS unresolved,
 CASE WHEN k < 4 THEN 'restored' WHEN k IN (5, 7) THEN 'response_error' ELSE 'not_processed' END AS restore_status,
 CASE WHEN k < 2 THEN sha256('{{"text":' || to_json(clear) || '}}') WHEN k = 2 THEN sha256(clear) WHEN k = 3 THEN sha256('broken {{ ' || clear) WHEN k = 4 THEN sha256(told) END AS body_sha256 FROM k"""),
        "sse_frames": (sse_frames, f"WITH {streams} SELECT stream_id, (length(text || ' to ' || token || ' end') + 6) // 7 + 1 AS frames, 1::BIGINT AS done FROM t"),
        "sse_fields": (sse_fields, f"WITH {streams} SELECT stream_id, 'delta:response.output_text.delta:output:0:0:0:0' AS channel, (length(text || ' to ' || token || ' end') + 6) // 7 AS pieces, length(text || ' to ' || token || ' end') AS chars FROM t"),
        "sse_restore": (sse_restore, f"WITH {streams} SELECT stream_id, text || ' to ' || raw || ' end' AS text FROM t"),
        "sse_sequence": (sse_sequence, f"WITH {streams} SELECT stream_id, true AS from_zero, true AS gapless, true AS distinct_numbers FROM t"),
        "sse_terminal_flush": (sse_terminal_flush, "SELECT c_custkey AS stream_id, 'hi {{RG_EMA' AS text, 1 AS last_delta FROM customer"),
        "sse_errors": (sse_errors, "SELECT CASE event_id % 5 WHEN 0 THEN 'upstream_stream_error' WHEN 1 THEN 'upstream_response_failed' WHEN 2 THEN 'upstream_response_incomplete' WHEN 3 THEN 'upstream_response_failed' ELSE '' END AS error, count(*) AS n FROM events GROUP BY 1"),
    }
    q = {n: f for n, (f, _) in rows.items()} | {"session_lru": session_lru}
    return q, {n: sql for n, (_, sql) in rows.items()}
