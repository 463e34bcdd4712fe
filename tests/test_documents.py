"""JSON bodies, protocol policy, event streams and the session cache."""

import json

import pandas as pd
import pytest

from tests.conftest import TINY
from veilspark.operators import jsondoc, policy, sessions
from veilspark.streaming import sse

TOKEN = "{{RG_EMAIL_ABCDEFGHIJKLMNOP}}"
CORE = TOKEN[2:-2]
LOOKUP = {TOKEN: 'a"b@x.org'}.get
FORMS = [TOKEN, CORE, "{" + CORE + "}", "{{" + CORE + "}", "{{" + CORE, CORE + "}}", r"\{\{" + CORE + r"\}\}", r"\\{\\{" + CORE + r"\\}\\}", TOKEN.lower(), "{{RG_EM_AIL_ABCDEFGHIJKLMNOP}}"]


def test_only_changed_strings_are_rewritten():
    body = r'{"a": 1.10, "arguments":"{\"mail\": \"a@b.co\", \"n\":9007199254740993}", "l":["a"]}'
    assert jsondoc.rewritten(body, {1: 'q"z'}) == body.replace(r"\"a@b.co\"", r"\"q\\\"z\"")
    assert jsondoc.rewritten(body, {}) == body


@pytest.mark.parametrize(("depth", "ok"), [(64, True), (65, False), (3000, False)])
def test_depth_limit(depth, ok):
    body = "[" * depth + "]" * depth
    if ok:
        assert jsondoc.scan(body) is not None
    else:
        with pytest.raises(jsondoc.TooDeep):
            jsondoc.scan(body)


def test_invalid_json_is_no_document():
    for bad in ("", "{", "[1,]", '{"a" 1}', "1 2", "nul", '"\n"'):
        assert jsondoc.scan(bad) is None


def scanned(body, protocol):
    some = jsondoc.scan(json.dumps(body)).leaves
    return [jsondoc.audit_path(w) for x, w, _, _ in jsondoc.walk(some) if x.kind == "string" and not policy.protected(body, protocol, w)]


def test_policy():
    chat = {
        "model": "m", "messages": [{"role": "user", "content": [{"type": "image_url", "image_url": {"url": "u", "note": "n"}}]}, {"role": "assistant", "reasoning": {"a": "b"}, "tool_calls": [{"id": "1", "type": "function", "function": {"name": "f", "arguments": "{}"}}]}],
        "tools": [{"type": "function", "function": {"name": "n", "parameters": {"type": "object", "required": ["a"], "properties": {"a": {"type": "string", "description": "d", "enum": ["e"]}}}}}],
    }
    assert scanned(chat, policy.CHAT) == ["$.messages[0].content[0].image_url.note", "$.tools[0].function.parameters.properties.a.description", "$.tools[0].function.parameters.properties.a.enum[0]"]
    assert "$.model" in scanned(chat, "generic")
    responses = {"previous_response_id": "p", "input": [{"type": "reasoning", "x": "y"}, {"type": "reasoning", "role": "user", "x": "z"}, {"type": "function_call", "name": "f", "call_id": "c", "arguments": "x"}]}
    assert scanned(responses, policy.RESPONSES) == ["$.input[1].x", "$.input[2].arguments"]
    anthropic = {"messages": [{"role": "assistant", "content": [{"type": "thinking", "thinking": "t"}, {"type": "tool_use", "id": "i", "name": "n", "input": {"name": "v"}}]}, {"role": "user", "content": [{"type": "image", "source": {"type": "base64", "media_type": "m", "data": "d"}}]}]}
    assert scanned(anthropic, policy.ANTHROPIC) == ["$.messages[0].content[1].input.name"]
    assert scanned({"messages": {"[0]": {"role": "user"}}}, policy.CHAT) == ['$.messages["[0]"].role']


def test_notice_once_and_only_where_it_fits():
    n = jsondoc.NOTICE
    body = json.dumps({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]})
    once = jsondoc.with_notice(body, policy.CHAT)
    assert json.loads(once)["messages"][0]["content"] == f"{n}\n\na" and jsondoc.with_notice(once, policy.CHAT) == once
    block = json.loads(jsondoc.with_notice(json.dumps({"input": [{"role": "user", "content": [{"type": "input_image"}]}]}), policy.RESPONSES))
    assert block["input"][0]["content"][0] == {"type": "input_text", "text": n}
    for same in ({"messages": []}, {"x": 1}, {"messages": [{"role": "user", "content": 5}]}):
        assert jsondoc.with_notice(json.dumps(same), policy.CHAT) == json.dumps(same)


def event(text, n, **more):
    return "data: " + json.dumps({"type": "response.output_text.delta", "output_index": 0, "sequence_number": n, "delta": text} | more) + "\n\n"


def payloads(out):
    return [json.loads(d) for x in sse.frames(out, True)[0] if (d := sse.Frame.of(x).data) and d != "[DONE]"]


@pytest.mark.parametrize("form", FORMS)
def test_every_split_restores(form):
    text = f"x {form} y"
    for cut in range(len(text) + 1):
        end = "data: " + json.dumps({"type": "response.output_text.done", "output_index": 0, "sequence_number": 2, "text": text}) + "\n\ndata: [DONE]\n\n"
        got = payloads(sse.Restorer().push(event(text[:cut], 0) + event(text[cut:], 1) + end, LOOKUP, True))
        assert "".join(d.get("delta", "") for d in got) == 'x a"b@x.org y'
        assert [d["sequence_number"] for d in got] == list(range(len(got)))


@pytest.mark.parametrize("form", [*FORMS[:5], TOKEN.replace("{", r"\u007b").replace("R", r"\u0052"), TOKEN.replace("}", r"\u007D")])
def test_every_split_of_arguments_restores(form):
    text = f'{{"to":"{form}","é":"\\u00e9"}}'
    for cut in range(len(text) + 1):
        parts = [event(t, n, type="response.function_call_arguments.delta") for n, t in enumerate((text[:cut], text[cut:]))]
        got = payloads(sse.Restorer().push("".join(parts) + "data: [DONE]\n\n", LOOKUP, True))
        assert json.loads("".join(d["delta"] for d in got)) == {"to": 'a"b@x.org', "é": "é"}, cut


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\r"])
def test_every_transport_split(newline):
    raw = (event("hi " + TOKEN[:9], 0) + ": beat\n\n" + event(TOKEN[9:] + " é", 1) + "data: [DONE]\n\n").replace("\n", newline)
    want = sse.Restorer().push(raw, LOOKUP, True)
    for k in range(len(raw)):
        r = sse.Restorer()
        assert r.push(raw[:k], LOOKUP) + r.push(raw[k:], LOOKUP, True) == want


def test_parallel_tool_calls_keep_apart():
    def call(index, text):
        return "data: " + json.dumps({"choices": [{"index": 0, "delta": {"tool_calls": [{"index": index, "function": {"arguments": text}}]}}]}) + "\n\n"

    r = sse.Restorer()
    out = r.push(call(0, '{"a":"' + TOKEN[:10]) + call(1, '{"b":"' + TOKEN[:5]) + call(0, TOKEN[10:] + '"}') + call(1, TOKEN[5:] + '"}') + "data: [DONE]\n\n", LOOKUP, True)
    texts = {0: "", 1: ""}
    for d in payloads(out):
        for c in d["choices"][0]["delta"]["tool_calls"]:
            texts[c["index"]] += c["function"]["arguments"]
    assert [json.loads(t) for t in texts.values()] == [{"a": 'a"b@x.org'}, {"b": 'a"b@x.org'}]


def test_not_placeholders():
    for t in ("prefix_" + CORE, CORE + "_backup", CORE + "A", "{{RG_TYPE_TOKEN}}"):
        assert sse.restore_text(t, LOOKUP) == t


def test_channel_limit_is_sticky(monkeypatch):
    monkeypatch.setattr(sse, "MAX_CHANNELS", 2)
    r = sse.Restorer()
    out = r.push("".join(event("a", n, output_index=n) for n in range(4)), LOOKUP)
    assert r.failed == "stream_limit_exceeded" and len(payloads(out)) == 2 and r.push(event("b", 9), LOOKUP) == ""


def test_structured_streaming_gives_the_table_s_answer(spark, tmp_path):
    from veilspark.plans import documents

    v, chunks = documents.stream_chunks(spark, TINY)
    full = sse.with_tokens(chunks, v, chunks.conv_id).select("stream_id", "seq", "chunk", "last", "tokens")
    want = {(r.stream_id, r.seq): r.text for r in sse.restore_table(full).collect()}
    for k in range(3):  # three micro-batches
        full.where(f"seq % 1000 between {k * 4} and {k * 4 + 3 if k < 2 else 999}").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(full.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
    q = sse.restore_stream(stream).writeStream.format("memory").queryName("restored").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.stream_id, r.seq): r.text for r in spark.table("restored").collect()} == want


def test_session_cache():
    c = sessions.Cache(sessions.Limits(ttl_s=10, sessions=2, mappings=3, held_bytes=10_000))
    assert [c.use(0, "a", "x"), c.use(1, "a", "x"), c.use(2, "b", "y"), c.use(3, "c", "z")] == ["stored", "hit", "stored", "stored"]
    assert list(c.held) == ["b", "c"]  # a was used least recently
    assert c.use(13, "b", "y") == "stored"  # idle for the time to live
    assert c.use(13, "b", "v" * 20_000) == "local"
    assert c.held_bytes == sum(512 + sum(v.values()) for _, v in c.held.values())


def test_bodies_are_taken_in_slices():
    whole = pd.DataFrame({"doc_id": range(1000), "body": ["{}"] * 1000})
    some = list(jsondoc._slices(iter([whole, whole.iloc[:1]])))
    assert max(map(len, some)) == 256 and [i for b in some for i in b["doc_id"]] == [*range(1000), 0]
