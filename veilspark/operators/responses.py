"""A table of upstream responses to restored bodies or errors: one row is routed by its class to a JSON tree, to text, or stays as it is.

The class comes from status, type, encoding and size alone. Bodies of JSON and text are read once for the placeholders that they ask for, in Python, which knows
every spelling, also those that only show once a JSON string is unescaped; the values asked for are joined by scope and placeholder, never a scope's whole vault;
and the bodies are written once. Bodies meet the values found for them by id, so a scope with many responses is no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions import net
from veilspark.operators import jsondoc, vault
from veilspark.streaming.sse import restore_text

MAX_BODY = 20 << 20


def _strings(kind: str, body: str) -> list[tuple[int, str]] | None:
    """(number, value) of a JSON body's strings; None for what is restored as text."""
    if kind != "json":
        return None
    try:
        found = jsondoc.scan(body, credentials=False)
    except jsondoc.TooDeep:
        return None
    return None if found is None else [(n, leaf.value) for n, (leaf, *_) in enumerate(jsondoc.walk(found.leaves)) if leaf.kind == "string"]


def _wanted(kind: str, body: str) -> list[str]:
    """The placeholders that a body asks for, as they are issued."""
    out: dict[str, None] = {}
    for _, value in _strings(kind, body) or [(0, body)]:
        restore_text(value, lambda t: out.setdefault(t))
    return list(out)


def _restored(kind: str, body: str, known: dict[str, str]) -> tuple[str, int, int, int]:
    """(body, placeholders restored, different ones, unresolved)."""
    hits: list[str] = []
    missed = 0

    def look(token: str) -> str | None:
        nonlocal missed
        raw = known.get(token)
        if raw is None:
            missed += 1
        else:
            hits.append(token)
        return raw

    strings = _strings(kind, body)
    if strings is None:
        body = restore_text(body, look)
    else:
        new = {n: r for n, v in strings if (r := restore_text(v, look)) != v}
        body = jsondoc.rewritten(body, new, False) if new else body
    return body, len(hits), len(set(hits)), missed


def restore(responses: DataFrame, known: DataFrame, max_body: int = MAX_BODY) -> DataFrame:
    """id, class, error, body, restored, restored_unique, unresolved, restore_status from rows (id, scope, status, content_type, encoding, redactions, body).

    known: scope, token, raw. class is empty, untouched, json or text, and '' beside an error; body is null for the empty class and errors. Ids are unique.
    """
    size = F.coalesce(F.octet_length("body"), F.lit(0))
    kind = net.response_class(F.col("status"), F.col("content_type"), F.col("encoding"), size, max_body)
    source = responses.select("id", "scope", "redactions", kind.alias("kind"), F.when(kind.isin("untouched", "json", "text"), F.coalesce("body", F.lit(""))).alias("body"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, scope, k, body in zip(*(b.column(n).to_pylist() for n in ("id", "scope", "kind", "body"))):
                if some := _wanted(k, body):
                    yield pa.RecordBatch.from_pydict({"id": pa.array([i] * len(some), b.schema.field("id").type), "scope": pa.array([scope] * len(some), b.schema.field("scope").type), "token": pa.array(some, pa.string())})

    types = dict(source.dtypes)
    asked = source.where(F.col("kind").isin("json", "text") & F.lower("body").contains("rg")).mapInArrow(ask, f"id {types['id']}, scope {types['scope']}, token string")
    values = asked.join(known.select("scope", "token", "raw"), ["scope", "token"]).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("token", "raw"))).alias("known"))
    joined = source.join(values, "id", "left").select("id", "redactions", "kind", "body", "known")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_restored(k, t, dict(v or ())) if k in ("json", "text") else (t, 0, 0, 0) for k, t, v in zip(*(b.column(n).to_pylist() for n in ("kind", "body", "known")))]
            columns = [pa.array([m[j] for m in made], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("redactions"), b.column("kind"), *columns], names=["id", "redactions", "kind", "body", "restored", "restored_unique", "unresolved"])

    done = joined.mapInArrow(put, f"id {types['id']}, redactions {types['redactions']}, kind string, body string, restored int, restored_unique int, unresolved int")
    fine = F.col("kind").isin("empty", "untouched", "json", "text")
    told = vault.restore_status(F.col("restored"), F.col("unresolved"), F.col("redactions"), F.col("kind").isin("json", "text") | ~fine, ~fine)
    return done.select("id", F.when(fine, F.col("kind")).otherwise("").alias("class"), F.when(fine, "").otherwise(F.col("kind")).alias("error"), "body", "restored", "restored_unique", "unresolved", told.alias("restore_status"))
