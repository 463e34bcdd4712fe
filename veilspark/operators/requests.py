"""A table of request bodies to masked bodies or errors, a row in, a row out.

A row leaves either with a masked body and what was done to it, or with an error class and no body. The body that comes out is only ever made by the last
step, from a row in which no step before it found a fault; a row that any step loses track of has the error invalid_request. Requests don't meet: the
scope of the placeholders is a column, values are hashed with it, and a value's label is that of its first place in the request. So nothing is exchanged,
and what is held for a request is bounded by the size that a body may have.

Steps: content type and size; one pass in Python to leaves; numbers; spans of every string that isn't protocol, with fields of credentials as a whole,
without the placeholders that are there; the limit of distinct values; one pass in Python that puts new strings in and, where something was newly
masked, the notice.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions import net
from veilspark.functions import validators as V
from veilspark.functions.arrays import let
from veilspark.operators import intervals, jsondoc, masking, policy, spans, vault

MAX_BODY = 20 << 20
_LEAF = "struct<leaf:int,steps:array<string>,field:string,kind:string,value:string>"


def _text(value: str) -> str:
    """value without halves of surrogate pairs, which no table can hold."""
    return value if value.isascii() else re.sub("[\ud800-\udfff]", "\ufffd", value)


def _leaves(body: str, path: str, anthropic: bool, credentials: bool) -> tuple[str, str, list[dict]]:
    """(error, protocol, the leaves that aren't protocol)."""
    try:
        found = jsondoc.scan(body, credentials=credentials)
    except jsondoc.TooDeep:
        return "json_nesting_limit", "generic", []
    if found is None:
        return "invalid_request", "generic", []
    root = json.loads(body)
    keys = root.keys() if isinstance(root, dict) else ()
    name = net.protocol_of(path, "messages" in keys, "input" in keys, anthropic)
    rules, out = policy.Policy(root, name), []
    for n, (leaf, where, own, _) in enumerate(jsondoc.walk(found.leaves)):
        if not rules.keeps(where):
            steps = [f"[{p}]" if isinstance(p, int) else _text(p) for p in where]
            out.append({"leaf": n, "steps": steps, "field": _text(own), "kind": leaf.kind, "value": _text(leaf.value)})
    return "", name, out


def _read(df: DataFrame) -> DataFrame:
    """df (id, body, path, anthropic, flags, scope, error) with protocol and leaves; rows that have an error have none."""
    kind = pa.list_(pa.struct([("leaf", pa.int32()), ("steps", pa.list_(pa.string())), ("field", pa.string()), ("kind", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in ("body", "path", "anthropic", "flags", "error")}
            made = [(e, "generic", []) if e else _leaves(t or "", p or "", bool(a), "G" in (f or "")) for t, p, a, f, e in zip(*c.values())]
            gone = b.schema.get_field_index("error")
            columns = [pa.array([m[0] for m in made], pa.string()) if k == gone else x for k, x in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], kind)], names=[*b.schema.names, "protocol", "leaves"])

    return df.mapInArrow(run, f"{df._jdf.schema().toDDL()}, protocol string, leaves array<{_LEAF}>")


def _with_masks(df: DataFrame, costs: list[int] | None) -> DataFrame:
    """df with masks, the strings of the column leaves with their spans to mask, in place of leaves; flags is the row's, and rows with an error have none.

    A step is a column: the analyzer resolves a level of nesting a pass and gives up after 100, more than one expression of all steps leaves room for.
    """
    whole = f"contains(flags, 'G') AND {jsondoc.credential_sql('lf_.field')} AND rlike(lf_.value, '[^\\\\s]')"
    named = f"array(named_struct('start', 0, 'end', length(lf_.value), 'value', lf_.value, 'label', 'CREDENTIAL', 'priority', 80))"
    some = f"CASE WHEN {whole} THEN cast({named} AS {spans.CANDIDATES}) ELSE {spans.candidates_sql('lf_.value', costs=costs, switch='flags')} END"
    strings = f"CASE WHEN error = '' THEN filter(leaves, lf_ -> lf_.kind = 'string') ELSE cast(array() AS array<{_LEAF}>) END"
    held = f"CASE WHEN size(lf_.spans) = 0 THEN cast(array() AS {vault.PLACEHOLDERS}) ELSE {vault.placeholders_sql('lf_.value')} END"
    rest = f"transform({intervals.without_sql('lf_.spans', 'lf_.held')}, q_ -> named_struct('start', q_.start, 'end', q_.end, 'label', q_.label, 'raw', substr(lf_.value, q_.start + 1, q_.end - q_.start)))"
    step = lambda of, more: f"transform({of}, lf_ -> named_struct('leaf', lf_.leaf, 'steps', lf_.steps, 'value', lf_.value, {more}))"
    out = df.withColumn("masks", F.expr(step(strings, f"'found', {some}"))).drop("leaves")
    for more in (f"'spans', {intervals.merged_sql('lf_.found')}", f"'spans', lf_.spans, 'held', {held}", f"'spans', {rest}"):
        out = out.withColumn("masks", F.expr(step("masks", more)))
    return out.withColumn("masks", F.expr("filter(masks, lf_ -> size(lf_.spans) > 0)"))


def _numbers_sql() -> str:
    """Whether a number's exact value is sensitive, under the row's flags."""
    digits = V.exact_integer_sql("lf_.value")
    bad = f"contains(flags, 'P') AND rlike(dg0_, '^1[3-9][0-9]{{9}}$') OR contains(flags, 'I') AND {V.identity_number_sql('dg0_', spans.AS_OF)} OR contains(flags, 'B') AND {V.luhn_card_sql('dg0_')}"
    return f"exists(filter(leaves, lf_ -> lf_.kind = 'number'), lf_ -> coalesce({let(digits, 'dg0_', bad)}, false))"


def _path_sql(costs: list[int] | None) -> str:
    """The audit path of lf_.steps; a key that any rule matches shows as redacted."""
    plain = "rlike(st_, '^[A-Za-z_$][A-Za-z0-9_$]*$')"
    hit = f"size({spans.candidates_sql('st_', costs=costs)}) > 0"
    quoted = "concat('[', regexp_extract(to_json(array(st_)), '(?s)^\\\\[(.*)\\\\]$', 1), ']')"
    step = f"CASE WHEN rlike(st_, '^\\\\[[0-9]+\\\\]$') THEN st_ WHEN {hit} THEN '[\"<redacted-key>\"]' WHEN {plain} THEN concat('.', st_) ELSE {quoted} END"
    return f"concat('$', array_join(transform(lf_.steps, st_ -> {step}), ''))"


def prepare(requests: DataFrame, secret: str, costs: list[int] | None = None, max_body: int = MAX_BODY, limit: int = vault.LIMIT) -> DataFrame:
    """id, protocol, error, status, body, hits {label: n}, redactions, fields [path], noticed from rows (id, scope, content_type, path, anthropic, flags, body).

    error is '' or a class with its status; body is null where there is one, and for an empty body. A row with null flags has all of them.
    """
    of = requests.select(
        "id", F.col("scope").cast("string").alias("scope"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("anthropic", F.lit(False)).alias("anthropic"), F.coalesce("flags", F.lit(spans.FLAGS)).alias("flags"), "body",
        F.when(F.coalesce(F.octet_length("body"), F.lit(0)) == 0, "").when(F.octet_length("body") > max_body, "request_too_large").when(~net.is_json_type(F.coalesce("content_type", F.lit(""))), "unsupported_body").otherwise("").alias("error"),
    )
    empty = F.coalesce(F.octet_length("body"), F.lit(0)) == 0
    read = _read(of.where(~empty))
    checked = read.withColumn("error", F.when(F.col("error") != "", F.col("error")).when(F.expr(_numbers_sql()), "numeric_sensitive_value").otherwise(""))
    found = _with_masks(checked, costs)
    every = F.flatten(F.transform("masks", lambda m: m["spans"]))
    listed = found.withColumn("every", every).withColumn("raws", F.transform("every", lambda s: s["raw"]))
    limited = listed.withColumn("error", F.when((F.col("error") == "") & (F.size(F.array_distinct("raws")) > limit), masking.TOO_MANY).otherwise(F.col("error")))
    first = lambda s: F.get(F.col("every"), (F.array_position("raws", s["raw"]) - 1).cast("int"))["label"]
    placed = lambda m: F.transform(m["spans"], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), vault.token(secret, F.col("scope"), first(s), s["raw"]).alias("token")))
    new = F.transform("masks", lambda m: F.struct(m["leaf"].alias("leaf"), m["value"].alias("value"), placed(m).alias("parts")))
    paths = F.array_sort(F.array_distinct(F.expr(f"transform(masks, lf_ -> {_path_sql(costs)})")))
    labels = F.transform("every", lambda s: s["label"])
    hits = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(labels)), lambda n: F.struct(n.alias("label"), F.size(F.filter(labels, lambda x: x == n)).alias("n"))))
    ok = F.col("error") == ""
    told = limited.select("id", "protocol", "flags", "error", "body", F.when(ok, new).alias("new"), F.when(ok, hits).alias("hits"), F.when(ok, F.size("every")).alias("redactions"), F.when(ok, paths).alias("fields"))
    out = _rewritten(told).withColumn("status", F.when(F.col("error") == "", F.lit(200)).otherwise(net.error_status(F.col("error"))))
    none = of.where(empty).select("id", net.protocol(F.col("path"), F.lit(False), F.lit(False), F.lit(False)).alias("protocol"), F.lit("").alias("error"), F.lit(None).cast("string").alias("body"), F.lit(None).cast("map<string,int>").alias("hits"), F.lit(0).alias("redactions"), F.lit(None).cast("array<string>").alias("fields"), F.lit(False).alias("noticed"), F.lit(200).alias("status"))
    return out.unionByName(none)


def _spliced(value: str, parts: list[dict]) -> str:
    out, at = [], 0
    for p in parts:
        out += [value[at : p["start"]], p["token"]]
        at = p["end"]
    return "".join([*out, value[at:]])


def _rewritten(told: DataFrame) -> DataFrame:
    """The only place where a body comes out: rows without an error, all their masked strings put in."""
    kept = told.drop("flags", "body", "new")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in ("error", "body", "new", "protocol", "flags")}
            bodies, noticed, errors = [], [], []
            for error, body, new, protocol, flags in zip(*c.values()):
                made, told_of = None, False
                if error == "" and (new is None or body is None):
                    error = "invalid_request"
                if error == "":
                    made = jsondoc.rewritten(body, {m["leaf"]: _spliced(m["value"], m["parts"]) for m in new}, "G" in flags) if new else body
                    with_notice = jsondoc.with_notice(made, protocol) if new else made
                    made, told_of = with_notice, with_notice != made
                bodies.append(made)
                noticed.append(told_of)
                errors.append(error)
            names = [n for n in b.schema.names if n not in ("flags", "body", "new")]
            columns = [pa.array(errors, pa.string()) if n == "error" else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bodies, pa.string()), pa.array(noticed, pa.bool_())], names=[*names, "body", "noticed"])

    return told.mapInArrow(run, f"{kept._jdf.schema().toDDL()}, body string, noticed boolean")
