"""JSON bodies as tables of leaves, and back.

A body is scanned once, in Python, to leaves: strings and numbers with their place in the text, their path and field.
Strings that hold JSON are scanned in turn. Everything about detection then runs on the leaf table with column functions, and
rewrite() puts new strings into the places of old ones, so that everything else (key order, number lexemes, white space,
escapes) stays byte for byte. Keys are never rewritten.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import validators as V
from veilspark.functions.arrays import quoted
from veilspark.operators import policy, spans, vault

MAX_DEPTH, MAX_ENCODED = 64, 8
#: Fields whose text is read as JSON of any kind, not just objects and arrays. Fixed values.
JSON_FIELDS = ("arguments", "partial_json")
# Names, without case and separators, whose whole value is a credential.
CREDENTIAL_FIELDS = (
    "apikey", "apitoken", "accesskey", "accesskeyid", "accesskeysecret", "secretaccesskey", "accesstoken", "refreshtoken", "clientsecret",
    "password", "passwd", "secret", "token", "authorization", "privatekey", "credential", "credentials",
)
_SPACE, _STRING = re.compile(r"[ \t\n\r]*"), re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_NUMBER, _WORD = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"), re.compile("true|false|null")


class TooDeep(ValueError):
    """Nesting beyond the limit."""


@dataclass
class Leaf:
    path: tuple[str | int, ...]
    kind: str  # string or number
    start: int
    end: int
    value: str
    inner: list[Leaf] | None = None  # leaves of the JSON that the string holds


@dataclass
class Scan:
    text: str
    depth: int = 0
    leaves: list[Leaf] = field(default_factory=list)
    opened: dict[tuple[str | int, ...], int] = field(default_factory=dict)  # where each array begins

    def run(self) -> Scan | None:
        """None if the text is not exactly one JSON value."""
        try:
            at = self._value(_SPACE.match(self.text).end(), ())
        except _Invalid:
            return None
        return self if _SPACE.match(self.text, at).end() == len(self.text) else None

    def _skip(self, at: int, c: str) -> int:
        if self.text[at : at + 1] != c:
            raise _Invalid
        return _SPACE.match(self.text, at + 1).end()

    def _value(self, at: int, path: tuple[str | int, ...]) -> int:
        c = self.text[at : at + 1]
        if c and c in "{[":
            if self.depth + len(path) >= MAX_DEPTH:
                raise TooDeep
            close, at = "}" if c == "{" else "]", self._skip(at, c)
            if c == "[":
                self.opened[path] = at
            if self.text[at : at + 1] == close:
                return at + 1
            n = 0
            while True:
                if c == "{":
                    m = _STRING.match(self.text, at)
                    if not m:
                        raise _Invalid
                    step: str | int = json.loads(m.group())
                    at = self._skip(_SPACE.match(self.text, m.end()).end(), ":")
                else:
                    step = n
                at = _SPACE.match(self.text, self._value(at, (*path, step))).end()
                n += 1
                if self.text[at : at + 1] == close:
                    return at + 1
                at = self._skip(at, ",")
        for kind, pattern in (("string", _STRING), ("number", _NUMBER), ("", _WORD)):
            if m := pattern.match(self.text, at):
                if kind:
                    self.leaves.append(Leaf(path, kind, at, m.end(), json.loads(m.group()) if kind == "string" else m.group()))
                return m.end()
        raise _Invalid


class _Invalid(ValueError):
    pass


def field_of(path: tuple[str | int, ...]) -> str:
    """The nearest key: elements of an array have the field of the array."""
    return next((p for p in reversed(path) if isinstance(p, str)), "")


def is_credential_field(name: str) -> bool:
    return re.sub(r"[_\-. ]", "", name).lower() in CREDENTIAL_FIELDS


def credential_field(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[_\-. ]", "")).isin(*CREDENTIAL_FIELDS)


def credential_sql(name: str) -> str:
    return f"lower(regexp_replace({name}, '[_. -]', '')) IN ({', '.join(map(quoted, CREDENTIAL_FIELDS))})"


def scan(text: str, depth: int = 0, encoded: int = 0, name: str = "", credentials: bool = True) -> Scan | None:
    """Scans text and, layer by layer, the JSON inside its strings. TooDeep beyond either limit."""
    found = Scan(text, depth).run()
    if found is None:
        return None
    for leaf in found.leaves:
        own = field_of(leaf.path) or name
        if leaf.kind != "string" or credentials and is_credential_field(own) and leaf.value.strip():
            continue
        if leaf.value.lstrip()[:1] in ("{", "[") and leaf.value.strip() or own in JSON_FIELDS:
            inner = scan(leaf.value, depth + len(leaf.path), encoded + 1, own, credentials) if encoded < MAX_ENCODED else Scan(leaf.value).run()
            if inner is not None:
                if encoded >= MAX_ENCODED:
                    raise TooDeep
                leaf.inner = inner.leaves
    return found


def walk(leaves: list[Leaf], outer: tuple[str | int, ...] | None = None, name: str = "", layer: int = 0) -> Iterator[tuple[Leaf, tuple[str | int, ...], str, int]]:
    """The leaves that hold text themselves: (leaf, path of the outermost string, field, layer), in text order."""
    for leaf in leaves:
        own = field_of(leaf.path) or name
        where = outer if outer is not None else leaf.path
        if leaf.inner is None:
            yield leaf, where, own, layer
        else:
            yield from walk(leaf.inner, where, own, layer + 1)


def audit_path(path: tuple[str | int, ...], masked: Callable[[str], bool] = lambda _: False) -> str:
    """$.a[0]["b c"]; a key that is sensitive itself shows as redacted."""
    out = "$"
    for p in path:
        if isinstance(p, int):
            out += f"[{p}]"
        elif masked(p):
            out += '["<redacted-key>"]'
        else:
            out += f".{p}" if re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", p) else f"[{json.dumps(p, ensure_ascii=False)}]"
    return out


#: Bodies that are taken at once: a batch's rows in Python are those of so many, not of all bodies that arrive together.
_AT_ONCE = 256


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for k in range(0, len(b), _AT_ONCE):
            yield b.iloc[k : k + _AT_ONCE]


LEAF_SCHEMA = "doc_id long, leaf int, steps array<string>, field string, kind string, value string, layer int, protected boolean, error string"


def leaves(df: DataFrame, id_col: str = "doc_id", body_col: str = "body", protocol_col: str | None = None, credentials: bool = True) -> DataFrame:
    """A row for each leaf; for a body that can't be read one row with error. steps are keys, and [n] for elements."""
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(body_col).alias("body"), (F.col(protocol_col) if protocol_col else F.lit("generic")).alias("protocol"))

    def rows(doc: int, body: str | None, protocol: str) -> Iterator[tuple]:
        try:
            found = scan(body or "", credentials=credentials)
        except TooDeep:
            yield doc, 0, [], "", "error", "", 0, False, "json_nesting_limit"
            return
        if found is None:
            yield doc, 0, [], "", "error", "", 0, False, "invalid_request"
            return
        rules = policy.Policy(json.loads(body), protocol)
        for n, (leaf, where, name, layer) in enumerate(walk(found.leaves)):
            safe = rules.keeps(where)  # JSON in a string has the string's own protection and no other
            yield doc, n, [f"[{p}]" if isinstance(p, int) else p for p in where], name, leaf.kind, leaf.value, layer, safe, ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in LEAF_SCHEMA.split(", ")]
        for b in _slices(batches):
            out = [r for x in b.itertuples(index=False) for r in rows(x.doc_id, x.body, x.protocol)]
            yield pd.DataFrame(out, columns=names)

    return source.mapInPandas(run, LEAF_SCHEMA)


def leaf_spans(found: DataFrame, flags: str = spans.FLAGS, costs: list[int] | None = None) -> DataFrame:
    """Candidates in the leaves that may be masked: id is the struct (doc_id, leaf). A credential field's text is one span."""
    some = found.where((F.col("kind") == "string") & ~F.col("protected")).withColumn("id", F.struct("doc_id", "leaf"))
    whole = credential_field(F.col("field")) & (F.regexp_replace("value", r"\s", "") != "") if "G" in flags else F.lit(False)
    out = spans.candidates(some.where(~whole), flags, "id", "value", costs)
    if "G" in flags:
        named = some.where(whole).select("id", F.lit(0).alias("start"), F.length("value").alias("end"), "value", F.lit("CREDENTIAL").alias("label"), F.lit(80).alias("priority"))
        out = out.unionByName(named)
    return out


def blocked_numbers(found: DataFrame, flags: str = "PIB") -> DataFrame:
    """doc_id, leaf, steps, label of number leaves whose exact integer value is sensitive. The value is not shown."""
    digits = F.col("digits")
    label = F.lit(None).cast("string")
    if "B" in flags:
        label = F.when(V.luhn_card(digits), "CARD").otherwise(label)
    if "I" in flags:
        label = F.when(V.identity_number(digits, spans.AS_OF), "IDCARD").otherwise(label)
    if "P" in flags:
        label = F.when(digits.rlike("^1[3-9][0-9]{9}$"), "PHONE").otherwise(label)
    numbers = found.where((F.col("kind") == "number") & ~F.col("protected")).withColumn("digits", V.exact_integer(F.col("value")))
    return numbers.withColumn("label", label).where(F.col("label").isNotNull()).select("doc_id", "leaf", "steps", "label")


def sensitive_keys(found: DataFrame, costs: list[int] | None = None) -> DataFrame:
    """Distinct keys of the leaves' paths that a rule matches."""
    keys = found.select(F.explode("steps").alias("key")).where(~F.col("key").rlike(r"^\[[0-9]+\]$")).distinct()
    return spans.candidates(keys.select("key", F.col("key").alias("text")), id_col="key", costs=costs).select("key").distinct()


def rendered_paths(found: DataFrame, masked_keys: DataFrame) -> DataFrame:
    """doc_id, leaf, path: audit paths, with sensitive keys shown as redacted."""
    steps = found.select("doc_id", "leaf", F.posexplode_outer("steps").alias("pos", "key"))
    joined = steps.join(masked_keys.select(F.col("key").alias("mk")), F.col("key") == F.col("mk"), "left")
    plain = F.col("key").rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$")
    quoted = F.concat(F.lit("["), F.regexp_extract(F.to_json(F.array("key")), r"(?s)^\[(.*)\]$", 1), F.lit("]"))
    part = F.when(F.col("key").isNull(), "").when(F.col("mk").isNotNull(), '["<redacted-key>"]').when(F.col("key").rlike(r"^\[[0-9]+\]$"), F.col("key")).when(plain, F.concat(F.lit("."), "key")).otherwise(quoted)
    ordered = F.array_sort(F.collect_list(F.struct("pos", part.alias("s"))))
    return joined.groupBy("doc_id", "leaf").agg(F.concat(F.lit("$"), F.array_join(F.transform(ordered, lambda x: x.s), "")).alias("path"))


def rewritten(text: str, new: dict[int, str], credentials: bool = True) -> str:
    """text with leaf n replaced by new[n], each layer escaped anew where, and only where, something changed."""

    def build(body: str, some: list[Leaf], counter: list[int]) -> str:
        out, at = [], 0
        for leaf in some:
            if leaf.inner is not None:
                changed = build(leaf.value, leaf.inner, counter)
            else:
                changed = new.get(counter[0], leaf.value)
                counter[0] += 1
            if leaf.kind == "string" and changed != leaf.value:
                out += [body[at : leaf.start], json.dumps(changed, ensure_ascii=False)]
                at = leaf.end
        return "".join([*out, body[at:]])

    found = scan(text, credentials=credentials)
    return text if found is None else build(text, found.leaves, [0])


def rewrite(df: DataFrame, replacements: DataFrame, id_col: str = "doc_id", body_col: str = "body", credentials: bool = True) -> DataFrame:
    """id_col, body_col with the strings of replacements (doc_id, leaf, text) put in."""
    per = replacements.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("leaf", "text"))).alias("new")).withColumnRenamed("doc_id", "rid")
    joined = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(body_col).alias("body")).join(per, F.col("doc_id") == F.col("rid"), "left").select("doc_id", "body", "new")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _slices(batches):
            made = [body if new is None or body is None else rewritten(body, dict(new), credentials) for body, new in zip(b["body"], b["new"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "body": made})

    return joined.mapInPandas(run, "doc_id long, body string")


def restored(df: DataFrame, known: DataFrame, scope: Column, id_col: str = "doc_id", body_col: str = "body") -> DataFrame:
    """id_col, body_col with the placeholders in all strings restored, also in JSON inside strings: each layer is escaped anew, so that a
    value with quotes or backslashes can't break the body. A body that is no JSON is restored as text. known: the vault; scope: over id_col as doc_id."""
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(body_col).alias("body"))
    found = leaves(source, credentials=False)
    texts = found.where((F.col("kind") == "string") & F.col("value").rlike("[Rr][Gg]_")).select(F.struct("doc_id", "leaf").alias("id"), "value", "doc_id")
    back = vault.restore(texts, known, scope, "id", "value").where(F.col("restored") > 0)
    new = rewrite(source, back.select("id.doc_id", "id.leaf", F.col("restored_text").alias("text")), credentials=False)
    plain = found.where("kind = 'error'").select(F.col("doc_id").alias("pid")).distinct()
    text = vault.restore(source.join(plain, F.col("doc_id") == F.col("pid"), "left_semi"), known, scope, "doc_id", "body")
    rest = new.join(plain, F.col("doc_id") == F.col("pid"), "left_anti")
    return rest.unionByName(text.select("doc_id", F.col("restored_text").alias("body"))).withColumnRenamed("doc_id", id_col).withColumnRenamed("body", body_col)


# The notice -------------------------------------------------------------------------------------------------------------------

#: Fixed value: what is put before the last user message of a request in which something was masked.
NOTICE = (
    "Some values in this request are opaque redaction placeholders. When using those values in text or tool arguments, copy the placeholders exactly "
    "so the local gateway can restore them. Apply this silently while completing the user's original task; do not acknowledge this notice or invent example placeholders."
)


def with_notice(body: str, protocol: str) -> str:
    """body with the notice, once; unchanged where there is no user message to carry it."""
    found = Scan(body).run()
    root = json.loads(body) if found else None
    if not isinstance(root, dict):
        return body
    at = {leaf.path: leaf for leaf in found.leaves if leaf.kind == "string"}

    def put(path: tuple[str | int, ...]) -> str:
        leaf = at[path]
        if leaf.value == NOTICE or leaf.value.startswith(NOTICE + "\n\n"):
            return body
        return body[: leaf.start] + json.dumps(f"{NOTICE}\n\n{leaf.value}", ensure_ascii=False) + body[leaf.end :]

    name = "input" if protocol == "openai_responses" and isinstance(root.get("input"), (str, list)) else "messages"
    some = root.get(name)
    if isinstance(some, str) and name == "input":
        return put((name,))
    users = [k for k, m in enumerate(some) if isinstance(m, dict) and m.get("role") == "user"] if isinstance(some, list) else []
    if not users:
        return body
    here = (name, users[-1], "content")
    content = some[users[-1]].get("content")
    if isinstance(content, str):
        return put(here)
    if not isinstance(content, list):
        return body
    for k, block in enumerate(content):
        if isinstance(block, dict) and isinstance(block.get("text"), str) and (block.get("type") if isinstance(block.get("type"), str) else "") in ("", "text", "input_text"):
            return put((*here, k, "text"))
    block = json.dumps({"type": "input_text" if protocol == "openai_responses" else "text", "text": NOTICE})
    begin = found.opened[here]
    return body[:begin] + block + ("," if content else "") + body[begin:]


def add_notice(df: DataFrame, body_col: str, protocol: str) -> DataFrame:
    """df with noticed_body."""

    @F.pandas_udf("string")
    def put(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: with_notice(b, protocol) if b else b)

    return df.withColumn("noticed_body", put(F.col(body_col)))
