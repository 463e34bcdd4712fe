"""Reversible placeholders: issue, redact, recognise, restore.

A token is {{RG_<LABEL>_<16 base-32 digits>}}. Its digits are 80 bits of a keyed hash of (scope, value), so a repeated or
speculative task issues the same token, and without the key values can't be guessed. In a scope one value has one token
whatever it was found as: the label of its first place counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.arrays import let, over, quoted
from veilspark.operators import intervals, spans

_BASE32, _ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Distinct values that may be masked in one scope.
LIMIT = 16_384
CORE = r"(?i)RG_[A-Z][A-Z0-9_]{0,63}_[A-Z2-7]{16}"


def clean_label(label: Column) -> Column:
    """Upper case, letters and digits only, a letter first, 32 at most; SECRET if nothing is left."""
    kept = F.regexp_replace(F.upper(label), "[^A-Z0-9]", "")
    return F.when(kept.rlike("^[A-Z]"), F.substring(kept, 1, 32)).otherwise(F.lit("SECRET"))


def token_id(secret: str, scope: Column, raw: Column) -> Column:
    digest = F.sha2(F.concat_ws("\x1f", F.lit(secret), scope.cast("string"), raw), 256)
    part = lambda at: F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0")
    return F.translate(F.concat(part(1), part(11)), _BASE32, _ALPHABET)


def token(secret: str, scope: Column, label: Column, raw: Column) -> Column:
    return F.concat(F.lit("{{RG_"), clean_label(label), F.lit("_"), token_id(secret, scope, raw), F.lit("}}"))


def issue(found: DataFrame, secret: str, id_col: str = "doc_id") -> DataFrame:
    """scope, raw, label, token from rows (scope, id, start, label, raw). Partial aggregation keeps a frequent value from being a hot key."""
    first = F.min_by("label", F.struct(id_col, "start"))
    return found.groupBy("scope", "raw").agg(first.alias("label")).withColumn("token", token(secret, F.col("scope"), F.col("label"), F.col("raw")))


def over_limit(vault: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Scopes with more distinct values than the limit, with their number."""
    return vault.groupBy("scope").agg(F.count(F.lit(1)).alias("n_values")).where(F.col("n_values") > limit)


def with_raw(df: DataFrame, merged: DataFrame, scope: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Merged spans with their scope and text."""
    texts = df.select(F.col(id_col).alias("tid"), F.col(text_col).alias("t"), scope.alias("scope"))
    joined = merged.join(texts, F.col(id_col) == F.col("tid"))
    return joined.select(id_col, "start", "end", "label", "scope", F.expr("substring(t, start + 1, end - start)").alias("raw"))


def _spliced(df: DataFrame, parts: DataFrame, id_col: str, text_col: str, out: str, extra: list[str]) -> DataFrame:
    joined = df.join(parts.withColumnRenamed(id_col, "pid"), F.col(id_col) == F.col("pid"), "left")
    return joined.withColumn(out, F.when(F.col("parts").isNull(), F.col(text_col)).otherwise(intervals.splice(F.col(text_col), F.col("parts")))).select(*df.columns, out, *extra)


def redact(df: DataFrame, found: DataFrame, vault: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with redacted_text; found as with_raw() gives it."""
    placed = found.join(vault.select("scope", "raw", "token"), ["scope", "raw"])
    parts = placed.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "end", "token"))).alias("parts"))
    return _spliced(df, parts, id_col, text_col, "redacted_text", [])


_CLOSING, _BRACES = r"^((?:\\{0,3}\}){0,2})", r"((?:\\{0,3}\{){1,2})$"
PLACEHOLDERS = "array<struct<start:int,end:int,token:string,altered:boolean>>"


def placeholders_sql(t: str) -> str:
    """[(start, end, token, altered)] of everything in a text that may be a placeholder, whatever happened to its spelling, in order.

    Up to two braces at either side, each behind up to three backslashes, any case, underscores in the label. A bare core
    must not touch an identifier. token is null where the label is too long to have been issued.
    """
    before = f"CASE WHEN x_.start > 0 THEN substr({t}, greatest(x_.start - 7, 1), least(x_.start, 8)) ELSE '' END"
    label = f"regexp_replace(upper(regexp_extract(x_.value, {quoted('(?i)^RG_(.*)_[A-Z2-7]{16}$')}, 1)), '_', '')"
    closing, braces = f"regexp_extract(af_, {quoted(_CLOSING)}, 1)", f"regexp_extract(be_, {quoted(_BRACES)}, 1)"
    opening = f"CASE WHEN be_ LIKE '%{{{{' THEN 2 WHEN length(regexp_replace(br_, '[^{{]', '')) = 1 AND NOT contains(cl_, {quoted(chr(92))}) THEN 1 ELSE length(br_) END"
    loose = "(op_ = 0 AND rlike(be_, '[A-Za-z0-9_]$')) OR (length(cl_) = 0 AND rlike(af_, '^[A-Za-z0-9_]'))"
    made = "CASE WHEN length(la_) <= 32 THEN concat('{{RG_', la_, '_', upper(right(x_.value, 16)), '}}') END"
    seen = "concat(right(be_, op_), x_.value, left(af_, length(cl_)))"
    out = f"CASE WHEN NOT ({loose}) THEN {let(made, 'to_', f"named_struct('start', x_.start - op_, 'end', x_.end + length(cl_), 'token', to_, 'altered', to_ IS NOT NULL AND {seen} <> to_)")} END"
    for value, name in ((opening, "op_"), (label, "la_"), (braces, "br_"), (closing, "cl_")):
        out = let(value, name, out)
    # As it was issued: nothing is to be undone.
    issued = f"endswith(be_, '{{{{') AND startswith(af_, '}}}}') AND rlike(x_.value, {quoted('^RG_[A-Z][A-Z0-9]{0,31}_[A-Z2-7]{16}$')})"
    out = f"CASE WHEN {issued} THEN named_struct('start', x_.start - 2, 'end', x_.end + 2, 'token', concat('{{{{', x_.value, '}}}}'), 'altered', false) ELSE {out} END"
    for value, name in ((f"substr({t}, x_.end + 1, 8)", "af_"), (before, "be_")):
        out = let(value, name, out)
    return f"CASE WHEN rlike({t}, '[Rr][Gg]_') THEN array_compact(transform({spans.matches_sql(t, CORE)}, x_ -> {out})) ELSE cast(array() AS {PLACEHOLDERS}) END"


def placeholders_in(text: Column) -> Column:
    return over(text, "t_", placeholders_sql("t_"))


def placeholders(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """placeholders_in() as rows."""
    return df.select(id_col, F.explode(F.expr(placeholders_sql(f"`{text_col}`"))).alias("p")).select(id_col, "p.*")


def unprotected(merged: DataFrame, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Merged spans without the placeholders that df's texts hold already: what is masked stays as it is, the rest of a span goes on."""
    return intervals.difference(merged, placeholders(df, id_col, text_col).select(id_col, "start", "end"), id_col)


def limited(found: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(spans of the scopes with at most limit distinct values, scopes beyond it with their number). Whoever masks with the first must refuse
    the texts of the second, whole: see masking.redact()."""
    beyond = found.groupBy("scope").agg(F.count_distinct("raw").alias("n_values")).where(F.col("n_values") > limit)
    return found.join(beyond, "scope", "left_anti"), beyond


def restore(df: DataFrame, vault: DataFrame, scope: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with restored_text, restored, restored_unique, unresolved, degraded. What is put in is not scanned again."""
    scopes = df.select(F.col(id_col).alias("sid"), scope.alias("scope"))
    found = placeholders(df, id_col, text_col).join(scopes, F.col(id_col) == F.col("sid")).drop("sid")
    known = vault.select(F.col("scope").alias("vs"), F.col("token").alias("vt"), "raw")
    looked = found.join(known, (F.col("scope") == F.col("vs")) & (F.col("token") == F.col("vt")), "left")
    hit = F.col("raw").isNotNull()
    parts = looked.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.when(hit, F.struct("start", "end", F.col("raw").alias("token"))))).alias("parts"),
        F.count_if(hit).alias("restored"),
        F.count_distinct(F.when(hit, F.col("token"))).alias("restored_unique"),
        F.count_if(~hit).alias("unresolved"),
        F.count_if(hit & F.col("altered")).alias("degraded"),
    )
    counters = ["restored", "restored_unique", "unresolved", "degraded"]
    return _spliced(df, parts, id_col, text_col, "restored_text", counters).fillna(0, counters)


def restore_status(restored: Column, unresolved: Column, redactions: Column, processed: Column, failed: Column) -> Column:
    """partial, unresolved, restored, no_sensitive_data, no_placeholders; response_error and not_processed go before."""
    return (
        F.when(~processed, "not_processed").when(failed, "response_error").when((restored > 0) & (unresolved > 0), "partial")
        .when(unresolved > 0, "unresolved").when(restored > 0, "restored").when(redactions == 0, "no_sensitive_data").otherwise("no_placeholders")
    )


def vault_bytes(vault: DataFrame) -> DataFrame:
    """scope, n_values, held_bytes: 512 a scope and 256 a mapping beside the bytes of value and token."""
    held = F.sum(F.octet_length("raw") + F.octet_length("token") + 256) + 512
    return vault.groupBy("scope").agg(F.count(F.lit(1)).alias("n_values"), held.alias("held_bytes"))


def session_ttl(events: DataFrame, key: str, at: str, minutes: int = 30) -> DataFrame:
    """key, started, ended, n: sessions that end when unused for the time to live; each use renews it."""
    order = Window.partitionBy(key).orderBy(at)
    last = F.lag(at).over(order)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    new = F.when(last.isNull() | (micros(F.col(at)) - micros(last) >= minutes * 60_000_000), 1).otherwise(0)
    numbered = events.withColumn("new", new).withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count(F.lit(1)).alias("n"))
