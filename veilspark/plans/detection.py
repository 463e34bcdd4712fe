"""Queries of detection, intervals, placeholders: DataFrames and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import validators as V
from veilspark.operators import audit, credentials, entropy, intervals, masking, scan, spans, vault
from veilspark.sources import tables as T
from veilspark.sources import work

SECRET = "test-secret"
_L = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_LUHN = """length(d) BETWEEN 13 AND 19 AND length(replace(d, d[1], '')) > 0 AND
 list_sum(list_transform(range(0, length(d)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(d[length(d) - i] AS INT) WHEN 2 * CAST(d[length(d) - i] AS INT) > 9 THEN 2 * CAST(d[length(d) - i] AS INT) - 9 ELSE 2 * CAST(d[length(d) - i] AS INT) END)) % 10 = 0"""
_ID = f"""d[1:2] IN ({", ".join(f"'{p}'" for p in V.ID_PROVINCES)}) AND d[3:6] <> '0000' AND d[15:17] <> '000' AND try_strptime(d[7:14], '%Y%m%d') IS NOT NULL
 AND d[7:14] BETWEEN '18000101' AND '{spans.AS_OF}' AND upper(d[18:18]) = '{V.ID_CHECKS}'[CAST(list_sum(list_transform(range(1, 18), lambda i: CAST(d[i] AS INT) * {list(V.ID_WEIGHTS)}[i])) % 11 + 1 AS BIGINT)]"""

#: The oracle's own patterns, in its regex dialect, and its checks of d, the value or its digits.
SQL_RULES = {
    "email": (rf"[A-Za-z0-9.!#$%&''*+/=?^_`{{|}}~-]+@{_L}(?:\.{_L})+", None),
    "phone_cn": ("1[3-9][0-9]{9}", "true"),
    "phone_intl": (r"\+(?:[0-9][ .()\-]{0,2}){7,}[0-9]", "length(d) BETWEEN 8 AND 15 AND value[2] <> '0'"),
    "apikey": (r"\bsk-[A-Za-z0-9_-]{20,}\b", None),
    "idcard": ("[0-9]{17}[0-9Xx]", "id"),
    "card_plain": ("[0-9]{13,19}", _LUHN),
    "card_grouped": ("[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?", _LUHN),
    "privatekey": ("(?s)-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----.*?-----END (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----", None),
    "aws": (r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", None),
    "github": (r"\bgh[pousr]_[A-Za-z0-9]{20,255}\b", None),
    "gitlab": (r"\bglpat-[A-Za-z0-9_-]{20,}\b", None),
    "jwt": (r"\beyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\b", None),
    "connstr": (r"""(?i)\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|mssql)://[^\s"''<>]+""", None),
    "bearer": (r"(?i)\bBearer[ \t]+[A-Za-z0-9._~+/=-]{20,}", None),
    "assignment": (r"""(?i)\b(?:api[_-]?key|access[_-]?token|client[_-]?secret|token|secret|password|passwd)[ \t]*[:=][ \t]*["''][^"''\n]{8,200}["'']""", None),
    "stripe": (r"\b(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,99}\b", None),
    "google": (r"\bAIza[A-Za-z0-9_-]{35}\b", None),
    "npm": (r"\bnpm_[A-Za-z0-9]{36}\b", None),
    "huggingface": (r"\bhf_[A-Za-z0-9]{30,}\b", None),
    "entropy": ("[A-Za-z0-9]{9,}", None),
}


def spans_sql(source: str, name: str) -> str:
    """doc_id, start, end, value, label, priority of a rule."""
    pattern, check = SQL_RULES[name]
    rule = spans.BY_NAME.get(name, spans.TOKEN)
    base = f"""SELECT doc_id, text, value, CAST(list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda m: length(m))), 0) AS INT) AS start
 FROM (SELECT *, unnest(ms) AS value, generate_subscripts(ms, 1) AS k FROM (SELECT doc_id, text, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS ms FROM ({source})))"""
    out = f"SELECT doc_id, start, start + length(value) AS \"end\", value, '{rule.label}' AS label, {rule.priority} AS priority FROM ({base})"
    if check:
        d = "value" if check == "id" else "regexp_replace(value, '[^0-9]', '', 'g')"
        test = _ID if check == "id" else check
        edge = "NOT regexp_matches(substr(text, start + length(value) + 1, 1), '[0-9]') AND (start = 0 OR NOT regexp_matches(substr(text, start, 1), '[0-9]'))"
        out = f"SELECT doc_id, start, start + length(value) AS \"end\", value, '{rule.label}' AS label, {rule.priority} AS priority FROM (SELECT *, {d} AS d FROM ({base})) WHERE ({test}) AND {edge}"
    return out


DOCS = "SELECT doc_id, text FROM documents"


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return T.read(spark, folder, "documents").select("doc_id", "text")


def _rule_query(name: str):
    rule = spans.BY_NAME[name]
    if name in T.SECRETS:
        return lambda s, d: spans.spans(T.secrets(s, d, name), rule), spans_sql(T.secrets_sql(name), name)
    return lambda s, d: spans.spans(docs(s, d), rule), spans_sql(DOCS, name)


# Random tokens: the model is fitted to the benchmark's words ------------------------------------------------------------------

_COSTS_SQL = """words AS (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM benchmark),
pairs AS (SELECT substr('^' || w || '$', i, 2) AS p FROM (SELECT w, unnest(range(1, length(w) + 2)) AS i FROM words)),
counts AS (SELECT p[1] AS a, p[2] AS b, count(*) AS n FROM pairs GROUP BY ALL),
symbols AS (SELECT unnest(string_split('^$0123456789abcdefghijklmnopqrstuvwxyz', '')) AS c),
totals AS (SELECT s.c AS a, coalesce(sum(n), 0) AS total FROM symbols s LEFT JOIN counts ON a = s.c GROUP BY s.c),
costs AS MATERIALIZED (SELECT t.a || s.c AS p, CAST(round(-log2((coalesce(n, 0) + 1) / (total + 37.0)) * 10000) AS BIGINT) AS cost
  FROM totals t CROSS JOIN symbols s LEFT JOIN counts c ON c.a = t.a AND c.b = s.c WHERE s.c <> '^')"""
_CURVE = "CASE WHEN n <= 8 THEN CAST('inf' AS DOUBLE) " + " ".join(f"WHEN n <= {b} THEN {x}::DOUBLE + ({y - x!r})::DOUBLE * (n - {a}) / {b - a}::DOUBLE" for (a, x), (b, y) in zip(V.THRESHOLDS, V.THRESHOLDS[1:])) + f" ELSE {V.THRESHOLDS[-1][1]}::DOUBLE END"


def _random_sql(source: str) -> str:
    """CTEs; random(v) holds the values that count as random."""
    return f"""{_COSTS_SQL},
toks AS MATERIALIZED ({spans_sql(source, "entropy")}),
vals AS (SELECT DISTINCT value AS v, lower(value) AS l, length(value) AS n FROM toks WHERE NOT regexp_full_match(value, '[0-9]+')),
chars AS (SELECT v, n, c, count(*) AS k FROM (SELECT v, n, unnest(string_split(l, '')) AS c FROM vals) GROUP BY ALL),
varied AS (SELECT v FROM chars GROUP BY v, n HAVING -sum(k / n * log2(k / n)) >= least(2.5, log2(n) * 0.72)),
scored AS (SELECT v, n, sum(cost) AS cost FROM (SELECT v, n, substr('^' || l || '$', i, 2) AS p FROM (SELECT *, unnest(range(1, n + 2)) AS i FROM vals)) JOIN costs USING (p) GROUP BY v, n),
random AS MATERIALIZED (SELECT v FROM scored JOIN varied USING (v) WHERE cost / 10000.0::DOUBLE / (n + 1) > {_CURVE})"""


def model(spark: SparkSession, folder: str) -> list[int]:
    return entropy.fit(T.read(spark, folder, "benchmark"))


def entropy_tokens(s: SparkSession, d: str) -> DataFrame:
    return entropy.random_tokens(docs(s, d), model(s, d))


def entropy_by_lang(s: SparkSession, d: str) -> DataFrame:
    found = entropy_tokens(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return T.read(s, d, "documents").select("doc_id", "lang").join(found, "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_tokens"))


def bigram_costs(s: SparkSession, d: str) -> DataFrame:
    return entropy.bigrams(T.read(s, d, "benchmark")).select("a", "b", F.col("n").cast("long").alias("n"))


def threshold_curve(s: SparkSession, d: str) -> DataFrame:
    """The threshold of tokens of as many lengths as parts have."""
    n = F.length("p_name") + F.col("p_partkey") % 100
    return T.read(s, d, "part").select("p_partkey", n.cast("int").alias("n")).withColumn("threshold", F.round(F.when(F.col("n") > 8, V.random_threshold(F.col("n"))).otherwise(-1.0), 6))


def char_entropy(s: SparkSession, d: str) -> DataFrame:
    return T.read(s, d, "part").select("p_partkey", F.round(V.char_entropy(F.col("p_name")), 9).alias("bits"))


# Validators -------------------------------------------------------------------------------------------------------------------

_LEX = ["{v}", "{v}.0", "{v}.000", "0{v}", "{v}.5", "-{v}", "1.{v}e11", "0.{v}e12", "{v}e-2", "{v}00e-2", "{v}e9999999999", "{v}e2"]
_LEX_EXPR = "array(" + ", ".join("concat('" + x.replace("{v}", "', v, '") + "')" for x in _LEX) + ")"


def _lexemes(s: SparkSession, d: str) -> DataFrame:
    base = T.read(s, d, "customer").select("c_custkey", F.concat(F.lit("13"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("v"))
    return base.select("c_custkey", F.posexplode(F.expr(_LEX_EXPR)).alias("form", "lexeme"))


def numeric_block(s: SparkSession, d: str) -> DataFrame:
    """Number lexemes whose exact integer value would be blocked as a phone number or card."""
    x = _lexemes(s, d).withColumn("digits", V.exact_integer(F.col("lexeme")))
    label = F.when(F.col("digits").rlike("^1[3-9][0-9]{9}$"), "PHONE").when(V.luhn_card(F.col("digits")), "CARD")
    return x.select("c_custkey", "form", F.coalesce("digits", F.lit("")).alias("digits"), F.coalesce(label, F.lit("")).alias("blocked"))


def _numeric_sql() -> str:
    # The oracle reads the lexeme as a decimal of 38 digits with the exponent applied by hand.
    return f"""WITH x AS (SELECT c_custkey, '13' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS v FROM customer),
y AS (SELECT c_custkey, unnest([{", ".join("'" + l.replace("{v}", "' || v || '") + "'" for l in _LEX)}]) AS lexeme, unnest(range(0, {len(_LEX)})) AS form FROM x),
z AS (SELECT *, try_cast(string_split(lexeme, 'e')[1] AS DECIMAL(38, 18)) AS m, coalesce(try_cast(string_split(lexeme, 'e')[2] AS INT), CASE WHEN contains(lexeme, 'e') THEN 9999 ELSE 0 END) AS e FROM y),
w AS (SELECT *, CASE WHEN m <= 0 OR e > 20 THEN NULL WHEN e >= 0 THEN CAST(m AS DECIMAL(38, 18)) * CAST(10::HUGEINT ** 0 AS INT) END AS u FROM z),
q AS (SELECT c_custkey, form, lexeme, regexp_extract(lexeme, '^([0-9]+)', 1) AS i, regexp_extract(lexeme, '\\.([0-9]*)', 1) AS f, e, m FROM w),
r AS (SELECT *, CASE WHEN m <= 0 OR e > 40 THEN NULL WHEN e >= length(f) THEN i || f || repeat('0', e - length(f))
        WHEN e >= 0 THEN CASE WHEN regexp_matches(substr(f, e + 1), '[1-9]') THEN NULL ELSE i || substr(f, 1, e) END
        ELSE CASE WHEN regexp_matches(right(i, -e) || f, '[1-9]') THEN NULL ELSE left(i, length(i) + e) END END AS t FROM q),
k AS (SELECT c_custkey, form, CASE WHEN length(ltrim(t, '0')) BETWEEN 11 AND 19 THEN ltrim(t, '0') ELSE '' END AS d FROM r)
SELECT c_custkey, form, d AS digits, CASE WHEN regexp_full_match(d, '1[3-9][0-9]{{9}}') THEN 'PHONE' WHEN d <> '' AND ({_LUHN}) THEN 'CARD' ELSE '' END AS blocked FROM k"""


def luhn_valid(s: SparkSession, d: str) -> DataFrame:
    o = T.read(s, d, "orders").select("o_orderkey", F.concat(F.lit("4000"), F.lpad((F.col("o_orderkey") * 7919).cast("string"), 12, "0")).alias("v"))
    return o.select("o_orderkey", V.luhn_card(F.col("v")).alias("valid"))


def idcard_valid(s: SparkSession, d: str) -> DataFrame:
    return T.secrets(s, d, "idcard").select("doc_id", V.identity_number(F.regexp_extract("text", "([0-9]{17}[0-9X])", 1), spans.AS_OF).alias("valid"))


# Intervals, vault, restoration ------------------------------------------------------------------------------------------------

UNITS_SQL = f"SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 1000000000, text FROM ({T.secrets_sql()})"
_ALL_RULES = [r.name for r in spans.RULES]


def units(s: SparkSession, d: str) -> DataFrame:
    more = T.secrets(s, d).select((F.col("doc_id") + 1000000000).alias("doc_id"), "text")
    return T.dealt(docs(s, d), "doc_id").unionByName(more)


def _candidates_sql(source: str, with_random: bool = True) -> str:
    parts = [spans_sql("SELECT * FROM units", n) for n in _ALL_RULES]
    if with_random:
        parts.append("SELECT * FROM toks WHERE value IN (SELECT v FROM random)")
    head = f"units AS MATERIALIZED ({source})"
    if with_random:
        head += ", " + _random_sql("SELECT * FROM units")
    return f"{head}, c AS MATERIALIZED ({' UNION ALL '.join(parts)})"


_MERGE = """isl AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, priority DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl
 FROM (SELECT *, CASE WHEN pm IS NULL OR start >= pm THEN 1 ELSE 0 END AS nw
  FROM (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, priority DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM c))),
m AS MATERIALIZED (SELECT doc_id, min(start) AS start, max("end") AS "end", CASE WHEN max("end") = max(CASE WHEN rn = 1 THEN "end" END) THEN max(CASE WHEN rn = 1 THEN label END) ELSE 'SECRET' END AS label
 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, isl ORDER BY start, "end" DESC, priority DESC, label) AS rn FROM isl) GROUP BY doc_id, isl)"""


def candidates_all(s: SparkSession, d: str) -> DataFrame:
    return spans.candidates(units(s, d), costs=model(s, d))


def merged_spans(s: SparkSession, d: str) -> DataFrame:
    return intervals.merge(candidates_all(s, d))


def _protected(merged: DataFrame) -> DataFrame:
    """Every second span of a document's merged ones is made narrower by one at both ends, as something already masked."""
    m = merged.where("end - start > 4")
    return m.select("doc_id", (F.col("start") + 1).alias("start"), (F.col("end") - 2).alias("end")).where("start % 2 = 0")


def protected_split(s: SparkSession, d: str) -> DataFrame:
    m = work.written(merged_spans(s, d), "merged")  # places and labels, read twice
    return intervals.difference(m, _protected(m))


def coverage_monotone(s: SparkSession, d: str) -> DataFrame:
    """For each flag: spans found without it that aren't covered with all flags. No rows."""
    marked, every = scan.with_candidates(units(s, d), costs=model(s, d))
    return uncovered_flags(marked.select("doc_id", F.expr(every).alias("found")))


def uncovered_flags(found: DataFrame) -> DataFrame:
    """flag, doc_id, start, end of all flags from one scan: the spans of a choice of flags are those of all flags without the labels of the others, so
    nothing is scanned or merged twice. found: doc_id and all candidates of the text as an array."""
    of = lambda f: ", ".join(f"'{x}'" for x, b in _BIT.items() if b == spans.FLAGS.index(f))
    small = lambda f: intervals.merged_sql(f"filter(found, c_ -> c_.label NOT IN ({of(f)}))")
    bad = lambda f: f"transform({intervals.outside_sql(small(f), 'full')}, y_ -> named_struct('flag', '{f}', 'start', y_.start, 'end', y_.end))"
    merged = found.withColumn("full", F.expr(intervals.merged_sql("found")))
    every = F.expr(f"concat({', '.join(map(bad, spans.FLAGS))})")
    return merged.select("doc_id", F.explode(every).alias("s")).select("s.flag", "doc_id", "s.start", "s.end")


_BIT = {r.label: spans.FLAGS.index(r.flag) for r in (*spans.RULES, spans.TOKEN)}


def coverage_sets(s: SparkSession, d: str) -> DataFrame:
    """For each of the 128 choices of flags and each flag: code points covered before and after the flag is added, and those that it uncovers."""
    bit = F.get(F.array(*[F.lit(b) for b in _BIT.values()]), F.array_position(F.array(*[F.lit(x) for x in _BIT]), F.col("label")).cast("int") - 1)
    return intervals.coverage_steps(candidates_all(s, d).select("doc_id", "start", "end", bit.alias("bit"), F.lit(0).alias("hidden_by")), len(spans.FLAGS))


_COVERAGE_SETS = f"""b AS (SELECT doc_id, start AS p FROM c UNION SELECT doc_id, "end" FROM c), seg AS (SELECT doc_id, p AS a, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS z FROM b),
w AS (SELECT doc_id, start, "end", CASE label {" ".join(f"WHEN '{x}' THEN {1 << b}" for x, b in _BIT.items())} END AS f FROM c),
k AS (SELECT a, z, seg.doc_id, bit_or(f) AS mask FROM seg JOIN w ON w.doc_id = seg.doc_id AND start <= a AND "end" >= z WHERE z IS NOT NULL GROUP BY ALL), n AS (SELECT mask, sum(z - a) AS chars FROM k GROUP BY mask)
SELECT s.range::INT AS choice, t.range::INT AS added, coalesce(sum(chars) FILTER (mask & s.range <> 0), 0)::BIGINT AS before, coalesce(sum(chars) FILTER (mask & (s.range | (1 << t.range)) <> 0), 0)::BIGINT AS after,
 coalesce(sum(chars) FILTER (mask & s.range <> 0 AND mask & (s.range | (1 << t.range)) = 0), 0)::BIGINT AS lost FROM range(128) s, range(7) t, n GROUP BY ALL"""


# Credential formats: an invented value of each, from customer keys -------------------------------------------------------------

_HH = "(md5(cast(c_custkey AS string)) || md5(cast(c_custkey + 1 AS string)))"
_hex = lambda n, at=1: f"substr({_HH}, {at}, {n})"
SAMPLES = {
    "slack_token": f"'xoxb-' || {_hex(24)} || '-' || {_hex(12)}", "slack_webhook": f"'hooks.slack.com/services/T' || upper({_hex(9)}) || '/B' || upper({_hex(9, 9)}) || '/' || {_hex(24)}",
    "sendgrid": f"'SG.' || {_hex(22)} || '.' || {_hex(43)}", "twilio": f"'SK' || {_hex(32)}", "mailgun": f"'key-' || {_hex(32)}", "mailchimp": f"{_hex(32)} || '-us7'", "pypi": f"'pypi-AgEIcHlwaS5vcmc' || {_hex(60)}",
    "docker": f"'dckr_pat_' || {_hex(27)}", "digitalocean": f"'dop_v1_' || {_hex(64)}", "shopify": f"'shpat_' || {_hex(32)}", "square": f"'sq0atp-' || {_hex(22)}", "telegram": f"'123456789:AA' || {_hex(33)}",
    "vault": f"'hvs.' || {_hex(24)}", "terraform": f"{_hex(14)} || '.atlasv1.' || {_hex(64)}", "databricks": f"'dapi' || {_hex(32)}", "linear": f"'lin_api_' || {_hex(40)}", "notion": f"'ntn_' || {_hex(46)}",
    "postman": f"'PMAK-' || {_hex(24)} || '-' || {_hex(34)}", "grafana": f"'glsa_' || {_hex(32)} || '_' || {_hex(8)}", "new_relic": f"'NRAK-' || upper({_hex(27)})", "sentry": f"'sntrys_' || {_hex(64)}", "atlassian": f"'ATATT3' || {_hex(64)}",
    "age": f"'AGE-SECRET-KEY-1' || upper({_hex(58)})", "doppler": f"'dp.pt.' || {_hex(42)}", "planetscale": f"'pscale_tkn_' || {_hex(43)}", "pulumi": f"'pul-' || {_hex(40)}", "rubygems": f"'rubygems_' || {_hex(48)}",
    "shippo": f"'shippo_live_' || {_hex(40)}", "typeform": f"'tfp_' || {_hex(44)}", "airtable": f"'pat' || {_hex(14)} || '.' || {_hex(64)}", "facebook": f"'EAACEdEose0cBA' || {_hex(30)}", "google_oauth": f"'ya29.' || {_hex(40)}",
    "heroku": f"'heroku_key = ' || {_hex(8)} || '-' || {_hex(4, 9)} || '-' || {_hex(4, 13)} || '-' || {_hex(4, 17)} || '-' || {_hex(12, 21)}", "named_value": f"'client_secret: \"' || CASE WHEN c_custkey % 3 = 0 THEN 'some-plain-words' WHEN c_custkey % 4 = 0 THEN 'Example_Token' ELSE {_hex(40)} END || '\"'",
}


def _sample_item(name: str) -> str:
    """Every fifth value has a letter behind it, every seventh one before it, every eleventh an accented one."""
    text = f"'note ' || CASE WHEN c_custkey % 7 = 0 THEN 'z' WHEN c_custkey % 11 = 0 THEN 'é' ELSE '' END || ({SAMPLES[name]}) || CASE WHEN c_custkey % 5 = 0 THEN 'g' ELSE '' END || ' end'"
    return f"c_custkey * 64 + {list(SAMPLES).index(name)} + 2000000000 AS doc_id, {text} AS text"


def _with_samples(s: SparkSession, d: str) -> DataFrame:
    items = ", ".join("struct(" + _sample_item(n) + ")" for n in SAMPLES)
    keys = T.dealt(T.read(s, d, "customer").select("c_custkey"), "c_custkey")
    return T.dealt(docs(s, d), "doc_id").unionByName(keys.select(F.explode(F.expr(f"array({items})")).alias("x")).select("x.doc_id", "x.text"))


def credential_pack(s: SparkSession, d: str) -> DataFrame:
    return credentials.candidates(_with_samples(s, d))


def _pack_sql() -> str:
    source = f"{DOCS} UNION ALL " + " UNION ALL ".join(f"SELECT {_sample_item(n)} FROM customer" for n in SAMPLES)
    entropy_of = "(SELECT -sum(k / length(g)::DOUBLE * log2(k / length(g)::DOUBLE)) FROM (SELECT count(*) AS k FROM (SELECT unnest(string_split(g, '')) AS ch) GROUP BY ch))"
    stop, parts = ", ".join(f"'{w}'" for w in credentials.STOP_WORDS), []
    for f in credentials.PACK:
        pattern = (rf"\b{f.before}({f.group})" + (f.after or r"\b")).replace("'", "''")
        tail = 1 if f.after else 0
        base = f"""SELECT doc_id, text, value, CAST(list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda m: length(m))), 0) AS INT) AS p0
 FROM (SELECT *, unnest(ms) AS value, generate_subscripts(ms, 1) AS k FROM (SELECT doc_id, text, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS ms FROM src WHERE {" OR ".join(f"contains(lower(text), '{k}')" for k in f.keywords)}))"""
        got = f"SELECT doc_id, p0 + length(value) - {tail} AS e, regexp_extract(value, '{pattern}', 1) AS g FROM ({base})"
        allow = f" AND NOT regexp_matches(g, '{f.allow}')" if f.allow else ""
        parts.append(f"SELECT doc_id, CAST(e - length(g) AS INT) AS start, CAST(e AS INT) AS \"end\", g AS value, 'CREDENTIAL' AS label, 80 AS priority, '{f.name}' AS format FROM (SELECT *, {entropy_of} AS bits FROM ({got})) WHERE bits >= {f.floor} AND lower(g) NOT IN ({stop}){allow}")
    return f"WITH src AS ({source}) " + " UNION ALL ".join(parts)


def covered_chars(s: SparkSession, d: str) -> DataFrame:
    return intervals.covered(merged_spans(s, d))


def _scope():
    return F.floor(F.col("doc_id") / 64).cast("long")


_SCOPE_SQL = "CAST(floor(doc_id / 64) AS BIGINT)"


def _masked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(units, their spans): one scan, of which places and keyed hashes are written, as labels, limit and masked texts are made of them."""
    u = units(s, d)
    return u, masking.found(u, SECRET, _scope(), costs=model(s, d))


def protected_redaction(s: SparkSession, d: str) -> DataFrame:
    """Texts that hold a placeholder already: what stands around it is masked, the placeholder isn't, alone or inside a longer span."""
    token = F.concat(F.lit("{{RG_EMAIL_QX7ZK2VWJ4PTM3YB}}"))
    c = T.dealt(T.read(s, d, "customer").select("c_custkey"), "c_custkey")
    host = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@x.org"))
    forms = F.array(F.concat(F.lit("see "), token, F.lit(" ok")), F.concat(F.lit("see "), token, F.lit(" and "), host, F.lit(" ok")), F.concat(F.lit("postgres://root:"), token, F.lit("@db.example.com/app")))
    texts = c.select(F.posexplode(forms).alias("k", "text"), "c_custkey").select((F.col("c_custkey") * 4 + F.col("k")).alias("doc_id"), "text")
    marked, every = scan.with_candidates(texts, costs=entropy.english())
    found = marked.select("doc_id", "text", F.explode(F.expr(masking.masked_sql("text", every))).alias("x"))
    return found.select("doc_id", "x.start", "x.end", "x.label", masking.raw_of(F.col("text"), F.col("x")).alias("raw"))


def token_vault(s: SparkSession, d: str) -> DataFrame:
    return masking.values(*_masked(s, d))


def redacted_text(s: SparkSession, d: str) -> DataFrame:
    u, f = _masked(s, d)
    return masking.redact(u, f, _scope()).select("doc_id", F.sha2("redacted_text", 256).alias("redacted_sha256"))


def refused_scopes(s: SparkSession, d: str, limit: int = 8) -> DataFrame:
    """Masking with a limit of 8 values a scope: the texts of a scope beyond it don't come out."""
    u, f = _masked(s, d)
    return masking.redact(u, f, _scope(), limit).select("doc_id", "error", F.sha2("redacted_text", 256).alias("redacted_sha256"))


def restored_text(s: SparkSession, d: str) -> DataFrame:
    return masking.round_trip(units(s, d), SECRET, _scope(), costs=model(s, d))


def restored_counts(s: SparkSession, d: str) -> DataFrame:
    r = restored_text(s, d)
    return r.select("doc_id", F.sha2("restored_text", 256).alias("restored_sha256"), "restored", "restored_unique", "unresolved", "degraded")


def roundtrip_diff(s: SparkSession, d: str) -> DataFrame:
    """Documents that come back changed. No rows."""
    changed = F.filter(F.array(F.struct("text", "restored_text")), lambda x: x["text"] != x["restored_text"])
    return restored_text(s, d).select("doc_id", F.explode(changed)).select("doc_id")


_ID16 = """list_aggregate(list_transform(range(7, -1, -1), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(({v} >> (5 * i)) & 31 AS INT) + 1]), 'string_agg', '')"""
_VAULT = f"""f AS MATERIALIZED (SELECT m.doc_id, m.start, m."end", m.label, {_SCOPE_SQL.replace("doc_id", "m.doc_id")} AS scope, substr(text, m.start + 1, m."end" - m.start) AS raw FROM m JOIN units USING (doc_id)),
v0 AS (SELECT scope, raw, arg_min(label, (doc_id, start)) AS label, sha256('{SECRET}' || chr(31) || CAST(scope AS VARCHAR) || chr(31) || raw) AS h FROM f GROUP BY scope, raw),
v AS MATERIALIZED (SELECT scope, raw, label, '{{{{RG_' || label || '_' || {_ID16.format(v="CAST('0x' || h[1:10] AS BIGINT)")} || {_ID16.format(v="CAST('0x' || h[11:20] AS BIGINT)")} || '}}}}' AS token FROM v0)"""
_PARTS = """p AS (SELECT doc_id, start, "end", token, lag("end", 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS b FROM f JOIN v USING (scope, raw)),
g AS (SELECT doc_id, string_agg(substr(text, b + 1, start - b) || token, '' ORDER BY start) AS head, max("end") AS e FROM p JOIN units USING (doc_id) GROUP BY doc_id),
red AS (SELECT doc_id, CASE WHEN head IS NULL THEN text ELSE head || substr(text, e + 1) END AS t, text FROM units LEFT JOIN g USING (doc_id))"""


def restore_variants(s: SparkSession, d: str) -> DataFrame:
    """Twelve spellings of each customer's placeholder, restored."""
    v, texts = _variants(s, d)
    return vault.restore(texts, v, F.lit(1)).select("doc_id", "restored_text", "restored", "unresolved", "degraded")


#: Spellings, as what stands around and happens to a core; the last four are no placeholders or unknown.
_SPELLINGS = [("{{", "}}"), ("", ""), ("{", "}"), ("{{", "}"), ("{{", ""), ("", "}}"), (r"\{\{", r"\}\}"), (r"\\{\\{", r"\\}\\}"), (r"\\\{", r"\\\}"), ("prefix_", ""), ("", "_backup"), ("", "A")]


def _variants(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    raws = T.read(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("scope"), F.concat(F.lit("a"), F.col("c_custkey").cast("string"), F.lit("@x.org")).alias("raw"), F.lit(0).alias("start"), F.lit("EMAIL").alias("label"))
    v = vault.issue(raws, SECRET)
    core = v.select("raw", F.expr("substring(token, 3, length(token) - 4)").alias("core")).join(raws.select("raw", "doc_id"), "raw")
    forms = F.array(*[F.concat(F.lit("see "), F.lit(a), F.col("core"), F.lit(b), F.lit(" ok")) for a, b in _SPELLINGS], F.concat(F.lit("low {{"), F.lower("core"), F.lit("}}")))
    texts = core.select("doc_id", F.posexplode(forms).alias("k", "text")).select((F.col("doc_id") * 16 + F.col("k")).alias("doc_id"), "text")
    return v, texts


def _variants_sql() -> str:
    good = range(9)
    wanted = [f"'see ' || raw || ' ok'" if k in good else None for k in range(len(_SPELLINGS))]
    wanted = [w or "'see ' || " + f"'{a}' || core || '{b}' || ' ok'" for w, (a, b) in zip(wanted, _SPELLINGS)] + ["'low ' || raw"]
    n = len(wanted)
    return f"""WITH v0 AS (SELECT c_custkey AS k, 'a' || CAST(c_custkey AS VARCHAR) || '@x.org' AS raw, sha256('{SECRET}' || chr(31) || '1' || chr(31) || 'a' || CAST(c_custkey AS VARCHAR) || '@x.org') AS h FROM customer),
v AS (SELECT k, raw, 'RG_EMAIL_' || {_ID16.format(v="CAST('0x' || h[1:10] AS BIGINT)")} || {_ID16.format(v="CAST('0x' || h[11:20] AS BIGINT)")} AS core FROM v0)
SELECT k * 16 + unnest(range(0, {n})) AS doc_id, unnest([{", ".join(wanted)}]) AS restored_text, unnest([{", ".join("0" if 9 <= k < 12 else "1" for k in range(n))}])::BIGINT AS restored,
 0::BIGINT AS unresolved, unnest([{", ".join("0" if k == 0 or 9 <= k < 12 else "1" for k in range(n))}])::BIGINT AS degraded FROM v"""


def rule_hits_by_doc(s: SparkSession, d: str) -> DataFrame:
    return audit.hit_counts(merged_spans(s, d))


def vault_bytes(s: SparkSession, d: str) -> DataFrame:
    return vault.vault_bytes(token_vault(s, d))


def vault_over_limit(s: SparkSession, d: str) -> DataFrame:
    """Scopes with more than 8 values."""
    return masking.refused(_masked(s, d)[1], 8)


def build() -> tuple[dict, dict]:
    q, o = {}, {}
    for name in spans.BY_NAME:
        q[f"{name}_spans"], o[f"{name}_spans"] = _rule_query(name)
    with_c = f"WITH {_candidates_sql(UNITS_SQL)}"
    with_m = f"{with_c}, {_MERGE}"
    with_v = f"{with_m}, {_VAULT}"
    prot = """p AS (SELECT doc_id, start + 1 AS s, "end" - 2 AS e FROM m WHERE "end" - start > 4 AND (start + 1) % 2 = 0)"""
    rows = {
        "entropy_tokens": (entropy_tokens, f"WITH {_random_sql(DOCS)} SELECT * FROM toks WHERE value IN (SELECT v FROM random)"),
        "entropy_by_lang": (entropy_by_lang, f"WITH {_random_sql(DOCS)}, h AS (SELECT doc_id, count(*) AS n FROM toks WHERE value IN (SELECT v FROM random) GROUP BY doc_id) SELECT lang, count(*) AS n_docs, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_tokens FROM documents LEFT JOIN h USING (doc_id) GROUP BY lang"),
        "bigram_counts": (bigram_costs, f"WITH {_COSTS_SQL} SELECT a, b, n FROM counts"),
        "entropy_threshold_curve": (threshold_curve, f"SELECT p_partkey, n, round(CASE WHEN n > 8 THEN {_CURVE} ELSE -1 END, 6) AS threshold FROM (SELECT p_partkey, CAST(length(p_name) + p_partkey % 100 AS INT) AS n FROM part)"),
        "char_entropy": (char_entropy, "SELECT p_partkey, round(-sum(k / n * log2(k / n)), 9) AS bits FROM (SELECT p_partkey, length(p_name) AS n, c, count(*) AS k FROM (SELECT p_partkey, p_name, unnest(string_split(p_name, '')) AS c FROM part) GROUP BY ALL) GROUP BY p_partkey"),
        "luhn_valid": (luhn_valid, f"SELECT o_orderkey, ({_LUHN}) AS valid FROM (SELECT o_orderkey, '4000' || lpad(CAST(o_orderkey * 7919 AS VARCHAR), 12, '0') AS d FROM orders)"),
        "idcard_valid": (idcard_valid, f"SELECT doc_id, coalesce({_ID}, false) AS valid FROM (SELECT doc_id, regexp_extract(text, '([0-9]{{17}}[0-9X])', 1) AS d FROM ({T.secrets_sql('idcard')}))"),
        "numeric_block": (numeric_block, _numeric_sql()),
        "candidates_all": (candidates_all, f"{with_c} SELECT * FROM c"),
        "merged_spans": (merged_spans, f"{with_m} SELECT * FROM m"),
        "covered_chars": (covered_chars, f'{with_m} SELECT doc_id, CAST(sum("end" - start) AS BIGINT) AS covered FROM m GROUP BY doc_id'),
        "protected_split": (protected_split, f"""{with_m}, {prot}, b AS (SELECT m.*, s, e FROM m JOIN p ON m.doc_id = p.doc_id AND s < "end" AND e > start UNION ALL SELECT *, "end", "end" FROM m),
g AS (SELECT doc_id, label, greatest(start, coalesce(lag(e) OVER (PARTITION BY doc_id, start ORDER BY s, e), start)) AS x, s AS y FROM b) SELECT doc_id, x AS start, y AS "end", label FROM g WHERE x < y"""),
        "coverage_sets": (coverage_sets, f"{with_c}, {_COVERAGE_SETS}"),
        "credential_pack": (credential_pack, _pack_sql()),
        "coverage_monotone": (coverage_monotone, "SELECT 'H' AS flag, 0::BIGINT AS doc_id, 0 AS start, 0 AS \"end\" WHERE false"),
        "token_vault": (token_vault, f"{with_v} SELECT scope, raw, label, token FROM v"),
        "redacted_text": (redacted_text, f"{with_v}, {_PARTS} SELECT doc_id, sha256(t) AS redacted_sha256 FROM red"),
        "restored_text": (restored_counts, f"""{with_v}, n AS (SELECT doc_id, count(*) AS k, count(DISTINCT raw) AS u FROM f GROUP BY doc_id)
SELECT doc_id, sha256(text) AS restored_sha256, coalesce(k, 0) AS restored, coalesce(u, 0) AS restored_unique, 0::BIGINT AS unresolved, 0::BIGINT AS degraded FROM units LEFT JOIN n USING (doc_id)"""),
        "refused_scopes": (refused_scopes, f"""{with_v}, {_PARTS}, o AS (SELECT scope FROM v GROUP BY scope HAVING count(*) > 8), e AS (SELECT doc_id, t, {_SCOPE_SQL} IN (SELECT scope FROM o) AS refused FROM red)
SELECT doc_id, CASE WHEN refused THEN 'request_too_large' ELSE '' END AS error, CASE WHEN NOT refused THEN sha256(t) END AS redacted_sha256 FROM e"""),
        "roundtrip_diff": (roundtrip_diff, "SELECT doc_id FROM documents WHERE false"),
        "restore_variants": (restore_variants, _variants_sql()),
        "rule_hits_by_doc": (rule_hits_by_doc, f"{with_m} SELECT doc_id, label, count(*) AS hits FROM m GROUP BY doc_id, label"),
        "protected_redaction": (protected_redaction, """WITH k AS (SELECT c_custkey AS k, 'c' || CAST(c_custkey AS VARCHAR) || '@x.org' AS m FROM customer)
SELECT k * 4 + 1 AS doc_id, 38 AS start, 38 + length(m) AS "end", 'EMAIL' AS label, m AS raw FROM k
UNION ALL SELECT k * 4 + 2, 0, 16, 'CONNSTR', 'postgres://root:' FROM k UNION ALL SELECT k * 4 + 2, 45, 64, 'CONNSTR', '@db.example.com/app' FROM k"""),
        "vault_bytes": (vault_bytes, f"{with_v} SELECT scope, count(*) AS n_values, CAST(sum(strlen(raw) + strlen(token) + 256) + 512 AS BIGINT) AS held_bytes FROM v GROUP BY scope"),
        "vault_over_limit": (vault_over_limit, f"{with_v} SELECT scope, count(*) AS n_values FROM v GROUP BY scope HAVING count(*) > 8"),
    }
    for name, (fn, sql) in rows.items():
        q[name], o[name] = fn, sql
    return q, o
