"""Queries of the audit log, settings, sessions, routes and hosts: DataFrames and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import net
from veilspark.operators import audit, vault
from veilspark.sources import tables as T

_K = "WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events), log AS (" + T.EVENTS_AS_AUDIT.replace("string", "VARCHAR").replace("cast(floor(value * 100) AS bigint)", "CAST(floor(value * 100) AS BIGINT)") + ")"
_HAY = "lower(upstream_host || ' ' || upstream_path || ' ' || protocol || ' ' || flags || ' ' || CAST(status AS VARCHAR))"
_ERR = "status >= 400 OR error_class <> ''"
_SHOWN = ("id", "ts", "upstream_host", "upstream_path", "protocol", "flags", "status", "duration_ms")


def log(s: SparkSession, d: str) -> DataFrame:
    return T.audit_of_events(s, d)


def _now(df: DataFrame):
    """The log's newest time stands for now, so that results can be repeated."""
    return F.lit(df.agg(F.max("ts")).first()[0])


def _page(q: audit.Page):
    return lambda s, d: audit.page(log(s, d), q)[0].select(*_SHOWN)


def _page_sql(where: str, limit: int, at: int) -> str:
    return f"""{_K}, r AS (SELECT *, row_number() OVER (ORDER BY ts DESC, id DESC) AS rn, count(*) OVER () AS total FROM log WHERE {where})
SELECT {", ".join(_SHOWN)} FROM r WHERE rn > (least({at}, 1 + greatest(0, total - 1) // {limit}) - 1) * {limit} AND rn <= least({at}, 1 + greatest(0, total - 1) // {limit}) * {limit}"""


def stats_overview(s: SparkSession, d: str) -> DataFrame:
    x = log(s, d)
    return audit.overview(audit.within(x, 24, _now(x)))


def stats_overview_empty(s: SparkSession, d: str) -> DataFrame:
    return audit.overview(log(s, d).where("ts < timestamp'1970-01-01'"))


def retention_keep(s: SparkSession, d: str) -> DataFrame:
    x = log(s, d)
    return audit.retained(x, 7, _now(x)).select("id", "ts")


def settings_latest(s: SparkSession, d: str) -> DataFrame:
    """Events as settings changes: the key is the type, the value its k; older half first, then the changes."""
    e = T.read(s, d, "events").select(F.col("event_type").alias("key"), F.get_json_object("props", "$.k").alias("value_json"), F.struct("ts", "event_id").alias("updated_at"), "event_id")
    return audit.upserted(e.where("event_id % 2 = 0").drop("event_id"), e.where("event_id % 2 = 1").drop("event_id")).select("key", "value_json", F.col("updated_at.event_id").alias("event_id"))


def legacy_union(s: SparkSession, d: str) -> DataFrame:
    """Rows from before the restore columns, beside rows of today."""
    x = log(s, d).drop("k", "user_id")
    old = x.where("id % 3 = 0").drop("restore_count")
    new = x.where("id % 3 <> 0").withColumn("restore_status", F.lit("restored"))
    both = T.conformed(old).unionByName(T.conformed(new))
    return both.groupBy("restore_status", "redaction_fields_json").agg(F.count(F.lit(1)).alias("n"), F.sum("restore_count").alias("restores"))


def restore_status(s: SparkSession, d: str) -> DataFrame:
    x = log(s, d).withColumn("missed", F.col("k") % 3)
    status = vault.restore_status(F.col("restore_count"), F.col("missed"), F.col("redaction_count"), F.col("k") % 7 != 0, F.col("status") >= 400)
    return x.groupBy(status.alias("restore_status")).agg(F.count(F.lit(1)).alias("n"))


def events_by_protocol(s: SparkSession, d: str) -> DataFrame:
    return log(s, d).groupBy("protocol", "flags").agg(F.count(F.lit(1)).alias("n"), F.sum("redaction_count").alias("redactions"))


def session_ttl(s: SparkSession, d: str) -> DataFrame:
    return vault.session_ttl(T.read(s, d, "events"), "user_id", "ts").select("user_id", "session", "started", "ended", "n")


def hourly_metrics(s: SparkSession, d: str) -> DataFrame:
    return audit.metrics(log(s, d))


# Routes, flags, hosts ---------------------------------------------------------------------------------------------------------


def _uris(s: SparkSession, d: str) -> DataFrame:
    p = T.read(s, d, "pages").select("page_id", "url")
    return p.select("page_id", F.concat(F.expr("CASE page_id % 6 WHEN 0 THEN '/$' WHEN 1 THEN '/PE$' WHEN 2 THEN '/Z$' WHEN 3 THEN '/' WHEN 4 THEN 'http://gw.local:8080/HPS$' ELSE '/E$user:pw@' END"), "url").alias("uri"))


_URIS = "SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/$' WHEN 1 THEN '/PE$' WHEN 2 THEN '/Z$' WHEN 3 THEN '/' WHEN 4 THEN 'http://gw.local:8080/HPS$' ELSE '/E$user:pw@' END || url AS uri, url FROM pages"


def route_parse(s: SparkSession, d: str) -> DataFrame:
    u = F.col("uri")
    ok = net.route_error(u) == ""
    return _uris(s, d).select("page_id", net.route_error(u).alias("error"), F.coalesce(net.route_flags(u), F.lit("")).alias("flags"), F.when(ok, net.url_host(net.route_url(u))).otherwise("").alias("host"), F.when(ok, net.url_path(net.route_url(u))).otherwise("").alias("path"))


_ROUTE_SQL = rf"""WITH u AS ({_URIS}), x AS (SELECT *, CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'unknown_flag' WHEN 3 THEN 'missing_separator' WHEN 4 THEN '' ELSE 'bad_scheme' END AS error0, CASE WHEN error0 = '' AND contains(url, '#') THEN 'fragment' ELSE error0 END AS error FROM u)
SELECT page_id, error, CASE WHEN error <> '' THEN '' WHEN page_id % 6 = 0 THEN 'HPSIBEG' WHEN page_id % 6 = 1 THEN 'PE' ELSE 'HPS' END AS flags,
 CASE WHEN error = '' THEN lower(string_split(regexp_replace(url, '^https?://', ''), '/')[1]) ELSE '' END AS host,
 CASE WHEN error = '' THEN '/' || array_to_string(string_split(string_split(regexp_replace(url, '^https?://', ''), '?')[1], '/')[2:], '/') ELSE '' END AS path FROM x"""


def _flagged(s: SparkSession, d: str) -> DataFrame:
    """Flag strings of the orders table: letters picked by the key."""
    return T.read(s, d, "orders").select("o_orderkey", *[F.expr(x) for x in _FLAG_ITEMS])


_PICK = "substr('HPSIBEGGEBISPHe', cast(1 + (o_orderkey * {m}) % 15 as int), cast(1 + (o_orderkey * {m}) % 5 as int))"
_FLAG_ITEMS = (_PICK.format(m=3) + " AS a", _PICK.format(m=7) + " AS b")


def flag_intersection(s: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _flagged(s, d).select("o_orderkey", F.coalesce(net.canonical_flags(a), F.lit("error")).alias("canonical"), net.intersect_flags(a, b).alias("effective"))


_LETTERS = "['H', 'P', 'S', 'I', 'B', 'E', 'G']"
_FLAG_SQL = f"""WITH f AS (SELECT o_orderkey, {", ".join(_FLAG_ITEMS)} FROM orders)
SELECT o_orderkey, CASE WHEN contains(a, 'e') THEN 'error' ELSE array_to_string(list_filter({_LETTERS}, lambda x: contains(a, x)), '') END AS canonical,
 array_to_string(list_filter({_LETTERS}, lambda x: contains(a, x) AND contains(b, x)), '') AS effective FROM f"""


def host_allowlist(s: SparkSession, d: str) -> DataFrame:
    """Hosts of the pages against the list of every host that ends in an even page's domain."""
    h = T.read(s, d, "pages").select("page_id", net.url_host(F.col("url")).alias("host"))
    allowed = net.normalized_hosts(F.lit("Example.COM.,\n site1.example.org\r\n*.bad,host3.net"))
    return h.select("page_id", "host", net.host_allowed(F.col("host"), allowed).alias("allowed"), net.valid_host(F.col("host")).alias("valid"))


_HOST_SQL = r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host FROM pages)
SELECT page_id, host, host IN ('example.com', 'site1.example.org', 'host3.net') OR suffix(host, '.example.com') OR suffix(host, '.site1.example.org') OR suffix(host, '.host3.net') AS allowed,
 regexp_full_match(host, '[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)*') AS valid FROM h"""

_ADDRESS = "cast((c_custkey * 37) % 256 AS {t}) || '.' || cast((c_custkey * 11) % 260 AS {t}) || '.' || cast(c_custkey % 256 AS {t}) || '.' || cast((c_custkey * 3) % 256 AS {t})"


#: Addresses of 128 bits by form, with their class and digits; h is the key in hex.
_SIX = (
    ("'::'", "unspecified", "repeat('0', 32)"), ("'::1'", "loopback", "repeat('0', 31) || '1'"), ("'fd00::' || h", "private", "'fd' || lpad(h, 30, '0')"), ("'FE80::1:' || h", "link_local", "'fe80' || lpad('1' || lpad(h, 4, '0'), 28, '0')"),
    ("'ff02::' || h", "multicast", "'ff02' || lpad(h, 28, '0')"), ("'2001:db8::' || h || ':0'", "public", "'20010db8' || lpad(h || '0000', 24, '0')"), ("'::ffff:10.0.0.7'", "private", "repeat('0', 20) || 'ffff0a000007'"), ("'::FFFF:8.8.4.4'", "public", "repeat('0', 20) || 'ffff08080404'"),
    ("'1:2:3:4:5:6:7:' || h", "public", "'0001000200030004000500060007' || lpad(h, 4, '0')"), ("'1::2::' || h", "invalid", "''"), ("'12345::' || h", "invalid", "''"), ("'1:2:3:4:5:6:' || h", "invalid", "''"), ("'::1.2.3.256'", "invalid", "''"), ("':1::' || h", "invalid", "''"), ("'10.0.0.1'", "private", "''"),
)
_SIX_FORMS = "CASE c_custkey % " + str(len(_SIX)) + " " + " ".join(f"WHEN {k} THEN {form}" for k, (form, _, _) in enumerate(_SIX)) + " END"


def ip6_class(s: SparkSession, d: str) -> DataFrame:
    c = T.read(s, d, "customer").select("c_custkey", F.lower(F.hex(F.col("c_custkey") % 65_536)).alias("h")).select("c_custkey", F.expr(_SIX_FORMS).alias("a"))
    return c.select("c_custkey", "a", net.address_class(F.col("a")).alias("class"), F.coalesce(net.ipv6(F.col("a")), F.lit("")).alias("digits"))


def host_allowlist_table(s: SparkSession, d: str) -> DataFrame:
    """Hosts of the pages against a table of hosts, which grows with the customers."""
    h = T.read(s, d, "pages").select("page_id", net.url_host(F.col("url")).alias("host"))
    listed = T.read(s, d, "customer").select(F.concat(F.lit("h"), F.col("c_custkey").cast("string"), F.lit(".example.net")).alias("host"))
    some = h.where("page_id % 10 = 0").select(F.regexp_replace("host", r"^[^.]*\.(?=[^.]*\.[^.]*\.)", "").alias("host"))
    return net.allowed_hosts(h, listed.unionByName(some)).select("page_id", "host", "allowed")


_ALLOW_SQL = r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host FROM pages),
l AS (SELECT DISTINCT CASE WHEN len(string_split(host, '.')) > 3 THEN array_to_string(string_split(host, '.')[2:], '.') ELSE host END AS a FROM h WHERE page_id % 10 = 0 UNION SELECT 'h' || CAST(c_custkey AS VARCHAR) || '.example.net' FROM customer)
SELECT page_id, host, EXISTS (SELECT 1 FROM l WHERE host = a OR suffix(host, '.' || a)) AS allowed FROM h"""


def ip_class(s: SparkSession, d: str) -> DataFrame:
    a = T.read(s, d, "customer").select("c_custkey", F.expr(_ADDRESS.format(t="string")).alias("a"))
    return a.select("c_custkey", net.address_class(F.col("a")).alias("address_class"))


_IP_SQL = f"""WITH a AS (SELECT c_custkey, list_transform(string_split({_ADDRESS.format(t="VARCHAR")}, '.'), lambda x: CAST(x AS INT)) AS o FROM customer)
SELECT c_custkey, CASE WHEN list_max(o) > 255 THEN 'invalid' WHEN o = [0, 0, 0, 0] THEN 'unspecified' WHEN o[1] = 127 THEN 'loopback' WHEN o[1] = 10 OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168) THEN 'private'
 WHEN o[1] = 169 AND o[2] = 254 THEN 'link_local' WHEN o[1] BETWEEN 224 AND 239 THEN 'multicast' ELSE 'public' END AS address_class FROM a"""

_TYPES = "['application/json', 'Application/Problem+JSON; charset=utf-8', 'text/plain', 'text/event-stream', 'application/javascript', 'image/svg+xml', 'image/png', '']"


def content_types(s: SparkSession, d: str) -> DataFrame:
    t = F.get(F.expr(_TYPES.replace("[", "array(").replace("]", ")")), (F.col("p_partkey") % 8).cast("int"))
    return T.read(s, d, "part").select("p_partkey", net.is_json_type(t).alias("json"), net.is_text_type(t).alias("textual"))


_TYPES_SQL = f"""WITH x AS (SELECT p_partkey, lower({_TYPES}[p_partkey % 8 + 1]) AS t FROM part), j AS (SELECT *, contains(t, '/json') OR contains(t, '+json') AS json FROM x)
SELECT p_partkey, json, json OR starts_with(t, 'text/') OR contains(t, 'javascript') OR contains(t, 'xml') AS textual FROM j"""


def protocol_detect(s: SparkSession, d: str) -> DataFrame:
    e = log(s, d)
    path = F.expr("CASE k % 6 WHEN 0 THEN '/v1/Chat/Completions/' WHEN 1 THEN '/v1/responses' WHEN 2 THEN '/v1/messages' ELSE upstream_path END")
    return e.select("id", net.protocol(path, F.expr("k % 4 = 0"), F.expr("k % 5 = 0"), F.expr("k % 8 = 0")).alias("protocol"))


_PROTOCOL_SQL = f"{_K} SELECT id, CASE WHEN k % 6 = 0 THEN 'openai_chat' WHEN k % 6 = 1 THEN 'openai_responses' WHEN k % 6 = 2 THEN 'anthropic_messages' WHEN k % 8 = 0 THEN 'anthropic_messages' WHEN k % 4 = 0 THEN 'openai_chat' WHEN k % 5 = 0 THEN 'openai_responses' ELSE 'generic' END AS protocol FROM log"


def header_projection(s: SparkSession, d: str) -> DataFrame:
    """Names that are sent on, of headers made from the event."""
    h = F.expr("map('Host', 'x', 'Content-Type', 'application/json', 'CF-Ray', '1', 'Connection', concat('close, X-Hop', k % 3), 'X-Hop1', 'a', 'X-Hop2', 'b', 'Sec-Fetch-Mode', 'cors', 'X-Forwarded-For', '1', 'Authorization', 'b', 'Cookie', 'c')")
    return log(s, d).select("id", F.array_join(F.array_sort(F.map_keys(net.request_headers(h))), ",").alias("sent"))


_HEADER_SQL = f"{_K} SELECT id, 'Authorization,Content-Type' || CASE k % 3 WHEN 1 THEN ',X-Hop2' WHEN 2 THEN ',X-Hop1' ELSE ',X-Hop1,X-Hop2' END AS sent FROM log"


def session_ids(s: SparkSession, d: str) -> DataFrame:
    i = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'short' WHEN 1 THEN repeat('x', 257) WHEN 2 THEN concat('session_id-', lpad(cast(c_custkey as string), 8, '0')) ELSE 'has a blank in it!' END")
    scope = net.session_scope([i, F.lit("https"), F.col("c_name")], [F.expr("CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE 'key' END")])
    return T.read(s, d, "customer").select("c_custkey", net.valid_session(i).alias("valid"), F.coalesce(scope, F.lit("")).alias("scope"))


_SESSION_SQL = """WITH i AS (SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'short' WHEN 1 THEN repeat('x', 257) WHEN 2 THEN 'session_id-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') ELSE 'has a blank in it!' END AS i FROM customer)
SELECT c_custkey, c_custkey % 4 = 2 AS valid, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE sha256(strlen(i) || ':' || i || '5:https' || strlen(c_name) || ':' || c_name) END AS scope FROM i"""


def gateway_urls(s: SparkSession, d: str) -> DataFrame:
    u = F.expr("CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'https://gw.example.com:8443/base//' WHEN 2 THEN 'ftp://x' WHEN 3 THEN 'http://u:p@host' WHEN 4 THEN 'http://host:99999' WHEN 5 THEN 'http://host/a?b' ELSE concat('http://h', c_custkey, '/') END")
    base = net.base_url(F.lit("https"), F.expr("CASE c_custkey % 3 WHEN 0 THEN 'localhost' WHEN 1 THEN '10.0.0.7' ELSE 'gw.example.com' END"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN 80 ELSE 8080 END"))
    return T.read(s, d, "customer").select("c_custkey", F.coalesce(net.gateway_url(u), F.lit("error")).alias("url"), base.alias("base"))


_GATEWAY_SQL = """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'https://gw.example.com:8443/base' WHEN 6 THEN 'http://h' || c_custkey ELSE 'error' END AS url,
 CASE c_custkey % 3 WHEN 2 THEN 'https://gw.example.com' ELSE 'http://' || CASE c_custkey % 3 WHEN 0 THEN 'localhost' ELSE '10.0.0.7' END || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ':8080' END END AS base FROM customer"""


def error_classes(s: SparkSession, d: str) -> DataFrame:
    """Body classes of the events' props under made-up types and limits, with their status."""
    e = log(s, d).withColumn("props", F.expr("CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN concat('{\"k\": ', k, '}') WHEN 2 THEN '{broken' ELSE concat('{\"pad\": \"', repeat('x', k), '\"}') END"))
    c = net.body_class(F.expr("CASE WHEN k % 7 = 0 THEN 'text/plain' ELSE 'application/json' END"), F.col("props"), 64)
    return e.groupBy(c.alias("error_class")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(net.error_status(c)), F.lit(0)).alias("status"))


_BODY_SQL = f"""{_K}, b AS (SELECT k, CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN '{{"k": ' || k || '}}' WHEN 2 THEN '{{broken' ELSE '{{"pad": "' || repeat('x', k) || '"}}' END AS props FROM log),
c AS (SELECT CASE WHEN props = '' THEN 'passthrough' WHEN strlen(props) > 64 THEN 'request_too_large' WHEN k % 7 = 0 THEN 'unsupported_body' WHEN NOT json_valid(props) THEN 'invalid_request' ELSE '' END AS error_class FROM b)
SELECT error_class, count(*) AS n, CASE error_class WHEN 'request_too_large' THEN 413 WHEN 'unsupported_body' THEN 415 WHEN 'invalid_request' THEN 400 ELSE 0 END AS status FROM c GROUP BY error_class"""


_NAMES = (("H", "ENTROPY"), ("P", "PHONE"), ("S", "APIKEY"), ("I", "IDCARD"), ("B", "CARD"), ("E", "EMAIL"), ("G", "CREDENTIAL"))


def rule_catalogue(s: SparkSession, d: str) -> DataFrame:
    """The seven rules with whether the log's newest selection has them, and in how many rows of the log they were on."""
    x = log(s, d)
    newest = x.select(F.max_by("flags", F.struct("ts", "id")).alias("newest"))
    used = x.select(F.explode(F.split("flags", "")).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    rows = s.createDataFrame(list(_NAMES), "flag string, name string").join(F.broadcast(used), "flag", "left").join(newest)
    return rows.select("flag", "name", F.lit(True).alias("is_default"), F.contains("newest", "flag").alias("enabled"), F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"))


_CATALOGUE_SQL = f"""{_K}, n AS (SELECT arg_max(flags, (ts, id)) AS newest FROM log)
SELECT flag, name, true AS is_default, contains(newest, flag) AS enabled, (SELECT count(*) FROM log WHERE contains(flags, flag)) AS n_rows FROM (VALUES {", ".join(map(str, _NAMES))}) t(flag, name), n"""


def build() -> tuple[dict, dict]:
    q, o = {}, {}
    pages = {
        "events_page": (audit.Page(limit=50, page=3), "true", 50, 3),
        "events_search": (audit.Page(limit=100, page=1, search=" CHAT "), f"instr({_HAY}, 'chat') > 0", 100, 1),
        "events_search_literal": (audit.Page(search="%_"), f"instr({_HAY}, '%_') > 0", 100, 1),
        "events_host": (audit.Page(limit=20, page=2, host=" h9.example.com ", search="500"), f"upstream_host = 'h9.example.com' AND instr({_HAY}, '500') > 0", 20, 2),
        "events_clamp": (audit.Page(limit=9999, page=100_000), "true", 100, 100_000),
    }
    for name, (p, where, limit, at) in pages.items():
        q[name], o[name] = _page(p), _page_sql(where, limit, at)
    window = f"ts >= (SELECT max(ts) FROM log) - INTERVAL 24 HOUR"
    sums = f"count(*) AS requests, CAST(coalesce(sum(redaction_count), 0) AS BIGINT) AS redactions, CAST(coalesce(sum(restore_count), 0) AS BIGINT) AS restores, count(*) FILTER ({_ERR}) AS errors, round(coalesce(avg(duration_ms), 0), 6) AS average_ms"
    host = f"SELECT upstream_host, count(*) AS requests, count(*) FILTER ({_ERR}) AS errors, round(avg(duration_ms), 6) AS average_ms FROM log GROUP BY upstream_host"
    rows = {
        "stats_overview": (stats_overview, f"{_K} SELECT {sums} FROM log WHERE {window}"),
        "stats_overview_empty": (stats_overview_empty, "SELECT 0::BIGINT AS requests, 0::BIGINT AS redactions, 0::BIGINT AS restores, 0::BIGINT AS errors, 0.0::DOUBLE AS average_ms"),
        "stats_by_host": (lambda s, d: audit.by_host(log(s, d)), f"{_K} {host}"),
        "stats_top_hosts": (lambda s, d: audit.top_hosts(log(s, d)), f"{_K} {host} ORDER BY requests DESC, upstream_host LIMIT 10"),
        "retention_keep": (retention_keep, f"{_K} SELECT id, ts FROM log WHERE ts >= (SELECT max(ts) FROM log) - INTERVAL 7 DAY"),
        "settings_latest": (settings_latest, "SELECT event_type AS key, json_extract_string(props, '$.k') AS value_json, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1"),
        "legacy_union": (legacy_union, f"{_K} SELECT CASE WHEN id % 3 = 0 THEN 'unavailable' ELSE 'restored' END AS restore_status, '[]' AS redaction_fields_json, count(*) AS n, CAST(sum(CASE WHEN id % 3 = 0 THEN 0 ELSE restore_count END) AS BIGINT) AS restores FROM log GROUP BY 1"),
        "restore_status": (restore_status, f"{_K} SELECT CASE WHEN k % 7 = 0 THEN 'not_processed' WHEN status >= 400 THEN 'response_error' WHEN restore_count > 0 AND k % 3 > 0 THEN 'partial' WHEN k % 3 > 0 THEN 'unresolved' WHEN restore_count > 0 THEN 'restored' WHEN redaction_count = 0 THEN 'no_sensitive_data' ELSE 'no_placeholders' END AS restore_status, count(*) AS n FROM log GROUP BY 1"),
        "events_by_protocol": (events_by_protocol, f"{_K} SELECT protocol, flags, count(*) AS n, CAST(sum(redaction_count) AS BIGINT) AS redactions FROM log GROUP BY ALL"),
        "session_ttl": (session_ttl, """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM n GROUP BY ALL"""),
        "hourly_metrics": (hourly_metrics, f"{_K} SELECT date_trunc('hour', ts) AS hour, upstream_host, count(*) AS requests, count(*) FILTER ({_ERR}) AS errors FROM log GROUP BY ALL"),
        "ip6_class": (ip6_class, f"""WITH c AS (SELECT c_custkey, lower(to_hex(c_custkey % 65536)) AS h FROM customer)
SELECT c_custkey, {_SIX_FORMS} AS a, CASE c_custkey % {len(_SIX)} {" ".join(f"WHEN {k} THEN '{name}'" for k, (_, name, _) in enumerate(_SIX))} END AS class, CASE c_custkey % {len(_SIX)} {" ".join(f"WHEN {k} THEN {digits}" for k, (_, _, digits) in enumerate(_SIX))} END AS digits FROM c"""),
        "host_allowlist_table": (host_allowlist_table, _ALLOW_SQL),
        "route_parse": (route_parse, _ROUTE_SQL), "flag_intersection": (flag_intersection, _FLAG_SQL), "host_allowlist": (host_allowlist, _HOST_SQL), "ip_class": (ip_class, _IP_SQL),
        "content_types": (content_types, _TYPES_SQL), "protocol_detect": (protocol_detect, _PROTOCOL_SQL), "header_projection": (header_projection, _HEADER_SQL), "session_ids": (session_ids, _SESSION_SQL),
        "gateway_urls": (gateway_urls, _GATEWAY_SQL), "error_classes": (error_classes, _BODY_SQL), "rule_catalogue": (rule_catalogue, _CATALOGUE_SQL),
    }
    for name, (fn, sql) in rows.items():
        q[name], o[name] = fn, sql
    return q, o
