"""Routes, flags, hosts, addresses, headers and error classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.streaming.events import ERRORS

FLAGS = "HPSIBEG"


def route_flags(uri: Column) -> Column:
    """The letters before the first $ of /<flags>$<url>; null where the route is not valid."""
    raw = F.regexp_extract(uri, r"^(?:https?://[^/]*)?/([^$/]*)\$", 1)
    return F.when(route_error(uri) == "", F.when(raw == "", F.lit(FLAGS)).otherwise(raw))


def route_url(uri: Column) -> Column:
    return F.regexp_extract(uri, r"(?s)^(?:https?://[^/]*)?/[^$/]*\$(.*)$", 1)


def route_error(uri: Column) -> Column:
    """'' or why the route is not valid."""
    url, flags = route_url(uri), F.regexp_extract(uri, r"^(?:https?://[^/]*)?/([^$/]*)\$", 1)
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return (
        F.when(~uri.rlike(r"^(?:https?://[^/]*)?/[^$/]*\$"), "missing_separator").when(~flags.rlike("^[HPSIBEG]*$"), "unknown_flag")
        .when(~url.rlike("^(?i)https?://"), "bad_scheme").when(F.contains(authority, F.lit("@")), "userinfo")
        .when(F.regexp_replace(authority, ":[0-9]*$", "") == "", "missing_host").when(F.contains(url, F.lit("#")), "fragment").otherwise("")
    )


def url_host(url: Column) -> Column:
    """Lower-case, without credentials, port and a trailing dot."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.regexp_replace(F.lower(authority), r"\.$", "")


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def canonical_flags(raw: Column) -> Column:
    """Flags once each, in the fixed order; null where a letter is unknown."""
    return F.when(raw.rlike("^[HPSIBEG]*$"), intersect_flags(raw, F.lit(FLAGS)))


def intersect_flags(a: Column, b: Column) -> Column:
    letters = F.filter(F.split(F.lit(FLAGS), ""), lambda f: (f != "") & F.contains(a, f) & F.contains(b, f))
    return F.array_join(letters, "")


def normalized_hosts(raw: Column) -> Column:
    """Host names of a list split at line ends and commas: lower case, without a trailing dot, valid ones, the first of equals."""
    parts = F.transform(F.split(raw, "[\r\n,]+"), lambda h: F.regexp_replace(F.lower(F.regexp_replace(h, r"^\s+|\s+$", "")), r"\.$", ""))
    return F.array_distinct(F.filter(parts, valid_host))


def valid_host(host: Column) -> Column:
    label = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    return host.rlike(rf"^{label}(?:\.{label})*$") & (F.length(host) <= 253)


def host_allowed(host: Column, allowed: Column) -> Column:
    """The host or a parent domain of it is in the list; an empty list allows all."""
    return (F.size(allowed) == 0) | F.exists(allowed, lambda h: (host == h) | host.endswith(F.concat(F.lit("."), h)))


def host_list_error(raw: Column) -> Column:
    """The number of the first entry of a list, split at line ends and commas, that is no host, counted from 1; 0 if all are. Such a list is refused as a whole."""
    parts = F.transform(F.split(raw, "[\r\n,]+"), lambda h: F.regexp_replace(F.lower(F.regexp_replace(h, r"^\s+|\s+$", "")), r"\.$", ""))
    return F.array_position(F.transform(parts, lambda h: ~(valid_host(h) | ipv6(h).isNotNull())), True).cast("int")


def allowed_hosts(df: DataFrame, allowed: DataFrame, host: str = "host") -> DataFrame:
    """df with allowed: the host or a parent domain of it is in allowed (host), a table of any size; an empty one allows all.

    A host is looked up by each of its suffixes, so the join is on equal names, and each different host is looked up once.
    """
    if allowed.isEmpty():
        return df.withColumn("allowed", F.lit(True))
    labels = F.split(F.col(host), r"\.")
    hosts = df.select(host).where(F.col(host).isNotNull()).distinct()
    tails = hosts.select(host, F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("_tail"))
    known = tails.join(allowed.select(F.col("host").alias("_tail")).distinct(), "_tail").select(F.col(host).alias("_known")).distinct()
    return df.join(known, F.col(host) == F.col("_known"), "left").withColumn("allowed", F.col("_known").isNotNull()).drop("_known")


_OCTET = "(?:0|[1-9][0-9]{0,2})"


def ipv4(address: Column) -> Column:
    """The address as a number, null if it is none."""
    parts = F.split(address, r"\.")
    octet = lambda k: F.get(parts, k).try_cast("long")
    whole = address.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$") & (F.greatest(*[octet(k) for k in range(4)]) <= 255)
    return F.when(whole, octet(0) * (1 << 24) + octet(1) * (1 << 16) + octet(2) * (1 << 8) + octet(3))


_GROUPS = "[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"


def ipv6(address: Column) -> Column:
    """The address as 32 hex digits, null if it is none: :: stands once for groups of zeros, the last two groups may be an IPv4 address."""
    a = F.lower(address)
    tail = F.regexp_extract(a, r"([0-9]+(?:\.[0-9]+){3})$", 1)
    number = ipv4(tail)
    quads = F.lower(F.lpad(F.hex(number), 8, "0"))
    text = F.when(tail == "", a).otherwise(F.concat(F.left(a, F.length(a) - F.length(tail)), F.substring(quads, 1, 4), F.lit(":"), F.substring(quads, 5, 4)))

    def expanded(t: Column) -> Column:
        sides = F.split(t, "::")
        groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
        left, right = groups(F.get(sides, 0)), groups(F.coalesce(F.get(sides, 1), F.lit("")))
        short = F.size(sides) == 2
        few = F.size(left) + F.size(right)
        zeros = F.when(short, F.array_repeat(F.lit("0"), F.lit(8) - few)).otherwise(F.expr("cast(array() as array<string>)"))
        good = t.rlike(f"^(?:{_GROUPS}|(?:{_GROUPS})?::(?:{_GROUPS})?)$") & F.when(short, few <= 7).otherwise((F.size(sides) == 1) & (few == 8))
        return F.when(good, F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), ""))

    return F.element_at(F.transform(F.array(text), expanded), 1)


#: What an upstream address must not be, as first address and prefix length.
BLOCKED = (
    ("unspecified", "0.0.0.0", 32), ("loopback", "127.0.0.0", 8), ("private", "10.0.0.0", 8), ("private", "172.16.0.0", 12),
    ("private", "192.168.0.0", 16), ("link_local", "169.254.0.0", 16), ("multicast", "224.0.0.0", 4),
)


#: The same for addresses of 128 bits, as the beginning of their 32 hex digits.
BLOCKED6 = (
    ("unspecified", "0{32}"), ("loopback", "0{31}1"), ("private", "f[cd]"), ("link_local", "fe[89ab]"), ("multicast", "ff"),
)


def address_class(address: Column) -> Column:
    """unspecified, loopback, private, link_local, multicast, public, or invalid, of either family; an IPv4 address within an IPv6 one counts as itself."""
    hexed = ipv6(address)
    n, out = F.coalesce(ipv4(address), F.when(hexed.rlike("^0{20}ffff"), F.conv(F.substring(hexed, 25, 8), 16, 10).cast("long"))), None
    for name, first, bits in BLOCKED:
        a, b, c, d = map(int, first.split("."))
        low = (a << 24) + (b << 16) + (c << 8) + d
        test = n.between(low, low + (1 << (32 - bits)) - 1)
        out = F.when(test, name) if out is None else out.when(test, name)
    six = None
    for name, begin in BLOCKED6:
        test = hexed.rlike(f"^{begin}")
        six = F.when(test, name) if six is None else six.when(test, name)
    return F.when(n.isNotNull(), out.otherwise("public")).when(hexed.isNotNull(), six.otherwise("public")).otherwise("invalid")


def is_json_type(content_type: Column) -> Column:
    t = F.lower(content_type)
    return F.contains(t, F.lit("/json")) | F.contains(t, F.lit("+json"))


def is_text_type(content_type: Column) -> Column:
    t = F.lower(content_type)
    return is_json_type(t) | t.startswith("text/") | F.contains(t, F.lit("javascript")) | F.contains(t, F.lit("xml"))


def protocol(path: Column, has_messages: Column, has_input: Column, anthropic: Column) -> Column:
    """By the path's end, else by the body's fields."""
    p = F.regexp_replace(F.lower(path), "/$", "")
    return (
        F.when(p.endswith("/chat/completions"), "openai_chat").when(p.endswith("/responses"), "openai_responses").when(p.endswith("/messages"), "anthropic_messages")
        .when(has_messages, F.when(anthropic, "anthropic_messages").otherwise("openai_chat")).when(has_input, "openai_responses").otherwise("generic")
    )


def protocol_of(path: str, has_messages: bool, has_input: bool, anthropic: bool) -> str:
    """protocol() of one body."""
    low = path.lower().removesuffix("/")
    for end, name in (("/chat/completions", "openai_chat"), ("/responses", "openai_responses"), ("/messages", "anthropic_messages")):
        if low.endswith(end):
            return name
    by_body = "anthropic_messages" if anthropic else "openai_chat"
    return by_body if has_messages else "openai_responses" if has_input else "generic"


#: Headers that stay behind, and beginnings of such.
HOP_BY_HOP = (
    "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
DROPPED_REQUEST = (
    *HOP_BY_HOP, "accept-encoding", "content-length", "cookie", "cookie2", "forwarded", "host", "origin", "referer", "via", "x-real-ip",
    "x-redact-session", "x-redact-token",
)
DROPPED_RESPONSE = (*HOP_BY_HOP, "content-encoding", "content-length")
DROPPED_PREFIXES = ("cf-", "sec-", "x-forwarded-")


def _without(headers: Column, dropped: tuple[str, ...], prefixes: tuple[str, ...] = ()) -> Column:
    """headers without the dropped ones and those that a Connection header, however it is spelled, names."""
    said = F.array_join(F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == "connection")), ",")
    named = F.transform(F.split(F.lower(said), ","), lambda x: F.trim(x))

    def stays(k: Column, _: Column) -> Column:
        low = F.lower(k)
        out = ~low.isin(*dropped) & ~F.array_contains(named, low)
        for p in prefixes:
            out = out & ~low.startswith(p)
        return out

    return F.map_filter(headers, stays)


def request_headers(headers: Column) -> Column:
    """A map of headers without hop-by-hop, cookie, forwarding and control headers, and those that Connection names."""
    return _without(headers, DROPPED_REQUEST, DROPPED_PREFIXES)


def response_headers(headers: Column) -> Column:
    return _without(headers, DROPPED_RESPONSE)


def response_class(status: Column, content_type: Column, encoding: Column, size: Column, limit: int) -> Column:
    """empty, untouched, json, text, or an error class: what becomes of a response's body."""
    kind = F.coalesce(content_type, F.lit(""))
    coded = F.lower(F.trim(F.coalesce(encoding, F.lit(""))))
    return (
        F.when(status.isin(204, 304), "empty").when(~is_text_type(kind), "untouched").when(~coded.isin("", "identity"), "encoded_response")
        .when(size > limit, "response_too_large").when(is_json_type(kind), "json").otherwise("text")
    )


def epoch_ms(text: Column) -> Column:
    """Milliseconds since 1970 of an RFC 3339 time; null if it is none."""
    good = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$")
    fraction = F.rpad(F.substring(F.regexp_extract(text, r"\.([0-9]+)", 1), 1, 3), 3, "0").cast("long")
    whole = F.concat(F.substring(text, 1, 10), F.lit(" "), F.substring(text, 12, 8), F.regexp_replace(F.upper(F.regexp_extract(text, r"([Zz]|[+-][0-9]{2}:[0-9]{2})$", 1)), "Z", "+00:00"))
    seconds = F.unix_seconds(F.try_to_timestamp(F.when(good, whole), F.lit("yyyy-MM-dd HH:mm:ssXXX")))
    return seconds * 1000 + fraction


def rfc3339(ms: Column) -> Column:
    """An RFC 3339 time in UTC, with milliseconds where there are any."""
    day = F.floor(ms / 86_400_000)
    inside = ms - day * 86_400_000
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(inside / 3_600_000)), two(F.floor(inside / 60_000) % 60), two(F.floor(inside / 1000) % 60))
    rest = F.when(inside % 1000 == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.rtrim(F.lpad((inside % 1000).cast("string"), 3, "0"), F.lit("0"))))
    return F.concat(F.date_format(F.date_from_unix_date(day.cast("int")), "yyyy-MM-dd"), F.lit("T"), clock, rest, F.lit("Z"))


def valid_session(session: Column) -> Column:
    return session.rlike("^[A-Za-z0-9_-]{16,256}$")


def session_scope(parts: list[Column], credentials: list[Column]) -> Column:
    """SHA-256 of the length-framed parts; null unless a credential header is not blank."""
    framed = F.concat(*[F.concat(F.octet_length(F.coalesce(p, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p, F.lit(""))) for p in parts])
    known = F.coalesce(F.trim(credentials[0]) != "", F.lit(False))
    for c in credentials[1:]:
        known = known | F.coalesce(F.trim(c) != "", F.lit(False))
    return F.when(known, F.sha2(framed, 256))


def gateway_url(url: Column) -> Column:
    """The URL without trailing slashes; '' stays, null where it is not valid."""
    port = F.regexp_extract(url, r"^[A-Za-z]+://[^/]*?:([0-9]*)(?:/|$)", 1)
    good = (
        url.rlike(r"^(?i)https?://[^/:@]+(:[0-9]+)?(/.*)?$") & ~url.rlike(r"[\s\\?#@]") & ((port == "") | port.try_cast("int").between(1, 65535))
    )
    return F.when(url == "", F.lit("")).when(good, F.regexp_replace(url, "/+$", ""))


def base_url(scheme: Column, host: Column, port: Column) -> Column:
    """Where the console is served from an address or localhost: the proxy's own port, 80 left out; from a domain: the page's scheme and host."""
    local = (host == "localhost") | ipv4(host).isNotNull() | host.startswith("[")
    shown = F.when(port == 80, F.lit("")).otherwise(F.concat(F.lit(":"), port.cast("string")))
    return F.when(local, F.concat(F.lit("http://"), host, shown)).otherwise(F.concat(scheme, F.lit("://"), host))


#: Status of each error class.
ERROR_STATUS = {
    "numeric_sensitive_value": 400, "json_nesting_limit": 413, "request_too_large": 413, "unsupported_body": 415, "invalid_request": 400,
    "upstream_blocked": 403, "encoded_request": 415, "invalid_session": 400, "upstream_failed": 502, "encoded_response": 502,
    "response_read_failed": 502, "response_too_large": 502,
}


def error_status(error_class: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in ERROR_STATUS.values()]), (F.array_position(F.array(*[F.lit(k) for k in ERROR_STATUS]), error_class) - 1).cast("int"))


def body_class(content_type: Column, body: Column, limit: int) -> Column:
    """'' for a body to process, passthrough for an empty one, else its error class."""
    return (
        F.when(F.coalesce(F.octet_length(body), F.lit(0)) == 0, "passthrough").when(F.octet_length(body) > limit, "request_too_large").when(~is_json_type(content_type), "unsupported_body")
        .when(F.try_parse_json(body).isNull(), "invalid_request").otherwise("")
    )


def stream_error(event_type: Column, status: Column) -> Column:
    """'' or the class of an event that ends a stream badly, by the rows of streaming.events."""
    out = F.lit("")
    for pattern, name in reversed(ERRORS):
        bad = F.coalesce(event_type.rlike(f"^(?:{pattern})$"), F.lit(False)) | F.coalesce(F.concat(F.lit("status "), status).rlike(f"^(?:{pattern})$"), F.lit(False))
        out = F.when(bad, name).otherwise(out)
    return out


def stream_limit_class(limit_hit: Column) -> Column:
    return F.when(limit_hit, "stream_limit_exceeded").otherwise("restore_failed")


def shown_bytes(n: Column) -> Column:
    """1536 as 1.5 KB, for people."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(F.round(n / 1024, 1).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.round(n / (1 << 20), 1).cast("string"), F.lit(" MB")))
