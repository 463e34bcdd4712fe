"""Main text of web pages by template deduction over the pages of a host.

Tokens are tags and the texts of blocks, each with the path of elements above it. For each host, tokens that occur in the same pages equally often share an
occurrence vector and form a class. Classes of at least LEAST_TOKENS tokens in at least LEAST_SHARE of the host's pages (and LEAST_PAGES of them)
are candidates; those whose tokens keep one order in every page and lie in one gap of the class around them are valid. Nested into one another
they are the host's template, and what stands between their tokens are its slots. A block whose text is a template's token is no slot and goes.

Of the slots, the main text's are chosen by what HTML says of them: elements and names for menus, headers, footers, sidebars, notices, adverts, forms
and comments go; a declared article (else main) is the region where there is one, with its headings. On pages without one the region is the
innermost container that holds most of the text over all such pages of the host, without blocks that are mostly links.

No list of a host's pages is ever in one place: vectors are sums of a hash of page and count, added up in the tasks and by partial aggregation; order and
nesting are hashes that must be equal in all pages. A host's template is as long as a page at most. Pages are read twice and aren't exchanged, unless
all templates together have too many rows to broadcast; then hosts with many pages are salted.

Defined results: null and empty html have no text. Malformed html is read on: elements left open end with the one around them, a tag that
never ends ends the page. A host's pages that hold the same text throughout would be template as a whole: a page in which no slot is left
keeps its region's blocks. Hosts with fewer than LEAST_PAGES pages have no template, and are read by elements and names alone. Repeated pages count as often as
they occur; null urls are one host. Very long pages are read whole. Extra columns are kept; new ones take an underscore in front where df has the name.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base as base

LEAST_TOKENS, LEAST_SHARE, LEAST_PAGES = 3, 0.9, 10
#: Share of a host's slot text that its container must hold, of a block's text in links that makes it a menu; rows that a task holds before they go.
CONTAINER, LINKS, HELD = 0.6, 0.5, 400_000

# Elements of HTML by what they do, and names that sites give to parts that aren't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style title textarea iframe noembed noframes xmp noscript template svg math canvas object audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = HEADINGS | frozenset("p li ul ol dl dt dd blockquote pre table tbody thead tfoot tr td th figure figcaption caption address".split())
#: What an element that begins ends, up to the first of what stops it.
ENDS = {
    **dict.fromkeys(BLOCKS - {"body", "html", "head"}, (frozenset(["p"]), frozenset("article aside section div main td th li table body button".split()))),
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])), "body": (frozenset(["head"]), frozenset(["body"])),
}
NEVER = frozenset("nav footer aside dialog menu head button select".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form status".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar sidebars aside footer masthead cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations comment comments disqus reply replies respond search pagination pager widget widgets toolbar "
    "copyright form teaser teasers".split()
)
#: Those that count on an article or main element too, which says of itself to be the text.
STRONG = frozenset("ad ads advert advertisement comment comments reply replies related teaser teasers promo sponsored widget recommended".split())
#: A comment, a tag (with quotes that never end up to the next >, without a > up to the end), a declaration.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.DOTALL)
_NAMED = re.compile(r"""(?i)(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_MASK = (1 << 64) - 1
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def token(path: int, name: str) -> int:
    return xxhash.xxh64_intdigest(name.encode("utf-8", "replace"), path & 0xFFFFFFFFFFFFFFFF)


@functools.lru_cache(20_000)
def _told(name: str, attributes: str) -> tuple[str, int, str]:
    """Why an element isn't main text, 2 for an article or 1 for a main element, and its step in paths."""
    said = {k.lower(): v.strip("\"'") for k, v in _NAMED.findall(attributes)} if attributes else {}
    words = {w.lower() for w in _PARTS.findall(f"{said.get('class', '')} {said.get('id', '')}")}
    role, body = said.get("role", "").lower(), "articleBody" in said.get("itemprop", "")
    kind = 2 if name == "article" or body else 1 if name == "main" or role == "main" else 0
    if name in NEVER or role in ROLES:
        own = "never"
    elif name not in ("html", "body") and words & (STRONG if kind else NAMES) or name in ("form", "fieldset"):
        own = "named"
    else:
        own = "header" if name == "header" or "header" in words and not kind and name != "body" else ""
    return own, kind, name + "." + re.sub(r"\s+|\d{3,}", " ", said.get("class", "")).strip()


@functools.lru_cache(100_000)
def _below(path: int, step: str) -> int:
    return token(path, step)


@dataclass
class Block:
    path: int
    element: int
    at: int  # place among the page's tags
    heading: bool
    runs: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.runs)).split())

    def token(self) -> int:
        return token(self.path, " ".join("".join(self.runs).split()))


@dataclass
class Page:
    """Elements in page order, each with what is above it, and blocks of text."""

    name: list[str] = field(default_factory=list)
    path: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    own: list[str] = field(default_factory=list)  # why it isn't main text: never, named, header, or nothing
    holds: list[bool] = field(default_factory=list)  # an article or main
    declared: list[int] = field(default_factory=list)  # 2 article, 1 main
    tags: list[int] = field(default_factory=list)  # tokens of the tags, in order
    blocks: list[Block] = field(default_factory=list)

    def open(self, name: str, attributes: str, above: int) -> int:
        own, kind, step = _told(name, attributes)
        here = len(self.name)
        self.name.append(name)
        self.path.append(_below(self.path[above] if above >= 0 else 0, step))
        self.parent.append(above)
        self.own.append(own)
        self.holds.append(False)
        self.declared.append(0 if own else kind)
        if self.declared[here]:
            k = above
            while k >= 0 and not self.holds[k]:
                self.holds[k] = True
                k = self.parent[k]
        return here

    def judged(self) -> tuple[list[int], list[int]]:
        """For each element: 2 if it isn't main text, 1 if it is a declared article's header; and the region that it is in: 2, 1 or 0."""
        out, region = [], []
        for k, above in enumerate(self.parent):
            over, inside = (out[above], region[above]) if above >= 0 else (0, 0)
            own = self.own[k]
            if over == 2 or own == "never" or own == "named" and not self.holds[k] or own == "header" and not inside and not self.holds[k]:
                mine = 2
            else:
                mine = 1 if over or own == "header" and not self.holds[k] else 0
            out.append(mine)
            region.append(max(inside, self.declared[k]) if mine == 0 else inside)
        return out, region


def parse(text: str | None) -> Page:
    page, text = Page(), text or ""
    names: list[str] = []
    line: list[tuple[int, int, bool, bool]] = [(-1, -1, False, False)]  # of each open element: itself, the block, whether in a heading, in a link
    block: Block | None = None
    at = 0
    while at < len(text):
        m = _TAG.search(text, at)
        start = m.start() if m else len(text)
        if start > at:
            run, (_, top, heading, linked) = text[at:start], line[-1]
            if block is None and not run.isspace():
                block = Block(page.path[top] if top >= 0 else 0, top, len(page.tags), heading)
                page.blocks.append(block)
            if block is not None:
                block.runs.append(run)
                block.linked += len(run) if linked else 0
        if m is None:
            break
        at = m.end()
        closing, name, attributes = m.groups()
        if name is None:
            continue
        name = name.lower()
        blocky = name in BLOCKS
        if blocky:
            block = None
        elif name == "br":
            if block is not None:
                block.runs.append(" ")
            continue
        if closing:
            if name in names:
                depth = len(names) - 1 - names[::-1].index(name)
                if not BLOCKS.isdisjoint(names[depth:]):
                    block = None
                del names[depth:], line[depth + 1 :]
            above = line[-1][0]
            page.tags.append(_below(page.path[above] if above >= 0 else 0, "</" + name))
            continue
        if name in ENDS:
            ended, stops = ENDS[name]
            for depth in range(len(names) - 1, -1, -1):
                if names[depth] in ended:
                    del names[depth:], line[depth + 1 :]
                    break
                if names[depth] in stops:
                    break
        above, top, heading, linked = line[-1]
        here = page.open(name, attributes, above)
        page.tags.append(page.path[here])
        if name in UNREAD:
            if not attributes.endswith("/"):
                end = re.compile(f"(?i)</{re.escape(name)}(?=[\\s/>])").search(text, at)
                close = text.find(">", end.end()) if end else -1
                at = close + 1 if close >= 0 else len(text)
        elif name not in VOID and (blocky or not attributes.endswith("/")):
            names.append(name)
            line.append((here, here if blocky else top, heading or name in HEADINGS, linked or name == "a"))
    return page


def counted(page: Page) -> Counter:
    """The page's tokens: its tags and its blocks' texts."""
    return Counter(page.tags + [b.token() for b in page.blocks])


def _mixed(page: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each (page, count)."""
    z = page + times.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class _Vectors:
    """(host, token) to pages, occurrences and the sum of page hashes, of the pages that a task has read lately."""

    def __init__(self) -> None:
        self.hosts: dict[str, int] = {}
        self.host, self.token, self.times, self.page = [], [], [], []

    def add(self, host: str, key: int, page: Page) -> None:
        found = counted(page)
        self.token += found.keys()
        self.times += found.values()
        self.host += [self.hosts.setdefault(host, len(self.hosts))] * len(found)
        self.page += [key] * len(found)

    def full(self) -> bool:
        return len(self.token) >= HELD

    def batch(self) -> pa.RecordBatch:
        host, token_, times = np.array(self.host, np.int64), np.array(self.token, np.uint64), np.array(self.times, np.int64)
        mixed = _mixed(np.array(self.page, np.uint64), times)
        order = np.lexsort((token_, host))
        new = np.r_[True, (np.diff(host[order]) != 0) | (token_[order][1:] != token_[order][:-1])]
        first, size = np.flatnonzero(new), len(order)
        total = lambda x: np.add.reduceat(x[order], first)
        return pa.RecordBatch.from_pydict({
            "host": pa.array(np.array(list(self.hosts), object)[host[order][first]], pa.string()), "token": pa.array(token_[order][first].view(np.int64)),
            "pages": pa.array(np.diff(np.r_[first, size])), "times": pa.array(total(times)), "vector": pa.array(total(mixed).view(np.int64)),
        })


def vectors(pages: DataFrame) -> DataFrame:
    """host, token, pages, times, vector from pages (host, key, html): the vector of counts, hashed to a sum that is the same in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Vectors()
        for b in batches:
            for host, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                held.add(host, key & _MASK, parse(text.as_py()))
                if held.full():
                    yield held.batch()
                    held = _Vectors()
        if held.token:
            yield held.batch()

    got = pages.select("host", "key", "html").mapInArrow(run, "host string, token long, pages long, times long, vector long")
    wrap = F.lit(str(2**64)).cast("decimal(20,0)")
    # A task's sums wrap around at 2^64; theirs are added as decimals, which don't.
    total = F.sum(F.col("vector").cast("decimal(20,0)")) % wrap
    wrapped = F.when(total < 0, total + wrap).otherwise(total)
    return got.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("times").alias("times"), wrapped.alias("vector"))


def candidates(found: DataFrame, pages: DataFrame) -> DataFrame:
    """host, members [(token, class)] of the classes that are large and frequent enough. class is a number within the host."""
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") >= LEAST_PAGES)
    often = found.join(base.if_small(base.materialize(sizes, "page-hosts")), "host").where(F.col("pages") >= F.greatest(F.lit(LEAST_PAGES), F.col("all") * LEAST_SHARE))
    classes = often.groupBy("host", "pages", "times", "vector").agg(F.collect_list("token").alias("tokens")).where(F.size("tokens") >= LEAST_TOKENS)
    name = F.xxhash64("pages", "times", "vector")
    members = classes.select("host", name.alias("class"), F.explode("tokens").alias("token"))
    return members.groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("members"))


def shape(page: Page, members: dict[int, int]) -> list[tuple[int, int]]:
    """(class, hash of the order of its tokens and of its place in the class around it) for each class on the page; 0 if it breaks its own order or a gap."""
    places: dict[int, list[tuple[int, int]]] = {}
    after = iter([*page.blocks, None])
    block = next(after)
    for at, t in enumerate([*page.tags, -1]):
        while block is not None and block.at <= at:  # blocks stand between tags
            own = block.token()
            if own in members:
                places.setdefault(members[own], []).append((2 * at, own))
            block = next(after)
        if t in members:
            places.setdefault(members[t], []).append((2 * at + 1, t))
    spans = {}
    for c, found in places.items():
        order = [t for _, t in found]
        once = len(set(order))
        same = all(order[k : k + once] == order[:once] for k in range(0, len(order), once))
        spans[c] = (found[0][0], found[-1][0], order[:once] if same else [], once == len(order))
    out = []
    for c, (first, last, order, _) in spans.items():
        around: tuple[int, ...] = ()
        for d, (begin, end, _, single) in spans.items():
            if single and begin < first and last < end and (not around or end - begin < around[0]):
                around = (end - begin, d, sum(p < first for p, _ in places[d]), sum(p < last for p, _ in places[d]))
        fits = order and (not around or around[2] == around[3])
        out.append((c, xxhash.xxh64_intdigest(repr((order, around[1:])).encode()) if fits else 0))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _containers(page: Page, element: int) -> list[int]:
    """The elements around a block that can hold a page's text, outermost first."""
    out = []
    while element >= 0:
        if page.name[element] in BLOCKS and page.name[element] not in TEXTUAL:
            out.append(element)
        element = page.parent[element]
    return out[::-1]


def chosen(page: Page, members: dict[int, int]) -> list[tuple[str, int | None, list[int]]]:
    """(text, class of the template if it may belong to it, paths of the containers) of the blocks that may be main text, in page order. The paths
    are given only where the page declares no article or main."""
    judged, region = page.judged()
    fine = [b for b in page.blocks if b.element < 0 or judged[b.element] == 0 or judged[b.element] == 1 and b.heading]
    most = max((region[b.element] for b in fine if b.element >= 0), default=0)
    if most:
        fine = [b for b in fine if b.element >= 0 and region[b.element] == most]
    else:
        fine = [b for b in fine if b.linked <= LINKS * sum(map(len, b.runs))]
    out = []
    for b in fine:
        text = b.text()
        if text:
            out.append((text, members.get(b.token()) if members else None, [] if most else [_signed(page.path[k]) for k in _containers(page, b.element)]))
    return out


_BLOCKS = "array<struct<text:string,class:long,containers:array<long>>>"
_SHAPES = "array<struct<class:long,shape:long>>"


def _joined(left: DataFrame, table: DataFrame, key: str, by: list[str]) -> DataFrame:
    """left left join table, which is written and has a row a key; keys with many rows are salted where it is too large to broadcast."""
    small = base.if_small(table)
    return left.join(small, key, "left") if small is not table else base.spread_join(left, table, [key], by, "left")


def extract(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """df without html, with text and n_chars."""
    kept = df.drop(html_col)
    text_name, size_name = base.output_names(kept, "text", "n_chars")
    host, key, source, member, block, form, gone, inner = base.fresh(kept, "host", "key", "html", "members", "blocks", "shapes", "template", "container")
    named = df.select(*[F.col(f"`{c}`") for c in kept.columns], host_of(F.col(url_col)).alias(host), F.xxhash64(F.col(url_col), F.col(html_col)).alias(key), F.col(html_col).cast("string").alias(source))
    pages = named.select(F.col(host).alias("host"), F.col(key).alias("key"), F.col(source).alias("html"))
    members = base.materialize(candidates(vectors(pages), pages), "page-classes")
    held = _joined(named, members.select(F.col("host").alias(host), F.col("members").alias(member)), host, [key])
    held = held.select(*[F.col(f"`{c}`") for c in kept.columns], host, key, source, member)
    schema = ", ".join([held.drop(source, member)._jdf.schema().toDDL(), f"{block} {_BLOCKS}", f"{form} {_SHAPES}"])
    block_type = pa.list_(pa.struct([("text", pa.string()), ("class", pa.int64()), ("containers", pa.list_(pa.int64()))]))
    shape_type = pa.list_(pa.struct([("class", pa.int64()), ("shape", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, blocks, shapes, known = b.num_columns - 2, [], [], {}
            for where, text, some in zip(b.column(n - 2).to_pylist(), b.column(n), b.column(n + 1)):
                if where not in known:
                    known[where] = {x["token"] & _MASK: x["class"] for x in some.as_py() or ()}
                page = parse(text.as_py())
                blocks.append([dict(zip(("text", "class", "containers"), x)) for x in chosen(page, known[where])])
                shapes.append([{"class": c, "shape": _signed(x)} for c, x in shape(page, known[where])] if known[where] else [])
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(blocks, block_type), pa.array(shapes, shape_type)], names=[*b.schema.names[:n], block, form])

    read = base.materialize(held.mapInArrow(run, schema), "page-blocks")
    table = base.materialize(_templates(read, host, block, form).select(F.col("host").alias(host), F.col("template").alias(gone), F.col("container").alias(inner)), "page-templates")
    blocks, template = F.col(block), F.coalesce(F.col(gone), F.expr("cast(array() as array<long>)"))
    inside = F.filter(blocks, lambda x: F.array_contains(x["containers"], F.col(inner)))
    region = F.when(F.size(inside) > 0, inside).otherwise(blocks)
    slots = lambda some: F.filter(some, lambda x: x["class"].isNull() | ~F.array_contains(template, x["class"]))
    main = base.let(region, lambda some: base.let(slots(some), lambda left: F.when(F.size(left) > 0, left).otherwise(some)))
    text = F.array_join(F.transform(main, lambda x: x["text"]), "\n")
    return _joined(read, table, host, [key]).select(*[F.col(f"`{c}`") for c in kept.columns], text.alias(text_name)).withColumn(size_name, F.length(text_name).cast("long"))


def _templates(read: DataFrame, host: str, block: str, form: str) -> DataFrame:
    """host, template [valid classes], container: the innermost path that holds enough of the host's text."""
    shapes = read.select(F.col(host).alias("host"), F.explode(form).alias("s")).groupBy("host", "s.class").agg(F.min("s.shape").alias("least"), F.max("s.shape").alias("most"))
    valid = shapes.where("least = most AND least <> 0").groupBy("host").agg(F.collect_list("class").alias("template"))
    texts = read.select(F.col(host).alias("host"), F.explode(block).alias("b")).select("host", F.length("b.text").alias("size"), F.posexplode("b.containers").alias("depth", "path"))
    sizes = texts.groupBy("host", "depth", "path").agg(F.sum("size").alias("size"))
    whole = sizes.groupBy("host").agg(F.max("size").alias("whole"))
    inner = sizes.join(whole, "host").where(F.col("size") >= CONTAINER * F.col("whole")).groupBy("host").agg(F.max_by("path", F.struct("depth", "size", "path")).alias("container"))
    return valid.join(inner, "host", "full")


def op12_page_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(base.read(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op12_page_template": op12_page_template}
ORACLE: dict[str, str] = {}
