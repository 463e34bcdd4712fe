"""Personal data by base patterns and a semi-Markov conditional random field.

The base patterns (e-mail, ip, card, phone) are fixed; what they find stays. A semi-Markov CRF then reads what they leave
around digits and at-signs, spelled ones too: it scores whole candidate spans, as long as their shape can be, with features of the whole span (checksum,
digit count, grouping, shape, what stands at either side, the words before it) and of the segment before (its kind, and whether it touches or only marks
stand between), and dynamic programming chooses boundaries and kinds jointly. So it finds
what a greedy pattern loses: two cards with a space between, a phone number run together with the number after it, an
address spelled with (at) and (dot), an ip with its dots in brackets, a phone number without country code. A span is added if it is in the best segmentation and its
posterior probability is at least SURE.

The weights are fitted here, by likelihood, to windows of a bounded sample (SAMPLE documents that have base spans or digits, the first in
hash order): base spans as they stand are positives, and spans of the same sample composed or respelled as above;
digit runs that the patterns reject are negatives. Applying it is a narrow map over whole texts.

Words that spell an address (name at host dot com) are taken for one, whatever the sentence means.

What a candidate can be is bounded by the formats alone: a card has at most 19 digits, groups of digits are at most GAP marks apart, the part of an
address before its sign has at most 64 characters and the domain 255. Windows reach as far as the longest candidate.

Defined results: null and empty texts have no spans. Very long texts are searched whole, window by window. Of segmentations with equal scores
the one that the dynamic programme reaches first counts, the same for equal texts. Repeated rows get equal spans. Extra columns are kept; new ones take an
underscore in front where df has the name. An empty table gives an empty result.
"""

from __future__ import annotations

import logging
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base as base

KINDS = ("email", "ip", "card", "phone")
#: Documents that the field is fitted on, posterior that an added span needs.
SAMPLE, SURE = 1500, 0.75
#: Bounds of the fit alone: characters of a sampled document, windows of one and their characters, base values a kind.
SAMPLE_CHARS, SAMPLE_WINDOWS, WINDOW_CHARS, SAMPLE_VALUES = 50_000, 3, 400, 400
#: Features that fewer examples hold aren't weighed. Characters before a span whose last two words are features of it.
LEAST_EXAMPLES, CONTEXT = 5, 24
#: Digits of a card, the longest kind, marks between two of its groups, and what the longest number of digits and marks takes.
DIGITS, GAP = 19, 3
REACH = DIGITS * (1 + GAP) + GAP
#: Characters of an address before its sign, and behind: a domain of 255 characters, each of its 127 dots spelled in 9, and the sign.
BEFORE, BEHIND = 64, 255 + 127 * 8 + 9
# Of an address [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ the part behind the sign; what stands before is read
# backwards, so that long words cost no more than their length. Possessive repeats keep long digit runs linear too.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|(?s:.)")

Span = tuple[int, int, str]
_LOG = logging.getLogger(__name__)


def luhn(digits: str) -> bool:
    """The mod 10 check."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _octet(part: str) -> bool:
    """At most 255, whatever number of zeros stands before."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            yield start, end, "email"
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) by start, then kind as listed; per kind leftmost and not overlapping, without retries."""
    out: list[Span] = []
    if "@" in text:
        out += _emails(text)
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(_octet(p) for p in m.group().split("."))]
        out += [(m.start(), m.end(), "card") for m in _CARD.finditer(text) if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# Candidates and their features ------------------------------------------------------------------------------------------------

_AT = r"(?:@|\x20?[(\[{<]\x20?(?:at|@)\x20?[)\]}>]\x20?|\x20at\x20)"
_DOT = r"(?:\.|\x20?[(\[{<]\x20?(?:dot|\.)\x20?[)\]}>]\x20?|\x20dot\x20)"
_SHAPES = {
    "email": re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}", re.IGNORECASE),
    "ip": re.compile(rf"[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}", re.IGNORECASE),
    "card": re.compile(r"[0-9]+(?:[ .-][0-9]+)*"),
    "phone": re.compile(r"\+?\(?[0-9]+(?:[ ()./-]{1,3}[0-9]+)*"),
}
#: What follows the part before the sign, as far as an address can reach.
_REST = re.compile(rf"{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*", re.IGNORECASE)
#: An ip from its first digit on, its dots spelled or not.
_SPELLED_IP = re.compile(rf"[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
#: What opens a window; plain words do where both sign and a dot are spelled.
_MARKS = re.compile(
    r"[0-9]{2,}|[0-9](?:[\x20()./-]{1,3}[0-9]){8}|[0-9](?=\x20?[(\[{<]\x20?(?:dot|\.)|\x20dot\x20[0-9])|@|[(\[{<]\x20?at\x20?[)\]}>]|(?<=[A-Za-z0-9._%+-])\x20at\x20(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?:\x20dot\x20|\x20?[(\[{<]\x20?(?:dot\b|\.)))", re.IGNORECASE
)
_SPELLED = re.compile(r"\x20?[(\[{<]\x20?(?:(?:dot|at)\b|[.@])|\x20dot\x20", re.IGNORECASE)
_WORD = re.compile("[A-Za-z]{2,}")
_GROUPS = {"card": re.compile(r"[0-9]{12,19}|(?:[0-9]{4}([ .-]))(?:[0-9]{4}\1){2}[0-9]{1,7}"), "phone": re.compile(r"(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")}


def features(kind: str, span: str, left: str, right: str, words: tuple[str, ...] = ()) -> list[str] | None:
    """Names of the whole-span features, or None if the span can't be of the kind; words are the last before the span."""
    if not _SHAPES[kind].fullmatch(span):
        return None
    d, out = _digits(span), ["bias"]
    if kind == "email":
        out.append("sign" if "@" in span else "spelled" if re.search(r"[(\[{<]", span) else "words" if re.search(r"\x20dot\x20", span, re.IGNORECASE) else "half words")
    elif kind == "ip":
        out += ["octets" if all(int(p) <= 255 for p in re.findall("[0-9]+", span)) else "beyond", "dots" if span.count(".") == 3 and len(span) == len(d) + 3 else "spelled dots"]
    elif kind == "card":
        if not 12 <= len(d) <= 19:
            return None
        out += ["luhn" if luhn(d) and len(set(d)) > 1 else "no luhn", "grouped" if _GROUPS["card"].fullmatch(span) else "loose"]
    else:
        if not 9 <= len(d) <= 15:
            return None
        out += ["plus" if span[0] == "+" else "bare", "grouped" if _GROUPS["phone"].fullmatch(span) else "loose", "marked" if re.search(r"[ ().-]", span) else "run"]
        if "/" in span:
            out.append("slash")
        if span.count("(") != span.count(")"):
            out.append("uneven")
    for side, c in (("left", left[-1:]), ("right", right[:1])):
        if c.isdigit():
            out.append(f"{side} digit")
        elif c.isalpha() or c == "_":
            out.append(f"{side} letter")
        elif c in (".", "-", "+", "@") or side == "right" and _SPELLED.match(right):
            out.append(f"{side} joint")
    return [f"{kind}:{x}" for x in [*out, *(f"word {w}" for w in dict.fromkeys(words))]]


Candidate = tuple[int, int, str, list[str]]


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[list[Candidate]]:
    """For each token, the candidates (start token, end token, kind, features) that end with it."""
    out: list[list[Candidate]] = [[] for _ in tokens]
    first = [text[a] for a, _ in tokens]
    ends_at = {b: j for j, (_, b) in enumerate(tokens)}
    said: dict[int, tuple[str, ...]] = {}

    def add(i: int, j: int, kinds: tuple[str, ...]) -> None:
        a, b = tokens[i][0], tokens[j][1]
        if i not in said:
            inside = a > 0 and text[a - 1] in _LOCAL  # within a longer run: what stands before isn't a word about it
            said[i] = () if inside else tuple(w.lower() for w in _WORD.findall(text, max(0, a - CONTEXT), a)[-2:])
        for kind in kinds:
            if (f := features(kind, text[a:b], text[max(0, a - 1) : a], text[b : b + 8], said[i])) is not None:
                out[j].append((i, j, kind, f))

    for i, c in enumerate(first):
        if not (c.isascii() and c.isdigit() or c in "+("):
            continue
        digits = gap = 0
        for j in range(i, len(tokens)):
            if first[j].isascii() and first[j].isdigit():
                digits, gap = digits + tokens[j][1] - tokens[j][0], 0
                if digits > DIGITS:
                    break
                add(i, j, ("card", "phone"))
            elif (gap := gap + 1) > GAP or first[j] not in " ()./-" and j > i:
                break
        if c.isdigit() and (m := _SPELLED_IP.match(text, tokens[i][0])) and m.end() in ends_at:
            add(i, ends_at[m.end()], ("ip",))
    # Addresses: from each sign, the starts before it and the ends behind it.
    sign = len(tokens)
    for i in range(len(tokens) - 1, -1, -1):
        if first[i] not in _LOCAL:
            sign, ends = i, None
        elif first[i].isalnum() and sign < len(tokens) and tokens[sign][0] - tokens[i][0] <= BEFORE:
            if ends is None:
                ends, m = [], _REST.match(text, tokens[sign][0])
                for j in range(sign, len(tokens)):
                    if m is None or tokens[j][1] > min(m.end(), m.start() + BEHIND):
                        break
                    if first[j].isascii() and first[j].isalpha():
                        ends.append(j)
            for j in ends:
                add(i, j, ("email",))
    return out


#: What stands before a segment: nothing near, a span of a kind that it touches, or one with only marks between.
STATES = ("", *KINDS, *(f"{k} and marks" for k in KINDS))
_AFTER_MARK = (0, 5, 6, 7, 8, 5, 6, 7, 8)


def _or(a: float, b: float) -> float:
    """Log of the sum of two numbers that are given by their logs."""
    a, b = (a, b) if a > b else (b, a)
    return a + math.log1p(math.exp(b - a))


def _join(sums: dict[int, float], state: int, value: float) -> None:
    sums[state] = _or(sums[state], value) if state in sums else value


@dataclass
class Lattice:
    """A window's tokens with the candidates that end with each; before: the kind of the base span that it begins at."""

    found: list[list[Candidate]]
    marks: list[bool]
    before: str = ""

    def on(self, j: int, state: int) -> int:
        """The state behind token j, outside spans."""
        return _AFTER_MARK[state] if self.marks[j] else 0


def lattice(text: str, tokens: list[tuple[int, int]], before: str = "") -> Lattice:
    return Lattice(candidates(text, tokens), [not text[a].isalnum() for a, _ in tokens], before)


@dataclass
class Field:
    weights: dict[str, float] = field(default_factory=dict)
    #: Examples that the fit had to leave out, as a true span wasn't a candidate.
    left_out: list[tuple[str, list[Span]]] = field(default_factory=list)

    def _score(self, c: Candidate) -> float:
        return sum(self.weights.get(f, 0.0) for f in c[3])

    def _after(self, state: int, kind: str) -> float:
        return self.weights.get(f"{kind}:after {STATES[state]}", 0.0) if state else 0.0

    def sums(self, w: Lattice) -> tuple[list[dict[int, float]], list[dict[int, float]], float]:
        """Log sums of all segmentations before and after each token, by state; tokens outside spans score nothing."""
        n = len(w.found)
        fore: list[dict[int, float]] = [{STATES.index(w.before): 0.0}, *({} for _ in range(n))]
        starts: list[list[tuple[Candidate, float, int]]] = [[] for _ in range(n)]
        for j in range(n):
            for state, v in fore[j].items():
                _join(fore[j + 1], w.on(j, state), v)
            for c in w.found[j]:
                score = self._score(c)
                starts[c[0]].append((c, score, j + 1))
                for state, v in fore[c[0]].items():
                    _join(fore[j + 1], 1 + KINDS.index(c[2]), v + score + self._after(state, c[2]))
        back: list[dict[int, float]] = [{} for _ in range(n)] + [dict.fromkeys(fore[n], 0.0)]
        for j in range(n - 1, -1, -1):
            for state in fore[j]:
                v = back[j + 1][w.on(j, state)]
                for c, score, end in starts[j]:
                    v = _or(v, score + self._after(state, c[2]) + back[end][1 + KINDS.index(c[2])])
                back[j][state] = v
        return fore, back, back[0][STATES.index(w.before)]

    def posteriors(self, w: Lattice) -> Iterator[tuple[Candidate, int, float]]:
        """Each candidate with each state before it and the probability of both."""
        fore, back, z = self.sums(w)
        for j, some in enumerate(w.found):
            for c in some:
                rest = self._score(c) + back[j + 1][1 + KINDS.index(c[2])] - z
                for state, v in fore[c[0]].items():
                    yield c, state, math.exp(min(0.0, v + self._after(state, c[2]) + rest))

    def best(self, w: Lattice) -> list[tuple[Candidate, float]]:
        """The spans of the best segmentation with their posteriors."""
        n = len(w.found)
        top: list[dict[int, tuple[float, tuple]]] = [{STATES.index(w.before): (0.0, ())}, *({} for _ in range(n))]
        for j in range(n):
            reached = [(w.on(j, state), v, how) for state, (v, how) in top[j].items()]
            for c in w.found[j]:
                score = self._score(c)
                reached += [(1 + KINDS.index(c[2]), v + score + self._after(state, c[2]), (c, how)) for state, (v, how) in top[c[0]].items()]
            for state, v, how in reached:
                if state not in top[j + 1] or v > top[j + 1][state][0]:
                    top[j + 1][state] = v, how
        how, out = max(top[n].values(), key=lambda x: x[0])[1], []
        if not how:
            return out
        sure: dict[tuple[int, int, str], float] = {}
        for c, _, p in self.posteriors(w):
            sure[c[:3]] = sure.get(c[:3], 0.0) + p
        while how:
            out.append((how[0], sure[how[0][:3]]))
            how = how[1]
        return out[::-1]


def windows(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Ranges of text around digits and at-signs that base spans don't cover, cut at them."""
    marks = [m.start() for m in _MARKS.finditer(text)]
    out: list[list[int]] = []
    k, ends = 0, sorted({(s, e) for s, e, _ in taken})
    for m in marks:
        while k < len(ends) and ends[k][1] <= m:
            k += 1
        if k < len(ends) and ends[k][0] <= m:
            continue
        low = max([e for _, e in ends[max(0, k - 3) : k]], default=0)
        high = ends[k][0] if k < len(ends) else len(text)
        a, b = max(low, m - max(BEFORE, REACH)), min(high, m + REACH)
        # An address with its dots spelled out can be longer. A space in front of a bracket belongs to the sign.
        if not text[m].isdigit() and (rest := _REST.match(text, m) or _REST.match(text, m - 1 if m else m)):
            b = min(high, max(b, min(rest.end(), m + BEHIND)))
        while a > low and a > 0 and text[a - 1].isalnum():
            a -= 1
        while b < high and text[b].isalnum():
            b += 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _tokens(text: str, a: int, b: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, a, b)]


def added_spans(text: str, taken: list[Span], model: Field) -> list[Span]:
    """The spans that the field adds."""
    if not model.weights:
        return []
    out, ends = [], {e: kind for _, e, kind in taken}
    for a, b in windows(text, taken):
        tokens = _tokens(text, a, b)
        w = lattice(text, tokens, ends.get(a, ""))
        if any(w.found):
            out += [(tokens[c[0]][0], tokens[c[1]][1], c[2]) for c, p in model.best(w) if p >= SURE]
    return out


def all_spans(text: str, taken: list[Span], model: Field) -> list[Span]:
    return sorted([*taken, *added_spans(text, taken, model)], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# Fitting ----------------------------------------------------------------------------------------------------------------------


#: Words before the made examples: of any, of one kind, and of numbers that are nobody's.
PLAIN = ("to", "and", "the", "of", "see")
LEADS = {"email": ("mail", "write to", "contact"), "ip": ("host", "from", "address"), "card": ("card", "paid with", "visa"), "phone": ("call", "tel", "phone", "mobile")}
OTHER = ("order", "id", "number", "invoice", "version", "on")


def examples(rows: list[tuple[str, list[Span]]], seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Short texts with their true spans, made of the sample's base spans and of what the base leaves."""
    rng = random.Random(seed)
    by: dict[str, list[str]] = {k: [] for k in KINDS}
    out: list[tuple[str, list[Span]]] = []
    for text, spans in rows:
        clear = [s for s in spans if not any(o is not s and o[0] < s[1] and s[0] < o[1] for o in spans)]
        for s, e, kind in clear:
            by[kind].append(text[s:e])
            a, b = max(0, s - CONTEXT), min(len(text), e + CONTEXT)
            inside = [(x - a, y - a, k) for x, y, k in clear if a <= x and y <= b]
            if not any(x < b and a < y and not (a <= x and y <= b) for x, y, _ in spans):
                out.append((text[a:b], inside))
        for a, b in windows(text, spans)[:SAMPLE_WINDOWS]:  # rejected digits
            if b - a < WINDOW_CHARS:
                out.append((text[a:b], []))
    for kind, some in by.items():
        by[kind] = some[:SAMPLE_VALUES] or {"email": ["a.b@mail.example.com"], "ip": ["10.0.0.1"], "card": ["4111111111111111"], "phone": ["+1 (202) 555-0100"]}[kind]

    def joined(parts: list[tuple[str, str | None]], leads: tuple[str, ...] = PLAIN) -> None:
        text, spans = rng.choice(leads) + " ", []
        for s, kind in parts:
            if kind:
                spans.append((len(text), len(text) + len(s), kind))
            text += s
        out.append((text + " on", spans))

    pick = lambda k: rng.choice(by[k])
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    for _ in range(150):
        card, phone, ip, mail = (pick(k) for k in ("card", "phone", "ip", "email"))
        joined([(card, "card"), (" ", None), (pick("card"), "card")])
        joined([(phone, "phone"), (" ", None), (card, "card")])
        joined([(card, "card"), (" ", None), (phone, "phone")])
        joined([(phone, "phone"), (" ", None), (str(rng.randint(10, 99999)), None)])
        joined([(ip, "ip"), (rng.choice([" ", ", ", ":"]), None), (str(rng.randint(1, 65535)), None)])
        local, _, domain = mail.partition("@")
        local = re.sub("^[._%+-]+", "", local) or "info"
        for at, dot in ((" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), (" at ", " dot "), ("@", rng.choice(["[.]", " dot "]))):
            joined([(local + at + domain.replace(".", dot), "email")], PLAIN + LEADS["email"])
        joined([("jo_ann-" + local + " (at) " + domain.replace(".", " (dot) "), "email")])  # joints of all kinds inside
        joined([(local + " at " + domain, None)])  # as in: see us at example.com
        joined([(ip.replace(".", rng.choice(["[.]", "(.)", " dot ", "[dot]"])), "ip")], PLAIN + LEADS["ip"])
        if (bare := _digits(card)) == card and len(bare) == 16:
            joined([(rng.choice([" ", "-", "."]).join(bare[k : k + 4] for k in range(0, 16, 4)), "card")], PLAIN + LEADS["card"])
        plain = re.sub(r"^\+[0-9]{1,3}[ .-]?", "", phone)
        if 9 <= len(_digits(plain)) <= 15 and re.search("[ .-]", plain):
            joined([(plain, "phone")])
            joined([(_digits(plain), "phone")], LEADS["phone"])
            joined([(rng.choice(["/", "."]).join(re.findall("[0-9]+", plain)), "phone")], LEADS["phone"])
        joined([(f"+{digits(2)} {digits(rng.randint(2, 4))}/{digits(rng.randint(5, 8))}", "phone")], PLAIN + LEADS["phone"])
        wrong = card[:-1] + str((int(card[-1]) + rng.randint(1, 9)) % 10)
        joined([(wrong, None)], PLAIN + LEADS["card"] + OTHER)
        joined([(digits(rng.randint(5, 15)), None)], PLAIN + OTHER)
        joined([(digits(rng.randint(5, 11)), None)], OTHER)
        joined([("-".join(digits(rng.randint(2, 5)) for _ in range(rng.randint(3, 4))), None)], OTHER)
        joined([(f"{rng.randint(256, 999)}.{rng.randint(0, 300)}.{rng.randint(0, 300)}.{rng.randint(256, 999)}", None)])
        joined([(".".join(str(rng.randint(0, 40)) for _ in range(5)), None)])
        mark = rng.choice("-/.")
        joined([(f"{rng.randint(1990, 2030)}{mark}{rng.randint(10, 12)}{mark}{rng.randint(10, 28)} {rng.randint(10, 23)}:{rng.randint(10, 59)}", None)], PLAIN + OTHER)
        joined([("%040x" % rng.getrandbits(160), None)])
    return out


def fit_examples(data: list[tuple[str, list[Span]]], rounds: int = 25, rate: float = 0.5, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by AdaGrad. Examples whose true spans aren't candidates are left out and reported, in left_out too."""
    ready, left_out = [], []
    for text, spans in data:
        tokens = _tokens(text, 0, len(text))
        w = lattice(text, tokens)
        flat = {(tokens[c[0]][0], tokens[c[1]][1], c[2]): c for some in w.found for c in some}
        if all(s in flat for s in spans) and flat:
            ready.append((w, sorted(flat[s] for s in spans)))
        elif spans:
            left_out.append((text, spans))
    if left_out:
        _LOG.warning("%d of %d examples left out: a true span is not a candidate", len(left_out), len(data))
    held = Counter(f for w, _ in ready for f in {f for some in w.found for c in some for f in c[3]})
    rare = {f for f, n in held.items() if n < LEAST_EXAMPLES and ":word " in f}
    true: Counter[str] = Counter()
    for w, chosen in ready:
        for some in w.found:
            for c in some:
                c[3][:] = [f for f in c[3] if f not in rare]
        state, j = 0, 0
        for c in chosen:
            while j < c[0]:
                state, j = w.on(j, state), j + 1
            true.update(c[3])
            if state:
                true[f"{c[2]}:after {STATES[state]}"] += 1
            state, j = 1 + KINDS.index(c[2]), c[1] + 1
    model, square = Field(left_out=left_out), {}
    for _ in range(rounds):
        slope: dict[str, float] = dict(true)
        for w, _ in ready:
            for c, state, p in model.posteriors(w):
                if p > 1e-4:
                    for f in c[3]:
                        slope[f] = slope.get(f, 0.0) - p
                    if state:
                        after = f"{c[2]}:after {STATES[state]}"
                        slope[after] = slope.get(after, 0.0) - p
        for f, g in slope.items():
            g = g / len(ready) - ridge * model.weights.get(f, 0.0)
            square[f] = square.get(f, 0.0) + g * g
            model.weights[f] = model.weights.get(f, 0.0) + rate * 2 * g / (square[f] ** 0.5 + 1e-8)
    return model


def fit(df: DataFrame, text_col: str = "text") -> Field:
    """A field for df, fitted on at most SAMPLE of its documents."""
    some = df.select(F.coalesce(text_col, F.lit("")).alias("t")).where(F.col("t").rlike("[0-9@]") & (F.length("t") <= SAMPLE_CHARS)).withColumn("h", F.xxhash64("t"))
    # Hashes are chosen first, so that tasks send numbers, not texts, to be ranked; copies of a text count once.
    first = some.select(F.col("h").alias("chosen")).distinct().orderBy("chosen").limit(SAMPLE)
    rows = some.join(F.broadcast(first), F.col("h") == F.col("chosen")).groupBy("h").agg(F.min("t").alias("t")).orderBy("h").collect()
    return fit_examples(examples([(r.t, base_spans(r.t)) for r in rows]))


def find(df: DataFrame, model: Field, text_col: str = "text") -> DataFrame:
    """df with base and spans, each [(start, end, kind)] in code points."""
    new = base.output_names(df, "base", "spans")
    at = df.columns.index(text_col)
    kind = "array<struct<start:int,end:int,kind:string>>"
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    shape = lambda spans: [{"start": s, "end": e, "kind": k} for s, e, k in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in base.sliced(batches):
            texts = [t.as_py() or "" for t in b.column(at)]
            fixed = [base_spans(t) for t in texts]
            every = [all_spans(t, s, model) for t, s in zip(texts, fixed)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(shape, fixed), arrow), pa.array(map(shape, every), arrow)], names=[*b.schema.names, *new])

    return df.mapInArrow(run, f"{df._jdf.schema().toDDL()}, `{new[0]}` {kind}, `{new[1]}` {kind}")


def redact(df: DataFrame, model: Field, text_col: str = "text") -> DataFrame:
    """df with [KIND] in place of each span; of overlapping spans the one that starts first names the whole."""
    at = df.columns.index(text_col)

    def masked(text: str | None) -> str | None:
        if not text:
            return text
        out, end, parts = [], 0, []
        for s, e, k in all_spans(text, base_spans(text), model):
            if parts and s < parts[-1][1]:
                parts[-1][1] = max(e, parts[-1][1])
            else:
                parts.append([s, e, k])
        for s, e, k in parts:
            out += [text[end:s], f"[{k.upper()}]"]
            end = e
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in base.sliced(batches):
            yield b.set_column(at, b.schema.field(at), pa.array([masked(t.as_py()) for t in b.column(at)], b.column(at).type))

    return df.mapInArrow(run, df.schema)


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op6_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, fit(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


QUERIES = {"op6_pii_crf": op6_pii_crf}
ORACLE: dict[str, str] = {}
