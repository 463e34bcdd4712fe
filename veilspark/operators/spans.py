"""Text to spans: rules, and a generator that gives each match its exact place.

A single match whose value stands but once in the text is found by that value. Else a match's end is the length of the pieces, each a gap
with the match behind it, that regexp_extract_all() returns, summed up to it. All stays in the JVM; no text is shuffled and only documents that
pass a rule's cheap prefilter are scanned. Offsets count code points. Validation follows matching: a match that fails is dropped,
not tried again at another place or length, and a rule with a check also drops matches that touch a digit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import validators as V
from veilspark.functions.arrays import let, over, quoted, running_sum

FLAGS = "HPSIBEG"
#: Identity numbers with a later birth date are rejected; fixed so that results can be repeated.
AS_OF = "20250101"
_WB, _WE = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"


@dataclass(frozen=True)
class Rule:
    name: str
    flag: str
    label: str
    priority: int
    pattern: str
    prefilter: Callable[[str], str]
    check: Callable[[str], str] | None = None


@dataclass(frozen=True)
class Needs:
    """What a text must hold so that a rule can match: one of the words, in any case if low, or a shape. Called with a name, it is SQL over it."""

    words: tuple[str, ...] = ()
    low: bool = False
    shape: str | None = None

    def __call__(self, t: str) -> str:
        if self.shape is not None:
            return f"rlike({t}, {quoted(self.shape)})"
        return "(" + " OR ".join(f"contains({f'lower({t})' if self.low else t}, {quoted(w)})" for w in self.words) + ")"


def _has(*needles: str) -> Needs:
    return Needs(needles)


def _has_any_case(needle: str) -> Needs:
    return Needs((needle,), low=True)


def _shape(pattern: str) -> Needs:
    return Needs(shape=pattern)


# Patterns, labels and priorities are fixed values: they decide what is found.
RULES = (
    Rule("email", "E", "EMAIL", 90, rf"[A-Za-z0-9.!#$%&'*+/=?^_`{{|}}~-]+@{_LABEL}(?:\.{_LABEL})+", _has("@")),
    Rule("phone_cn", "P", "PHONE", 88, "1[3-9][0-9]{9}", _shape("1[3-9][0-9]{9}"), lambda v: "true"),
    Rule("phone_intl", "P", "PHONE", 87, r"\+(?:[0-9][ .()\-]{0,2}){7,}[0-9]", _has("+"), V.international_phone_sql),
    Rule("apikey", "S", "APIKEY", 110, rf"{_WB}sk-[A-Za-z0-9_-]{{20,}}(?<=[A-Za-z0-9_]){_WE}", _has("sk-")),
    Rule("idcard", "I", "IDCARD", 100, "[0-9]{17}[0-9Xx]", _shape("[0-9]{17}"), lambda v: V.identity_number_sql(v, AS_OF)),
    Rule("card_plain", "B", "CARD", 85, "[0-9]{13,19}", _shape("[0-9]{13}"), V.luhn_card_sql),
    Rule("card_grouped", "B", "CARD", 85, "[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?", _shape("[0-9]{4}[ -][0-9]{4}"), V.luhn_card_sql),
    Rule("privatekey", "G", "PRIVATEKEY", 130, "(?s)-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----.*?-----END (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----", _has("-----BEGIN ")),
    Rule("aws", "G", "AWSKEY", 120, rf"{_WB}(?:AKIA|ASIA)[A-Z0-9]{{16}}{_WE}", _has("AKIA", "ASIA")),
    Rule("github", "G", "GITHUB", 120, rf"{_WB}gh[pousr]_[A-Za-z0-9]{{20,255}}{_WE}", _has("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("gitlab", "G", "GITLAB", 120, rf"{_WB}glpat-[A-Za-z0-9_-]{{20,}}(?<=[A-Za-z0-9_]){_WE}", _has("glpat-")),
    Rule("jwt", "G", "JWT", 105, rf"{_WB}eyJ[A-Za-z0-9_-]{{5,}}\.[A-Za-z0-9_-]{{5,}}\.[A-Za-z0-9_-]{{5,}}(?<=[A-Za-z0-9_]){_WE}", _has("eyJ")),
    Rule("connstr", "G", "CONNSTR", 115, rf"(?i){_WB}(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|mssql)://[^ \t\n\f\r\"'<>]+", _has("://")),
    Rule("bearer", "G", "BEARER", 95, rf"(?i){_WB}Bearer[ \t]+[A-Za-z0-9._~+/=-]{{20,}}", _has_any_case("bearer")),
    # Our own small pack of public key formats and of assignments to a credential name.
    Rule("assignment", "G", "CREDENTIAL", 80, rf"(?i){_WB}(?:api[_-]?key|access[_-]?token|client[_-]?secret|token|secret|password|passwd)[ \t]*[:=][ \t]*[\"'][^\"'\n]{{8,200}}[\"']", _has("=")),
    Rule("stripe", "G", "CREDENTIAL", 80, rf"{_WB}(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{{16,99}}{_WE}", _has("k_live_", "k_test_")),
    Rule("google", "G", "CREDENTIAL", 80, rf"{_WB}AIza[A-Za-z0-9_-]{{35}}(?<=[A-Za-z0-9_]){_WE}", _has("AIza")),
    Rule("npm", "G", "CREDENTIAL", 80, rf"{_WB}npm_[A-Za-z0-9]{{36}}{_WE}", _has("npm_")),
    Rule("huggingface", "G", "CREDENTIAL", 80, rf"{_WB}hf_[A-Za-z0-9]{{30,}}{_WE}", _has("hf_")),
)
BY_NAME = {r.name: r for r in RULES}
#: Every match of these rules holds DIGITS.
DIGITS, IN_DIGITS = "[0-9]{4}[ -]?[0-9]{4}", {"phone_cn", "idcard", "card_plain", "card_grouped"}
TOKEN = Rule("entropy", "H", "ENTROPY", 10, "[A-Za-z0-9]{9,}", lambda t: f"length({t}) >= 9")

SPAN = "array<struct<start:int,end:int,value:string>>"
CANDIDATES = "array<struct<start:int,end:int,value:string,label:string,priority:int>>"


def matches_sql(t: str, pattern: str, keep: Callable[[str], str] | None = None, among: str | None = None, values: str | None = None) -> str:
    """[(start, end, value)] of all matches, or of those whose indexes among names, that keep() accepts. values: a column of all matches, if they are known.

    The pieces are measured once, between one accepted match and the next. Where one match is left and its value stands once in the text, no pieces are made.
    """
    none = f"cast(array() AS {SPAN})"
    index = among or "sequence(0, size(m_) - 1)"
    chosen = f"filter({index}, k_ -> coalesce({let('m_[k_]', 'v_', keep('v_'))}, false))" if keep else index
    before = "CASE WHEN i_ = 0 THEN -1 ELSE c_[i_ - 1] END"
    step = let(before, "l_", "length(array_join(slice(g_, l_ + 2, k_ - l_), ''))")
    span = "transform(c_, (k_, i_) -> named_struct('start', s_[i_] - length(m_[k_]), 'end', s_[i_], 'value', m_[k_]))"
    pieces = f"regexp_extract_all({t}, {quoted(f'(?s){_NEXT}.*?(?-s:{pattern})')}, 0)"
    placed = let(pieces, "g_", let(f"transform(c_, (k_, i_) -> {step})", "w_", let(running_sum("w_"), "s_", span)))
    only = f"array(named_struct('start', at_ - 1, 'end', at_ - 1 + length(v_), 'value', v_))"
    single = let("m_[c_[0]]", "v_", let(f"instr({t}, v_)", "at_", f"CASE WHEN at_ > 0 AND locate(v_, {t}, at_ + 1) = 0 THEN {only} ELSE {placed} END"))
    some = let(chosen, "c_", f"CASE WHEN size(c_) = 0 THEN {none} WHEN size(c_) = 1 THEN {single} ELSE {placed} END")
    body = f"CASE WHEN size(m_) = 0 THEN {none} ELSE {some} END"
    return let(values or f"regexp_extract_all({t}, {quoted(pattern)}, 0)", "m_", body)


#: Where the match before ended.
_NEXT = r"\G"


def matches(text: Column, pattern: str, keep: Callable[[str], str] | None = None) -> Column:
    return over(text, "t_", matches_sql("t_", pattern, keep))


def found_sql(rule: Rule, t: str, keep: Callable[[str], str] | None = None, among: str | None = None, values: str | None = None) -> str:
    """[(start, end, value, label, priority)] of a rule; empty where the prefilter rules it out. among: indexes of the matches that can count, values: all matches."""
    all_of = matches_sql(t, rule.pattern, keep or rule.check, among, values)
    if rule.check is not None:
        edge = lambda at: f"substr({t}, {at}, 1) BETWEEN '0' AND '9'"
        all_of = f"filter({all_of}, x_ -> NOT (x_.start > 0 AND {edge('x_.start')}) AND NOT coalesce({edge('x_.end + 1')}, false))"
    full = f"transform({all_of}, x_ -> named_struct('start', x_.start, 'end', x_.end, 'value', x_.value, 'label', {quoted(rule.label)}, 'priority', {rule.priority}))"
    return f"CASE WHEN {f'size({among}) > 0' if among else rule.prefilter(t)} THEN {full} ELSE cast(array() AS {CANDIDATES}) END"


def candidates_sql(t: str, flags: str = FLAGS, costs: list[int] | None = None, switch: str | None = None) -> str:
    """The bag union of all enabled rules' spans as one array. Rules that are off aren't in the plan. costs: the bigram model that H needs.
    switch: a name of a string of flags that switches them row by row, too. Over a table, scan.with_candidates() is faster."""
    none = f"cast(array() AS {CANDIDATES})"
    switched = lambda r, part: part if switch is None else f"CASE WHEN contains({switch}, '{r.flag}') THEN {part} ELSE {none} END"
    rules = [r for r in RULES if r.flag in flags]
    parts = [switched(r, found_sql(r, t)) for r in rules if r.name not in IN_DIGITS]
    # Texts without a long run of digits are told by one pattern, not by one of each rule.
    digits = [switched(r, found_sql(r, t)) for r in rules if r.name in IN_DIGITS]
    if digits:
        parts.append(f"CASE WHEN rlike({t}, '{DIGITS}') THEN flatten(array({', '.join(digits)})) ELSE {none} END")
    if "H" in flags and costs is not None:
        from veilspark.operators.entropy import is_random_sql

        parts.append(switched(TOKEN, found_sql(TOKEN, t, lambda v: is_random_sql(v, costs))))
    return f"CASE WHEN {t} IS NULL THEN {none} ELSE flatten(array({', '.join([*parts, none])})) END"


def candidate_spans(text: Column, flags: str = FLAGS, costs: list[int] | None = None) -> Column:
    return over(text, "t_", candidates_sql("t_", flags, costs))


def _exploded(df: DataFrame, every: str, id_col: str) -> DataFrame:
    return df.select(id_col, F.explode(F.expr(every)).alias("s")).select(id_col, "s.start", "s.end", "s.value", "s.label", "s.priority")


def spans(df: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text", keep: Callable[[str], str] | None = None, among: str | None = None, values: str | None = None) -> DataFrame:
    """id_col, start, end, value, label, priority of the rule's spans. Null text has none."""
    t = f"`{text_col}`"
    return _exploded(df.where(rule.prefilter(t)), found_sql(rule, t, keep, among, values), id_col)


def candidates(df: DataFrame, flags: str = FLAGS, id_col: str = "doc_id", text_col: str = "text", costs: list[int] | None = None) -> DataFrame:
    """candidate_spans() as rows, in one pass over the texts of a table."""
    from veilspark.operators import scan

    marked, found = scan.with_candidates(df.select(id_col, text_col), flags, text_col, costs)
    return _exploded(marked, found, id_col)
