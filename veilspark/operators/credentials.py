"""A pack of public credential formats: keywords by one automaton, then patterns, captured group, entropy floor, allowed shapes, stop words.

The keywords of all formats are one Aho-Corasick automaton, which reads a text once, however many formats there are, and names the formats whose
keyword occurs. Patterns then run in the JVM, on the texts that named them alone. All formats are one projection over one scan.

A span is the captured group, which ends a match. A format is a row: to add one, add a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions import validators as V
from veilspark.functions.arrays import let, quoted
from veilspark.operators import spans

LABEL, PRIORITY = "CREDENTIAL", 80


@dataclass(frozen=True)
class Format:
    """keywords, lower case; what may stand before the group; the group; what must follow it; least entropy in bits; shapes of groups that are no credentials."""

    name: str
    keywords: tuple[str, ...]
    group: str
    before: str = ""
    after: str = ""
    floor: float = 2.5
    allow: str = ""

    def pattern(self) -> str:
        """For the JVM: identifiers' ends are looked around for, not consumed."""
        end = f"(?={self.after})" if self.after else r"(?![A-Za-z0-9_])"
        return rf"(?<![A-Za-z0-9_]){self.before}({self.group}){end}"


# Formats that their issuers or scanners of secrets have published.
PACK = (
    Format("slack_token", ("xox",), r"xox[abprs]-[A-Za-z0-9]{10,48}(?:-[A-Za-z0-9]{2,48}){0,3}"),
    Format("slack_webhook", ("hooks.slack.com",), r"hooks\.slack\.com/services/T[A-Z0-9]{8,12}/B[A-Z0-9]{8,12}/[A-Za-z0-9]{24}"),
    Format("sendgrid", ("sg.",), r"SG\.[A-Za-z0-9_]{22}\.[A-Za-z0-9_]{43}"),
    Format("twilio", ("sk",), r"SK[0-9a-f]{32}"),
    Format("mailgun", ("key-",), r"key-[0-9a-f]{32}"),
    Format("mailchimp", ("-us",), r"[0-9a-f]{32}-us[0-9]{1,2}"),
    Format("pypi", ("pypi-",), r"pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_]{50,200}"),
    Format("docker", ("dckr_pat_",), r"dckr_pat_[A-Za-z0-9_]{27}"),
    Format("digitalocean", ("_v1_",), r"do[opr]_v1_[a-f0-9]{64}"),
    Format("shopify", ("shp",), r"shp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}"),
    Format("square", ("sq0",), r"sq0(?:atp|csp)-[A-Za-z0-9_]{22,43}"),
    Format("telegram", (":aa",), r"[0-9]{8,10}:AA[A-Za-z0-9_]{33}"),
    Format("vault", ("hvs.", "hvb.", "hvr."), r"hv[sbr]\.[A-Za-z0-9_]{24,200}"),
    Format("terraform", (".atlasv1.",), r"[A-Za-z0-9]{14}\.atlasv1\.[A-Za-z0-9_]{60,70}"),
    Format("databricks", ("dapi",), r"dapi[a-f0-9]{32}"),
    Format("linear", ("lin_api_",), r"lin_api_[A-Za-z0-9]{40}"),
    Format("notion", ("ntn_",), r"ntn_[A-Za-z0-9]{40,50}"),
    Format("postman", ("pmak-",), r"PMAK-[a-f0-9]{24}-[a-f0-9]{34}"),
    Format("grafana", ("glsa_",), r"glsa_[A-Za-z0-9]{32}_[a-fA-F0-9]{8}"),
    Format("new_relic", ("nrak-",), r"NRAK-[A-Z0-9]{27}"),
    Format("sentry", ("sntrys_",), r"sntrys_[A-Za-z0-9_]{60,200}"),
    Format("atlassian", ("atatt3",), r"ATATT3[A-Za-z0-9_]{60,200}"),
    Format("age", ("age-secret-key-1",), r"AGE-SECRET-KEY-1[A-Z0-9]{58}"),
    Format("doppler", ("dp.",), r"dp\.(?:pt|st|ct)\.[A-Za-z0-9]{40,44}"),
    Format("planetscale", ("pscale_",), r"pscale_(?:tkn|pw|oauth)_[A-Za-z0-9_]{32,64}"),
    Format("pulumi", ("pul-",), r"pul-[a-f0-9]{40}"),
    Format("rubygems", ("rubygems_",), r"rubygems_[a-f0-9]{48}"),
    Format("shippo", ("shippo_",), r"shippo_(?:live|test)_[a-f0-9]{40}"),
    Format("typeform", ("tfp_",), r"tfp_[A-Za-z0-9_]{40,59}"),
    Format("airtable", ("pat",), r"pat[A-Za-z0-9]{14}\.[a-f0-9]{64}"),
    Format("facebook", ("eaacedeose0cba",), r"EAACEdEose0cBA[A-Za-z0-9]{20,200}"),
    Format("google_oauth", ("ya29.",), r"ya29\.[A-Za-z0-9_]{30,200}"),
    Format("heroku", ("heroku",), r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", r"[Hh]eroku[A-Za-z0-9_.-]{0,20} {0,2}[=:] {0,2}[\"']?"),
    Format("named_value", ("key", "token", "secret"), r"[A-Za-z0-9_.=+/-]{10,120}", r"(?:api|auth|access|secret|client)[a-z0-9_.-]{0,20}(?:key|token|secret)[\"' ]{0,2}[=:]{1,2} {0,2}[\"']", "[\"']", 3.5, r"^[A-Za-z_.-]+$"),
)
#: Groups that are none, as a whole, in any case.
STOP_WORDS = ("changeme", "password", "your_api_key", "your-api-key", "example_key", "example_token", "test_token", "dummy_secret", "xxxxxxxxxx", "0123456789abcdef", "abcdefghijklmnop")


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    by: dict[str, list[int]] = {}
    for n, f in enumerate(PACK):
        for k in f.keywords:
            by.setdefault(k, []).append(n)
    for k, formats in by.items():
        found.add_word(k, formats)
    found.make_automaton()
    return found


def named_formats(texts: pd.Series) -> pd.Series:
    """Numbers of the formats whose keyword occurs in the text, in any case."""
    automaton = _automaton()
    return texts.map(lambda t: sorted({n for _, some in automaton.iter(t.lower()) for n in some}) if t else [])


def _found_sql(t: str, n: int, f: Format) -> str:
    group = f"regexp_extract(v_, {quoted(f.pattern().replace('(?=' + f.after + ')', '') if f.after else f.pattern())}, 1)"
    tests = [f"{V.char_entropy_sql('gr_')} >= {f.floor!r}D", f"lower(gr_) NOT IN ({', '.join(map(quoted, STOP_WORDS))})"] + ([f"NOT rlike(gr_, {quoted(f.allow)})"] if f.allow else [])
    some = spans.matches_sql(t, f.pattern(), lambda v: let(group.replace("v_", v), "gr_", " AND ".join(tests)))
    own = group.replace("v_", "x_.value")
    shown = f"transform({some}, x_ -> {let(own, 'gr_', f'''named_struct('format', {n}, 'start', x_.end - length(gr_), 'end', x_.end, 'value', gr_)''')})"
    return f"CASE WHEN array_contains(n_, {n}) THEN {shown} ELSE cast(array() AS array<struct<format:int,start:int,end:int,value:string>>) END"


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, end, value, label, priority, format of all spans of the pack, in one scan of the text."""
    named = df.select(id_col, F.col(text_col).alias("_text"), F.pandas_udf(named_formats, "array<int>")(F.col(text_col)).alias("named_")).where(F.size("named_") > 0)
    # In a lambda: as code of one method the patterns would be too long to be compiled.
    every = let("_text", "t_", let("named_", "n_", "concat(" + ", ".join(_found_sql("t_", n, f) for n, f in enumerate(PACK)) + ")"))
    names = F.array(*[F.lit(f.name) for f in PACK])
    each = named.select(id_col, F.explode(F.expr(every)).alias("s")).select(id_col, "s.*")
    return each.select(id_col, "start", "end", "value", F.lit(LABEL).alias("label"), F.lit(PRIORITY).alias("priority"), F.get(names, F.col("format")).alias("format"))
