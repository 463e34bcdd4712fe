"""Names of the engine's queries, with the DataFrame that answers each and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from veilspark.plans import detection, documents, relational

FLAGSHIP = "merged_spans"


def _build() -> tuple[dict, dict]:
    queries, oracle = {}, {}
    for part in (detection, relational, documents):
        q, o = part.build()
        queries |= q
        oracle |= o
    return queries, oracle


def queries() -> dict[str, Callable]:
    return _build()[0]


def oracle_sql() -> dict[str, str]:
    return _build()[1]
