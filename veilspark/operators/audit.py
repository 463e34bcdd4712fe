"""The audit log: page, search, statistics, retention, settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

#: Rows that page() holds at most.
DEEPEST = 20_000
SEARCHED = ("upstream_host", "upstream_path", "protocol", "flags", "status")


@dataclass(frozen=True)
class Page:
    """A query of the log as callers give it; clamped() as it runs."""

    limit: int = 100
    page: int = 1
    host: str = ""
    search: str = ""

    def clamped(self) -> Page:
        return Page(self.limit if 1 <= self.limit <= 500 else 100, max(1, self.page), self.host.strip(), self.search.strip().lower())


def clamp_hours(hours: int) -> int:
    return hours if 1 <= hours <= 2160 else 24


def searched(df: DataFrame, q: Page) -> DataFrame:
    """Rows of the host, exactly, that hold the needle literally; % and _ mean themselves."""
    q = q.clamped()
    if q.host:
        df = df.where(F.col("upstream_host") == q.host)
    if q.search:
        hay = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in SEARCHED]))
        df = df.where(F.instr(hay, F.lit(q.search)) > 0)
    return df


def _newest(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("ts"), F.desc("id"))


def page(df: DataFrame, q: Page) -> tuple[DataFrame, int, int, int]:
    """(rows newest first, total, page, limit); a page past the end is the last one.

    The total is observed while the same scan keeps its newest rows, so both are of one state of the log. The last page is among the newest page * limit rows,
    if it is the one to show, so no second look is needed. Pages deeper than DEEPEST rows count first; page_after() has no depth.
    """
    c = q.clamped()
    rows, wanted = searched(df, q), c.page * c.limit
    if wanted > DEEPEST:
        total = rows.count()
        at = min(c.page, 1 + max(0, total - 1) // c.limit)
        return _newest(rows).offset((at - 1) * c.limit).limit(c.limit), total, at, c.limit
    # Of rows known to be no more than wanted (a range, a limited log) the optimizer would drop the limit, and the sort of all of them reads the scan twice, once to
    # find its ranges: the total would be doubled. It doesn't know how many rows a generator makes, so the limit stays and each scan is read once.
    told, once = Observation(), rows.select("*", F.explode(F.array(F.lit(1))).alias("_once"))
    top = _newest(once.observe(told, F.count(F.lit(1)).alias("total"))).limit(wanted).select(*once.columns[:-1]).toArrow()
    total = told.get["total"]
    at = min(c.page, 1 + max(0, total - 1) // c.limit)
    return df.sparkSession.createDataFrame(top.slice((at - 1) * c.limit, c.limit), rows.schema), total, at, c.limit


def page_after(df: DataFrame, q: Page, ts: Column, id_: Column) -> DataFrame:
    """The page behind the row (ts, id): one scan and a top-k of one page, however deep it lies."""
    c = q.clamped()
    return _newest(searched(df, q).where((F.col("ts") < ts) | (F.col("ts") == ts) & (F.col("id") < id_))).limit(c.limit)


def page_bounds(total: int, at: int, limit: int) -> tuple[int, int, int]:
    """First and last row number shown, and the number of pages."""
    return (0 if not total else (at - 1) * limit + 1), min(total, at * limit), 1 + max(0, total - 1) // limit


def failed() -> Column:
    return (F.col("status") >= 400) | (F.col("error_class") != "")


def within(df: DataFrame, hours: int, now: Column) -> DataFrame:
    return df.where(F.col("ts") >= now - F.make_interval(hours=F.lit(clamp_hours(hours))))


def overview(df: DataFrame) -> DataFrame:
    """One row: requests, redactions, restores, errors, average_ms; zeros on an empty log."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return df.agg(
        F.count(F.lit(1)).alias("requests"), zero(F.sum("redaction_count")).alias("redactions"), zero(F.sum("restore_count")).alias("restores"),
        F.count_if(failed()).alias("errors"), F.round(F.coalesce(F.avg("duration_ms"), F.lit(0.0)), 6).alias("average_ms"),
    )


def by_host(df: DataFrame) -> DataFrame:
    return df.groupBy("upstream_host").agg(F.count(F.lit(1)).alias("requests"), F.count_if(failed()).alias("errors"), F.round(F.avg("duration_ms"), 6).alias("average_ms"))


def top_hosts(df: DataFrame, n: int = 10) -> DataFrame:
    """A report: the n hosts with the most requests, by name where equal."""
    return by_host(df).orderBy(F.desc("requests"), "upstream_host").limit(n)


def retained(df: DataFrame, days: int, now: Column) -> DataFrame:
    """Rows no older than days; 0 keeps all."""
    return df if days <= 0 else df.where(F.col("ts") >= now - F.make_interval(days=F.lit(days)))


def upserted(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Settings (key, value_json, updated_at) with the latest value of each key; keys that changes leaves out stay."""
    newest = Window.partitionBy("key").orderBy(F.desc("updated_at"), F.desc("rank"), F.desc("value_json"))
    both = current.withColumn("rank", F.lit(0)).unionByName(changes.withColumn("rank", F.lit(1)))
    return both.withColumn("nth", F.row_number().over(newest)).where("nth = 1").select("key", "value_json", "updated_at")


def hit_counts(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, label, hits."""
    return found.groupBy(id_col, "label").agg(F.count(F.lit(1)).alias("hits"))


def metrics(df: DataFrame) -> DataFrame:
    """Hourly request and error counts, for a watermarked stream as for a table. An extension: the log itself has no event-time windows."""
    at = F.window("ts", "1 hour")
    return df.groupBy(at.start.alias("hour"), "upstream_host").agg(F.count(F.lit(1)).alias("requests"), F.count_if(failed()).alias("errors"))
