"""Pages of the audit log and their total, of one scan; walking without depth."""

import datetime as dt

from pyspark.sql import functions as F

from veilspark.operators import audit


def log(spark, n=205):
    at = dt.datetime(2024, 1, 1, 12, 0, 0, 123456)
    rows = [(k, at, f"h{k % 2}.org", "/v1/x" if k != 1 else "/v1/100%_a", "generic", "PE", 200) for k in range(1, n + 1)]
    return spark.createDataFrame(rows, "id long, ts timestamp, upstream_host string, upstream_path string, protocol string, flags string, status int").repartition(5)


def shown(result):
    rows, total, at, limit = result
    return [r.id for r in rows.orderBy(F.desc("ts"), F.desc("id")).collect()], total, at, limit


def test_pages_and_totals(spark, monkeypatch):
    df, ids = log(spark), list(range(205, 0, -1))
    cases = [(audit.Page(), ids[:100], 205, 1, 100), (audit.Page(limit=50, page=3), ids[100:150], 205, 3, 50), (audit.Page(page=99), ids[200:], 205, 3, 100), (audit.Page(limit=999), ids[:100], 205, 1, 100), (audit.Page(search="100%_"), [1], 1, 1, 100), (audit.Page(search="nothing", page=4), [], 0, 1, 100), (audit.Page(host="h1.org", page=2), [k for k in ids if k % 2][100:], 103, 2, 100)]
    for deepest in (20_000, 10):  # one scan, and counted first
        monkeypatch.setattr(audit, "DEEPEST", deepest)
        for q, *want in cases:
            assert list(shown(audit.page(df, q))) == want
    assert audit.page(df, audit.Page(limit=2))[0].first().ts == dt.datetime(2024, 1, 1, 12, 0, 0, 123456)


def test_total_and_page_are_one_scan(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    df = log(spark)
    rows, total, *_ = audit.page(df.mapInPandas(seen, df.schema), audit.Page(limit=10, page=2))
    assert (rows.count(), total, read.value) == (10, 205, 205)


def test_walking_page_by_page(spark):
    df, got, last = log(spark), [], None
    while True:
        rows = (audit.page(df, audit.Page(limit=60))[0] if last is None else audit.page_after(df, audit.Page(limit=60), F.lit(last.ts), F.lit(last.id))).collect()
        if not rows:
            break
        got, last = got + [r.id for r in rows], rows[-1]
    assert got == list(range(205, 0, -1))
