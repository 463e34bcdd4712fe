"""Settings, configuration, and the audit log on disk."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from veilspark.operators import audit
from veilspark.sources import settings, tables
from veilspark.streaming import metrics


def test_settings_are_saved_together_and_others_stay(spark, tmp_path):
    path = f"file://{tmp_path}/settings"
    assert settings.value(settings.load(spark, path), "hosts", list) == ([], False)
    settings.save(spark, path, {"hosts": ["a.org"], "rules": "PE"}, 1)
    settings.save(spark, path, {"rules": "H"}, 2)
    now = settings.load(spark, path)
    assert settings.value(now, "hosts", list) == (["a.org"], True) and settings.value(now, "rules", str) == ("H", True)
    settings.save(spark, path, {"rules": None}, 3)
    with pytest.raises(ValueError, match="expected str"):
        settings.value(settings.load(spark, path), "rules", str)


def test_configuration():
    c = settings.Config.of({"REDACT_MAX_BODY_BYTES": "10", "REDACT_LOG_RETENTION_DAYS": "0", "REDACT_ALLOWED_HOSTS": " A.org., ,b.org,a.org"})
    assert (c.max_body_bytes, c.retention_days, c.allowed_hosts, c.cache_ttl_s) == (10, 0, ("a.org", "b.org"), 1800)
    for name, bad in (("REDACT_MAX_REDACTIONS", "0"), ("REDACT_SESSION_CACHE_MAX_BYTES", "1000"), ("REDACT_LOG_RETENTION_DAYS", "-1"), ("REDACT_MAX_BODY_BYTES", "x")):
        with pytest.raises(ValueError, match=name):
            settings.Config.of({name: bad})


def audit_rows(spark, n, **more):
    base = spark.range(n).select("id", F.lit(dt.datetime(2024, 1, 1)).alias("ts"), F.format_string("h%d.example.com", F.col("id") % 2).alias("upstream_host"), F.lit(200).alias("status"), F.lit("").alias("error_class"), F.lit("PE").alias("flags"), F.lit("/v1/x_100%").alias("upstream_path"), F.lit("generic").alias("protocol"))
    return base.select("*", *[F.lit(v).alias(k) for k, v in more.items()])


def test_log_of_any_age(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    tables.append_audit(audit_rows(spark, 3), path)
    tables.append_audit(audit_rows(spark, 2, restore_status="restored", rule_hits_json='{"EMAIL": 2}', redaction_fields_json="broken"), path)
    log = tables.scan_audit(spark, path)
    assert {(r.restore_status, r.n) for r in log.groupBy("restore_status").agg(F.count("*").alias("n")).collect()} == {("unavailable", 3), ("restored", 2)}
    assert log.where("restore_status = 'restored'").first().rule_hits == {"EMAIL": 2} and log.where("size(redaction_fields) > 0").count() == 0


@pytest.mark.parametrize(
    ("query", "total", "at", "limit", "rows", "first"),
    [
        (audit.Page(), 205, 1, 100, 100, 204), (audit.Page(limit=50, page=5), 205, 5, 50, 5, 4), (audit.Page(limit=50, page=99), 205, 5, 50, 5, 4), (audit.Page(limit=0, page=-1), 205, 1, 100, 100, 204),
        (audit.Page(limit=501), 205, 1, 100, 100, 204), (audit.Page(limit=500), 205, 1, 500, 205, 204), (audit.Page(host=" h1.example.com "), 102, 1, 100, 100, 203), (audit.Page(host="h1.example"), 0, 1, 100, 0, None),
        (audit.Page(search=" X_100% "), 205, 1, 100, 100, 204), (audit.Page(search="x_200%"), 0, 1, 100, 0, None), (audit.Page(search="' OR 1=1 --"), 0, 1, 100, 0, None), (audit.Page(search="h0.example.com /v1"), 103, 1, 100, 100, 204),
    ],
)
def test_pages(spark, query, total, at, limit, rows, first):
    got, n, page, size = audit.page(audit_rows(spark, 205), query)
    some = got.collect()
    assert (n, page, size, len(some), some[0].id if some else None) == (total, at, limit, rows, first)
    assert audit.page_bounds(205, 5, 50) == (201, 205, 5) and audit.page_bounds(0, 1, 50) == (0, 0, 1)


def test_total_is_counted_once(spark):
    """Also where the optimizer knows that there are as many rows as wanted, or fewer: of a log, a limited log, an empty one and an aggregated one."""
    log = audit_rows(spark, 90).repartition(3)
    for df, total in ((log, 90), (log.limit(50), 50), (log.limit(7), 7), (log.limit(0), 0), (log.groupBy().agg(F.max("id").alias("id"), *[F.first(c).alias(c) for c in log.columns[1:]]), 1)):
        for q in (audit.Page(limit=50), audit.Page(limit=51), audit.Page(limit=7, page=9), audit.Page(limit=500)):
            got, n, at, size = audit.page(df, q)
            assert n == total and got.columns == log.columns and got.count() == max(0, min(total - (at - 1) * size, size))


def test_streamed_statistics(spark, tmp_path):
    folder = str(tmp_path / "in")
    audit_rows(spark, 10).write.parquet(folder)
    gauge = metrics.Gauge()
    spark.streams.addListener(gauge)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    q = metrics.hourly(stream).writeStream.outputMode("complete").format("memory").queryName("hourly").trigger(availableNow=True).start()
    q.awaitTermination(60)
    spark.streams.removeListener(gauge)
    assert {(r.upstream_host, r.requests) for r in spark.table("hourly").collect()} == {("h0.example.com", 5), ("h1.example.com", 5)}
    assert gauge.status()["uptime_s"] > 0
