"""Settings as a small key-value table, and limits from the environment or the session's configuration.

A settings folder holds versions; a save writes the whole next version and only then points to it, so readers see all of a save or
nothing, and a save that fails leaves the version before. Running work keeps the snapshot it was started with.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import audit

SCHEMA = "key string, value_json string, updated_at long"


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    found = [s.getPath() for s in fs.listStatus(top)]
    done = [p for p in found if p.getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()[1:]) for p in done)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version; empty if there is none."""
    known = _versions(spark, path)
    return spark.read.schema(SCHEMA).parquet(f"{path}/v{known[-1]:09d}") if known else spark.createDataFrame([], SCHEMA)


def save(spark: SparkSession, path: str, values: Mapping[str, object], at: int) -> None:
    """Writes the given keys, all together; others stay."""
    changes = spark.createDataFrame([(k, json.dumps(v), at) for k, v in values.items()], SCHEMA)
    known = _versions(spark, path)
    audit.upserted(load(spark, path), changes).coalesce(1).write.parquet(f"{path}/v{(known[-1] if known else 0) + 1:09d}")


def value(settings: DataFrame, key: str, kind: type) -> tuple[object, bool]:
    """(value, found). A value that isn't of the kind is an error, not a default."""
    row = settings.where(F.col("key") == key).select("value_json").first()
    if row is None:
        return kind(), False
    found = json.loads(row[0])
    if kind is list and found is None:
        found = []
    if not isinstance(found, kind):
        raise ValueError(f"setting {key}: expected {kind.__name__}")
    return found, True


def positive(name: str, default: int, env: Mapping[str, str] = os.environ, least: int = 1) -> int:
    raw = env.get(name, "").strip()
    try:
        number = int(raw) if raw else default
    except ValueError:
        number = least - 1
    if number < least:
        raise ValueError(f"{name} must be an integer of at least {least}")
    return number


@dataclass(frozen=True)
class Config:
    """Limits of the engine. Names and defaults of the variables are fixed values."""

    max_body_bytes: int = 16 << 20
    max_redactions: int = 16_384
    retention_days: int = 30
    cache_ttl_s: int = 1800
    cache_sessions: int = 128
    cache_mappings: int = 16_384
    cache_bytes: int = 16 << 20
    allowed_hosts: tuple[str, ...] = ()

    @classmethod
    def of(cls, env: Mapping[str, str] = os.environ) -> Config:
        hosts = [h.strip().lower().removesuffix(".") for h in env.get("REDACT_ALLOWED_HOSTS", "").split(",") if h.strip()]
        return cls(
            positive("REDACT_MAX_BODY_BYTES", cls.max_body_bytes, env), positive("REDACT_MAX_REDACTIONS", cls.max_redactions, env),
            positive("REDACT_LOG_RETENTION_DAYS", cls.retention_days, env, 0), positive("REDACT_SESSION_CACHE_TTL_SECONDS", cls.cache_ttl_s, env),
            positive("REDACT_SESSION_CACHE_MAX_SESSIONS", cls.cache_sessions, env), positive("REDACT_SESSION_CACHE_MAX_ENTRIES", cls.cache_mappings, env),
            positive("REDACT_SESSION_CACHE_MAX_BYTES", cls.cache_bytes, env, 1024), tuple(dict.fromkeys(hosts)),
        )
