"""Working tables: written once, read as often as needed, deleted when released, at the driver's exit at the latest."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_KEPT: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where that is unset and the master is one machine, as in tests."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="veilspark-work-")
    return _LOCAL[context.applicationId]


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: its plan runs once, and lost executors cost nothing. release() deletes it. No caller
    writes values that are to be masked."""
    path = f"{folder(df.sparkSession)}/veilspark-work/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    _KEPT.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def held() -> int:
    """How many folders are kept now."""
    return len(_KEPT)


def release(since: int = 0) -> None:
    """Deletes the folders kept since then; results that still read them can't be used afterwards."""
    gone, _KEPT[since:] = _KEPT[since:], []
    for spark, path in gone:
        jvm = spark.sparkContext._jvm
        if jvm is not None:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # noqa: BLE001  the session may be gone already
        _KEPT.clear()
