"""Shared helpers of the training-data operators: shared-folder tables, let-bindings, ASCII text rules."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters that every contract of this package names.
SPACE = "[\\x20\\x09-\\x0D]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEPT: list[tuple[SparkSession, str]] = []
_LOCAL: dict[str, str] = {}
#: Rows that are broadcast at most where nothing else bounds a table.
MOST_BROADCAST = 200_000
#: Rows of an Arrow batch that a Python worker goes through at once.
SLICE = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a master on one machine (tests) gets a
    temporary folder for the life of the driver; on a cluster no folder is known to be shared, and that is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = _LOCAL.get(spark.sparkContext.applicationId)
        if known is None:
            known = _LOCAL[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="veilspark-")
    return known.rstrip("/")


def keep_until_exit(spark: SparkSession, path: str) -> None:
    """release() deletes the folder, at exit at the latest."""
    _KEPT.append((spark, path))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilspark/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    keep_until_exit(spark, path)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def held() -> int:
    """How many folders are kept now: release(held()), called later with the number of now, deletes those that came after."""
    return len(_KEPT)


def release(since: int = 0, but: int = 0) -> None:
    """Delete the folders kept since then, but for the last ones; results that still depend on them can't be read afterwards."""
    end = len(_KEPT) - but
    gone, _KEPT[since:end] = _KEPT[since:end], []
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


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column], F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. lower() does the same where no other cased character can occur and is much faster."""
    plain = (F.length(text) == F.octet_length(text)) | ~text.rlike("[À-ÞĀ-\U0010ffff]")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many at most, so that a worker holds what it makes of a few rows, not of 10,000."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that can't clash with df's own."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while f"_{name}" in taken:
            name += "_"
        out.append(f"_{name}")
        taken.add(f"_{name}")
    return out


def output_names(df: DataFrame, *names: str) -> list[str]:
    """Names for new columns of df; those that df has already, in any case, get underscores in front."""
    return [n if n.lower() not in {c.lower() for c in df.columns} else fresh(df, n)[0] for n in names]


def if_small(df: DataFrame) -> DataFrame:
    """df, which is written down, with the hint to broadcast it if it has few rows; else joins with it are exchanged as usual."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """left join right, which has a row a key. Keys that hold more than a task's share of the rows of left are salted.

    There are fewer such keys than partitions, as each holds more than a share, so the list of them is broadcast. A salted key's
    row of right is repeated for each salt, twice the number of partitions in all at most. by: columns of left to deal its rows by.
    """
    n = partitions(left.sparkSession)
    total = left.count()
    hot = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") * n > max(total, n * n))
    hot = materialize(hot.select(*keys, F.ceil(F.col("_rows") * n / max(1, total)).cast("int").alias("_salts")), "hot-keys")
    if hot.isEmpty():
        return left.join(right, keys, how)
    salts = F.coalesce("_salts", F.lit(1))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), salts).cast("int")).drop("_salts")
    again = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(again, [*keys, "_salt"], how).drop("_salt")
