"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_dir

#: White space of the word pattern [^\x20\x09-\x0D]+.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_written: dict[str, SparkSession] = {}


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER)


def named(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """For each of the names one like it that no column of docs has, in any case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        own = f"__{name}"
        while own.lower() in taken:
            own += "_"
        taken.add(own.lower())
        out.append(own)
    return out


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def drop_dir(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _written.pop(path, None)


@atexit.register
def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            drop_dir(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone
            return


#: Arrow batches of whole texts while a table is written: rows and bytes at most.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Smaller Arrow batches for the actions within; the session's own settings are restored."""
    before = {k: spark.conf.get(k) for k in BATCHES}
    for k, v in BATCHES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut lineage: write a table in the shared folder and read it again."""
    path = work_dir(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._tessera_dir = path
    return table


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Drop tables that materialise() wrote and that nothing reads any more.

    The driver's collector is called too: Spark removes a finished shuffle's files only when the
    plan that made them has been collected.
    """
    for table in tables:
        drop_dir(spark, table._tessera_dir)
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def scratch(spark: SparkSession, but: str) -> Iterator[None]:
    """Drop, at the end, all folders that work_dir() gave within the block."""
    known = {*_written, but}
    yield
    for path in set(_written) - known:
        drop_dir(spark, path)
