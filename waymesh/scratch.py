"""Tables that a query writes on its way: in the folder in spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders that were handed out and not removed yet.
_open: list[str] = []
#: Whether shuffle files go when the job that made them ends. Else they stay until the driver collects its garbage, with those of all jobs of a query.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one, if driver and executors are one process."""
    if not (where := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="waymesh-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    _open.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _open[-1]


@contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, before)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The same rows, read back from a table in the shared folder: lineage is cut and nothing is computed twice. What was shuffled for it is freed."""
    path = path or fresh_dir(df.sparkSession, name)
    with _freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a written table that no later plan reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _open:
        _open.remove(path)


def clean(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables that were written after the first `since` of those that are left: for when the results that read them are written or collected."""
    for path in _open[since:]:
        removed(spark, path)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What is written inside is deleted at the end, whatever happens; results are to be written or collected by then, under paths that were taken before."""
    since = len(_open)
    try:
        yield
    finally:
        clean(spark, since)


def alone(spark: SparkSession, name: str, rows: Callable[[], DataFrame]) -> DataFrame:
    """The rows of a step, written; what the step wrote on its way is deleted, and what it shuffled freed, before the next one."""
    path = fresh_dir(spark, name)
    with cleaned(spark):
        return written(rows(), name, path)
