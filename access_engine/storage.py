"""Shared storage of intermediate tables: the folder the cluster names, nothing machine-local."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or where it is unset one in the warehouse, which sessions share too.

    A warehouse on the driver's own file system is out of reach of a cluster's executors and refused there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stored"
    if not spark.sparkContext.master.startswith("local") and qualified(spark, folder).startswith("file:"):
        raise RuntimeError(f"spark.checkpoint.dir is unset and executors may not reach {folder}")
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/access_engine/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The rows are computed once, survive the loss of executors, and come back with file sizes
    the optimizer can use to choose joins.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    written = _written.get()
    if written is not None:
        written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def gathered(spark: SparkSession, parts: Iterable[DataFrame], schema: str, label: str) -> DataFrame:
    """The rows of all ``parts`` as one written table; a part is written before the next one is asked for.

    For work in many passes: no plan holds more than one of them.
    """
    path = new_path(spark, label)
    written = _written.get()
    if written is not None:
        written.append(path)
    spark.createDataFrame([], schema).write.parquet(path)
    for part in parts:
        part.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    return store(df, label)[0]


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system, as Spark names the files it reads below it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(target).toString()


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table written by :func:`store` once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables stored inside the block at its end, also after a failure.

    Nothing lazy may leave the block: what is to stay is written elsewhere inside it.
    """
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(token)
        for path in paths:
            drop(spark, path)


def settled(spark: SparkSession, label: str, rows: Callable[[], DataFrame]) -> DataFrame:
    """The rows that ``rows`` describes as a written table, without the tables stored on the way to them."""
    path = new_path(spark, label)
    with scratch(spark):
        df = rows()
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def leaves_nothing(run: Callable[..., None]) -> Callable[..., None]:
    """A run whose stored tables go when it ends; its first argument is the session."""

    @wraps(run)
    def inside(spark: SparkSession, *args, **kwargs) -> None:
        with scratch(spark):
            run(spark, *args, **kwargs)

    return inside
