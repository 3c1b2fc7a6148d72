"""What a run's results were made from, so that running it again computes only what changed.

A manifest is a table with a row per input file: its path below the input, length and time of change, and the dataset
(raster, facility type) whose results it goes into. A file without a dataset goes into all of them. A manifest names
only datasets whose results stand: before results are replaced, a version without their datasets is written, and the
full one after the last of them. A run that is broken off is therefore made good by the next update.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from access_engine.storage import drop, qualified

ROWS = "role string, path string, length long, modified timestamp, dataset array<string>"
_KIND = "run"


def _decoded(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))  # a plus sign in a path is no space


def below(spark: SparkSession, root: str, path: Column, encoded: bool = False) -> Column:
    """``path`` relative to ``root``, empty for ``root`` itself; Spark's metadata column has it ``encoded``."""
    full = F.regexp_replace(_decoded(path) if encoded else path, "^([a-z0-9]+):/+", "$1:/")
    base = re.sub("^([a-z0-9]+):/+", r"\1:/", qualified(spark, root).rstrip("/"))
    return F.regexp_replace(F.substring(full, len(base) + 1, 1 << 30), "^/", "")


def plain_path(path: str) -> str:
    """A path that names one file, for a reader that takes patterns."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def partition_values(path: Column, keys: Sequence[str]) -> Column:
    """The values of the partition folders ``keys`` in ``path`` as an array; NULL where one is missing."""
    texts = [F.regexp_extract(path, f"(?:^|/){key}=([^/]+)/", 1) for key in keys]

    def value(text: Column) -> Column:
        return F.when(text != "__HIVE_DEFAULT_PARTITION__", _decoded(text))

    every = reduce(Column.__and__, [text != "" for text in texts], F.lit(bool(keys)))
    return F.when(every, F.array(*map(value, texts)))


def listing(spark: SparkSession, role: str, root: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of :data:`ROWS` for the files at or below ``root``; no file is opened.

    With ``keys`` a file's dataset is told by the partition folders it lies in.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inner = below(spark, root, F.col("path"))
    dataset = partition_values(inner, keys) if keys else F.lit(None)
    return files.select(
        F.lit(role).alias("role"),
        inner.alias("path"),
        "length",
        F.col("modificationTime").alias("modified"),
        dataset.cast("array<string>").alias("dataset"),
    )


def inputs(spark: SparkSession, kind: str, common: Mapping[str, str | None]) -> DataFrame:
    """Rows for the run's kind and the files that go into every dataset; an input that is None has none."""
    first = spark.createDataFrame([(_KIND, kind, 0, None, None)], ROWS)
    parts = [listing(spark, role, root) for role, root in common.items() if root]
    return reduce(DataFrame.unionByName, parts, first)


def _system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _system(spark, path)
    return system.exists(target)


def _versions(spark: SparkSession, out: str) -> list[str]:
    """Manifests below ``out`` that were written to their end, the latest last."""
    system, target = _system(spark, f"{out}/manifest/*/_SUCCESS")
    return sorted(f"{out}/manifest/{s.getPath().getParent().getName()}" for s in system.globStatus(target) or [])


def last(spark: SparkSession, out: str) -> DataFrame | None:
    versions = _versions(spark, out)
    return spark.read.schema(ROWS).parquet(versions[-1]) if versions else None


def commit(spark: SparkSession, out: str, rows: DataFrame) -> None:
    """Write ``rows`` as the latest manifest and remove those before it."""
    versions = _versions(spark, out)
    number = int(versions[-1].rsplit("/", 1)[1]) + 1 if versions else 0
    rows.write.mode("overwrite").parquet(f"{out}/manifest/{number:08d}")
    for version in versions:
        drop(spark, version)


def differences(before: DataFrame, now: DataFrame) -> DataFrame:
    """(role, dataset) of files that came, went, or have another length or time, each pair once."""
    entry = [F.col(c).alias(f"b_{c}") for c in before.columns]
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in now.columns])
    gone = before.select(*entry).join(now, same, "left_anti").select(F.col("b_role").alias("role"), F.col("b_dataset").alias("dataset"))
    came = now.join(before.select(*entry), same, "left_anti").select("role", "dataset")
    return gone.unionByName(came).distinct()


@dataclass
class Work:
    """What a run has to compute: all datasets (``datasets`` is None) or those named."""

    datasets: list[tuple[str | None, ...]] | None
    fresh: bool

    @property
    def nothing(self) -> bool:
        return self.datasets == []

    @property
    def mode(self) -> str:
        """Results are new, or join the standing ones once :func:`clear` has removed what they replace."""
        return "errorifexists" if self.fresh else "append"

    def table(self, spark: SparkSession, keys: Sequence[str]) -> DataFrame:
        return spark.createDataFrame(self.datasets, ", ".join(f"`{k}` string" for k in keys))


def work(spark: SparkSession, out: str, now: DataFrame, update: bool) -> Work:
    """Compare ``now`` with the latest manifest below ``out``.

    The number of datasets that changed is that of folders or facility types, so their names come to the driver. A run
    of another kind is refused, and so is a folder with results unless ``update`` is set. Without a manifest all is
    computed.
    """
    before = last(spark, out)
    if before is None:
        return Work(None, True)
    if not update:
        raise FileExistsError(f"{out} holds the results of a run")
    kinds = {r.path for frame in (before, now) for r in frame.where(F.col("role") == _KIND).select("path").collect()}
    if len(kinds) != 1:
        raise ValueError(f"{out} holds the results of another run: {sorted(kinds)}")
    changed = [r.dataset for r in differences(before, now).collect()]
    if any(dataset is None for dataset in changed):
        return Work(None, False)
    return Work(sorted({tuple(d) for d in changed}, key=str), False)


def begin(spark: SparkSession, out: str, now: DataFrame, todo: Work, keys: Sequence[str]) -> None:
    """Take the datasets that are about to be replaced off the manifest."""
    if todo.datasets is None:
        standing = now.where(F.col("role") == _KIND)
    else:
        standing = _without(last(spark, out), todo, keys)
    commit(spark, out, standing)


def _without(rows: DataFrame, todo: Work, keys: Sequence[str]) -> DataFrame:
    return rows.join(_named(todo, rows.sparkSession, keys), F.col("dataset").eqNullSafe(F.col("named")), "left_anti")


def of_datasets(rows: DataFrame, todo: Work, keys: Sequence[str]) -> DataFrame:
    """The rows of the datasets that are to be computed."""
    if todo.datasets is None:
        return rows.where("dataset IS NOT NULL")
    return rows.join(_named(todo, rows.sparkSession, keys), F.col("dataset").eqNullSafe(F.col("named")), "left_semi")


def _named(todo: Work, spark: SparkSession, keys: Sequence[str]) -> DataFrame:
    return todo.table(spark, keys).select(F.array(*[f"`{k}`" for k in keys]).alias("named"))


def clear(spark: SparkSession, path: str, todo: Work, values: DataFrame | None = None) -> None:
    """Remove the results below ``path`` that are to be replaced.

    ``values`` holds the partition values of the datasets' folders; without it the whole of ``path`` goes.
    """
    if todo.fresh or not exists(spark, path):
        return
    if values is None or todo.datasets is None:
        drop(spark, path)
        return
    files = listing(spark, "", path, values.columns)
    named = values.select(F.array(*[F.col(f"`{c}`") for c in values.columns]).alias("named"))
    held = files.join(named, F.col("dataset").eqNullSafe(F.col("named")), "left_semi")
    for row in held.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).distinct().collect():
        drop(spark, f"{path}/{row.folder}")
