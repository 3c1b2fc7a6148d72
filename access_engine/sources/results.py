"""Result tables as files: one CSV, a folder tree of CSVs with provenance, bucketed cell tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from access_engine.config import LGU_RESULT
from access_engine.functions import paths as P
from access_engine.operators.grid import Grid
from access_engine.storage import qualified

BUCKET_CELLS = 1 << 19


def write_csv(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """Table as CSV with header; with ``partition_by`` one folder per group."""
    df.write.mode(mode).option("header", True).partitionBy(*partition_by).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV whose header has the schema's names in order; another header or a bad value is an error."""
    return _strict(spark, schema).csv(path)


def _strict(spark: SparkSession, schema: T.StructType) -> DataFrameReader:
    options = {"header": True, "enforceSchema": False, "mode": "FAILFAST"}
    return spark.read.schema(schema).options(**options)


def in_order(df: DataFrame, *order: str | Column) -> DataFrame:
    """Rows in one order over all partitions: files written from them, read by name, give it back.

    Rows are dealt out by ranges of the whole order, so a large group goes to several tasks.
    """
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def result_folders(datasets: DataFrame, level: str = "adm2") -> DataFrame:
    """``season, fac_type`` -> ``folder, file`` of the dataset in a result tree, other columns kept."""
    season, fac = F.col("season"), F.col("fac_type")
    file = F.concat(F.lower(season), F.lit("_"), fac, F.lit(f"_{level}.csv"))
    return datasets.withColumn("folder", season).withColumn("file", file).drop("season", "fac_type")


def write_result_tree(
    df: DataFrame, root: str, level: str = "adm2", mode: str = "errorifexists"
) -> None:
    """One folder ``<season>/<dataset>_<level>.csv`` per dataset, as a run per raster leaves it.

    All datasets go out in one job, each in the order of unit code and band over its files.
    """
    code = "adm2_code" if level == "adm2" else "adm_code"
    ordered = in_order(result_folders(df, level), "folder", "file", code, "trav_value")
    ordered.write.mode(mode).option("header", True).partitionBy("folder", "file").csv(root)


def read_results(
    spark: SparkSession, root: str, schema: T.StructType = LGU_RESULT
) -> DataFrame:
    """Every CSV below a subfolder of ``root`` with ``source, season, fac_type`` from its path.

    ``source`` is the path relative to ``root``; part files of a written folder count as that
    folder, and files lying in ``root`` itself are no results. Every file must have the header of
    ``schema``; a tree of the other level is an error, not a table of shifted columns.
    """
    rows = (
        _strict(spark, schema)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(root)
    )
    return _with_provenance(rows, spark, root, F.col("_metadata.file_path"))


def _with_provenance(rows: DataFrame, spark: SparkSession, root: str, file: Column) -> DataFrame:
    """Adds ``source, season, fac_type`` from the path of each row's file."""
    # a plus sign in a path is no space
    full = F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))
    full = F.regexp_replace(full, "^([a-z0-9]+):/+", "$1:/")
    base = re.sub("^([a-z0-9]+):/+", r"\1:/", qualified(spark, root).rstrip("/")) + "/"
    strange = F.raise_error(F.concat(F.lit(f"not below {base}: "), full))
    inner = F.when(F.startswith(full, F.lit(base)), F.substring(full, len(base) + 1, 1 << 30))
    inner = inner.otherwise(strange)
    plain = F.regexp_replace(inner, "(folder|file)=", "")
    source = F.regexp_replace(plain, r"/part-[^/]*$", "")
    return (
        rows.select("*", source.alias("source"))
        .where(F.col("source").contains("/"))
        .withColumn("season", P.season_of(F.col("source")))
        .withColumn("fac_type", P.facility_of(F.col("source")))
    )


def read_results_by_name(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Every CSV below a subfolder of ``root``, columns matched by the names of each file's header.

    Files may differ in their columns and in the order of them: a column of ``schema`` that a file
    lacks is NULL there; a file without a header, with a name ``schema`` has not, or with a value
    that is not of its column's type stops the run. All files are read in one job; a row is one
    line.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .text(root)
        .select("value", F.col("_metadata.file_path").alias("file"))
        .where(F.length("value") > 0)
    )
    # one more field at the end of each line, a mark, tells how many fields the line has
    mark, width = "#", len(schema)
    fields = F.from_csv(
        F.concat("value", F.lit(f",{mark}")), ", ".join(f"c{i} string" for i in range(width + 1))
    )
    split = lines.select("value", "file", fields.alias("f")).select(
        "value", "file", F.array("f.*").alias("cells")
    )
    last = F.array_max(
        F.transform("cells", lambda c, i: F.when(c.isNotNull(), i).otherwise(F.lit(-1)))
    )
    # a line of more fields than the schema has columns has lost its mark
    n = F.when(F.get("cells", last) == mark, last).otherwise(F.lit(-1))
    split = split.withColumn("n", n).withColumn("cells", F.slice("cells", 1, last))
    known = F.array(*[F.lit(n) for n in schema.names])
    is_header = (F.col("n") > 0) & F.forall(
        "cells", lambda c: F.coalesce(F.array_contains(known, c), F.lit(False))
    )
    split = split.withColumn("is_header", is_header)
    heads = (
        split.where("is_header").groupBy("file").agg(F.min("cells").alias("names"), F.max("cells").alias("other"))
    )
    wrong = F.raise_error(F.concat(F.lit("no header, or a line unlike it: "), "file", F.lit(": "), "value"))
    fits = (F.col("names") == F.col("other")) & (F.size("names") == F.col("n"))
    rows = split.where(~F.col("is_header")).join(heads, "file", "left")
    rows = rows.withColumn("names", F.when(F.coalesce(fits, F.lit(False)), F.col("names")).otherwise(wrong))

    def named(column: T.StructField) -> Column:
        text = F.get("cells", F.array_position("names", column.name).cast("int") - 1)
        value = text.try_cast(column.dataType)
        bad = F.raise_error(F.concat(F.lit(f"bad {column.name} in "), "file", F.lit(": "), text))
        return F.when(text.isNotNull() & value.isNull(), bad).otherwise(value).alias(column.name)

    typed = rows.select(*[named(c) for c in schema.fields], "file")
    return _with_provenance(typed, spark, root, F.col("file")).drop("file")


def bind_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames, filling columns a frame lacks with NULL."""
    united, *rest = frames
    for frame in rest:
        united = united.unionByName(frame, allowMissingColumns=True)
    return united


def save_result(df: DataFrame, table: str, schema: T.StructType = LGU_RESULT) -> None:
    """Keep the export columns of a result as a table, with the dataset columns in front."""
    dataset = [c for c in ("season", "fac_type") if c in df.columns]
    df.select(*dataset, *schema.names).write.saveAsTable(table)


def buckets_of(grid: Grid, least: int = 8) -> int:
    """Buckets for the cells of a grid: ``least``, and more where these would hold over :data:`BUCKET_CELLS` cells each.

    A bucket is read and joined by one task, so the number of buckets grows with the grid.
    """
    return max(least, -(-grid.nrows * grid.ncols // BUCKET_CELLS))


def save_cells(
    df: DataFrame, table: str, buckets: int, keys: Sequence[str] = ("row_no", "col_no")
) -> None:
    """Store a cell table bucketed and sorted by cell, so that later joins need no shuffle; a bucket is one file."""
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)
