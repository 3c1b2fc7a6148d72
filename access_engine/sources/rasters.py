"""Rasters as Parquet: long cells, tile rows, and multi-layer stacks; the grid as a JSON header."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from access_engine.operators.grid import Grid

# long cells, or row segments (operators.segments)
TRAVEL_TIME = {
    "cells": "row_no int, col_no int, hours double, season string, fac_type string",
    "segments": "row_no int, strip int, hours array<double>, season string, fac_type string",
}
POPULATION = {
    "cells": "row_no int, col_no int, pop double",
    "segments": "row_no int, strip int, pop array<double>",
}
GRID = "x0 double, y0 double, dx double, dy double, ncols int, nrows int, srid int"


def read_grid(spark: SparkSession, path: str) -> Grid:
    """Grid header: one JSON line."""
    return Grid(**spark.read.schema(GRID).json(path).first().asDict())


def write_grid(spark: SparkSession, grid: Grid, path: str) -> None:
    spark.createDataFrame([tuple(vars(grid).values())], GRID).write.json(path)


def read_travel_time(
    spark: SparkSession, path: str, layout: str = "cells", folders: Sequence[str] | None = None
) -> DataFrame:
    """All travel-time rasters, partitioned by season and facility type, or those in ``folders`` below ``path``."""
    reader = spark.read.schema(TRAVEL_TIME[layout])
    if folders is None:
        return reader.parquet(path)
    return reader.option("basePath", path).parquet(*[f"{path}/{f}" for f in folders])


def read_population(spark: SparkSession, path: str, layout: str = "cells") -> DataFrame:
    return spark.read.schema(POPULATION[layout]).parquet(path)


def tile_cells(
    tiles: DataFrame, width: int, height: int, value: str = "hours", nodata: float | None = None
) -> DataFrame:
    """Raster stored as one array per tile -> one row per cell with a value.

    ``tiles`` holds ``tile_row, tile_col, values`` and any dataset columns; ``values`` runs row by
    row through ``height`` x ``width`` cells.
    """
    keep = [c for c in tiles.columns if c not in ("tile_row", "tile_col", "values")]
    cells = tiles.select(*keep, "tile_row", "tile_col", F.posexplode("values").alias("at", value))
    if nodata is not None:
        cells = cells.where(F.col(value) != F.lit(nodata))
    return cells.where(F.col(value).isNotNull()).select(
        *keep,
        (F.col("tile_row") * height + F.floor(F.col("at") / width)).cast("int").alias("row_no"),
        (F.col("tile_col") * width + F.col("at") % width).cast("int").alias("col_no"),
        value,
    )


def stack_layers(rasters: DataFrame, names: Sequence[tuple[str, str]]) -> DataFrame:
    """Long rasters -> one row per cell with an array of the layers in the order of ``names``."""
    layer = [
        F.max(F.when((F.col("season") == season) & (F.col("fac_type") == fac), F.col("hours")))
        for season, fac in names
    ]
    return rasters.groupBy("row_no", "col_no").agg(F.array(*layer).alias("hours"))


def write_sorted(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Cells or segments laid out by raster row, so that Parquet statistics skip what a window
    does not need."""
    place = ["row_no", "strip" if "strip" in df.columns else "col_no"]
    ranged = df.repartitionByRange(*partition_by, *place)
    writer = ranged.sortWithinPartitions(*partition_by, *place).write
    writer.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
