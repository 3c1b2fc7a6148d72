"""Overlay, dissolve and zonal statistics on cell sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from access_engine.storage import stored

CELL = ["row_no", "col_no"]


def overlay(a: DataFrame, b: DataFrame, how: str, on: Sequence[str] = tuple(CELL)) -> DataFrame:
    """Overlay two cell sets: ``or`` keeps leftovers of both, ``and`` none, ``not`` is a minus b."""
    kind = {"or": "full", "and": "inner", "not": "left_anti"}[how]
    return a.join(b, list(on), kind)


def dissolve(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The set of cells per key, each once; without keys, of all features together."""
    return cells.select(*keys, *CELL).distinct()


def numbered_categories(df: DataFrame, keys: Sequence[str], number: str = "category") -> DataFrame:
    """Each different key once with its dense number from 1, in the order of the keys, NULL first.

    Keys are ordered over all tasks by a range partitioning; a number is the place in a range and the keys of the ranges
    before it. The numbers depend on the set of keys alone, so they are the same in every run.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written out, because counts and places must see the same ranges
    ordered = stored(
        df.select(*keys)
        .distinct()
        .repartitionByRange(partitions, *keys)
        .withColumn("part", F.spark_partition_id()),
        "categories",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    counts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*keys))
    return (
        ordered.withColumn("place", place)
        .join(offsets, "part")
        .select(*keys, (F.col("before") + F.col("place")).cast("long").alias(number))
    )


def zonal_stats(
    cells: DataFrame,
    keys: Sequence[str | Column],
    value: str = "pop",
    stats: Sequence[str] = ("sum", "count"),
    prefix: str = "pop_",
) -> DataFrame:
    """Statistics of a raster value per zone; partial sums are built before the shuffle."""
    known = {"sum": F.sum, "count": F.count, "mean": F.avg}
    return cells.groupBy(*keys).agg(*[known[s](value).alias(prefix + s) for s in stats])


def unstack(stack: DataFrame, *keep: str) -> DataFrame:
    """Multi-layer raster with an array ``hours`` -> one row per cell and ``layer`` number.

    The outer form keeps a cell without any layer (a leftover of an overlay), with NULLs.
    """
    return stack.select(*keep, F.posexplode_outer("hours").alias("layer", "hours"))


def name_layers(df: DataFrame, names: Sequence[tuple[str, str]]) -> DataFrame:
    """Replace the layer number by season and facility type, after the rows have become few."""
    seasons = F.array(*[F.lit(season) for season, _ in names])
    facilities = F.array(*[F.lit(fac) for _, fac in names])
    others = [c for c in df.columns if c != "layer"]
    return df.select(
        F.get(seasons, F.col("layer")).alias("season"),
        F.get(facilities, F.col("layer")).alias("fac_type"),
        *others,
    )


def lookup(df: DataFrame, dim: DataFrame, on: Column, columns: Sequence[str]) -> DataFrame:
    """Left join that brings named attribute columns; unmatched rows keep NULL.

    No broadcast hint: the dimension is broadcast when its size allows it and shuffled otherwise.
    """
    left, right = df.alias("left_side"), dim.alias("right_side")
    return left.join(right, on, "left").select(
        "left_side.*", *[F.col(f"right_side.{c}") for c in columns]
    )
