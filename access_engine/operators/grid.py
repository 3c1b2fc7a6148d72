"""Grid geometry: one small struct passed as literals, and index arithmetic on columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from access_engine.config import SRID, STRIP


#: Cells of all layers that one task unfolds and sorts.
TASK_CELLS = 1 << 20


@dataclass(frozen=True)
class Grid:
    """North-up raster grid; row 0 is the top row, ``(x0, y0)`` its upper left corner."""

    x0: float
    y0: float
    dx: float
    dy: float
    ncols: int
    nrows: int
    srid: int = SRID

    def x_centre(self, col: Column) -> Column:
        return F.lit(self.x0) + (col.cast("double") + F.lit(0.5)) * F.lit(self.dx)

    def y_centre(self, row: Column) -> Column:
        return F.lit(self.y0) - (row.cast("double") + F.lit(0.5)) * F.lit(self.dy)

    def col_position(self, x: Column) -> Column:
        """Distance from the left border in columns; its floor is the column."""
        return (x - F.lit(self.x0)) / F.lit(self.dx)

    def row_position(self, y: Column) -> Column:
        """Distance from the upper border in rows; its floor is the row."""
        return (F.lit(self.y0) - y) / F.lit(self.dy)

    def cell_id(self, row: Column, col: Column) -> Column:
        """Row-major cell number, 64 bit because ``nrows * ncols`` may pass 2**31."""
        return row.cast("long") * F.lit(self.ncols).cast("long") + col.cast("long")

    def cell_area(self) -> float:
        return self.dx * self.dy


def tasks_of(spark: SparkSession, grid: Grid, layers: int = 1) -> int:
    """How many tasks share the cells of all layers, with at most :data:`TASK_CELLS` in each on average."""
    return max(-(-grid.nrows * grid.ncols * layers // TASK_CELLS), spark.sparkContext.defaultParallelism)


def by_rows(df: DataFrame, grid: Grid, layers: int = 1) -> DataFrame:
    """Deal rows of a raster over tasks so that all of one raster row meets in one, however many layers are unfolded there.

    What is grouped, swept or joined within a raster row afterwards moves no more, if both sides of a join are dealt for the
    same grid and number of layers. The tasks grow in number with grid and layers, not in size.
    """
    return df.repartition(tasks_of(df.sparkSession, grid, layers), "row_no")


def strip_of(col: Column, width: int = STRIP) -> Column:
    """Number of the column strip a cell lies in."""
    return F.floor(col / F.lit(width)).cast("int")


def align(points: DataFrame, grid: Grid, x: str = "x", y: str = "y") -> DataFrame:
    """Give every point (a cell centre of another raster) its cell on ``grid``.

    Points outside the grid have no cell there and leave.
    """
    col, row = grid.col_position(F.col(x)), grid.row_position(F.col(y))
    inside = (col >= 0) & (col < grid.ncols) & (row >= 0) & (row < grid.nrows)
    return (
        points.where(inside)
        .withColumn("row_no", F.floor(row).cast("int"))
        .withColumn("col_no", F.floor(col).cast("int"))
    )


def _overlap(
    index: Column, origin: tuple[float, float], size: tuple[float, float], count: int, sign: int
) -> Column:
    """Target indexes along one axis that a source cell overlaps, with the share of it in each.

    Positions grow from the origin by ``sign``; ``origin`` and ``size`` are those of source and target.
    """
    (own, other), (width, wide) = origin, size
    low = F.lit(sign * (own - other)) + index.cast("double") * F.lit(width)
    high = low + F.lit(width)
    first = F.greatest(F.floor(low / F.lit(wide)), F.lit(0)).cast("int")
    last = F.least(F.ceil(high / F.lit(wide)) - 1, F.lit(count - 1)).cast("int")
    places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    def share(place: Column) -> Column:
        begin, end = place.cast("double") * F.lit(wide), (place + 1).cast("double") * F.lit(wide)
        return (F.least(high, end) - F.greatest(low, begin)) / F.lit(width)

    return F.transform(places, lambda place: F.struct(place.alias("place"), share(place).alias("share")))


def resample(
    cells: DataFrame, value: str, source: Grid, target: Grid, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Amounts of one raster on the cells of another: ``keys, row_no, col_no`` and ``value``.

    A cell is parted over the target cells by the share of its area in each, which is the product of its shares along
    both axes, so totals are kept; what lies outside the target leaves. Cells without a value add nothing. Partial sums
    are built before the shuffle.
    """
    same_srid(source, target)
    across = _overlap(F.col("col_no"), (source.x0, target.x0), (source.dx, target.dx), target.ncols, 1)
    down = _overlap(F.col("row_no"), (source.y0, target.y0), (source.dy, target.dy), target.nrows, -1)
    parts = (
        cells.where(F.col(value).isNotNull())
        .select(*keys, value, across.alias("across"), F.explode(down).alias("down"))
        .select(*keys, value, "down", F.explode("across").alias("across"))
        .where("down.share > 0 AND across.share > 0")
    )
    amount = F.col(value) * F.col("across.share") * F.col("down.share")
    place = [F.col("down.place").alias("row_no"), F.col("across.place").alias("col_no")]
    return parts.groupBy(*keys, *place).agg(F.sum(amount).alias(value))


def same_srid(*layers: Grid | int) -> int:
    """Overlaying layers of different reference systems is an error, not a silent misfit."""
    codes = {layer.srid if isinstance(layer, Grid) else layer for layer in layers}
    if len(codes) != 1:
        raise ValueError(f"layers have different reference systems: {sorted(codes)}")
    return codes.pop()
