"""Rasters stored as row segments: one array per (raster row, column strip).

A segment holds ``width`` neighbouring cells of a row, NULL where a cell has no value. Rasters,
population and polygon spans then meet on (row, strip) with one row per segment instead of one per
cell, so a join moves plain arrays and sorts a few hundred times fewer rows; cells appear only
after the joins, in the stage that pre-aggregates them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from access_engine.config import STRIP
from access_engine.operators.grid import strip_of
from access_engine.operators.spans import cut_by_strip, merge_spans


def to_segments(
    cells: DataFrame, value: str, keys: Sequence[str] = (), width: int = STRIP
) -> DataFrame:
    """Cells -> ``keys, row_no, strip`` and the array ``value``; a group holds one segment.

    Places without a cell are NULL. A segment without a gap is padded at its ends only. A cell
    that occurs twice stops the job.
    """
    kind = dict(cells.dtypes)[value]
    sorted_cells = F.sort_array(
        F.collect_list(F.struct((F.col("col_no") % width).alias("at"), F.col(value).alias("v")))
    )

    def blank(n: Column) -> Column:
        return F.array_repeat(F.lit(None).cast(kind), n.cast("int"))

    cell = F.col("cells")
    first, last = F.get(cell, F.lit(0))["at"], F.element_at(cell, -1)["at"]
    inner = F.flatten(
        F.transform(
            cell,
            lambda c, i: F.concat(
                blank(F.when(i > 0, c["at"] - F.get(cell, i - 1)["at"] - 1).otherwise(F.lit(0))),
                F.array(c["v"]),
            ),
        )
    )
    twice = F.size(F.array_distinct(cell["at"])) < F.size(cell)
    filled = (
        F.when(twice, F.raise_error(F.format_string("row %s holds a cell twice", "row_no")))
        .when(F.size(cell) == last - first + 1, cell["v"])
        .otherwise(inner)
    )
    return (
        cells.groupBy(*keys, "row_no", strip_of(F.col("col_no"), width).alias("strip"))
        .agg(sorted_cells.alias("cells"))
        .select(
            *keys,
            "row_no",
            "strip",
            F.concat(blank(first), filled, blank(F.lit(width - 1) - last)).alias(value),
        )
    )


def by_layer(segments: DataFrame, value: str) -> DataFrame:
    """Row segments of a multi-layer raster, an array of cells with all their layers, turned to an array of the layers' segments.

    The layers are then unstacked where their segment lies: a shuffle moves cells, not cells times layers. A place without
    a cell is NULL in every layer.
    """
    layers = F.array_max(F.transform(value, lambda cell: F.coalesce(F.size(cell), F.lit(0))))
    numbers = F.when(layers > 0, F.sequence(F.lit(0), layers - 1)).otherwise(F.array().cast("array<int>"))
    turned = F.transform(numbers, lambda layer: F.transform(value, lambda cell: F.get(cell, layer)))
    return segments.withColumn(value, turned)


def to_cells(segments: DataFrame, value: str, keys: Sequence[str] = (), width: int = STRIP) -> DataFrame:
    """The cells with a value of row segments."""
    return (
        segments.select(*keys, "row_no", "strip", F.posexplode(value).alias("at", value))
        .where(F.col(value).isNotNull())
        .select(*keys, "row_no", (F.col("strip") * width + F.col("at")).alias("col_no"), value)
    )


def _unit_pieces(spans: DataFrame, unit: str, width: int) -> DataFrame:
    """Spans cut by strip, with where they start in the segment's array and how long they are."""
    return cut_by_strip(spans, width).select(
        unit,
        "row_no",
        "strip",
        "c0",
        (F.col("c0") - F.col("strip") * width + 1).alias("first"),
        (F.col("c1") - F.col("c0")).alias("length"),
    )


def segment_cells(
    rasters: DataFrame,
    population: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    unit: str,
    width: int = STRIP,
) -> DataFrame:
    """Cells of every raster inside a unit: ``keys, unit, row_no, col_no, hours, pop``.

    The part of a segment a unit's span covers is sliced out of both arrays and unfolded; cells
    without travel time or population leave.
    """
    on = ["row_no", "strip"]
    met = rasters.select(*keys, *on, "hours").join(population.select(*on, "pop"), on)
    pairs = F.arrays_zip(
        F.slice("hours", F.col("first"), F.col("length")).alias("hours"),
        F.slice("pop", F.col("first"), F.col("length")).alias("pop"),
    )
    return (
        met.join(_unit_pieces(spans, unit, width), on)
        .select(*keys, unit, "row_no", "c0", F.posexplode(pairs).alias("at", "cell"))
        .select(
            *keys,
            unit,
            "row_no",
            (F.col("c0") + F.col("at")).alias("col_no"),
            F.col("cell.hours").alias("hours"),
            F.col("cell.pop").alias("pop"),
        )
        .where(F.col("hours").isNotNull() & F.col("pop").isNotNull())
    )


def located_segments(
    population: DataFrame, spans: DataFrame, unit: str = "id", width: int = STRIP
) -> DataFrame:
    """Cells of a population raster inside a unit: ``row_no, col_no, pop, unit``.

    Only segments are joined; cells without a value leave.
    """
    covered = F.slice("pop", F.col("first"), F.col("length"))
    return (
        population.join(_unit_pieces(spans, unit, width), ["row_no", "strip"])
        .select(unit, "row_no", "c0", F.posexplode(covered).alias("at", "pop"))
        .where(F.col("pop").isNotNull())
        .select("row_no", (F.col("c0") + F.col("at")).alias("col_no"), "pop", unit)
    )


def segment_zones(
    rasters: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    unit: str,
    classify: Callable[[Column], Column],
    width: int = STRIP,
) -> DataFrame:
    """Spans of equal (unit, class) of every raster: ``keys, unit, band, row_no, c0, c1``.

    Runs of equal class are found inside each segment, so only runs are shuffled, never cells;
    runs that touch at a strip border melt together. Cells without a class belong to no span.
    """
    on = ["row_no", "strip"]
    met = (
        rasters.select(*keys, *on, "hours")
        .join(_unit_pieces(spans, unit, width), on)
        .withColumn("covered", F.slice("hours", F.col("first"), F.col("length")))
        .withColumn("bands", F.transform("covered", lambda hours: classify(hours)))
    )
    bands, starts = F.col("bands"), F.col("starts")
    opens = F.filter(
        F.sequence(F.lit(0), F.col("length") - 1),
        lambda i: (i == 0) | ~F.get(bands, i).eqNullSafe(F.get(bands, i - 1)),
    )
    runs = F.transform(
        starts,
        lambda start, i: F.struct(
            F.get(bands, start).alias("band"),
            (F.col("c0") + start).alias("begin"),
            (F.col("c0") + F.coalesce(F.get(starts, i + 1), F.col("length"))).alias("end"),
        ),
    )
    pieces = (
        met.withColumn("starts", opens)
        .select(*keys, unit, "row_no", F.inline_outer(runs))
        .where(F.col("band").isNotNull())
        .withColumnsRenamed({"begin": "c0", "end": "c1"})
    )
    return merge_spans(pieces, [*keys, unit, "band"])
