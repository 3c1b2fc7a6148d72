"""Catchment gap: population outside the merged catchments of each unit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from access_engine.config import STRIP
from access_engine.operators.grid import Grid
from access_engine.operators.overlay import lookup, zonal_stats
from access_engine.operators.prefix import span_sums
from access_engine.operators.spans import (
    complement_spans,
    intersect_spans,
    locate,
    merge_blocks,
    rasterise_blocks,
)


def coverage(
    edges: DataFrame, grid: Grid, dataset: Sequence[str] = (), feature: Sequence[str] = ("id",)
) -> DataFrame:
    """Merged spans of all catchments, per dataset (file) when one is named.

    ``feature`` names the columns that tell every single feature apart: the even-odd rule holds
    within a feature, and two that shared a name would cancel where they overlap. Overlapping
    catchments melt into one span per raster row before any cell is touched, and rows are unfolded
    after the corners of all catchments are summed.
    """
    keys = [*dataset, *[f for f in feature if f not in dataset]]
    blocks = rasterise_blocks(edges, grid, keys)
    return merge_blocks(blocks.select(*dataset, "r0", "r1", "c0", "c1"), dataset)


def uncovered_cells(located: DataFrame, covered: DataFrame) -> DataFrame:
    """Unit cells outside every catchment."""
    return locate(located, covered, "left_anti")


def uncovered_spans(
    units: DataFrame, covered: DataFrame, grid: Grid, width: int = STRIP
) -> DataFrame:
    """What the merged catchments leave of every unit, as spans ``id, row_no, c0, c1``.

    For outlines and features; it works on outlines alone and reads no cell.
    """
    return intersect_spans(units, complement_spans(covered, grid), ["id"], width)


def uncovered_by_dataset(
    located: DataFrame, covered: DataFrame, adm2: DataFrame, datasets: DataFrame
) -> DataFrame:
    """Uncovered population and share per dataset (row of ``datasets``) and unit.

    What a dataset covers of a unit is taken off the unit's total, so cells are not repeated per
    dataset; a unit that a dataset covers completely has no row.
    """
    keys = datasets.columns
    whole = located.groupBy("id").agg(
        F.sum("pop").alias("pop"), F.count("pop").alias("known"), F.count(F.lit(1)).alias("cells")
    )
    part = (
        locate(located, covered)
        .groupBy(*keys, "id")
        .agg(
            F.sum("pop").alias("in_pop"),
            F.count("pop").alias("in_known"),
            F.count(F.lit(1)).alias("in_cells"),
        )
    )
    # the result has a row for nearly every pair, and these are all pairs
    every = whole.crossJoin(datasets).join(part, [*keys, "id"], "left")
    left = every.where(F.col("cells") > F.coalesce("in_cells", F.lit(0)))
    return _described(left.select(*keys, "id", _rest().alias("catch_pop_sum")), adm2, keys)


def _rest() -> Column:
    """What a dataset leaves of a unit's population; NULL where no cell that it leaves has one."""
    return F.when(
        F.col("known") > F.coalesce("in_known", F.lit(0)),
        F.col("pop") - F.coalesce("in_pop", F.lit(0.0)),
    )


def covered_spans(
    units: DataFrame, covered: DataFrame, dataset: Sequence[str] = (), width: int = STRIP
) -> DataFrame:
    """What the merged catchments of each dataset cover of every unit, as spans."""
    return intersect_spans(units, covered, [*dataset, "id"], width)


def uncovered_by_spans(
    units: DataFrame,
    covered: DataFrame,
    running: DataFrame,
    adm2: DataFrame,
    datasets: DataFrame,
    width: int = STRIP,
) -> DataFrame:
    """:func:`uncovered_by_dataset` from running sums of the population: a dataset costs its spans, and no cell is read.

    ``covered`` are the spans of :func:`covered_spans`. A unit of which a dataset leaves no cell with a known population
    has no row.
    """
    keys = datasets.columns
    whole = span_sums(units, running, ["id"], "", width).withColumnsRenamed({"sum": "pop", "count": "known"})
    part = span_sums(covered, running, [*keys, "id"], "in_", width)
    part = part.withColumnsRenamed({"in_sum": "in_pop", "in_count": "in_known"})
    # units x datasets rows, nearly all of which are results
    every = whole.crossJoin(datasets).join(part, [*keys, "id"], "left")
    left = every.select(*keys, "id", _rest().alias("catch_pop_sum")).where("catch_pop_sum IS NOT NULL")
    return _described(left, adm2, keys)


def uncovered_by_outline(
    free: DataFrame, running: DataFrame, adm2: DataFrame, width: int = STRIP
) -> DataFrame:
    """:func:`uncovered_population` from the spans that the catchments leave and running sums of the population."""
    sums = span_sums(free, running, ["id"], "catch_pop_", width).where("catch_pop_count > 0")
    return _described(sums.drop("catch_pop_count"), adm2, ())


def covered_by_spans(
    covered: DataFrame, running: DataFrame, units: DataFrame, datasets: DataFrame, width: int = STRIP
) -> DataFrame:
    """:func:`covered_by_dataset` from running sums of the population."""
    sums = span_sums(covered, running, [*datasets.columns, "id"], "covered_", width)
    return _covered_table(sums, units, datasets)


def uncovered_population(
    cells: DataFrame, adm2: DataFrame, dataset: Sequence[str] = ()
) -> DataFrame:
    """Uncovered population and share per unit; a unit without an uncovered cell has no row."""
    sums = zonal_stats(cells, [*dataset, "id"], stats=["sum"], prefix="catch_pop_")
    return _described(sums, adm2, dataset)


def _described(sums: DataFrame, adm2: DataFrame, dataset: Sequence[str]) -> DataFrame:
    joined = lookup(
        sums.withColumnRenamed("id", "unit"),
        adm2.select("id", "hlcit_code", "pop_sum"),
        F.col("unit") == F.col("id"),
        ["hlcit_code", "pop_sum"],
    )
    return joined.select(
        *dataset,
        F.col("hlcit_code").alias("a_hlcit_code"),
        F.col("pop_sum").alias("adm_pop"),
        "catch_pop_sum",
        F.try_divide("catch_pop_sum", "pop_sum").alias("pc_uncov"),
    )


def final_table(layer: DataFrame, dataset: Sequence[str] = ()) -> DataFrame:
    """One row per unit from a layer with a row per part, attributes averaged over the parts."""
    return layer.groupBy(*dataset, "a_hlcit_code").agg(
        F.avg("adm_pop").alias("adm_pop"),
        F.avg("catch_pop_sum").alias("catch_pop"),
        F.avg("pc_uncov").alias("pc_uncov"),
        F.count(F.lit(1)).alias("parts"),
    )


def with_geometry(final: DataFrame, shapes: DataFrame) -> DataFrame:
    """The final table with the merged ``geometry`` of each unit, one row per unit."""
    return final.join(shapes.select("a_hlcit_code", "geometry"), "a_hlcit_code")


def covered_split(uncovered: DataFrame, totals: DataFrame) -> DataFrame:
    """Covered and uncovered population of every unit as two rows.

    ``totals`` holds ``hlcit_code, pop_sum`` for all units; no uncovered row means none uncovered.
    """
    gaps = uncovered.select("a_hlcit_code", "catch_pop_sum")
    split = lookup(
        totals.select(F.col("hlcit_code").alias("adm2_code"), "pop_sum"),
        gaps,
        F.col("adm2_code") == F.col("a_hlcit_code"),
        ["catch_pop_sum"],
    ).select(
        "adm2_code",
        F.coalesce("catch_pop_sum", F.lit(0.0)).alias("Uncovered"),
        (F.coalesce("pop_sum", F.lit(0.0)) - F.coalesce("catch_pop_sum", F.lit(0.0))).alias(
            "Covered"
        ),
    )
    return split.unpivot("adm2_code", ["Covered", "Uncovered"], "coverage", "pop")


def covered_by_dataset(
    located: DataFrame, covered: DataFrame, units: DataFrame, datasets: DataFrame
) -> DataFrame:
    """Covered population of every unit and dataset (row of ``datasets``), 0 where none is."""
    keys = datasets.columns
    sums = zonal_stats(locate(located, covered), [*keys, "id"], stats=["sum"], prefix="covered_")
    return _covered_table(sums, units, datasets)


def _covered_table(sums: DataFrame, units: DataFrame, datasets: DataFrame) -> DataFrame:
    keys = datasets.columns
    every = units.select("id", F.col("hlcit_code").alias("adm2_code")).crossJoin(datasets)
    return every.join(sums, [*keys, "id"], "left").select(
        *keys, "adm2_code", F.coalesce("covered_sum", F.lit(0.0)).alias("covered_pop")
    )
