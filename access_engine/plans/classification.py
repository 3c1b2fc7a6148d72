"""Population per travel-time band and administrative unit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from access_engine.config import STRIP
from access_engine.functions import bands as B
from access_engine.operators.grid import Grid
from access_engine.operators.overlay import CELL, lookup, name_layers, unstack, zonal_stats
from access_engine.operators.segments import segment_cells
from access_engine.operators.spans import locate, rasterise

DATASET = ["season", "fac_type"]


def unit_cells(
    pop: DataFrame, edges: DataFrame, grid: Grid, key: str = "id", width: int = STRIP
) -> DataFrame:
    """Population cells with the unit each lies in; computed once and joined to every raster."""
    return locate(pop, rasterise(edges, grid, [key]), width=width)


def unit_dimension(located: DataFrame, codes: DataFrame) -> DataFrame:
    """Unit attributes with the zonal population, NULL for a unit without a cell."""
    totals = zonal_stats(located, ["id"], stats=["sum"])
    return codes.join(totals, "id", "left")


def banded_cells(located: DataFrame, stack: DataFrame) -> DataFrame:
    """Unit cells of every layer of a multi-layer raster with their band.

    The join runs on one row per cell; the layers are unfolded after it, inside the same stage
    that pre-aggregates, so the shuffle carries each cell once however many layers there are.
    """
    joined = located.join(stack.select(*CELL, "hours"), CELL)
    layers = unstack(joined, *located.columns)
    return B.classify_bands(layers).drop("hours")


def banded_rasters(located: DataFrame, rasters: DataFrame) -> DataFrame:
    """The same for rasters in long form; ``season, fac_type`` name the raster of a row.

    Cells outside the bands leave before the join.
    """
    banded = B.classify_bands(rasters).where(F.col("band") > 0).drop("hours")
    return banded.join(located, CELL)


def banded_segments(
    rasters: DataFrame,
    population: DataFrame,
    spans: DataFrame,
    unit: str,
    keys: Sequence[str],
    width: int = STRIP,
) -> DataFrame:
    """The same for rasters and population stored as row segments; units come as spans."""
    cells = segment_cells(rasters, population, spans, keys, unit, width)
    return B.classify_bands(cells).where(F.col("band") > 0).drop("hours")


def band_population(cells: DataFrame, unit: str, names: Sequence[tuple[str, str]]) -> DataFrame:
    """``cat_pop`` per dataset, unit and band; band 0 (outside the bands) makes no zone."""
    sums = (
        cells.where(F.col("band") > 0)
        .groupBy("layer", unit, F.col("band").alias("trav_value"))
        .agg(F.sum("pop").alias("cat_pop"))
    )
    return name_layers(sums, names)


def band_population_and_total(
    located: DataFrame, stack: DataFrame, unit: str, names: Sequence[tuple[str, str]]
) -> DataFrame:
    """``cat_pop`` per dataset, unit and band with the unit's whole population ``pop_sum``.

    One pass over the cells gives both: a cell goes in once per layer and once more for the total,
    which the few aggregated rows of its unit then take over.
    """
    joined = located.join(stack.select(*CELL, "hours"), CELL, "left")
    whole = F.array(F.lit(None).cast("double"))
    layers = joined.select(
        unit, "pop", F.posexplode(F.concat(whole, F.coalesce("hours", F.array().cast("array<double>")))).alias("at", "hours")
    )
    band = F.when(F.col("at") > 0, B.band_of(F.col("hours"))).otherwise(F.lit(-1))
    sums = (
        layers.withColumn("band", band)
        .where(F.col("band") != 0)
        .groupBy((F.col("at") - 1).alias("layer"), unit, F.col("band").alias("trav_value"))
        .agg(F.sum("pop").alias("cat_pop"))
    )
    total = F.max(F.when(F.col("layer") < 0, F.col("cat_pop"))).over(Window.partitionBy(unit))
    return name_layers(sums.withColumn("pop_sum", total).where(F.col("layer") >= 0), names)


def raster_band_population(cells: DataFrame, unit: str) -> DataFrame:
    """``cat_pop`` per dataset, unit and band of cells that carry their raster's names."""
    return cells.groupBy(*DATASET, unit, F.col("band").alias("trav_value")).agg(
        F.sum("pop").alias("cat_pop")
    )


def lgu_share(
    cat_pop: DataFrame,
    adm2: DataFrame,
    key: str = "hlcit_code",
    dataset: Sequence[str] = tuple(DATASET),
) -> DataFrame:
    """Result table of the local units: population and share per band.

    ``cat_pop`` and ``adm2`` meet on ``key``, the unit code or another unit number. Name and
    population are looked up, the population unless ``cat_pop`` brings it; a code the dimension
    lacks keeps its row with NULLs.
    """
    columns = ["hlcit_code", "lu_name"]
    if "pop_sum" not in cat_pop.columns:
        columns.append("pop_sum")
    named = lookup(
        cat_pop.withColumnRenamed(key, "unit"),
        adm2.select(*dict.fromkeys([key, *columns])),
        F.col("unit") == F.col(key),
        columns,
    )
    return named.withColumn(
        "adm2_code", F.col("unit") if key == "hlcit_code" else F.col("hlcit_code")
    ).select(
        *dataset,
        F.col("lu_name").alias("adm_name"),
        "adm2_code",
        B.key_province(F.col("adm2_code")).alias("province"),
        "trav_value",
        B.band_label(F.col("trav_value")).alias("trav_cat"),
        F.col("pop_sum").alias("adm_pop"),
        "cat_pop",
        B.share(F.col("cat_pop"), F.col("pop_sum")).alias("pc_pop"),
    )


def province_share(
    cat_pop: DataFrame, adm1: DataFrame, dataset: Sequence[str] = tuple(DATASET)
) -> DataFrame:
    """Result table of the provinces; the code doubles as the name."""
    named = lookup(
        cat_pop.withColumnRenamed("state", "adm_code"),
        adm1.select("state", "pop_sum"),
        F.col("adm_code") == F.col("state"),
        ["pop_sum"],
    )
    return named.select(
        *dataset,
        F.col("adm_code").alias("adm_name"),
        "adm_code",
        "trav_value",
        B.band_label(F.col("trav_value")).alias("trav_cat"),
        F.col("pop_sum").alias("adm_pop"),
        "cat_pop",
        B.share(F.col("cat_pop"), F.col("pop_sum")).alias("pc_pop"),
    )
