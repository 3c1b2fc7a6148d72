"""Sources and sinks: rasters, polygon layers, tables and result trees written, read again and used."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from access_engine import config, jobs
from access_engine.functions import bands as B
from access_engine.operators import overlay as O
from access_engine.operators.segments import to_segments
from access_engine.operators.spans import rasterise
from access_engine.plans import charts as H
from access_engine.plans import classification as C
from access_engine.sources import features as V
from access_engine.sources import rasters as W
from access_engine.sources import results as R
from access_engine.storage import drop, new_path, store
from checks import classification
from checks.classification import adm2, located, share_table
from checks.fixture_sql import BAND_CASE, with_views
from checks.order_grid import LAYERS, OrderGrid

TILE_ROWS, TILE_COLS, NODATA = 8, 32, -9999.0


def _long(stack: DataFrame) -> DataFrame:
    """All rasters in long form with their season and facility type."""
    return O.name_layers(O.unstack(stack, "row_no", "col_no"), LAYERS)


def raster_tiles(g: OrderGrid) -> DataFrame:
    """A raster written as one array per tile with a nodata value, read back and classified."""
    place = (F.col("row_no") % TILE_ROWS) * TILE_COLS + F.col("col_no") % TILE_COLS
    by_place = F.map_from_entries(F.collect_list(F.struct(place, "base_hours")))
    every = F.sequence(F.lit(0), F.lit(TILE_ROWS * TILE_COLS - 1))
    tiles = (
        g.base_hours.where("base_hours IS NOT NULL")
        .groupBy(
            F.floor(F.col("row_no") / TILE_ROWS).cast("int").alias("tile_row"),
            F.floor(F.col("col_no") / TILE_COLS).cast("int").alias("tile_col"),
        )
        .agg(by_place.alias("m"))
        .select(
            "tile_row",
            "tile_col",
            F.transform(every, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(NODATA))).alias("values"),
        )
    )
    path = new_path(g.spark, "raster_tiles")
    tiles.write.parquet(path)
    back = g.spark.read.schema(tiles.schema).parquet(path)
    return B.classify_bands(W.tile_cells(back, TILE_COLS, TILE_ROWS, nodata=NODATA))


def raster_cells(g: OrderGrid) -> DataFrame:
    """Long rasters laid out by row and partitioned by dataset, read back and counted by band."""
    path = new_path(g.spark, "raster_cells")
    W.write_sorted(_long(g.stack).where("hours IS NOT NULL"), path, ["season", "fac_type"])
    cells = B.classify_bands(W.read_travel_time(g.spark, path))
    return cells.groupBy("season", "fac_type", "band").agg(F.count(F.lit(1)).alias("cells"))


def raster_segments(g: OrderGrid) -> DataFrame:
    """The LGU result from rasters and population written as row segments."""
    times, people = (new_path(g.spark, name) for name in ("raster_segments", "pop_segments"))
    # written out, because laying out by range reads them twice
    segments, path = store(to_segments(_long(g.row_stack), "hours", C.DATASET), "segments")
    W.write_sorted(segments, times, C.DATASET)
    drop(g.spark, path)
    W.write_sorted(to_segments(g.population, "pop"), people)
    cells = C.banded_segments(
        W.read_travel_time(g.spark, times, "segments"),
        W.read_population(g.spark, people, "segments"),
        rasterise(g.lgu_edges, g.grid, ["id"]),
        "id",
        C.DATASET,
    )
    return C.lgu_share(C.raster_band_population(cells, "id"), adm2(g, located(g)), "id")


def raster_stack(g: OrderGrid) -> DataFrame:
    """Long rasters stacked to one array per cell, and the result of the stack."""
    cells = located(g)
    stack = W.stack_layers(_long(g.row_stack), LAYERS)
    per_unit = C.band_population(C.banded_cells(cells, stack), "id", LAYERS)
    return C.lgu_share(per_unit, adm2(g, cells), "id")


def _table(kind: str) -> str:
    return f"access_engine_{kind}_{uuid.uuid4().hex}"


def catalog_tables(g: OrderGrid) -> DataFrame:
    """Unit table and cells looked up in the catalog, the result saved there and read again."""
    units, cells, result = (_table(k) for k in ("units", "cells", "result"))
    within = located(g)
    adm2(g, within).write.saveAsTable(units)
    R.save_cells(within.select("row_no", "col_no", "id", "pop"), cells, R.buckets_of(g.grid, 8))
    per_unit = C.band_population(C.banded_cells(g.spark.table(cells), g.stack), "id", LAYERS)
    R.save_result(C.lgu_share(per_unit, g.spark.table(units), "id"), result)
    return g.spark.table(result)


def chart_folders(g: OrderGrid) -> DataFrame:
    """Bar chart tables, one folder per raster, read back with the raster from the folder's name."""
    path = new_path(g.spark, "charts")
    chart = H.lgu_bands(share_table(g))
    H.write_chart_tables(chart, path, C.DATASET)
    return g.spark.read.schema(chart.schema).parquet(path)


def result_order(g: OrderGrid) -> DataFrame:
    """Each raster's result in the order of unit code and band, the place as a column."""
    place = Window.partitionBy(*C.DATASET).orderBy("adm2_code", "trav_value")
    return share_table(g).select(
        *C.DATASET, "adm2_code", "trav_value", "cat_pop", F.row_number().over(place).alias("place")
    )


def csv_by_header(g: OrderGrid) -> DataFrame:
    """Unit and province results in one tree, matched by column name; what a file lacks is NULL."""
    root = new_path(g.spark, "results")
    R.write_result_tree(share_table(g), root)
    R.write_result_tree(classification.province_band_share(g), root, "adm1", "append")
    both = T.StructType([*config.LGU_RESULT.fields, config.PROVINCE_RESULT["adm_code"]])
    return R.read_results_by_name(g.spark, root, both)


def bound_rows(g: OrderGrid) -> DataFrame:
    """Unit and province results bound by row, missing columns filled with NULL."""
    return R.bind_rows([share_table(g), classification.province_band_share(g)])


def unit_in_parts(g: OrderGrid) -> DataFrame:
    """The LGU result with every unit given as two triangles that share its diagonal."""
    corners = F.array_sort(F.collect_list(F.struct("seq", F.array("x1", "y1").alias("p"))))
    at = [F.get("corners", F.lit(i))["p"] for i in range(4)]
    rings = F.array(F.array(at[0], at[1], at[2], at[0]), F.array(at[0], at[2], at[3], at[0]))
    shapes = (
        g.lgu_edges.groupBy("id")
        .agg(corners.alias("corners"))
        .select("id", F.explode(rings).alias("ring"))
        .join(adm2(g, located(g)), "id")
        .select(
            "hlcit_code",
            "lu_name",
            F.col("pop_sum").alias("sum"),
            F.concat(
                F.lit('{"type":"Polygon","coordinates":'), F.to_json(F.array("ring")), F.lit("}")
            ).alias("geometry"),
        )
    )
    path = new_path(g.spark, "units")
    V.write_geojson(shapes, path, jobs.ADM2.names, g.grid.srid)
    layer = V.read_geojson(g.spark, path, jobs.ADM2)
    units = jobs.one_row(layer.drop("coordinates", "srid", "feature"), "hlcit_code")
    edges = V.feature_edges(layer, ["hlcit_code"])
    cells = C.unit_cells(g.population, edges, g.grid, "hlcit_code")
    per_unit = C.band_population(C.banded_cells(cells, g.stack), "hlcit_code", LAYERS)
    return C.lgu_share(per_unit, units.withColumnRenamed("sum", "pop_sum"))


QUERIES = {
    f.__name__: f
    for f in (
        raster_tiles,
        raster_cells,
        raster_segments,
        raster_stack,
        catalog_tables,
        chart_folders,
        result_order,
        csv_by_header,
        bound_rows,
        unit_in_parts,
    )
}

_RESULT = "season, fac_type, adm_name, adm2_code, province, trav_value, trav_cat, adm_pop, cat_pop, pc_pop"
_SHARES = with_views(f"select {_RESULT} from fx_labelled")
_BOTH = (
    f"select {_RESULT}, cast(null as varchar) as adm_code{{0}} from fx_labelled union all "
    "select season, fac_type, adm_name, null, null, trav_value, trav_cat, adm_pop, cat_pop, pc_pop, adm_code{1} from fx_province_share"
)
_SOURCE = ", season || '/' || lower(season) || '_' || fac_type || '_{}.csv' as source"

ORACLE = {
    "raster_tiles": with_views(
        f"select row_no, col_no, hours, {BAND_CASE} as band from (select row_no, col_no, base_hours as hours from fx_cells) t where hours is not null"
    ),
    "raster_cells": with_views(
        "select season, fac_type, band, count(*) as cells from fx_band group by season, fac_type, band"
    ),
    "raster_segments": _SHARES,
    "raster_stack": _SHARES,
    "catalog_tables": _SHARES,
    "result_order": with_views(
        "select season, fac_type, adm2_code, trav_value, cat_pop, "
        "cast(row_number() over (partition by season, fac_type order by adm2_code, trav_value) as int) as place from fx_labelled"
    ),
    "csv_by_header": with_views(
        _BOTH.format(_SOURCE.format("adm2"), _SOURCE.format("adm1"))
    ),
    "bound_rows": with_views(_BOTH.format("", "")),
    "unit_in_parts": _SHARES,
}
