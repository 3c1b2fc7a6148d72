"""Catchment gap: union, difference, uncovered and covered population."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from access_engine.operators.overlay import dissolve
from access_engine.operators.prefix import running_sums, span_sums
from access_engine.operators.segments import to_segments
from access_engine.operators.spans import burn, rasterise
from access_engine.plans import catchment as K
from access_engine.sources import features as V
from access_engine.storage import new_path
from checks.classification import adm2, located
from checks.fixture_sql import with_views
from checks.order_grid import FACILITIES, OrderGrid


def covered(g: OrderGrid, dataset=()) -> DataFrame:
    return K.coverage(g.catchment_edges, g.grid, dataset)


def uncovered_layer(g: OrderGrid) -> DataFrame:
    cells = located(g)
    gaps = K.uncovered_cells(cells, covered(g))
    return K.uncovered_population(gaps, adm2(g, cells))


def catch_union_cells(g: OrderGrid) -> DataFrame:
    return dissolve(burn(covered(g))).withColumn("cat", F.lit(1))


def catch_uncovered(g: OrderGrid) -> DataFrame:
    return uncovered_layer(g)


def catch_uncovered_by_facility(g: OrderGrid) -> DataFrame:
    """Every facility type is one catchment file; all files in one job."""
    cells = located(g)
    files = g.spark.createDataFrame([(f,) for f in FACILITIES], "fac_type string")
    return K.uncovered_by_dataset(cells, covered(g, ["fac_type"]), adm2(g, cells), files)


def catch_shared_ids(g: OrderGrid) -> DataFrame:
    """Catchments whose ids repeat or are missing, as Polygon and MultiPolygon, written and read."""
    points = F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "x1", "y1"))), lambda p: F.array(p["x1"], p["y1"])
    )
    rings = g.catchment_edges.groupBy("id", "fac_type").agg(points.alias("ring"))
    polygon = F.to_json(F.array(F.concat("ring", F.slice("ring", 1, 1))))
    single = F.concat(F.lit('{"type":"Polygon","coordinates":'), polygon, F.lit("}"))
    multi = F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), polygon, F.lit("]}"))
    shapes = rings.select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("id"),
        "fac_type",
        F.when(F.col("id") % 2 == 0, single).otherwise(multi).alias("geometry"),
    )
    path = new_path(g.spark, "catchments")
    V.write_geojson(shapes, path, ["id", "fac_type"], g.grid.srid)
    kinds = T.StructType([shapes.schema["id"], shapes.schema["fac_type"]])
    outlines = V.feature_edges(V.read_geojson(g.spark, path, kinds), ["feature"])
    cells = located(g)
    free = K.uncovered_cells(cells, K.coverage(outlines, g.grid, feature=["feature"]))
    return K.uncovered_population(free, adm2(g, cells))


def catch_covered_split(g: OrderGrid) -> DataFrame:
    cells = located(g)
    totals = K.zonal_stats(cells, ["id"], stats=["sum"]).join(g.lgu_codes, "id")
    gaps = K.uncovered_population(
        K.uncovered_cells(cells, covered(g)), adm2(g, cells)
    )
    return K.covered_split(gaps, totals.select("hlcit_code", "pop_sum"))


def catch_by_facility(g: OrderGrid) -> DataFrame:
    return K.covered_by_dataset(
        located(g),
        covered(g, ["fac_type"]),
        g.lgu_codes,
        g.spark.createDataFrame([(f,) for f in FACILITIES], "fac_type string"),
    )


def _by_spans(g: OrderGrid):
    """Unit spans, what each file covers of them, running sums of the population, and the files."""
    units = rasterise(g.lgu_edges, g.grid, ["id"])
    inside = K.covered_spans(units, covered(g, ["fac_type"]), ["fac_type"])
    running = running_sums(to_segments(g.population, "pop"), "pop", g.grid)
    return units, inside, running, g.spark.createDataFrame([(f,) for f in FACILITIES], "fac_type string")


def _summed(g: OrderGrid, units: DataFrame, running: DataFrame) -> DataFrame:
    """Unit dimension from running sums; unit 23 is given population 0."""
    pop = F.when(F.col("id") == 23, F.lit(0.0)).otherwise(F.col("pop_sum")).alias("pop_sum")
    return span_sums(units, running, ["id"]).join(g.lgu_codes, "id").select("id", "hlcit_code", pop)


def prefix_uncovered_by_facility(g: OrderGrid) -> DataFrame:
    """Uncovered population per file and unit from running sums: files cost their spans alone."""
    units, inside, running, files = _by_spans(g)
    return K.uncovered_by_spans(units, inside, running, _summed(g, units, running), files)


def prefix_by_facility(g: OrderGrid) -> DataFrame:
    _, inside, running, files = _by_spans(g)
    return K.covered_by_spans(inside, running, g.lgu_codes, files)


def prefix_uncovered(g: OrderGrid) -> DataFrame:
    """Population outside all catchments from outlines and running sums."""
    units, _, running, _ = _by_spans(g)
    free = K.uncovered_spans(units, covered(g), g.grid)
    return K.uncovered_by_outline(free, running, _summed(g, units, running))


QUERIES = {
    f.__name__: f
    for f in (
        catch_union_cells,
        catch_uncovered,
        catch_uncovered_by_facility,
        catch_shared_ids,
        catch_covered_split,
        catch_by_facility,
        prefix_uncovered,
        prefix_uncovered_by_facility,
        prefix_by_facility,
    )
}

_GAP = "select id, sum(pop) as s from fx_uncovered group by id"

ORACLE = {
    "catch_union_cells": with_views(
        "select distinct c.row_no, c.col_no, 1 as cat from fx_catch_cell k join fx_cells c on c.cell = k.cell"
    ),
    "catch_uncovered": with_views(
        "select hlcit_code as a_hlcit_code, pop_sum as adm_pop, s as catch_pop_sum, "
        f"case when pop_sum <> 0 then s / pop_sum end as pc_uncov from ({_GAP}) u join fx_adm2 a on a.id = u.id"
    ),
    "catch_uncovered_by_facility": with_views(
        "select fac_type, hlcit_code as a_hlcit_code, pop_sum as adm_pop, s as catch_pop_sum, "
        "case when pop_sum <> 0 then s / pop_sum end as pc_uncov from "
        "(select f.fac_type, l.id, sum(c.pop) as s from fx_cells c join fx_lgu_cell l on l.cell = c.cell cross join fx_fac f "
        "where not exists (select 1 from fx_catch_cell k where k.cell = c.cell and k.fac_type = f.fac_type) group by f.fac_type, l.id) u "
        "join fx_adm2 a on a.id = u.id"
    ),
    "catch_covered_split": with_views(
        "select hlcit_code as adm2_code, coverage, case when coverage = 'Covered' then p - coalesce(s, 0) else coalesce(s, 0) end as pop "
        "from (select a.id, a.hlcit_code, sum(c.pop) as p from fx_adm2 a join fx_lgu_cell l on l.id = a.id join fx_cells c on c.cell = l.cell group by all) t "
        f"left join ({_GAP}) u on u.id = t.id cross join (values ('Covered'), ('Uncovered')) v(coverage)"
    ),
    "catch_by_facility": with_views(
        "select f.fac_type, a.hlcit_code as adm2_code, coalesce(s, 0) as covered_pop from fx_adm2 a cross join fx_fac f left join "
        "(select fac_type, l.id, sum(c.pop) as s from (select distinct fac_type, cell from fx_catch_cell) k join fx_cells c on c.cell = k.cell "
        "join fx_lgu_cell l on l.cell = k.cell group by fac_type, l.id) u on u.id = a.id and u.fac_type = f.fac_type"
    ),
}
ORACLE["catch_shared_ids"] = ORACLE["catch_uncovered"]
ORACLE |= {
    "prefix_uncovered": ORACLE["catch_uncovered"],
    "prefix_uncovered_by_facility": ORACLE["catch_uncovered_by_facility"],
    "prefix_by_facility": ORACLE["catch_by_facility"],
}
