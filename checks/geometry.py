"""Connected areas, dissolved boundaries, areas, features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from access_engine.config import STRIP
from access_engine.functions import bands as B
from access_engine.operators import boundary as S
from access_engine.operators import overlay as O
from access_engine.operators.grid import same_srid
from access_engine.operators.regions import TILE, connected_runs, polygonize
from access_engine.operators.rings import assemble_features
from access_engine.operators.segments import segment_zones
from access_engine.operators.spans import burn, merge_spans, rasterise
from access_engine.plans import catchment as K
from access_engine.plans.classification import banded_cells
from access_engine.sources import features as V
from access_engine.storage import new_path, stored
from checks.catchment import covered
from checks.classification import adm2, layer_segments, located
from checks.fixture_sql import with_views
from checks.order_grid import LAYERS, OrderGrid


#: Strip width and tile size that the small grid has several of, in both directions.
NARROW, SMALL = 16, 32


def zones(g: OrderGrid, tile: int = TILE) -> DataFrame:
    """Runs of the connected areas of equal band of all rasters; band 0 is no zone."""
    cells = B.classify_bands(O.unstack(g.row_stack, "row_no", "col_no"))
    runs = S.cells_to_spans(cells.where(F.col("band") > 0), ["layer", "band"])
    return connected_runs(runs, g.grid, "band", ["layer"], tile, layers=len(LAYERS))


def gaps(g: OrderGrid) -> DataFrame:
    return K.uncovered_cells(located(g), covered(g))


def gap_spans(g: OrderGrid, width: int = STRIP) -> DataFrame:
    """The uncovered part of each unit as spans, from the outlines alone."""
    return K.uncovered_spans(rasterise(g.lgu_edges, g.grid, ["id"]), covered(g), g.grid, width)


def band_spans(g: OrderGrid) -> DataFrame:
    """Spans of equal (unit, band) of every raster: the dissolved zones."""
    cells = banded_cells(g.by_rows(located(g)), g.row_stack).where(F.col("band") > 0)
    return S.cells_to_spans(cells, ["layer", "id", "band"])


def polygonize_components(g: OrderGrid, tile: int = TILE) -> DataFrame:
    size = F.sum(F.col("c1") - F.col("c0")).alias("cells")
    return O.name_layers(zones(g, tile).groupBy("layer", "band", "zone_id").agg(size), LAYERS)


def tile_components(g: OrderGrid) -> DataFrame:
    """The connected areas once more, over tile borders in both directions."""
    return polygonize_components(g, SMALL)


def smooth_components(g: OrderGrid) -> DataFrame:
    """Connected areas of a raster of broad slanting belts, which run through many tiles."""
    belts = g.base_hours.where("base_hours IS NOT NULL").selectExpr(
        "row_no", "col_no", "cast((row_no + 2 * col_no) div 40 % 9 as double) as hours"
    )
    areas = polygonize(B.classify_bands(belts).drop("hours"), g.grid, "band", tile=SMALL)
    return areas.groupBy("band", "zone_id").agg(F.count(F.lit(1)).alias("cells"))


def zone_area(g: OrderGrid) -> DataFrame:
    """Area per raster and band, number of areas and the largest one."""
    size = g.grid.cell_area()
    per_zone = (
        zones(g)
        .groupBy("layer", "band", "zone_id")
        .agg((F.sum(F.col("c1") - F.col("c0")) * F.lit(size)).alias("area"))
    )
    per_band = per_zone.groupBy("layer", "band").agg(
        F.count(F.lit(1)).alias("zones"),
        F.round(F.sum("area"), 6).alias("area"),
        F.round(F.max("area"), 6).alias("largest"),
    )
    return O.name_layers(per_band, LAYERS)


def dissolve_boundary_lgu_to_province(g: OrderGrid) -> DataFrame:
    edges = g.lgu_edges.join(
        g.lgu_codes.select("id", "state"), "id"
    )
    return S.dissolve_edges(edges, ["state"])


def province_cell_boundary(g: OrderGrid) -> DataFrame:
    """Outline of each province from the spans of its units."""
    spans = rasterise(g.lgu_edges, g.grid, ["id"]).join(g.lgu_codes.select("id", "state"), "id")
    return S.span_boundary(merge_spans(spans, ["state"]), ["state"])


def zone_boundary(g: OrderGrid) -> DataFrame:
    return zone_outlines(band_spans(g))


def zone_outlines(spans: DataFrame) -> DataFrame:
    """Cells, outline length and number of straight outline segments of every dissolved zone."""
    keys = ["layer", "id", "band"]
    spans = stored(spans, "zones")  # read twice
    outline = (
        S.span_boundary(spans, keys)
        .groupBy(*keys)
        .agg(F.sum(F.col("c1") - F.col("c0")).alias("edges"), F.count(F.lit(1)).alias("segments"))
    )
    sizes = spans.groupBy(*keys).agg(F.sum(F.col("c1") - F.col("c0")).alias("cells"))
    return O.name_layers(sizes.join(outline, keys), LAYERS)


def segment_zone_boundary(g: OrderGrid, width: int = STRIP) -> DataFrame:
    """The dissolved zones once more, from rasters stored as row segments."""
    units = rasterise(g.lgu_edges, g.grid, ["id"])
    spans = segment_zones(
        layer_segments(g, width), units, ["layer"], "id", B.band_of, width
    ).where(F.col("band") > 0)
    return zone_outlines(spans)


def strip_zone_boundary(g: OrderGrid) -> DataFrame:
    return segment_zone_boundary(g, NARROW)


def overlay_parts(g: OrderGrid) -> DataFrame:
    """Unit cells inside and outside the catchments by overlay of two cell sets."""
    units = located(g).select("row_no", "col_no", "id", "pop")
    reached = O.dissolve(burn(covered(g)))
    inside = O.overlay(units, reached, "and").withColumn("part", F.lit("covered"))
    outside = O.overlay(units, reached, "not").withColumn("part", F.lit("uncovered"))
    return O.zonal_stats(inside.unionByName(outside), ["id", "part"])


def uncovered_boundary(g: OrderGrid, width: int = STRIP) -> DataFrame:
    """Outline of the uncovered part of each unit as straight segments on grid lines."""
    return S.span_boundary(gap_spans(g, width), ["id"])


def strip_uncovered_boundary(g: OrderGrid) -> DataFrame:
    return uncovered_boundary(g, NARROW)


def catch_final(g: OrderGrid) -> DataFrame:
    """Final table per unit from the uncovered layer with one row per connected part.

    Its merged geometry is shown by the area and the number of corners of its rings.
    """
    cells = located(g)
    free = K.uncovered_cells(cells, covered(g))
    layer = K.uncovered_population(free, adm2(g, cells))
    codes = g.lgu_codes.select("id", F.col("hlcit_code").alias("a_hlcit_code"))
    parts = (
        polygonize(free.select("row_no", "col_no", "id"), g.grid, "id")
        .select("id", "zone_id")
        .distinct()
        .join(codes, "id")
    )
    shapes = assemble_features(gap_spans(g), g.grid, ["id"]).join(codes, "id").drop("id")
    table = K.final_table(parts.select("a_hlcit_code", "zone_id").join(layer, "a_hlcit_code"))
    final = K.with_geometry(table, shapes)
    columns = [c for c in final.columns if c != "geometry"]
    path = new_path(g.spark, "final")
    V.write_geojson(final, path, columns, g.grid.srid)
    back = V.read_geojson(g.spark, path, T.StructType([final.schema[c] for c in columns]))
    measured = V.feature_edges(back, columns).groupBy(*columns)
    twice = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return measured.agg(
        F.round(F.sum(twice) / 2, 4).alias("area"), F.count(F.lit(1)).alias("corners")
    )


def geojson_features(g: OrderGrid, width: int = STRIP) -> DataFrame:
    """Uncovered features with statistics, written as GeoJSON, read back and measured."""
    grid = g.grid
    cells = gaps(g)
    shapes = assemble_features(gap_spans(g, width), grid, ["id"])
    stats = O.zonal_stats(cells, ["id"])
    codes = g.lgu_codes.select("id", "hlcit_code")
    features = shapes.join(stats, "id").join(codes, "id")
    path = new_path(g.spark, "features")
    columns = ["hlcit_code", "pop_sum", "pop_count"]
    V.write_geojson(features, path, columns, grid.srid)
    kinds = T.StructType([features.schema[c] for c in columns])
    back = V.read_geojson(g.spark, path, kinds)
    same_srid(grid, *back.agg(F.min("srid"), F.max("srid")).first())
    area = S.signed_area(V.feature_edges(back, ["hlcit_code"]), ["hlcit_code"])
    counted = back.groupBy("hlcit_code").agg(
        F.max("pop_sum").alias("pop_sum"),
        F.max("pop_count").alias("pop_count"),
        F.sum(F.size("coordinates")).alias("parts"),
    )
    return counted.join(area, "hlcit_code").withColumn("area", F.round("area", 4))


def strip_geojson_features(g: OrderGrid) -> DataFrame:
    return geojson_features(g, NARROW)


QUERIES = {
    f.__name__: f
    for f in (
        polygonize_components,
        tile_components,
        smooth_components,
        zone_area,
        dissolve_boundary_lgu_to_province,
        province_cell_boundary,
        zone_boundary,
        segment_zone_boundary,
        strip_zone_boundary,
        overlay_parts,
        uncovered_boundary,
        strip_uncovered_boundary,
        catch_final,
        geojson_features,
        strip_geojson_features,
    )
}


def _components(cells: str, group: str) -> str:
    """Views ``adj`` and ``cc`` labelling 4-connected cells of equal ``group`` columns."""
    same = " and ".join(f"n.{g} = b.{g}" for g in group.split(", "))
    at_a = " and ".join(f"a.{g} = cc.{g}" for g in group.split(", "))
    at_k = " and ".join(f"k.{g} = a.{g}" for g in group.split(", "))
    picked = ", ".join(f"a.{g}" for g in group.split(", "))
    columns = ", ".join(f"b.{g}" for g in group.split(", "))
    return (
        f"adj as (select {columns}, b.cell, n.cell as other from {cells} b join {cells} n on {same} and "
        "((n.row_no = b.row_no and abs(n.col_no - b.col_no) = 1) or (n.col_no = b.col_no and abs(n.row_no - b.row_no) = 1))),\n"
        f"cc({group}, cell, label) using key ({group}, cell) as (select {group}, cell, cell from {cells} "
        f"union (select {picked}, a.other, min(cc.label) from cc join adj a on {at_a} and a.cell = cc.cell "
        f"join recurring.cc k on {at_k} and k.cell = a.other where cc.label < k.label group by all))"
    )


def _with_components(cells_sql: str, group: str, body: str) -> str:
    marker = "select 'body'"
    text = with_views(f"{marker} from lab", lab=cells_sql)
    head = text[: text.rindex(marker)].rstrip()
    return "with recursive " + head[len("with ") :] + ",\n" + _components("lab", group) + "\n" + body


def _segments(cells: str, keys: str) -> str:
    """Unit edges that occur once, run together along their grid line."""
    sides = " union all ".join(
        f"select {keys}, '{side}' as side, {line} as line, {pos} as pos from ({cells}) c"
        for side, line, pos in (
            ("h", "row_no", "col_no"),
            ("h", "row_no + 1", "col_no"),
            ("v", "col_no", "row_no"),
            ("v", "col_no + 1", "row_no"),
        )
    )
    return (
        f"select {keys}, side, line, cast(min(pos) as int) as c0, cast(max(pos) + 1 as int) as c1 from "
        f"(select *, pos - row_number() over (partition by {keys}, side, line order by pos) as run from "
        f"(select {keys}, side, line, pos from ({sides}) e group by {keys}, side, line, pos having count(*) = 1) u) r "
        f"group by {keys}, side, line, run"
    )


_DISSOLVED = (
    "select b.season, b.fac_type, l.id, b.band, b.row_no, b.col_no from fx_band b join fx_lgu_cell l on l.cell = b.cell where b.band > 0"
)
_ZONES = "select season, fac_type, band, cell, row_no, col_no from fx_band where band > 0"
_SIZE = "(select cast(4 as double) * (cast(500 as double) / nrows) from fx_rows)"

ORACLE = {
    "polygonize_components": _with_components(
        _ZONES,
        "season, fac_type, band",
        "select season, fac_type, band, label as zone_id, count(*) as cells from cc group by all",
    ),
    "zone_area": _with_components(
        _ZONES,
        "season, fac_type, band",
        "select season, fac_type, band, count(*) as zones, round(sum(area), 6) as area, round(max(area), 6) as largest from "
        f"(select season, fac_type, band, label, count(*) * {_SIZE} as area from cc group by all) z group by all",
    ),
    "dissolve_boundary_lgu_to_province": with_views(
        "select state, x1, y1, x2, y2 from (select state, least((x1, y1), (x2, y2)) as s, greatest((x1, y1), (x2, y2)) as e, "
        "min(case when (x1, y1) < (x2, y2) then x1 else x2 end) as x1, min(case when (x1, y1) < (x2, y2) then y1 else y2 end) as y1, "
        "min(case when (x1, y1) < (x2, y2) then x2 else x1 end) as x2, min(case when (x1, y1) < (x2, y2) then y2 else y1 end) as y2, count(*) as n "
        "from fx_lgu_edge l join fx_adm2 a on a.id = l.id group by 1, 2, 3) t where n = 1"
    ),
    "province_cell_boundary": with_views(
        _segments("select a.state, c.row_no, c.col_no from fx_lgu_cell l join fx_cells c on c.cell = l.cell join fx_adm2 a on a.id = l.id", "state")
    ),
    "zone_boundary": with_views(
        "select season, fac_type, id, band, cells, edges, segments from "
        "(select season, fac_type, id, band, sum(c1 - c0)::bigint as edges, count(*) as segments from "
        f"({_segments(_DISSOLVED, 'season, fac_type, id, band')}) t group by season, fac_type, id, band) o "
        f"join (select season, fac_type, id, band, count(*) as cells from ({_DISSOLVED}) u group by all) n using (season, fac_type, id, band)"
    ),
    "segment_zone_boundary": with_views(
        "select season, fac_type, id, band, cells, edges, segments from "
        "(select season, fac_type, id, band, sum(c1 - c0)::bigint as edges, count(*) as segments from "
        f"({_segments(_DISSOLVED, 'season, fac_type, id, band')}) t group by season, fac_type, id, band) o "
        f"join (select season, fac_type, id, band, count(*) as cells from ({_DISSOLVED}) u group by all) n using (season, fac_type, id, band)"
    ),
    "overlay_parts": with_views(
        "select l.id, case when k.cell is null then 'uncovered' else 'covered' end as part, sum(c.pop) as pop_sum, count(c.pop) as pop_count "
        "from fx_lgu_cell l join fx_cells c on c.cell = l.cell left join (select distinct cell from fx_catch_cell) k on k.cell = l.cell group by 1, 2"
    ),
    "uncovered_boundary": with_views(_segments("select id, row_no, col_no from fx_uncovered", "id")),
    "catch_final": _with_components(
        "select u.id, u.cell, u.row_no, u.col_no, u.pop, a.hlcit_code, a.pop_sum from fx_uncovered u join fx_adm2 a on a.id = u.id",
        "id",
        "select a_hlcit_code, adm_pop, catch_pop, pc_uncov, parts, area, corners from "
        "(select hlcit_code as a_hlcit_code, avg(pop_sum) as adm_pop, avg(s) as catch_pop, avg(pc) as pc_uncov, count(*) as parts, "
        f"round(max(n) * {_SIZE}, 4) as area, cc_id from "
        "(select distinct cc.id as cc_id, label from cc) p join (select id, hlcit_code, pop_sum, sum(pop) as s, count(*) as n, "
        "case when pop_sum <> 0 then sum(pop) / pop_sum end as pc from lab group by id, hlcit_code, pop_sum) g on g.id = p.cc_id group by hlcit_code, cc_id) f "
        # a grid point is a corner where one or three of the four cells around it belong to the unit, two where opposite ones do
        "join (select id, sum(case when n in (1, 3) then 1 when n = 2 and d in (0, 2) then 2 else 0 end)::bigint as corners from "
        "(select id, r, c, count(*) as n, sum(k) as d from (select id, row_no + i as r, col_no + j as c, (i + j) % 2 as k "
        "from lab cross join (values (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j)) e group by id, r, c) v group by id) w on w.id = f.cc_id",
    ),
    "geojson_features": _with_components(
        "select u.id, u.cell, u.row_no, u.col_no, u.pop, a.hlcit_code from fx_uncovered u join fx_adm2 a on a.id = u.id",
        "id",
        "select hlcit_code, sum(pop) as pop_sum, count(pop) as pop_count, max(parts) as parts, "
        f"round(count(*) * {_SIZE}, 4) as area from lab join (select id, count(distinct label) as parts from cc group by id) p on p.id = lab.id group by hlcit_code",
    ),
}
ORACLE |= {
    "tile_components": ORACLE["polygonize_components"],
    "strip_zone_boundary": ORACLE["zone_boundary"],
    "strip_uncovered_boundary": ORACLE["uncovered_boundary"],
    "strip_geojson_features": ORACLE["geojson_features"],
    "smooth_components": _with_components(
        "select cell, row_no, col_no, case ((row_no + 2 * col_no) - (row_no + 2 * col_no) % 40) / 40 % 9 "
        "when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 4 when 4 then 4 else 5 end as band "
        "from fx_cells where base_hours is not null",
        "band",
        "select band, label as zone_id, count(*) as cells from cc group by all",
    ),
}
