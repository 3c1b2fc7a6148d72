"""Travel-time classification: bands, overlay with units, population shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from access_engine.config import STRIP
from access_engine.functions import bands as B
from access_engine.operators import overlay as O
from access_engine.operators.grid import Grid, align, resample
from access_engine.operators.prefix import running_sums, span_sums
from access_engine.operators.segments import by_layer, segment_zones, to_segments
from access_engine.operators.spans import overlay_spans, rasterise
from access_engine.plans import classification as C
from checks.fixture_sql import BAND_CASE, with_views
from checks.order_grid import LAYERS, OrderGrid


def located(g: OrderGrid) -> DataFrame:
    """Population cells with their unit id."""
    return C.unit_cells(g.population, g.lgu_edges, g.grid)


def adm2(g: OrderGrid, cells: DataFrame) -> DataFrame:
    """Unit dimension; unit 23 is given population 0."""
    return C.unit_dimension(cells, g.lgu_codes).select(
        "id",
        "hlcit_code",
        "lu_name",
        "state",
        F.when(F.col("id") == 23, F.lit(0.0)).otherwise(F.col("pop_sum")).alias("pop_sum"),
    )


def adm1(units: DataFrame) -> DataFrame:
    return units.groupBy("state").agg(F.sum("pop_sum").alias("pop_sum"))


def share_table(g: OrderGrid) -> DataFrame:
    """LGU result of all 32 rasters with its season and facility codes."""
    return C.lgu_share(unit_bands(g), g.lgu_codes, "id")


def unit_bands(g: OrderGrid) -> DataFrame:
    """Population per raster, unit and band, with that of the unit; unit 23 is given population 0."""
    sums = C.band_population_and_total(located(g), g.stack, "id", LAYERS)
    return sums.withColumn("pop_sum", F.when(F.col("id") == 23, F.lit(0.0)).otherwise(F.col("pop_sum")))


def band_classify(g: OrderGrid) -> DataFrame:
    cells = B.classify_bands(O.unstack(g.stack, "cell"))
    return O.name_layers(cells, LAYERS).select(
        "season", "fac_type", "cell", "hours", "band", B.band_label(F.col("band")).alias("trav_cat")
    )


def band_cell_histogram(g: OrderGrid) -> DataFrame:
    cells = B.classify_bands(O.unstack(g.stack, "cell"))
    counts = cells.groupBy("layer", "band").agg(F.count("hours").alias("cells"))
    return O.name_layers(counts, LAYERS)


def cells_in_lgu(g: OrderGrid) -> DataFrame:
    return located(g).select("cell", "id")


def grid_align_pop(g: OrderGrid) -> DataFrame:
    """Population points summed on a travel-time grid of another resolution and extent."""
    fine = g.grid
    coarse = Grid(10.0, 490.0, 16.0, 15.0, 29, 31)
    points = g.population.select(
        "pop", fine.x_centre(F.col("col_no")).alias("x"), fine.y_centre(F.col("row_no")).alias("y")
    )
    return O.zonal_stats(align(points, coarse), ["row_no", "col_no"])


def grid_resample_pop(g: OrderGrid) -> DataFrame:
    """Population parted by area over the cells of a grid of another resolution and extent."""
    other = Grid(-6.0, 497.0, 7.0, 9.0, 70, 60)
    return resample(g.population, "pop", g.grid, other).withColumn("pop", F.round("pop", 6))


def overlay_union_or(g: OrderGrid) -> DataFrame:
    """Full overlay of units and zones: unit cells without a zone and the reverse are kept."""
    units = located(g).select("row_no", "col_no", "id", "pop")
    layers = g.stack.select("row_no", "col_no", "hours")
    cells = O.unstack(O.overlay(units, layers, "or"), "id", "pop")
    band = B.band_of(F.col("hours")).alias("band")
    zones = (
        cells.groupBy("layer", "id", band)
        .agg(F.count(F.lit(1)).alias("cells"), F.sum("pop").alias("pop_sum"))
        .withColumn("dissolve", B.dissolve_key(F.col("id").cast("string"), F.col("band")))
    )
    return O.name_layers(zones, LAYERS)


def layer_segments(g: OrderGrid, width: int = STRIP) -> DataFrame:
    """Row segments of all travel-time layers; the layers are parted after the cells are gathered."""
    return O.unstack(by_layer(to_segments(g.row_stack, "hours", width=width), "hours"), "row_no", "strip")


def span_overlay_or(g: OrderGrid, width: int = STRIP) -> DataFrame:
    """The full overlay once more, of span layers: one sweep per raster row, sums from running sums."""
    times = layer_segments(g, width)
    rows = g.spark.range(g.grid.nrows).select(F.lit(0).alias("all"), F.col("id").cast("int").alias("row_no"))
    rows = rows.select("*", F.lit(0).alias("c0"), F.lit(g.grid.ncols).alias("c1"))
    # all sides are dealt by raster row, so that what is swept along a row stays in its task
    zones = segment_zones(times, g.by_rows(rows), ["layer"], "all", B.band_of, width).drop("all")
    layers = g.spark.range(len(LAYERS)).select(F.col("id").cast("int").alias("layer"))
    units = g.by_rows(rasterise(g.lgu_edges, g.grid, ["id"])).crossJoin(layers)
    pieces = overlay_spans(units, zones, "or", ["layer"])
    sums = running_sums(to_segments(g.population, "pop", width=width), "pop", g.grid, width)
    found = span_sums(pieces, sums, ["layer", "id", "band"], width=width).where("pop_count > 0")
    counted = found.select(
        "layer",
        "id",
        "band",
        F.col("pop_count").alias("cells"),
        F.when(F.col("id").isNotNull(), F.col("pop_sum")).alias("pop_sum"),
        B.dissolve_key(F.col("id").cast("string"), F.col("band")).alias("dissolve"),
    )
    return O.name_layers(counted, LAYERS)


def strip_span_overlay_or(g: OrderGrid) -> DataFrame:
    return span_overlay_or(g, 16)


def overlay_key_dissolve(g: OrderGrid) -> DataFrame:
    """Overlay, drop rows lacking either key part, dissolve by key, read the key back."""
    cells = O.overlay(
        located(g).select("row_no", "col_no", "id"),
        g.stack.select("row_no", "col_no", "hours"),
        "or",
    )
    banded = O.unstack(cells, "id").withColumn("band", B.band_of(F.col("hours")))
    zones = (
        banded.where(F.col("id").isNotNull() & F.col("band").isNotNull())
        .groupBy("layer", "id", "band")
        .agg(F.count(F.lit(1)).alias("cells"))
        .join(g.lgu_codes.select("id", "hlcit_code"), "id")
    )
    key = F.col("dissolve")
    return O.name_layers(zones, LAYERS).select(
        "season",
        "fac_type",
        B.dissolve_key(F.col("hlcit_code"), F.col("band")).alias("dissolve"),
        "cells",
    ).select(
        "*",
        B.key_adm2(key).alias("adm2_code"),
        B.key_province(key).alias("province"),
        B.key_band(key).alias("trav_value"),
    )


def category_numbers(g: OrderGrid) -> DataFrame:
    """The overlay reclassed: every (unit, band) as a dense number, with its cells of all rasters."""
    cells = O.overlay(located(g).select("row_no", "col_no", "id"), g.stack.select("row_no", "col_no", "hours"), "and")
    banded = O.unstack(cells, "id").withColumn("band", B.band_of(F.col("hours")))
    zones = banded.groupBy("id", "band").agg(F.count(F.lit(1)).alias("cells"))
    numbers = O.numbered_categories(zones, ["id", "band"])
    same = zones["id"].eqNullSafe(numbers["id"]) & zones["band"].eqNullSafe(numbers["band"])
    return zones.join(numbers, same).select(zones["id"], zones["band"], "cells", "category")


def zonal_sum_count(g: OrderGrid) -> DataFrame:
    return O.zonal_stats(located(g), ["id"])


def prefix_zonal_sum(g: OrderGrid, width: int = STRIP) -> DataFrame:
    """Sums and counts of the units from running sums along raster rows; no cell meets a unit."""
    sums = running_sums(to_segments(g.population, "pop", width=width), "pop", g.grid, width)
    return span_sums(rasterise(g.lgu_edges, g.grid, ["id"]), sums, ["id"], width=width)


def strip_prefix_zonal_sum(g: OrderGrid) -> DataFrame:
    return prefix_zonal_sum(g, 16)


def lgu_band_share(g: OrderGrid) -> DataFrame:
    return share_table(g)


def segment_band_share(g: OrderGrid, width: int = STRIP) -> DataFrame:
    """The LGU result again, from rasters and population stored as row segments."""
    times = layer_segments(g, width)
    people = to_segments(g.population, "pop", width=width)
    units = rasterise(g.lgu_edges, g.grid, ["id"])
    cells = C.banded_segments(times, people, units, "id", ["layer"], width)
    within = C.unit_cells(g.population, g.lgu_edges, g.grid, width=width)
    return C.lgu_share(C.band_population(cells, "id", LAYERS), adm2(g, within), "id")


def strip_band_share(g: OrderGrid) -> DataFrame:
    """The same over strips of 16 columns, several of which a unit's row spans."""
    return segment_band_share(g, 16)


def province_band_share(g: OrderGrid) -> DataFrame:
    cells = located(g)
    units = adm2(g, cells)
    per_unit = C.band_population(C.banded_cells(cells, g.stack), "id", LAYERS)
    per_state = (
        per_unit.join(g.lgu_codes.select("id", "state"), "id")
        .groupBy("season", "fac_type", "state", "trav_value")
        .agg(F.sum("cat_pop").alias("cat_pop"))
    )
    return C.province_share(per_state, adm1(units))


def share_decimal_percent(g: OrderGrid) -> DataFrame:
    shares = share_table(g)
    percent = B.share_percent_decimal(F.col("cat_pop"), F.col("adm_pop"))
    return shares.select(
        "season", "fac_type", "adm2_code", "trav_value", percent.cast("double").alias("pc_pop")
    )


def lgu_left_lookup(g: OrderGrid) -> DataFrame:
    """Zones looked up in a unit table that lacks province 2: its rows stay, with NULLs."""
    cells = located(g)
    units = adm2(g, cells).where(F.col("state") != "2")
    per_unit = C.band_population(C.banded_cells(cells, g.stack), "id", LAYERS)
    keyed = per_unit.join(g.lgu_codes.select("id", "hlcit_code"), "id").drop("id")
    return C.lgu_share(keyed, units)


QUERIES = {
    f.__name__: f
    for f in (
        band_classify,
        band_cell_histogram,
        cells_in_lgu,
        grid_align_pop,
        grid_resample_pop,
        overlay_union_or,
        span_overlay_or,
        strip_span_overlay_or,
        overlay_key_dissolve,
        category_numbers,
        zonal_sum_count,
        prefix_zonal_sum,
        strip_prefix_zonal_sum,
        lgu_band_share,
        segment_band_share,
        strip_band_share,
        province_band_share,
        share_decimal_percent,
        lgu_left_lookup,
    )
}

_RESULT = "season, fac_type, adm_name, adm2_code, province, trav_value, trav_cat, adm_pop, cat_pop, pc_pop"

ORACLE = {
    "band_classify": with_views(
        f"select season, fac_type, cell, hours, {BAND_CASE} as band, "
        "case when b = 1 then '0 to 30 minutes' when b = 2 then '30 minutes to 1 hour' "
        "when b = 3 then '1 to 2 hours' when b = 4 then '2 to 4 hours' when b = 5 then '4 to 8 hours' "
        "when b = 6 then '8 to 16 hours' when b = 7 then '16 to 32 hours' when b = 8 then '> 32 hours' end as trav_cat "
        f"from (select *, {BAND_CASE} as b from fx_ct where hours is not null) t"
    ),
    "band_cell_histogram": with_views(
        "select season, fac_type, band, count(*) as cells from fx_band group by season, fac_type, band"
    ),
    "cells_in_lgu": with_views("select cell, id from fx_lgu_cell"),
    "grid_align_pop": with_views(
        "select cast(floor((490.0::double - y) / 15.0::double) as int) as row_no, "
        "cast(floor((x - 10.0::double) / 16.0::double) as int) as col_no, sum(pop) as pop_sum, count(pop) as pop_count "
        "from fx_cells where floor((490.0::double - y) / 15.0::double) between 0 and 30 "
        "and floor((x - 10.0::double) / 16.0::double) between 0 and 28 group by 1, 2"
    ),
    "grid_resample_pop": with_views(
        "select row_no, col_no, round(sum(pop * w * h), 6) as pop from ("
        "select pop, t.i as col_no, (least(x0 + 4::double, (t.i + 1) * 7::double - 6) - greatest(x0, t.i * 7::double - 6)) / 4::double as w, "
        "u.i as row_no, (least(y1, 497 - u.i * 9::double) - greatest(y1 - 500::double / nrows, 497 - (u.i + 1) * 9::double)) / (500::double / nrows) as h "
        "from (select pop, col_no * 4::double as x0, 500::double - f.row_no * (500::double / nrows) as y1, nrows from fx_cells f cross join fx_rows) c "
        "join (select i::int as i from range(70) r(i)) t on x0 < (t.i + 1) * 7::double - 6 and x0 + 4 > t.i * 7::double - 6 "
        "join (select i::int as i from range(60) r(i)) u on y1 > 497 - (u.i + 1) * 9::double and y1 - 500::double / nrows < 497 - u.i * 9::double) p "
        "where w > 0 and h > 0 group by row_no, col_no"
    ),
    "overlay_union_or": with_views(
        "select season, fac_type, id, band, count(*) as cells, sum(pop) as pop_sum, "
        "cast(id as varchar) || '_' || cast(band as varchar) as dissolve "
        "from (select coalesce(u.season, z.season) as season, coalesce(u.fac_type, z.fac_type) as fac_type, u.id, z.band, u.pop "
        "from (select l.cell, l.id, c.pop, season, fac_type from fx_lgu_cell l join fx_cells c on c.cell = l.cell cross join fx_season cross join fx_fac) u "
        "full join fx_band z on z.cell = u.cell and z.season = u.season and z.fac_type = u.fac_type) t "
        "group by season, fac_type, id, band"
    ),
    "overlay_key_dissolve": with_views(
        "select season, fac_type, dissolve, count(*) as cells, left(dissolve, 14) as adm2_code, "
        "substring(dissolve, 5, 1) as province, cast(right(dissolve, 1) as int) as trav_value "
        "from (select season, fac_type, hlcit_code || '_' || cast(band as varchar) as dissolve from fx_band b "
        "join fx_lgu_cell l on l.cell = b.cell join fx_adm2 a on a.id = l.id) t where dissolve is not null "
        "group by season, fac_type, dissolve"
    ),
    "category_numbers": with_views(
        "select id, band, count(*) as cells, dense_rank() over (order by id nulls first, band nulls first) as category "
        "from (select l.id, z.band from fx_lgu_cell l join (select c.cell, b.band from fx_cells c cross join fx_season s cross join fx_fac f "
        "left join fx_band b on b.cell = c.cell and b.season = s.season and b.fac_type = f.fac_type) z on z.cell = l.cell) t group by id, band"
    ),
    "zonal_sum_count": with_views(
        "select id, sum(pop) as pop_sum, count(pop) as pop_count from fx_cells c join fx_lgu_cell l on l.cell = c.cell group by id"
    ),
    "lgu_band_share": with_views(f"select {_RESULT} from fx_labelled"),
    "segment_band_share": with_views(f"select {_RESULT} from fx_labelled"),
    "strip_band_share": with_views(f"select {_RESULT} from fx_labelled"),
    "province_band_share": with_views("select * from fx_province_share"),
    "share_decimal_percent": with_views(
        "select season, fac_type, adm2_code, trav_value, cast(try_cast(case when adm_pop > 0 then cat_pop / adm_pop * cast(100 as double) end as decimal(5,4)) as double) as pc_pop from fx_share"
    ),
    "lgu_left_lookup": with_views(
        "select season, fac_type, case when province <> '2' then adm_name end as adm_name, adm2_code, province, trav_value, trav_cat, "
        "case when province <> '2' then adm_pop end as adm_pop, cat_pop, case when province <> '2' then pc_pop end as pc_pop from fx_labelled"
    ),
}
ORACLE |= {n: ORACLE["zonal_sum_count"] for n in ("prefix_zonal_sum", "strip_prefix_zonal_sum")}
ORACLE |= {n: ORACLE["overlay_union_or"] for n in ("span_overlay_or", "strip_span_overlay_or")}
