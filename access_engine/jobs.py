"""The three runs from files to files.

``classify`` and ``catchments`` read rasters, population and polygon layers and leave result CSVs,
features and chart tables; ``statistics`` reads the result CSVs of all rasters and leaves summaries.
Every run covers all datasets of its input folder in one job. With ``update`` the first two read ``out``'s manifest
and compute the datasets whose input files came, went or changed since; if an input that all of them share changed,
all are computed anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from access_engine import config
from access_engine.functions import bands as B
from access_engine.operators import density as D
from access_engine.operators import summary as S
from access_engine.operators.grid import Grid, resample, same_srid
from access_engine.operators.prefix import running_sums, span_sums
from access_engine.operators.rings import assemble_features
from access_engine.operators.segments import segment_zones, to_cells, to_segments
from access_engine.operators.spans import merge_spans, rasterise
from access_engine.plans import catchment as K
from access_engine.plans import charts as H
from access_engine.plans import classification as C
from access_engine.plans import pooled as N
from access_engine.sources import features as V
from access_engine.sources import manifest as M
from access_engine.sources import rasters as W
from access_engine.sources import results as R
from access_engine.storage import leaves_nothing, stored

# properties of the two administrative layers and of a catchment layer
ADM2 = T.StructType(
    [
        T.StructField("hlcit_code", T.StringType()),
        T.StructField("lu_name", T.StringType()),
        T.StructField("sum", T.DoubleType()),
    ]
)
ADM1 = T.StructType(
    [T.StructField("state", T.StringType()), T.StructField("pop_sum", T.DoubleType())]
)
CATCHMENT = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("fac_type", T.StringType())]
)


def _layer(
    spark: SparkSession, path: str | list[str], kinds: T.StructType, grid: Grid
) -> DataFrame:
    layer = V.read_geojson(spark, path, kinds)
    low, high, known = layer.agg(F.min("srid"), F.max("srid"), F.count("srid")).first()
    if known:  # plain GeoJSON names no system and is taken as in the grid's
        same_srid(grid, low, high)
    return layer


def _population(
    spark: SparkSession, path: str, layout: str, grid: Grid, own: str | None
) -> DataFrame:
    """Population as row segments on ``grid``; ``own`` is the header of a raster on another grid."""
    people = W.read_population(spark, path, layout)
    header = W.read_grid(spark, own) if own else grid
    if header != grid:
        cells = to_cells(people, "pop") if layout == "segments" else people
        return to_segments(resample(cells, "pop", header, grid), "pop")
    return to_segments(people, "pop") if layout == "cells" else people


def one_row(layer: DataFrame, code: str) -> DataFrame:
    """Attributes of each unit; features of one unit that disagree on them stop the run."""

    def agreed(column: str):
        wrong = F.concat(F.lit(f"features of a unit disagree on {column}: "), F.col(code))
        return F.when(
            F.min(column).eqNullSafe(F.max(column)), F.min(column)
        ).otherwise(F.raise_error(wrong)).alias(column)

    return layer.groupBy(code).agg(*[agreed(c) for c in layer.columns if c != code])


def _units(
    spark: SparkSession, path: str, grid: Grid, level: str
) -> tuple[DataFrame, DataFrame, str]:
    """Edges and attribute table of an administrative layer, and its code column."""
    kinds, code = (ADM2, "hlcit_code") if level == "adm2" else (ADM1, "state")
    layer = _layer(spark, path, kinds, grid)
    # a unit may come as several features; they share its attributes
    attributes = layer.drop("coordinates", "srid", "feature").withColumnRenamed("sum", "pop_sum")
    table = one_row(attributes, code)
    return V.feature_edges(layer, [code]), table, code


@leaves_nothing
def classify(
    spark: SparkSession,
    rasters: str,
    population: str,
    units: str,
    grid: str,
    out: str,
    level: str = "adm2",
    layout: str = "cells",
    population_grid: str | None = None,
    update: bool = False,
) -> None:
    """Result CSV tree, dissolved features and bar chart tables of every raster.

    ``layout`` tells whether rasters and population are stored as ``cells`` or row ``segments``.
    Cells are turned into segments first, which is the only time they are shuffled. A population
    raster on a grid of its own, whose header ``population_grid`` names, is parted over the cells
    of ``grid``.
    ``out`` receives ``results/<season>/<dataset>_<level>.csv``, ``features`` and ``charts``, the last two in folders
    by season and facility type, and ``manifest``.
    """
    shared = {"population": population, "units": units, "grid": grid, "population_grid": population_grid}
    files = M.inputs(spark, f"classify {level}", shared)
    files = stored(files.unionByName(M.listing(spark, "rasters", rasters, C.DATASET)), "files")
    todo = M.work(spark, out, files, update)
    if todo.nothing:
        return
    folders = None
    if todo.datasets is not None:
        held = M.of_datasets(files, todo, C.DATASET).where("role = 'rasters'")
        folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
        folders = [r.folder for r in held.select(folder.alias("folder")).distinct().collect()]
    if folders == []:  # datasets only went
        _replace_datasets(spark, out, files, todo, level)
        M.commit(spark, out, files)
        return
    header = W.read_grid(spark, grid)
    edges, table, code = _units(spark, units, header, level)
    times = W.read_travel_time(spark, rasters, layout, folders)
    people = stored(_population(spark, population, layout, header, population_grid), "segments")
    if layout == "cells":
        times = stored(to_segments(times, "hours", C.DATASET), "segments")
    spans = stored(rasterise(edges, header, [code]), "spans")
    keys = ["season", "fac_type", code, "band"]
    cells = C.banded_segments(times, people, spans, code, C.DATASET)
    zones = segment_zones(times, spans, C.DATASET, code, B.band_of).where(F.col("band") > 0)
    sums = C.raster_band_population(cells, code)
    share = C.lgu_share if level == "adm2" else C.province_share
    result = stored(share(sums, table), "result")
    _replace_datasets(spark, out, files, todo, level)
    R.write_result_tree(result, f"{out}/results", level, todo.mode)

    shapes = assemble_features(zones, header, keys)
    features = shapes.withColumn("dissolve", B.dissolve_key(F.col(code), F.col("band")))
    own = "adm2_code" if level == "adm2" else "adm_code"
    described = features.withColumnsRenamed({code: own, "band": "trav_value"}).join(
        result, ["season", "fac_type", own, "trav_value"], "left"
    )
    columns = ["season", "fac_type", "dissolve", *result.columns[2:]]
    V.write_geojson(described, f"{out}/features", columns, header.srid, C.DATASET, todo.mode)

    chart = H.lgu_bands(result) if level == "adm2" else H.province_bands(result)
    H.write_chart_tables(chart, f"{out}/charts", C.DATASET, todo.mode)
    M.commit(spark, out, files)


def _replace_datasets(
    spark: SparkSession, out: str, files: DataFrame, todo: M.Work, level: str
) -> None:
    """Take the results that a classification run replaces off its manifest and its folders."""
    M.begin(spark, out, files, todo, C.DATASET)
    named = todo.table(spark, C.DATASET) if todo.datasets is not None else None
    tree = R.result_folders(named, level) if named is not None else None
    M.clear(spark, f"{out}/results", todo, tree)
    for folder in ("features", "charts"):
        M.clear(spark, f"{out}/{folder}", todo, named)


@leaves_nothing
def catchments(
    spark: SparkSession,
    layer: str,
    population: str,
    units: str,
    grid: str,
    out: str,
    layout: str = "cells",
    population_grid: str | None = None,
    update: bool = False,
) -> None:
    """Uncovered features and tables: of all catchments together and per facility type.

    ``layout`` tells whether the population is stored as ``cells`` or row ``segments``, and
    ``population_grid`` names its header where it is not ``grid``.
    ``out`` receives ``uncovered`` (features), ``coverage`` (CSV), by facility type ``uncovered_by_facility``,
    ``covered_by_facility`` (CSV) and the merged spans ``covered`` of its catchments (Parquet), and ``manifest``. An
    update reads the files of the facility types that changed; what all catchments leave together follows from the
    merged spans of all types.
    """
    keys = ["fac_type"]
    shared = {"population": population, "units": units, "grid": grid, "population_grid": population_grid}
    files = stored(
        M.inputs(spark, "catchments", shared).unionByName(_typed_files(spark, layer, M.last(spark, out))), "files"
    )
    todo = M.work(spark, out, files, update)
    if todo.nothing:
        return
    header = W.read_grid(spark, grid)
    edges, table, _ = _units(spark, units, header, "adm2")
    codes = table.withColumn("id", F.col("hlcit_code"))
    unit_spans = stored(
        rasterise(edges.withColumnRenamed("hlcit_code", "id"), header, ["id"]), "unit_spans"
    )
    people = _population(spark, population, layout, header, population_grid)
    running = stored(running_sums(people, "pop", header), "running_sums")
    source: str | list[str] = layer
    if todo.datasets is not None:
        held = M.of_datasets(files, todo, keys).where("role = 'layer'").select("path").distinct()
        source = [M.plain_path(f"{layer}/{r.path}" if r.path else layer) for r in held.collect()]
    types = spark.createDataFrame([], "fac_type string")
    if source:
        areas = _layer(spark, source, CATCHMENT, header)
        if todo.datasets is not None:
            wanted = todo.table(spark, ["wanted"])
            areas = areas.join(wanted, F.col("fac_type").eqNullSafe(F.col("wanted")), "left_semi")
        types = stored(areas.select("fac_type").distinct(), "types")
        outlines = V.feature_edges(areas, ["fac_type", "feature"])
        per_type = stored(K.coverage(outlines, header, keys, ["feature"]), "coverage")

    M.begin(spark, out, files, todo, keys)
    named = todo.table(spark, keys) if todo.datasets is not None else None
    for folder in ("covered", "uncovered_by_facility", "covered_by_facility"):
        M.clear(spark, f"{out}/{folder}", todo, named)
    for folder in ("uncovered", "coverage"):
        M.clear(spark, f"{out}/{folder}", todo)
    if source:
        spans = per_type.repartitionByRange("fac_type", "row_no")
        spans.write.mode(todo.mode).partitionBy(*keys).parquet(f"{out}/covered")
        inside = stored(K.covered_spans(unit_spans, per_type, keys), "covered_spans")
        R.write_csv(
            K.uncovered_by_spans(unit_spans, inside, running, codes, types),
            f"{out}/uncovered_by_facility", keys, todo.mode,
        )
        R.write_csv(
            K.covered_by_spans(inside, running, codes, types), f"{out}/covered_by_facility", keys, todo.mode
        )

    every_type = spark.read.schema("row_no int, c0 int, c1 int").parquet(f"{out}/covered")
    together = stored(merge_spans(every_type), "coverage")
    free = stored(K.uncovered_spans(unit_spans, together, header), "free")
    gaps = stored(K.uncovered_by_outline(free, running, codes), "gaps")
    shapes = assemble_features(free, header, ["id"])
    final = shapes.join(gaps.withColumnRenamed("a_hlcit_code", "id"), "id").select(
        F.col("id").alias("a_hlcit_code"),
        "adm_pop",
        F.col("catch_pop_sum").alias("catch_pop"),
        "pc_uncov",
        "geometry",
    )
    columns = ["a_hlcit_code", "adm_pop", "catch_pop", "pc_uncov"]
    V.write_geojson(final, f"{out}/uncovered", columns, header.srid)
    totals = span_sums(unit_spans, running, ["id"]).withColumnRenamed("id", "hlcit_code")
    every = codes.select("hlcit_code").join(totals, "hlcit_code", "left")
    R.write_csv(K.covered_split(gaps, every), f"{out}/coverage")
    M.commit(spark, out, files)


def _typed_files(spark: SparkSession, layer: str, before: DataFrame | None) -> DataFrame:
    """Manifest rows of a catchment layer: a row per file and facility type in it.

    Files that ``before`` holds unchanged are not opened. A file without features has the type NULL.
    """
    files = M.listing(spark, "layer", layer).drop("dataset")
    state = ["path", "length", "modified"]
    old = before.where("role = 'layer'") if before is not None else None
    known = files.join(old.select(*state, "dataset"), state) if old is not None else None
    new = stored(files.join(old, state, "left_anti") if old is not None else files, "new_files")
    # the paths of files to read, which the driver lists anyway
    paths = [M.plain_path(f"{layer}/{r.path}" if r.path else layer) for r in new.select("path").collect()]
    if paths:
        lines = spark.read.schema("properties struct<fac_type: string>").json(paths)
        found = lines.select(
            M.below(spark, layer, F.col("_metadata.file_path"), encoded=True).alias("path"),
            F.array("properties.fac_type").alias("dataset"),
        ).distinct()
        empty = F.array(F.lit(None).cast("string"))
        typed = new.join(found, "path", "left").withColumn("dataset", F.coalesce("dataset", empty))
        known = typed if known is None else known.unionByName(typed, allowMissingColumns=True)
    elif known is None:
        known = files.withColumn("dataset", F.lit(None).cast("array<string>"))
    return known.select(F.lit("layer").alias("role"), *state, "dataset")


@leaves_nothing
def statistics(spark: SparkSession, results: str, lookup: str, out: str) -> None:
    """Summaries, season comparisons, chart tables and density curves of pooled results."""
    zones = R.read_csv(spark, lookup, config.ZONE_LOOKUP)
    final = stored(N.final_frame(N.pool(R.read_results(spark, results), zones)), "final")
    complete = stored(N.complete_rows(final), "complete")
    summary = stored(S.summarise_all(complete), "summary")
    R.write_csv(R.in_order(summary, *H.category_order(summary.columns)), f"{out}/summary")
    for level in ("nation", "province", "zone"):
        table = S.one_level(summary, level)
        keys = S.LEVELS[level][0]
        H.write_chart_tables(
            H.level_bars(table, level), f"{out}/charts/{level}", [*keys, "season", "fac_type"]
        )
        H.write_chart_tables(
            H.level_comparison(table, level), f"{out}/charts/{level}_seasons", [*keys, "fac_type"]
        )
    seasons = final.where(F.col("season").isin(config.NON_WALKING))
    normal = final.where((F.col("season") == config.NORMAL) & F.col("geog").isNotNull())
    for rows, panel, name in ((seasons, "season", "season"), (normal, "geog", "zone")):
        curves = D.density(rows, ["fac_type", panel], "trav_cat", "pc_pop")
        H.write_chart_tables(curves, f"{out}/ridges/{name}", ["fac_type"])
        lines = D.quantile_lines(rows, ["fac_type", panel], "trav_cat", "pc_pop")
        H.write_chart_tables(lines, f"{out}/ridges/{name}_quartiles", ["fac_type"])
    labels = H.zone_labels(final.where(F.col("season") == config.NORMAL))
    R.write_csv(R.in_order(labels, "fac_type", "geog_order", "geog"), f"{out}/ridges/zone_labels")
    R.write_csv(H.ridge_headings(seasons, "LGU comparison"), f"{out}/ridges/season_headings")
    R.write_csv(
        H.ridge_headings(normal, "Physiogeographic LGU comparison"), f"{out}/ridges/zone_headings"
    )
