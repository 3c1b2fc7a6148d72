"""The runs from files to files give what the registered queries give."""

import os
import shutil
from pathlib import Path

import pytest
from conftest import plan_of
from pyspark.sql import functions as F
from pyspark.sql import types as T

from access_engine import __main__ as cli
from access_engine import config, jobs
from access_engine.operators import boundary as S
from access_engine.operators.grid import Grid
from access_engine.operators.overlay import name_layers, unstack
from access_engine.operators.segments import segment_cells, to_segments
from access_engine.operators.spans import burn, rasterise
from access_engine.sources import features as V
from access_engine.sources import manifest as M
from access_engine.sources import rasters as W
from access_engine.sources import results as R
from access_engine.storage import shared_folder
from checks import QUERIES
from checks.classification import adm1, adm2, located
from checks.order_grid import LAYERS, OrderGrid

FOLDER = "/root/testdata/sf0.001"


def ring_text(edges, keys):
    """Edges in ring order -> MultiPolygon text (one ring per feature)."""
    points = F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "x1", "y1"))), lambda p: F.array(p["x1"], p["y1"])
    )
    closed = F.concat(F.col("ring"), F.slice("ring", 1, 1))
    return (
        edges.groupBy(*keys)
        .agg(points.alias("ring"))
        .withColumn("geometry", F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), F.to_json(closed), F.lit("]]}")))
        .drop("ring")
    )


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("inputs"))
    g = OrderGrid(spark, FOLDER)
    W.write_grid(spark, g.grid, f"{root}/grid")
    W.write_sorted(g.population.select("row_no", "col_no", "pop"), f"{root}/population")
    long = name_layers(unstack(g.stack, "row_no", "col_no"), LAYERS)
    W.write_sorted(long, f"{root}/rasters", ["season", "fac_type"])
    units = adm2(g, located(g))
    shapes = ring_text(g.lgu_edges, ["id"])
    V.write_geojson(
        shapes.join(units.withColumnRenamed("pop_sum", "sum"), "id"),
        f"{root}/units", ["hlcit_code", "lu_name", "sum"], g.grid.srid,
    )
    V.write_geojson(
        ring_text(g.catchment_edges, ["id", "fac_type"]), f"{root}/catchments", ["id", "fac_type"], g.grid.srid
    )
    # provinces are not adjacent blocks here, so each is written as the parts it consists of
    parts = shapes.join(g.lgu_codes.select("id", "state"), "id").join(adm1(units), "state")
    V.write_geojson(parts, f"{root}/provinces", ["state", "pop_sum"], g.grid.srid)
    R.write_csv(g.zone_lookup, f"{root}/lookup")
    return root


def run(*words):
    cli.main([str(w) for w in words])


def stored_tables(spark):
    folder = Path(shared_folder(spark).removeprefix("file:")) / "access_engine"
    return {p.name for p in folder.iterdir()} if folder.exists() else set()


def rows_of(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def classified(spark, inputs, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("classified"))
    run(
        "classify", "--rasters", f"{inputs}/rasters", "--population", f"{inputs}/population",
        "--units", f"{inputs}/units", "--grid", f"{inputs}/grid", "--out", out,
    )
    return out


def test_classify(spark, classified):
    want = QUERIES["lgu_band_share"](spark, FOLDER)
    got = R.read_results(spark, f"{classified}/results")
    assert rows_of(got, want.columns) == rows_of(want, want.columns)
    kinds = T.StructType([T.StructField("dissolve", T.StringType()), T.StructField("season", T.StringType()),
                          T.StructField("fac_type", T.StringType()), T.StructField("cat_pop", T.DoubleType())])
    features = V.read_geojson(spark, f"{classified}/features", kinds)
    assert features.count() == want.count()
    # the drawn features cover each cell of bands 1 to 8 of each raster once
    g = OrderGrid(spark, FOLDER)
    keys = ["season", "fac_type", "dissolve"]
    cells = burn(rasterise(V.feature_edges(features, keys), g.grid, keys))
    histogram = QUERIES["band_cell_histogram"](spark, FOLDER).where("band > 0")
    assert cells.count() == histogram.agg(F.sum("cells")).first()[0]
    assert cells.count() == cells.select("season", "fac_type", "row_no", "col_no").distinct().count()
    charts = spark.read.parquet(f"{classified}/charts")
    assert charts.count() == want.count()
    # files of a dataset, read one after the other by name, hold its rows in the order of code and band
    for dataset in Path(classified, "results").glob("*/*"):
        lines = [line.split(",") for file in sorted(dataset.glob("part-*")) for line in file.read_text().splitlines()]
        head = lines[0]
        keys = [(r[head.index("adm2_code")], int(r[head.index("trav_value")])) for r in lines if r != head]
        assert keys == sorted(keys) and len(keys) == len(set(keys)) > 0
    one = next(Path(classified, "charts").glob("*/*"))
    shown = [r for file in sorted(one.glob("part-*")) for r in spark.read.parquet(str(file)).select("adm2_code", "trav_value").collect()]
    assert shown == sorted(shown)


def test_classify_row_segments(spark, inputs, classified, tmp_path):
    """The same rasters stored as row segments give the same results and features."""
    times = W.read_travel_time(spark, f"{inputs}/rasters").where("hours is not null")
    people = W.read_population(spark, f"{inputs}/population")
    W.write_sorted(to_segments(times, "hours", ["season", "fac_type"]), f"{tmp_path}/t", ["season", "fac_type"])
    W.write_sorted(to_segments(people, "pop"), f"{tmp_path}/p")
    run(
        "classify", "--rasters", f"{tmp_path}/t", "--population", f"{tmp_path}/p", "--units", f"{inputs}/units",
        "--grid", f"{inputs}/grid", "--out", f"{tmp_path}/out", "--layout", "segments",
    )
    want = QUERIES["lgu_band_share"](spark, FOLDER)
    got = R.read_results(spark, f"{tmp_path}/out/results")
    assert rows_of(got, want.columns) == rows_of(want, want.columns)
    kinds = T.StructType([T.StructField(n, T.StringType()) for n in ("season", "fac_type", "dissolve")])
    sides = [V.read_geojson(spark, f"{root}/features", kinds) for root in (classified, f"{tmp_path}/out")]
    areas = [S.signed_area(V.feature_edges(f, kinds.names), kinds.names) for f in sides]
    mine, theirs = ({tuple(r)[:3]: r.area for r in a.collect()} for a in areas)
    assert mine.keys() == theirs.keys() and all(mine[k] == pytest.approx(theirs[k]) for k in mine)


def test_segments_hold_every_cell(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 5, 2.0), (0, 9, None), (3, 4, 7.0)], "row_no int, col_no int, pop double")
    rows = {(r.row_no, r.strip): r.pop for r in to_segments(cells, "pop", width=4).collect()}
    assert rows == {(0, 0): [1.0, None, None, None], (0, 1): [None, 2.0, None, None],
                    (0, 2): [None] * 4, (3, 1): [7.0, None, None, None]}
    spans = spark.createDataFrame([(1, 0, 0, 6), (2, 0, 6, 12), (1, 3, 2, 5)], "id int, row_no int, c0 int, c1 int")
    seg = to_segments(cells, "pop", width=4)
    both = segment_cells(seg.withColumnRenamed("pop", "hours").withColumn("d", F.lit(0)), seg, spans, ["d"], "id", 4)
    assert {(r.id, r.row_no, r.col_no, r.pop) for r in both.collect()} == {(1, 0, 0, 1.0), (1, 0, 5, 2.0), (1, 3, 4, 7.0)}


@pytest.mark.parametrize("columns", [[0, 0], [0, 0, 2]])  # the latter has as many rows as places
def test_a_cell_twice_is_refused(spark, columns):
    cells = spark.createDataFrame([(7, c, 1.0) for c in columns], "row_no int, col_no int, pop double")
    with pytest.raises(Exception, match="row 7 holds a cell twice"):
        to_segments(cells, "pop", width=4).collect()


def test_classify_provinces(spark, inputs, tmp_path):
    before = stored_tables(spark)
    run(
        "classify", "--rasters", f"{inputs}/rasters", "--population", f"{inputs}/population", "--units",
        f"{inputs}/provinces", "--grid", f"{inputs}/grid", "--out", tmp_path, "--level", "adm1",
    )
    assert stored_tables(spark) == before  # the run leaves none of its own
    want = QUERIES["province_band_share"](spark, FOLDER)
    got = R.read_results(spark, f"{tmp_path}/results", config.PROVINCE_RESULT)
    columns = [c for c in want.columns if c not in ("season", "fac_type")]
    names = ["season", "fac_type", *columns]
    assert rows_of(got, names) == rows_of(want, names)


@pytest.mark.parametrize("layout", ["cells", "segments"])
def test_catchments(spark, inputs, tmp_path, layout):
    people = f"{inputs}/population"
    if layout == "segments":
        W.write_sorted(to_segments(W.read_population(spark, people), "pop"), f"{tmp_path}/p")
        people = f"{tmp_path}/p"
    run(
        "catchments", "--layer", f"{inputs}/catchments", "--population", people, "--layout", layout,
        "--units", f"{inputs}/units", "--grid", f"{inputs}/grid", "--out", tmp_path,
    )
    want = QUERIES["catch_uncovered"](spark, FOLDER)
    kinds = T.StructType([T.StructField("a_hlcit_code", T.StringType()), T.StructField("adm_pop", T.DoubleType()),
                          T.StructField("catch_pop", T.DoubleType()), T.StructField("pc_uncov", T.DoubleType())])
    got = V.read_geojson(spark, f"{tmp_path}/uncovered", kinds)
    assert rows_of(got, kinds.names) == rows_of(want, want.columns)
    for folder, query in (("coverage", "catch_covered_split"), ("covered_by_facility", "catch_by_facility"),
                          ("uncovered_by_facility", "catch_uncovered_by_facility")):
        expected = QUERIES[query](spark, FOLDER)
        back = R.read_csv(spark, f"{tmp_path}/{folder}", expected.schema)
        assert rows_of(back, expected.columns) == rows_of(expected, expected.columns)


@pytest.mark.parametrize("layout", ["cells", "segments"])
def test_population_on_a_grid_of_its_own(spark, tmp_path, layout):
    """Cells of the population two wide and half as high as those of the run: shares and totals stay."""
    squares = [feature('{"hlcit_code":"%s","lu_name":"u","sum":50.0}' % u, "Polygon", square_text(x, 10, 5, 10)) for u, x in (("a", 0), ("b", 5))]
    small_inputs(spark, tmp_path, squares, [feature('{"id":1,"fac_type":"f"}', "Polygon", square_text(3, 10, 1, 10))])
    W.write_grid(spark, Grid(0.0, 10.0, 2.0, 0.5, 5, 20), f"{tmp_path}/own")
    people = spark.range(100).selectExpr("int(id / 5) as row_no", "int(id % 5) as col_no", "1D as pop")
    people = to_segments(people, "pop") if layout == "segments" else people
    W.write_sorted(people, f"{tmp_path}/people")
    run("catchments", "--layer", f"{tmp_path}/catchments", "--population", f"{tmp_path}/people", "--units", f"{tmp_path}/units",
        "--grid", f"{tmp_path}/grid", "--out", f"{tmp_path}/parted", "--layout", layout, "--population-grid", f"{tmp_path}/own")
    kinds = T.StructType.fromDDL("adm2_code string, coverage string, pop double")
    rows = {(r.adm2_code, r.coverage): r.pop for r in R.read_csv(spark, f"{tmp_path}/parted/coverage", kinds).collect()}
    assert rows == {("a", "Covered"): 10.0, ("a", "Uncovered"): 40.0, ("b", "Covered"): 0.0, ("b", "Uncovered"): 50.0}


def test_statistics(spark, inputs, classified, tmp_path):
    run("statistics", "--results", f"{classified}/results", "--lookup", f"{inputs}/lookup", "--out", tmp_path)
    want = QUERIES["summary_grouping_sets"](spark, FOLDER)
    got = R.read_csv(spark, f"{tmp_path}/summary", want.schema)
    soft = {c: F.round(c, 6) for c in ("avg_pc_pop", "sd_pc_pop", "q25", "q50", "q75")}
    assert rows_of(got.withColumns(soft), want.columns) == rows_of(want, want.columns)
    names = "".join(f.read_text() for f in sorted(Path(tmp_path, "summary").glob("part-*"))).splitlines()
    levels = [line.split(",")[0] for line in names if not line.startswith("level")]
    assert levels == sorted(levels) and set(levels) == {"nation", "zone", "province", "province_zone"}
    wanted = QUERIES["zone_labels"](spark, FOLDER).select("geog", "fac_type", "geog_count", "geog_label", "geog_order").distinct()
    labels = R.read_csv(spark, f"{tmp_path}/ridges/zone_labels", T.StructType.fromDDL(
        "geog string, fac_type string, geog_count long, geog_pop double, geog_label string, geog_order int"))
    assert rows_of(labels, wanted.columns) == rows_of(wanted, wanted.columns)
    curves = QUERIES["ridge_density_season"](spark, FOLDER)
    assert spark.read.parquet(f"{tmp_path}/ridges/season").count() == curves.count()
    for level, query in (("nation", "chart_national"), ("zone_seasons", "chart_compare_zone")):
        assert spark.read.parquet(f"{tmp_path}/charts/{level}").count() == QUERIES[query](spark, FOLDER).count()


def test_layers_of_another_reference_system_are_refused(spark, inputs, tmp_path):
    g = OrderGrid(spark, FOLDER)
    V.write_geojson(ring_text(g.lgu_edges, ["id"]).selectExpr("string(id) as state", "1D as pop_sum", "geometry"),
                    f"{tmp_path}/units", ["state", "pop_sum"], 4326)
    with pytest.raises(ValueError):
        run("classify", "--rasters", f"{inputs}/rasters", "--population", f"{inputs}/population", "--units",
            f"{tmp_path}/units", "--grid", f"{inputs}/grid", "--out", f"{tmp_path}/out", "--level", "adm1")


SQUARE = "[[[%d,%d],[%d,%d],[%d,%d],[%d,%d],[%d,%d]]]"


def square_text(x, y, w, h):
    return SQUARE % (x, y, x + w, y, x + w, y - h, x, y - h, x, y)


def write_lines(folder, *features):
    folder.mkdir()
    (folder / "part.json").write_text("\n".join(features))
    return str(folder)


def feature(properties, kind, coordinates, srid=""):
    return '{"type":"Feature",%s"properties":%s,"geometry":{"type":"%s","coordinates":%s}}' % (srid, properties, kind, coordinates)


def test_geojson_of_any_polygon_kind(spark, tmp_path):
    kinds = T.StructType([T.StructField("id", T.LongType())])
    one, two = square_text(0, 10, 4, 4), square_text(5, 10, 2, 2)
    path = write_lines(tmp_path / "a", feature('{"id":1}', "Polygon", one), feature("{}", "MultiPolygon", f"[{one},{two}]", '"srid":5,'))
    rows = {r.id: r for r in V.read_geojson(spark, path, kinds).collect()}
    assert (rows[1].srid, len(rows[1].coordinates)) == (None, 1) and (rows[None].srid, len(rows[None].coordinates)) == (5, 2)
    assert rows[1].feature != rows[None].feature
    for bad in (feature("{}", "Point", "[1,2]"), '{"type":"Feature","geometry":{"type":"Pol', '{"type":"Feature"}'):
        path = write_lines(tmp_path / f"b{len(bad)}", feature('{"id":1}', "Polygon", one), bad)
        with pytest.raises(Exception):
            V.read_geojson(spark, path, kinds).collect()


def small_inputs(spark, root, units, catchments):
    """A grid of 10 x 10 cells of one person."""
    W.write_grid(spark, Grid(0.0, 10.0, 1.0, 1.0, 10, 10), f"{root}/grid")
    people = spark.range(100).selectExpr("int(id / 10) as row_no", "int(id % 10) as col_no", "1D as pop")
    W.write_sorted(people, f"{root}/population")
    write_lines(root / "units", *units)
    write_lines(root / "catchments", *catchments)
    run("catchments", "--layer", f"{root}/catchments", "--population", f"{root}/population", "--units", f"{root}/units",
        "--grid", f"{root}/grid", "--out", f"{root}/out")


UNIT = '{"hlcit_code":"c1","lu_name":"one","sum":100}'


@pytest.mark.parametrize("ids", [("1", "1"), ("null", "null")])
def test_catchments_that_share_an_id(spark, tmp_path, ids):
    """Two files use one id, and their catchments overlap: what either covers is covered."""
    areas = [
        feature('{"id":%s,"fac_type":"dhq"}' % ids[0], "Polygon", square_text(0, 10, 7, 10)),
        feature('{"id":%s,"fac_type":"banks"}' % ids[1], "Polygon", square_text(4, 10, 4, 10)),
        feature('{"id":%s,"fac_type":"dhq"}' % ids[1], "Polygon", square_text(5, 10, 3, 10)),
    ]
    small_inputs(spark, tmp_path, [feature(UNIT, "Polygon", square_text(0, 10, 10, 10))], areas)
    kinds = T.StructType([T.StructField("a_hlcit_code", T.StringType()), T.StructField("catch_pop", T.DoubleType())])
    assert [tuple(r)[:2] for r in V.read_geojson(spark, f"{tmp_path}/out/uncovered", kinds).collect()] == [("c1", 20.0)]
    by_file = spark.read.option("header", True).csv(f"{tmp_path}/out/uncovered_by_facility")
    assert {(r.fac_type, float(r.catch_pop_sum)) for r in by_file.collect()} == {("dhq", 20.0), ("banks", 60.0)}


def test_unit_in_parts(spark, tmp_path):
    parts = [square_text(0, 10, 5, 10), square_text(5, 10, 5, 10)]
    area = feature('{"id":1,"fac_type":"dhq"}', "Polygon", square_text(0, 10, 7, 10))
    small_inputs(spark, tmp_path, [feature(UNIT, "Polygon", p) for p in parts], [area])
    rows = spark.read.option("header", True).csv(f"{tmp_path}/out/uncovered_by_facility").collect()
    assert [(r.a_hlcit_code, float(r.adm_pop), float(r.pc_uncov)) for r in rows] == [("c1", 100.0, 0.3)]
    other = tmp_path / "other"
    other.mkdir()
    with pytest.raises(Exception, match="disagree on pop_sum"):
        small_inputs(spark, other, [feature(UNIT, "Polygon", parts[0]), feature(UNIT.replace("100", "60"), "Polygon", parts[1])], [area])


@pytest.mark.parametrize("name", ["results(2026)", "a+b", "with space", "results/NM/results"])
def test_results_below_any_folder_name(spark, tmp_path, name):
    row = [("one", "c1", "1", 1, "band", 10.0, 1.0, 0.1, "NM", "dhq"), ("two", "c2", "1", 1, "band", 10.0, 2.0, 0.2, "MSN", "all_hosp")]
    df = spark.createDataFrame(row, T.StructType([*config.LGU_RESULT, T.StructField("season", T.StringType()), T.StructField("fac_type", T.StringType())]))
    R.write_result_tree(df, f"{tmp_path}/{name}")
    back = R.read_results(spark, f"{tmp_path}/{name}")
    assert rows_of(back, df.columns) == rows_of(df, df.columns)
    with pytest.raises(Exception):
        R.read_results(spark, f"{tmp_path}/{name}", config.PROVINCE_RESULT).collect()


def test_tiles_and_stacks(spark):
    tiles = spark.createDataFrame(
        [(0, 0, [1.0, 2.0, -9.0, 4.0]), (0, 1, [5.0, None, 7.0, 8.0]), (1, 0, [9.0] * 4)],
        "tile_row int, tile_col int, values array<double>",
    )
    cells = {(r.row_no, r.col_no): r.hours for r in W.tile_cells(tiles, 2, 2, nodata=-9.0).collect()}
    assert cells == {(0, 0): 1.0, (0, 1): 2.0, (1, 1): 4.0, (0, 2): 5.0, (1, 2): 7.0, (1, 3): 8.0,
                     (2, 0): 9.0, (2, 1): 9.0, (3, 0): 9.0, (3, 1): 9.0}
    g = OrderGrid(spark, FOLDER)
    long = name_layers(unstack(g.stack, "row_no", "col_no"), LAYERS)
    back = W.stack_layers(long, LAYERS)
    assert rows_of(back, ["row_no", "col_no", "hours"]) == rows_of(g.stack, ["row_no", "col_no", "hours"])


def test_raster_partitions_and_rows_are_pruned(spark, inputs):
    one = W.read_travel_time(spark, f"{inputs}/rasters").where("season = 'NM' and fac_type = 'dhq' and row_no < 3")
    plan = plan_of(one)
    assert "PartitionFilters: [isnotnull(season" in plan and "LessThan(row_no,3)" in plan
    assert one.count() == 3 * 125


def test_results_by_name(spark, tmp_path):
    """Files with other columns in another order are read by their header; what doesn't fit stops the run."""
    schema = T.StructType(
        [
            T.StructField("adm_name", T.StringType()),
            T.StructField("trav_value", T.IntegerType()),
            T.StructField("cat_pop", T.DoubleType()),
        ]
    )

    def tree(name, **files):
        for file, text in files.items():
            path = tmp_path / name / "NM" / f"{file}.csv"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
        return R.read_results_by_name(spark, str(tmp_path / name), schema).select(*schema.names, "source")

    good = tree(
        "a+b (1)",
        nm_dhq_adm2='adm_name,trav_value,cat_pop\n"Old, new",1,2.5\nB,,\n\n',
        nm_fi_adm2="cat_pop,adm_name\n7,C\n",
        nm_hps_adm2="adm_name\n",
    )
    assert sorted(map(tuple, good.collect()), key=str) == [
        ("B", None, None, "NM/nm_dhq_adm2.csv"),
        ("C", None, 7.0, "NM/nm_fi_adm2.csv"),
        ("Old, new", 1, 2.5, "NM/nm_dhq_adm2.csv"),
    ]
    for name, text in {
        "other_name": "adm_name,pop\nA,1\n",
        "no_header": "A,1,2\n",
        "short": "adm_name,trav_value,cat_pop\nA,1\n",
        "long": "adm_name,cat_pop\nA,1,2\n",
        "longer": "adm_name,trav_value,cat_pop\nA,1,2,3\n",
        "bad_value": "adm_name,trav_value\nA,one\n",
    }.items():
        with pytest.raises(Exception, match="unlike it|bad trav_value"):
            tree(name, nm_dhq_adm2=text).collect()


def spoil(folder):
    """Fill the data files of ``folder`` with zeros, length and time of change as before: whoever opens one fails."""
    for file in [f for f in Path(folder).rglob("part-*") if not f.name.endswith(".crc")]:
        state = file.stat()
        file.write_bytes(bytes(state.st_size))
        os.utime(file, ns=(state.st_atime_ns, state.st_mtime_ns))
        checksum = file.with_name(f".{file.name}.crc")
        if checksum.exists():
            checksum.unlink()


def written(out):
    return {str(f.relative_to(out)): f.stat().st_mtime_ns for f in Path(out).rglob("part-*") if "manifest" not in f.parts}


def test_classify_update(spark, inputs, tmp_path):
    """A raster changed, one came and one went: only these are read and only their results are written."""
    rasters, out = tmp_path / "rasters", tmp_path / "out"
    long = W.read_travel_time(spark, f"{inputs}/rasters").where("season in ('NM', 'MSN') and fac_type in ('dhq', 'banks')")
    W.write_sorted(long, str(rasters), ["season", "fac_type"])
    words = ["classify", "--rasters", rasters, "--population", f"{inputs}/population", "--units", f"{inputs}/units",
             "--grid", f"{inputs}/grid", "--out", out]
    datasets = sorted(tuple(r) for r in long.select("season", "fac_type").distinct().collect())
    assert len(datasets) == 4
    run(*words)
    first = written(out)
    with pytest.raises(FileExistsError):
        run(*words)
    run(*words, "--update")
    assert written(out) == first  # nothing changed, nothing written

    stays, changes, goes, _ = ("season=%s/fac_type=%s" % d for d in datasets)
    later = W.read_travel_time(spark, f"{inputs}/rasters").where("season = 'NM' and fac_type = 'dhq'").selectExpr(
        "row_no", "col_no", "hours / 2 as hours")
    later.write.mode("overwrite").parquet(str(rasters / changes))
    later.write.parquet(str(rasters / "season=MSN/fac_type=new+one"))
    shutil.rmtree(rasters / goes)
    want = tmp_path / "want"
    run(*words[:-1], want)
    for folder in ("season=%s/fac_type=%s" % datasets[0], "season=%s/fac_type=%s" % datasets[3]):
        spoil(rasters / folder)
    run(*words, "--update")
    kinds = T.StructType([T.StructField(n, T.StringType()) for n in ("season", "fac_type", "dissolve", "cat_pop")])
    for read in (lambda o: R.read_results(spark, f"{o}/results"), lambda o: spark.read.parquet(f"{o}/charts"),
                 lambda o: V.read_geojson(spark, f"{o}/features", kinds).drop("feature", "coordinates")):
        mine, theirs = read(out), read(want)
        assert rows_of(mine, sorted(mine.columns)) == rows_of(theirs, sorted(mine.columns))
    now = written(out)
    kept = {f: t for f, t in first.items() if f in now}
    assert kept and all(now[f] == t for f, t in kept.items())
    assert len([f for f in kept if f.startswith("charts")]) >= 2
    assert {r.fac_type for r in R.read_results(spark, f"{out}/results").collect()} >= {"new+one"}


def test_update_after_a_run_that_was_broken_off(spark, inputs, tmp_path, monkeypatch):
    """Results half written, then a run to the end: as if nothing had happened."""
    rasters, out = tmp_path / "rasters", tmp_path / "out"
    long = W.read_travel_time(spark, f"{inputs}/rasters").where("season = 'NM' and fac_type in ('dhq', 'banks')")
    W.write_sorted(long, str(rasters), ["season", "fac_type"])
    words = ["classify", "--rasters", rasters, "--population", f"{inputs}/population", "--units", f"{inputs}/units",
             "--grid", f"{inputs}/grid", "--out", out]
    run(*words)
    want = rows_of(R.read_results(spark, f"{out}/results"), [*config.LGU_RESULT.names, "season", "fac_type"])
    long.where("fac_type = 'dhq'").drop("season", "fac_type").write.mode("overwrite").parquet(
        str(rasters / "season=NM/fac_type=dhq"))

    def breaks(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(jobs.H, "write_chart_tables", breaks)
        with pytest.raises(RuntimeError, match="lost"):
            run(*words, "--update")
    names = [r.dataset for r in M.last(spark, str(out)).where("role = 'rasters'").select("dataset").distinct().collect()]
    assert names == [["NM", "banks"]]
    run(*words, "--update")
    assert rows_of(R.read_results(spark, f"{out}/results"), [*config.LGU_RESULT.names, "season", "fac_type"]) == want
    assert spark.read.parquet(f"{out}/charts").count() == len(want)


def test_update_when_a_shared_input_changed(spark, inputs, tmp_path):
    rasters, people, out = tmp_path / "rasters", tmp_path / "people", tmp_path / "out"
    W.write_sorted(W.read_travel_time(spark, f"{inputs}/rasters").where("season = 'NM' and fac_type = 'dhq'"),
                   str(rasters), ["season", "fac_type"])
    W.write_sorted(W.read_population(spark, f"{inputs}/population"), str(people))
    words = ["classify", "--rasters", rasters, "--population", people, "--units", f"{inputs}/units",
             "--grid", f"{inputs}/grid", "--out", out]
    run(*words)
    total = R.read_results(spark, f"{out}/results").agg(F.sum("cat_pop")).first()[0]
    W.read_population(spark, f"{inputs}/population").withColumn("pop", F.col("pop") * 2).write.mode("overwrite").parquet(str(people))
    run(*words, "--update")
    assert R.read_results(spark, f"{out}/results").agg(F.sum("cat_pop")).first()[0] == pytest.approx(2 * total)
    with pytest.raises(ValueError, match="another run"):
        run(*words[:-1], out, "--level", "adm1", "--update")


def test_catchments_update(spark, tmp_path):
    """Files of facility types, one of which holds two, come, change and go."""
    square = lambda kind, x, w: feature('{"id":1,"fac_type":"%s"}' % kind, "Polygon", square_text(x, 10, w, 10))
    layer = tmp_path / "catchments"
    small_inputs(spark, tmp_path, [feature(UNIT, "Polygon", square_text(0, 10, 10, 10))], [square("a", 0, 2), square("b", 1, 3)])
    words = ["catchments", "--layer", layer, "--population", f"{tmp_path}/population", "--units", f"{tmp_path}/units",
             "--grid", f"{tmp_path}/grid", "--out", tmp_path / "out", "--update"]

    def state():
        free = R.read_csv(spark, f"{tmp_path}/out/uncovered_by_facility", T.StructType.fromDDL(
            "a_hlcit_code string, adm_pop double, catch_pop_sum double, pc_uncov double, fac_type string"))
        held = R.read_csv(spark, f"{tmp_path}/out/covered_by_facility", T.StructType.fromDDL(
            "adm2_code string, covered_pop double, fac_type string"))
        every = spark.read.option("header", True).csv(f"{tmp_path}/out/coverage").where("coverage = 'Uncovered'").first()
        return ({r.fac_type: r.catch_pop_sum for r in free.collect()},
                {r.fac_type: r.covered_pop for r in held.collect()}, float(every["pop"]))

    assert state() == ({"a": 80.0, "b": 70.0}, {"a": 20.0, "b": 30.0}, 60.0)
    first = written(tmp_path / "out")
    run(*words)
    assert written(tmp_path / "out") == first
    (layer / "more.json").write_text(square("c", 8, 2) + "\n" + square("b", 4, 1))
    run(*words)
    assert state() == ({"a": 80.0, "b": 60.0, "c": 80.0}, {"a": 20.0, "b": 40.0, "c": 20.0}, 30.0)
    same = [f for f, t in written(tmp_path / "out").items() if first.get(f) == t]
    assert {f.split("/")[0] for f in same if "fac_type=a" in f} == {"covered", "uncovered_by_facility", "covered_by_facility"}
    assert not [f for f in same if "fac_type=b" in f]
    (layer / "part.json").unlink()
    run(*words)
    assert state() == ({"b": 90.0, "c": 80.0}, {"b": 10.0, "c": 20.0}, 70.0)
    (layer / "more.json").unlink()
    (layer / "none [1].json").write_text("")
    run(*words)
    assert state() == ({}, {}, 100.0)


def test_a_folder_of_the_driver_alone_is_refused(spark):
    class Session:
        """The session on another master, with or without a shared folder."""

        def __init__(self, master, folder):
            self.settings = {"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": spark.conf.get("spark.sql.warehouse.dir")}
            self.conf = self
            context = spark.sparkContext
            self.sparkContext = type("Context", (), {"master": master, "_jvm": context._jvm, "_jsc": context._jsc})

        def get(self, name, default=None):
            return self.settings.get(name, default)

    assert shared_folder(Session("spark://somewhere:7077", "hdfs://shared/x/")) == "hdfs://shared/x"
    assert shared_folder(Session("local[8]", None)).endswith("/_stored")
    with pytest.raises(RuntimeError, match="executors may not reach"):
        shared_folder(Session("spark://somewhere:7077", None))
