"""Whole plans on hand-written layers, and the shape of their physical plans."""

from pathlib import Path

import pytest
from conftest import plan_of
from pyspark.sql import functions as F
from pyspark.sql import types as T

from access_engine.config import LGU_RESULT
from access_engine.operators.boundary import cells_to_spans
from access_engine.operators.grid import TASK_CELLS, Grid, tasks_of
from access_engine.operators.overlay import unstack
from access_engine.operators.segments import to_segments
from access_engine.plans import catchment as K
from access_engine.plans import charts as H
from access_engine.plans import classification as C
from access_engine.sources import results as R
from access_engine.storage import drop, gathered, new_path, scratch, settled, shared_folder, store, stored
from checks.order_grid import OrderGrid

FOLDER = "/root/testdata/sf0.001"
GRID = Grid(0.0, 10.0, 1.0, 1.0, 10, 10)


def square(key, x0, y0, x1, y1, *more):
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return [(key, *more, *map(float, a), *map(float, b)) for a, b in zip(ring, ring[1:])]


@pytest.fixture(scope="module")
def layers(spark):
    """Two units side by side, every cell one person; unit 2 is fully covered by two catchments."""
    edges = spark.createDataFrame(
        square(1, 0, 0, 5, 10) + square(2, 5, 0, 10, 10), "id int, x1 double, y1 double, x2 double, y2 double"
    )
    pop = spark.range(100).selectExpr("int(id / 10) as row_no", "int(id % 10) as col_no", "1D as pop")
    codes = spark.createDataFrame([(1, "c1", "one", "1"), (2, "c2", "two", "1"), (3, "c3", "three", "2")], "id int, hlcit_code string, lu_name string, state string")
    catchments = spark.createDataFrame(
        square(10, 4, 0, 8, 10, "dhq") + square(11, 7, -5, 30, 20, "banks"),
        "id int, fac_type string, x1 double, y1 double, x2 double, y2 double",
    )
    located = C.unit_cells(pop, edges, GRID)
    return located, C.unit_dimension(located, codes), codes, catchments


def test_catchment_gap(spark, layers):
    located, adm2, codes, catchments = layers
    covered = K.coverage(catchments, GRID)
    gaps = K.uncovered_population(K.uncovered_cells(located, covered), adm2)
    assert [tuple(r) for r in gaps.collect()] == [("c1", 50.0, 40.0, 0.8)]
    split = {(r.adm2_code, r.coverage): r.pop for r in K.covered_split(gaps, adm2).collect()}
    assert split == {
        ("c1", "Covered"): 10.0, ("c1", "Uncovered"): 40.0, ("c2", "Covered"): 50.0,
        ("c2", "Uncovered"): 0.0, ("c3", "Covered"): 0.0, ("c3", "Uncovered"): 0.0,
    }


def test_catchment_gap_by_dataset(spark, layers):
    located, adm2, codes, catchments = layers
    covered = K.coverage(catchments, GRID, ["fac_type"])
    files = spark.createDataFrame([("dhq",), ("banks",), ("fi",)], "fac_type string")
    gaps = K.uncovered_by_dataset(located, covered, adm2, files)
    got = {(r.fac_type, r.a_hlcit_code): r.catch_pop_sum for r in gaps.collect()}
    assert got == {
        ("dhq", "c1"): 40.0, ("dhq", "c2"): 20.0, ("banks", "c1"): 50.0, ("banks", "c2"): 20.0,
        ("fi", "c1"): 50.0, ("fi", "c2"): 50.0,
    }
    inside = K.covered_by_dataset(located, covered, codes, files.where("fac_type != 'banks'"))
    assert {(r.fac_type, r.adm2_code): r.covered_pop for r in inside.collect()} == {
        ("dhq", "c1"): 10.0, ("dhq", "c2"): 30.0, ("dhq", "c3"): 0.0,
        ("fi", "c1"): 0.0, ("fi", "c2"): 0.0, ("fi", "c3"): 0.0,
    }


def test_shares_of_a_unit_add_up(spark):
    """Bands, band 0 and nodata together make the population of the unit."""
    g = OrderGrid(spark, FOLDER)
    located = C.unit_cells(g.population, g.lgu_edges, g.grid).cache()
    total = located.agg(F.sum("pop")).first()[0]
    cells = C.banded_cells(located, g.stack)
    assert cells.agg(F.sum("pop")).first()[0] < 32 * total
    layers = located.join(g.stack.select("row_no", "col_no", "hours"), ["row_no", "col_no"])
    everything = layers.select("pop", F.explode_outer("hours")).agg(F.sum("pop")).first()[0]
    assert everything == 32 * total
    shares = C.band_population(cells, "id", [("s", str(i)) for i in range(32)])
    assert shares.groupBy("season", "fac_type", "id").agg(F.sum("cat_pop").alias("s")).join(
        located.groupBy("id").agg(F.sum("pop").alias("t")), "id"
    ).where("s > t").count() == 0


def test_scan_reads_two_columns_and_has_no_product(spark):
    from checks import QUERIES

    plan = plan_of(QUERIES["lgu_band_share"](spark, FOLDER))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_bucketed_cells_join_without_a_shuffle(spark):
    g = OrderGrid(spark, FOLDER)
    R.save_cells(g.population, "pop_cells", 4)
    R.save_cells(g.stack, "travel_cells", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = spark.table("pop_cells").join(spark.table("travel_cells"), ["row_no", "col_no"])
        assert "Exchange" not in plan_of(joined) and "SortMergeJoin" in plan_of(joined)
        assert joined.count() == g.population.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table pop_cells")
        spark.sql("drop table travel_cells")


def test_buckets_grow_with_the_grid(spark):
    """A bucket is one file and read by one task, so its cells are bounded."""
    small, large = Grid(0.0, 1.0, 1.0, 1.0, 125, 1200), Grid(0.0, 1.0, 1.0, 1.0, 125, 432000)
    assert R.buckets_of(small) == 8 and large.nrows * large.ncols / R.buckets_of(large) <= R.BUCKET_CELLS
    cells = spark.range(400).selectExpr("cast(id div 20 as int) row_no", "cast(id % 20 as int) col_no").repartition(5)
    R.save_cells(cells, "few_files", 3)
    try:
        assert len(spark.table("few_files").inputFiles()) == 3
        assert spark.table("few_files").count() == 400
    finally:
        spark.sql("drop table few_files")


def test_layers_are_unfolded_where_their_row_lies(spark):
    """Nothing is shuffled once the layers of a cell are rows of their own; tasks grow in number with grid and layers."""
    g = OrderGrid(spark, FOLDER)
    cells = unstack(g.row_stack, "row_no", "col_no")
    for df in (cells_to_spans(cells, ["layer", "hours"]), to_segments(cells, "hours", ["layer"], 16)):
        plan = plan_of(df)
        assert "Exchange" in plan and plan.index("Generate posexplode") < plan.index("Exchange")
        assert plan.count("Exchange hashpartitioning") == 1
    assert tasks_of(spark, Grid(0.0, 1.0, 1.0, 1.0, 125, 432000), 32) == -(-125 * 432000 * 32 // TASK_CELLS)


def test_result_tree_and_bind(spark, tmp_path):
    rows = [("n1", "c1", "1", 1, "0 to 30 minutes", 10.0, 2.5, 0.25, "NM", "all_hosp"),
            ("n,2", 'c"2', "1", 2, None, None, 1e-9, None, "MSN", "dhq")]
    kinds = T.StructType([*LGU_RESULT.fields, T.StructField("season", T.StringType()), T.StructField("fac_type", T.StringType())])
    df = spark.createDataFrame(rows, kinds)
    root = str(tmp_path / "tree")
    R.write_result_tree(df, root)
    (tmp_path / "tree" / "adm2_physgeo.csv").write_text("adm2_code,geog\nc1,Hill\n")
    back = R.read_results(spark, root)
    assert sorted(tuple(r) for r in back.drop("source").collect()) == sorted(rows)
    assert {r.source for r in back.collect()} == {"NM/nm_all_hosp_adm2.csv", "MSN/msn_dhq_adm2.csv"}
    lookup = spark.createDataFrame([("c1", "Hill")], "adm2_code string, geog string")
    R.write_csv(lookup, str(tmp_path / "one"))
    assert R.read_csv(spark, str(tmp_path / "one"), "adm2_code string, geog string").first().geog == "Hill"
    stacked = R.bind_rows([df, lookup])
    assert stacked.count() == 3 and stacked.where("geog is null").count() == 2


def test_plain_files_of_one_folder_per_season(spark, tmp_path):
    """Files as single runs leave them, without any Spark part names."""
    head = ",".join(f.name for f in LGU_RESULT.fields)
    for season, fac in (("NM", "hps"), ("MSNW", "fi")):
        (tmp_path / season).mkdir()
        (tmp_path / season / f"{season.lower()}_{fac}_adm2.csv").write_text(f"{head}\nA,c,1,3,1 to 2 hours,10,1,0.1\n")
    rows = R.read_results(spark, str(tmp_path)).collect()
    assert {(r.season, r.fac_type, r.source) for r in rows} == {
        ("NM", "hps", "NM/nm_hps_adm2.csv"), ("MSNW", "fi", "MSNW/msnw_fi_adm2.csv")
    }


def test_results_as_a_table(spark):
    from checks import QUERIES

    shares = QUERIES["lgu_band_share"](spark, FOLDER)
    R.save_result(shares.withColumn("extra", F.lit(1)), "shares")
    try:
        kept = spark.table("shares")
        assert kept.columns == ["season", "fac_type", *LGU_RESULT.names]
        assert kept.count() == shares.count() and kept.limit(5).count() == 5
    finally:
        spark.sql("drop table shares")


def test_one_folder_per_chart(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "loop string, v int")
    H.write_chart_tables(df, str(tmp_path / "charts"), ["loop"])
    assert sorted(p.name for p in (tmp_path / "charts").glob("loop=*")) == ["loop=a", "loop=b"]
    assert df.select("loop").distinct().count() == 2


def test_storage_uses_the_folder_of_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_path(spark, "x").startswith(shared_folder(spark))
    table, path = store(spark.range(5).toDF("n"), "numbers")
    assert table.count() == 5
    drop(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_parts_of_many_passes_are_one_table(spark):
    asked = []

    def parts():
        for k in range(3):
            asked.append(gathered_files())
            yield spark.range(k, k + 2)

    def gathered_files():
        return len(list(Path(shared_folder(spark).removeprefix("file:"), "access_engine").glob("passes-*/part-*")))

    before = gathered_files()
    table = gathered(spark, parts(), "id long", "passes")
    assert sorted(r.id for r in table.collect()) == [0, 1, 1, 2, 2, 3]
    assert before < asked[0] < asked[1] < asked[2]  # each was written before the next
    assert gathered(spark, iter(()), "id long", "passes").count() == 0


def test_settled_rows_stay_and_the_tables_before_them_go(spark):
    folder = Path(shared_folder(spark).removeprefix("file:")) / "access_engine"

    def rows():
        return stored(spark.range(5).toDF("n"), "passing").where("n > 2")

    table = settled(spark, "lasting", rows)
    assert [r.n for r in table.orderBy("n").collect()] == [3, 4]
    names = [p.name for p in folder.iterdir()]
    assert any(n.startswith("lasting-") for n in names) and not any(n.startswith("passing-") for n in names)


def test_a_failed_run_leaves_no_table(spark):
    folder = Path(shared_folder(spark).removeprefix("file:")) / "access_engine"
    with pytest.raises(ValueError), scratch(spark):
        stored(spark.range(5).toDF("n"), "failing")
        raise ValueError
    assert not any(p.name.startswith("failing-") for p in folder.iterdir())


def test_chart_labels_of_missing_shares(spark):
    df = spark.createDataFrame(
        [("NM", "dhq", "c", "n", "1", 2, "30 minutes to 1 hour", None, 1234567.0)],
        "season string, fac_type string, adm2_code string, adm_name string, province string, trav_value int, trav_cat string, pc_pop double, cat_pop double",
    )
    row = H.lgu_bands(df).first()
    assert row.label == "NA%\n1,234,567 persons" and row.colour == "#2ab72e"
    assert row.file_name == "Province 1 - n - c - nm_dhq.jpeg"
