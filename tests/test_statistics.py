"""Quantiles, summaries, density curves, labels, paths."""

import math
import random
import statistics

import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from access_engine import config
from access_engine.functions import bands as B
from access_engine.functions import paths as P
from access_engine.functions.quantiles import group_quantiles, nested_quantiles
from access_engine.operators import density as D
from access_engine.operators import overlay as O
from access_engine.operators import summary as S
from access_engine.plans import pooled as N

PROBS = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99}


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_bands_at_their_bounds(spark):
    rows = [(-0.1, 0), (0.0, 1), (0.5009, 1), (0.501, 2), (1.01, 3), (32.01, 8), (99.9, 8), (100.0, 0), (None, None)]
    df = spark.createDataFrame(rows, "hours double, want int")
    got = df.select(B.band_of(F.col("hours")).alias("band"), "want").collect()
    assert [r.band for r in got] == [r.want for r in got]
    assert B.classify_bands(df).count() == 8


def test_keys_and_codes(spark):
    df = spark.createDataFrame(
        [("524 3 07 1 007", 4), ("524 3 07 1 007", None), (None, 4)], "code string, band int"
    )
    key = B.dissolve_key(F.col("code"), F.col("band"))
    assert values(df.select(key.alias("k")), "k") == ["524 3 07 1 007_4", None, None]
    row = df.limit(1).select(
        B.key_adm2(key).alias("a"), B.key_province(key).alias("p"), B.key_band(key).alias("b"), B.key_adm1(F.lit("5_3")).alias("s")
    ).first()
    assert tuple(row) == ("524 3 07 1 007", "3", 4, "5")
    assert spark.range(1).select(B.key_band(F.lit("")).alias("b")).first().b is None


def test_shares(spark):
    df = spark.createDataFrame([(5.0, 10.0), (5.0, 0.0), (1.0, 20.0), (2.0, 20.0)], "c double, a double")
    assert values(df.select(B.share(F.col("c"), F.col("a")).alias("s")), "s") == [0.5, None, 0.05, 0.1]
    percent = B.share_percent_decimal(F.col("c"), F.col("a")).cast("string").alias("s")
    assert values(df.select(percent), "s") == [None, None, "5.0000", None]


def test_labels(spark):
    df = spark.createDataFrame([(0.12345, 1234.5), (1.0, 1235.5), (0.0057, 0.0), (0.05, 12.0)], "s double, p double")
    assert values(df.select(B.percent_text(F.col("s")).alias("t")), "t") == ["12.34", "100", "0.57", "5"]
    assert values(df.select(B.grouped_digits(F.col("p")).alias("t")), "t") == ["1,234", "1,236", "0", "12"]


def test_recode_passes_unknown_codes(spark):
    df = spark.createDataFrame([("NM",), ("XYZ",), (None,)], "s string")
    assert values(df.select(B.recode(F.col("s"), config.SEASON_NAMES).alias("n")), "n") == ["Normal times", "XYZ", None]


def test_paths(spark):
    df = spark.createDataFrame(
        [("NM/nm_allhf_adm2.csv",), ("MSN/msn_all_hosp_adm2.csv",), ("plain.csv",)], "p string"
    )
    assert values(df.select(P.season_of(F.col("p")).alias("x")), "x") == ["NM", "MSN", "plain.csv"]
    assert values(df.select(P.facility_of(F.col("p")).alias("x")), "x") == ["allhf", "all_hosp", None]
    one = spark.createDataFrame([("nmw_hps/nmw_hps_adm1.csv",)], "p string").select(
        P.chart_season_of(F.col("p")), P.chart_type_of(F.col("p")), P.dataset_of(P.file_name(F.col("p")))
    )
    assert tuple(one.first()) == ("nmw", "hps", "nmw_hps")
    assert spark.range(1).select(P.dataset_of(F.lit("nm_dhq_v2.final.tif")).alias("d")).first().d == "nm_dhq"


def hot_groups(spark):
    rng = random.Random(1)
    rows = [("hot", round(rng.random(), 3)) for _ in range(5000)]
    rows += [("same", 0.25)] * 700 + [("one", 3.5)] + [("pair", 1.0), ("pair", 2.0)]
    rows += [(None, float(i)) for i in range(10)] + [("nulls", None), ("nulls", 4.0)]
    return spark.createDataFrame(rows, "k string, v double")


def test_quantiles_equal_the_builtin(spark):
    df = hot_groups(spark)
    builtin = [F.percentile("v", p).alias(name) for name, p in PROBS.items()]
    want = {r.k: r for r in df.groupBy("k").agg(*builtin).collect()}
    ranked = group_quantiles(df, ["k"], "v", PROBS)
    assert "percentile(" not in plan_of(ranked)
    got = {r.k: r for r in ranked.collect()}
    assert set(got) == set(want)
    for k in want:
        for q in PROBS:
            assert got[k][q] == pytest.approx(want[k][q], abs=1e-12)


UNITS = ["u1", "u2", "u3", "u4", "u5"]


def pooled(spark):
    """Two seasons, two facilities, five units; u4 has no zone, u5 no population."""
    rng = random.Random(2)
    rows = []
    for season in ("NM", "MSN", "NMW"):
        for fac in ("dhq", "unheard of"):
            for i, unit in enumerate(UNITS):
                for band in (1, 2):
                    people = 0.0 if unit == "u5" else 100.0 * (i + 1)
                    part = float(rng.randint(0, 50))
                    share = part / people if people else None
                    rows.append((unit, str(i % 2 + 1), band, config.BAND_LABELS[band], people, part, share, season, fac))
    results = spark.createDataFrame(
        rows,
        "adm2_code string, province string, trav_value int, trav_cat string, adm_pop double, "
        "cat_pop double, pc_pop double, season string, fac_type string",
    )
    zones = spark.createDataFrame(
        [("u1", "Hill"), ("u2", "Hill"), ("u3", "Terai"), ("u5", "Terai")], "adm2_code string, geog string"
    )
    return N.final_frame(N.pool(results, zones))


def test_nested_quantiles_equal_those_of_each_level(spark):
    """Null keys, groups of one value, a group with a third of all rows, ranks in any range."""
    rng = random.Random(12)
    rows = [(rng.choice("ab"), rng.choice(["x", "y", None]), rng.choice([1, 2, None]), rng.choice([None, rng.random(), 0.5])) for _ in range(900)]
    rows += [("a", "x", 1, rng.random()) for _ in range(450)] + [("c", "x", 1, 0.25), ("c", "y", 2, None)]
    frame = spark.createDataFrame(rows, "b string, p string, g int, v double").repartition(5)
    levels = {"all": [], "p": ["p"], "g": ["g"], "both": ["p", "g"]}
    found = {(r.level, r.b, r.p, r.g): [r[q] for q in PROBS] for r in nested_quantiles(frame, ["b"], levels, "v", PROBS).collect()}
    wanted = {}
    for b, p, g, v in rows:
        for level, keys in levels.items():
            if v is not None:
                wanted.setdefault((level, b, p if "p" in keys else None, g if "g" in keys else None), []).append(v)
    assert found.keys() == wanted.keys()
    for key, own in wanted.items():
        assert found[key] == pytest.approx(list(np.quantile(own, list(PROBS.values()))))
    assert nested_quantiles(frame.limit(0), ["b"], levels, "v", PROBS).count() == 0


def test_denominators_count_incomplete_units(spark):
    final = pooled(spark)
    row = final.where("adm2_code = 'u1'").first()
    assert (row.tot_pop, row.geog_pop, row.prov_pop) == (1000.0, 300.0, 400.0)
    assert final.where("adm2_code = 'u4'").first().geog_pop is None
    left = {r.adm2_code for r in N.complete_rows(final).collect()}
    assert left == {"u1", "u2", "u3"}
    assert {r.fac_type for r in final.collect()} == {"District Headquarters", "unheard of"}


@pytest.mark.parametrize("level", S.LEVELS)
def test_summary_by_hand_and_by_ranks(spark, level):
    complete = N.complete_rows(pooled(spark))
    extra, whole = S.LEVELS[level]
    keys = [*extra, *S.BY_BAND]
    groups = {}
    for r in complete.collect():
        groups.setdefault(tuple(r[k] for k in keys), []).append(r)
    rows = S.summarise(complete, level).collect()
    assert {tuple(r[k] for k in keys) for r in rows} == set(groups)
    for r in rows:
        members = groups[tuple(r[k] for k in keys)]
        shares = [m.pc_pop for m in members]
        assert r.wtd_pc_pop == pytest.approx(sum(m.cat_pop for m in members) / members[0][whole])
        assert r.avg_pc_pop == pytest.approx(statistics.mean(shares))
        assert r.max_pc_pop == max(shares)
        assert r.q75 == pytest.approx(float(np.quantile(shares, 0.75)))
        if len(shares) == 1:
            assert r.sd_pc_pop is None
        else:
            assert r.sd_pc_pop == pytest.approx(statistics.stdev(shares))


def test_grouping_sets_equal_the_single_levels(spark):
    complete = N.complete_rows(pooled(spark))
    every = S.summarise_all(complete).cache()

    def table(df, columns):
        rows = df.select(*columns).collect()
        return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows], key=str)

    for level, (extra, _) in S.LEVELS.items():
        single = S.summarise(complete, level)
        found = S.one_level(every, level)
        assert [k for k in S.TOTALS if k in found.columns] == [k for k in S.TOTALS if k in extra]
        assert table(found, single.columns) == table(single, single.columns)


def test_season_comparison(spark):
    table = S.summarise(N.complete_rows(pooled(spark)), "nation")
    wide = S.compare_seasons(table, ["fac_type", "trav_value"], {"total": "tot_pop"}).collect()
    shares = {(r.season, r.fac_type, r.trav_value): r.wtd_pc_pop for r in table.collect()}
    assert len(wide) == 4
    for r in wide:
        assert r.normal_share == shares["Normal times", r.fac_type, r.trav_value]
        assert r.monsoon_share == shares["Monsoon season", r.fac_type, r.trav_value]


def test_density_integrates_to_one(spark):
    rng = random.Random(4)
    rows = [("p", g, min(max(rng.gauss(m, 0.05), 0.0), 1.0)) for g, m in (("a", 0.4), ("b", 0.55)) for _ in range(400)]
    rows += [("p", "tiny", 0.5), ("flat", "a", 0.5), ("flat", "a", 0.5), ("flat", "a", 0.5)]
    rows += [("p", "a", 1.5), ("p", "a", None)]
    df = spark.createDataFrame(rows, "panel string, band string, v double")
    exact = {(r.band, r.i): r for r in D.density(df, ["panel"], "band", "v").collect()}
    assert {b for b, _ in exact} == {"a", "b"}
    for band in ("a", "b"):
        area = sum(r.density for (b, _), r in exact.items() if b == band) / 511
        assert area == pytest.approx(1.0, abs=0.01)
    wide = D.density(df, ["panel"], "band", "v", min_points=401).select("band").distinct().collect()
    assert [r.band for r in wide] == []


def test_density_by_hand(spark):
    v = [0.1, 0.2, 0.4, 0.45]
    df = spark.createDataFrame([("p", "a", x) for x in v], "panel string, band string, v double")
    sd = statistics.stdev(v)
    q = np.quantile(v, [0.25, 0.75])
    bw = 0.9 * min(sd, (q[1] - q[0]) / 1.34) * len(v) ** -0.2
    for r in D.density(df, ["panel"], "band", "v", n=11).collect():
        want = sum(math.exp(-0.5 * ((r.x - x) / bw) ** 2) for x in v) / (len(v) * bw * math.sqrt(2 * math.pi))
        assert r.density == pytest.approx(want)


@pytest.mark.parametrize("bw", [0.0007, 0.02, 0.3, 5.0])
def test_series_equals_the_exact_sum_of_kernels(spark, bw):
    """Values at the ends of their boxes, many equal ones, bandwidths below a step of the grid and beyond it."""
    rng = random.Random(4)
    values = [rng.random() for _ in range(300)] + [0.0, 1.0, 0.5, bw, 3 * bw] + [0.25] * 50
    values = [v for v in values if v <= 1]
    rows = spark.createDataFrame([("g", bw, v) for v in values], "g string, bw double, at double")
    found = {r.i: r.s for r in D.kernel_sums(rows, ["g"], 65, 0.0, 1.0).collect()}
    for i in range(65):
        exact = sum(math.exp(-(((i / 64 - v) / bw) ** 2) / 2) for v in values)
        assert found.get(i, 0.0) == pytest.approx(exact, abs=1e-11)
    boxes = {math.floor(v / bw) for v in values}
    assert len(boxes) <= len(set(values))


def test_what_the_series_leaves_out_does_not_add_up(spark):
    """Many values at one end of their box, where a kernel's series is least exact."""
    rows = spark.range(4000).select(F.lit("g").alias("g"), F.lit(1.0).alias("bw"), F.lit(0.0).alias("at"))
    found = {r.i: r.s for r in D.kernel_sums(rows, ["g"], 9, 0.0, 1.0).collect()}
    for i in range(9):
        assert found[i] == pytest.approx(4000 * math.exp(-((i / 8) ** 2) / 2), rel=1e-13)


def test_quantile_lines_ignore_values_outside(spark):
    df = spark.createDataFrame([("p", "a", x) for x in (0.1, 0.3, 0.5, 7.0)], "panel string, band string, v double")
    assert D.quantile_lines(df, ["panel"], "band", "v").first().q50 == pytest.approx(0.3)


def test_overlay_kinds(spark):
    a = spark.createDataFrame([(0, 0, "x"), (0, 1, "x")], "row_no int, col_no int, a string")
    b = spark.createDataFrame([(0, 1, 5), (9, 9, 6)], "row_no int, col_no int, b int")
    assert O.overlay(a, b, "or").count() == 3
    assert O.overlay(a, b, "and").count() == 1
    assert [tuple(r) for r in O.overlay(a, b, "not").collect()] == [(0, 0, "x")]
    both = O.overlay(a, b, "or").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    assert "FullOuter" not in plan_of(both)
    twice = a.unionAll(a)
    assert O.dissolve(twice).count() == 2 and O.dissolve(twice, ["a"]).count() == 2


def test_categories_are_numbered_without_gaps(spark):
    rng = random.Random(2)
    keys = [(rng.choice([None, "a", "b", "cc"]), rng.choice([None, *range(40)])) for _ in range(500)]
    frame = spark.createDataFrame([(*k, "x") for k in keys], "code string, band int, part string").repartition(6)
    order = sorted(set(keys), key=lambda k: tuple((v is not None, v or type(v)()) if v is not None else (False, 0) for v in k))
    first, again = (
        {(r.code, r.band): r.number for r in O.numbered_categories(f.drop("part"), ["code", "band"], "number").collect()}
        for f in (frame, frame.repartition(3))
    )
    assert first == again == {k: n for n, k in enumerate(order, 1)}
    assert O.numbered_categories(frame.limit(0), ["code"]).count() == 0


def test_lookup_keeps_unmatched_rows(spark):
    df = spark.createDataFrame([("k1",), ("k2",)], "code string")
    dim = spark.createDataFrame([("k1", "one")], "key string, name string")
    rows = O.lookup(df, dim, F.col("code") == F.col("key"), ["name"]).orderBy("code").collect()
    assert [tuple(r) for r in rows] == [("k1", "one"), ("k2", None)]
