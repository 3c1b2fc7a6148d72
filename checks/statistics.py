"""Pooled import, denominators, summaries, season comparison, reshapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from access_engine import config
from access_engine.functions import bands as B
from access_engine.functions import paths as P
from access_engine.functions.quantiles import group_quantiles
from access_engine.operators import summary as S
from access_engine.plans import charts as H
from access_engine.plans import pooled as N
from access_engine.sources import results as R
from access_engine.storage import new_path
from checks.classification import share_table
from checks.fixture_sql import with_views
from checks.order_grid import OrderGrid


def results(g: OrderGrid) -> DataFrame:
    """Result rows with the path their file would have, and what is read off that path."""
    table = share_table(g)
    path = F.concat(
        F.col("season"), F.lit("/"), F.lower("season"), F.lit("_"), F.col("fac_type"), F.lit("_adm2.csv")
    )
    return (
        table.withColumn("source", path)
        .withColumn("season", P.season_of(F.col("source")))
        .withColumn("fac_type", P.facility_of(F.col("source")))
    )


def pooled(g: OrderGrid) -> DataFrame:
    return N.pool(results(g), g.zone_lookup)


def final(g: OrderGrid) -> DataFrame:
    return N.final_frame(pooled(g))


def complete(g: OrderGrid) -> DataFrame:
    return N.complete_rows(final(g))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


_SOFT = ("avg_pc_pop", "sd_pc_pop", "q25", "q50", "q75")


def pooled_import(g: OrderGrid) -> DataFrame:
    return pooled(g)


def csv_roundtrip(g: OrderGrid) -> DataFrame:
    """Result table written as a tree of CSV files, read back with provenance, stacked and named."""
    root = new_path(g.spark, "results")
    R.write_result_tree(share_table(g), root)
    return N.pool(R.read_results(g.spark, root), g.zone_lookup)


def adm1_path_parse(g: OrderGrid) -> DataFrame:
    """Season, type and dataset name of the province files of all rasters of the result."""
    files = (
        share_table(g)
        .select(F.lower("season").alias("s"), F.col("fac_type").alias("f"))
        .distinct()
        .select(F.format_string("%s_%s/%s_%s_adm1.csv", "s", "f", "s", "f").alias("path"))
    )
    path = F.col("path")
    return files.select(
        "path",
        P.chart_season_of(path).alias("season"),
        P.chart_type_of(path).alias("type"),
        P.dataset_of(P.file_name(path)).alias("dataset"),
    )


def denominators(g: OrderGrid) -> DataFrame:
    return (
        final(g)
        .select("adm2_code", "province", "geog", "tot_pop", "geog_pop", "prov_pop")
        .distinct()
    )


def _summary(level: str):
    def query(g: OrderGrid) -> DataFrame:
        return rounded(S.summarise(complete(g), level), *_SOFT)

    return query


def summary_grouping_sets(g: OrderGrid) -> DataFrame:
    return rounded(S.summarise_all(complete(g)), *_SOFT)


def season_compare_national(g: OrderGrid) -> DataFrame:
    table = S.summarise(complete(g), "nation")
    return S.compare_seasons(table, ["fac_type", "trav_cat", "trav_value"], {"total": "tot_pop"})


def season_compare_province(g: OrderGrid) -> DataFrame:
    table = S.summarise(complete(g), "province")
    keys = ["province", "fac_type", "trav_cat", "trav_value"]
    return S.compare_seasons(table, keys, {"total": "prov_pop"})


def season_compare_zone(g: OrderGrid) -> DataFrame:
    table = S.summarise(complete(g), "zone")
    keys = ["geog", "fac_type", "trav_cat", "trav_value"]
    return S.compare_seasons(table, keys, {"total": "geog_pop"})


def summary_melt(g: OrderGrid) -> DataFrame:
    table = S.summarise(complete(g), "nation")
    long = S.melt(
        table, S.BY_BAND, ["wtd_pc_pop", "avg_pc_pop", "sd_pc_pop", "max_pc_pop"]
    )
    return rounded(long, "value")


def share_melt(g: OrderGrid) -> DataFrame:
    """Unit shares of the non-walking seasons, one row per point under the density curves."""
    rows = final(g).where(F.col("season").isin(config.NON_WALKING))
    ids = ["season", "fac_type", "trav_cat", "adm2_code", "tot_pop", "adm_pop"]
    return S.melt(rows, ids, ["pc_pop"])


def median_adm_pop(g: OrderGrid) -> DataFrame:
    rows = final(g).where(F.col("season").isin(config.NON_WALKING))
    table = group_quantiles(rows, ["fac_type"], "adm_pop", {"median_adm_pop": 0.5})
    return table.withColumn(
        "subtitle",
        F.concat(F.lit("Median LGU population: "), B.grouped_digits(F.col("median_adm_pop"))),
    )


def labelled_zones(g: OrderGrid) -> DataFrame:
    """Rows of normal times with the unit count of their zone written back, and the zone label."""
    return H.labelled_zones(final(g).where(F.col("season") == config.NORMAL))


def zone_labels(g: OrderGrid) -> DataFrame:
    return labelled_zones(g).select(
        "geog",
        "fac_type",
        "trav_value",
        "adm2_code",
        "geog_count",
        "geog_label",
        B.zone_ordinal(F.col("geog")).alias("geog_order"),
    )


def zone_share_melt(g: OrderGrid) -> DataFrame:
    """Unit shares of normal times with their zone label, one row per point under the curves."""
    ids = [
        "geog", "fac_type", "trav_cat", "adm2_code", "tot_pop", "adm_pop", "geog_pop", "geog_label"
    ]
    return S.melt(labelled_zones(g), ids, ["pc_pop"])


def ordered_summary(g: OrderGrid) -> DataFrame:
    """Zone summary in category order, the order itself as columns."""
    table = S.summarise(complete(g), "zone")
    ordered = table.select(
        "season",
        "fac_type",
        "geog",
        "trav_cat",
        B.season_ordinal(F.col("season")).alias("season_order"),
        B.zone_ordinal(F.col("geog")).alias("geog_order"),
        B.label_ordinal(F.col("trav_cat")).alias("trav_order"),
        "wtd_pc_pop",
    )
    return ordered.orderBy("trav_order", "geog_order", "season_order", "fac_type")


def fill_null_zero(g: OrderGrid) -> DataFrame:
    rows = final(g)
    return rows.na.fill(0).select(
        "season", "fac_type", "adm2_code", "trav_value", "adm_pop", "cat_pop", "pc_pop", "geog_pop"
    )


QUERIES = {
    f.__name__: f
    for f in (
        pooled_import,
        csv_roundtrip,
        adm1_path_parse,
        denominators,
        summary_grouping_sets,
        season_compare_national,
        season_compare_province,
        season_compare_zone,
        summary_melt,
        share_melt,
        median_adm_pop,
        zone_labels,
        zone_share_melt,
        ordered_summary,
        fill_null_zero,
    )
} | {
    "summary_national": _summary("nation"),
    "summary_zone": _summary("zone"),
    "summary_province": _summary("province"),
    "summary_province_zone": _summary("province_zone"),
}

_MOMENTS = (
    "sum(cat_pop) as pop_in_band, round(avg(pc_pop), 6) as avg_pc_pop, round(stddev_samp(pc_pop), 6) as sd_pc_pop, "
    "round(quantile_cont(pc_pop, 0.25), 6) as q25, round(quantile_cont(pc_pop, 0.5), 6) as q50, "
    "round(quantile_cont(pc_pop, 0.75), 6) as q75, max(pc_pop) as max_pc_pop, avg(tot_pop) as tot_pop"
)
_BAND = "season, fac_type, trav_cat, trav_value"


def summary_sql(level: str) -> str:
    """Body of one summary level over ``fx_complete``."""
    extra, whole = S.LEVELS[level]
    keys = ", ".join([*extra, _BAND])
    totals = "".join(
        f", avg({t}) as {t}" for k, t in (("geog", "geog_pop"), ("province", "prov_pop")) if k in extra
    )
    return (
        f"select *, pop_in_band / {whole} as wtd_pc_pop, round_even(pop_in_band / {whole}, 4) as wtd_pc_pop_label "
        f"from (select {keys}, {_MOMENTS}{totals} from fx_complete group by {keys}) s"
    )


def _all_levels() -> str:
    parts = []
    for level, (extra, _) in S.LEVELS.items():
        province = "province" if "province" in extra else "cast(null as varchar)"
        geog = "geog" if "geog" in extra else "cast(null as varchar)"
        prov_pop = "prov_pop" if "province" in extra else "cast(null as double)"
        geog_pop = "geog_pop" if "geog" in extra else "cast(null as double)"
        parts.append(
            f"select '{level}' as level, {province} as province, {geog} as geog, {_BAND}, pop_in_band, avg_pc_pop, sd_pc_pop, "
            f"q25, q50, q75, max_pc_pop, tot_pop, {geog_pop} as geog_pop, {prov_pop} as prov_pop, wtd_pc_pop, wtd_pc_pop_label "
            f"from ({summary_sql(level)}) t"
        )
    return " union all ".join(parts)


def compare_sql(level: str, total: str) -> str:
    extra = "".join(f"{k}, " for k in S.LEVELS[level][0])
    pick = "max(case when season = '{0}' then {1} end)"
    return (
        f"select {extra}fac_type, trav_cat, trav_value, "
        f"{pick.format('Normal times', 'wtd_pc_pop')} as normal_share, {pick.format('Monsoon season', 'wtd_pc_pop')} as monsoon_share, "
        f"{pick.format('Normal times', 'wtd_pc_pop_label')} as normal_label, {pick.format('Monsoon season', 'wtd_pc_pop_label')} as monsoon_label, "
        f"max({total}) as total from ({summary_sql(level)}) s where season in ('Normal times', 'Monsoon season') "
        f"group by {extra}fac_type, trav_cat, trav_value"
    )


_POOLED = "adm_name, adm2_code, province, trav_value, trav_cat, adm_pop, cat_pop, pc_pop, source, season, fac_type, geog"
ORACLE = {
    "pooled_import": with_views(f"select {_POOLED} from fx_pooled"),
    "csv_roundtrip": with_views(f"select {_POOLED} from fx_pooled"),
    "adm1_path_parse": with_views(
        "select p as path, regexp_extract(n, '^([^_]*)', 1) as season, regexp_extract(n, '_(.*)_', 1) as type, "
        "split_part(n, '_', 1) || '_' || split_part(n, '_', 2) as dataset from "
        "(select lower(season) || '_' || fac_type || '/' || lower(season) || '_' || fac_type || '_adm1.csv' as p, "
        "lower(season) || '_' || fac_type || '_adm1.csv' as n from (select distinct season, fac_type from fx_share) d) t"
    ),
    "denominators": with_views(
        "select distinct adm2_code, province, geog, tot_pop, geog_pop, prov_pop from fx_final"
    ),
    "summary_national": with_views(summary_sql("nation")),
    "summary_zone": with_views(summary_sql("zone")),
    "summary_province": with_views(summary_sql("province")),
    "summary_province_zone": with_views(summary_sql("province_zone")),
    "summary_grouping_sets": with_views(_all_levels()),
    "season_compare_national": with_views(compare_sql("nation", "tot_pop")),
    "season_compare_province": with_views(compare_sql("province", "prov_pop")),
    "season_compare_zone": with_views(compare_sql("zone", "geog_pop")),
    "summary_melt": with_views(
        " union all ".join(
            f"select {_BAND}, '{v}' as variable, round({v}, 6) as value from ({summary_sql('nation')}) s"
            for v in ("wtd_pc_pop", "avg_pc_pop", "sd_pc_pop", "max_pc_pop")
        )
    ),
    "share_melt": with_views(
        "select season, fac_type, trav_cat, adm2_code, tot_pop, adm_pop, 'pc_pop' as variable, pc_pop as value "
        "from fx_final where season in ('Normal times', 'Monsoon season')"
    ),
    "median_adm_pop": with_views(
        "select fac_type, median_adm_pop, 'Median LGU population: ' || format('{:,}', cast(round_even(median_adm_pop, 0) as bigint)) as subtitle from "
        "(select fac_type, median(adm_pop) as median_adm_pop from fx_final where season in ('Normal times', 'Monsoon season') group by fac_type) m"
    ),
    "zone_labels": with_views(
        "select f.geog, f.fac_type, trav_value, adm2_code, n as geog_count, "
        "f.geog || '; n=' || cast(n as varchar) || ' P:' || format('{:,}', cast(round_even(geog_pop, 0) as bigint)) as geog_label, "
        "case f.geog when 'Terai' then 1 when 'Shivalik' then 2 when 'Hill' then 3 when 'Mountain' then 4 when 'High Mountain' then 5 end as geog_order "
        "from fx_final f join (select geog, fac_type, count(distinct adm2_code) as n from fx_final where season = 'Normal times' group by geog, fac_type) c "
        "on c.geog = f.geog and c.fac_type = f.fac_type where season = 'Normal times'"
    ),
    "zone_share_melt": with_views(
        "select f.geog, f.fac_type, trav_cat, adm2_code, tot_pop, adm_pop, geog_pop, "
        "f.geog || '; n=' || cast(n as varchar) || ' P:' || format('{:,}', cast(round_even(geog_pop, 0) as bigint)) as geog_label, "
        "'pc_pop' as variable, pc_pop as value "
        "from fx_final f join (select geog, fac_type, count(distinct adm2_code) as n from fx_final where season = 'Normal times' group by geog, fac_type) c "
        "on c.geog = f.geog and c.fac_type = f.fac_type where season = 'Normal times'"
    ),
    "ordered_summary": with_views(
        "select season, fac_type, geog, trav_cat, case season when 'Normal times' then 1 when 'Monsoon season' then 2 end as season_order, "
        "case geog when 'Terai' then 1 when 'Shivalik' then 2 when 'Hill' then 3 when 'Mountain' then 4 when 'High Mountain' then 5 end as geog_order, "
        f"trav_value as trav_order, wtd_pc_pop from ({summary_sql('zone')}) s"
    ),
    "fill_null_zero": with_views(
        "select season, fac_type, adm2_code, trav_value, coalesce(adm_pop, 0) as adm_pop, coalesce(cat_pop, 0) as cat_pop, "
        "coalesce(pc_pop, 0) as pc_pop, coalesce(geog_pop, 0) as geog_pop from fx_final"
    ),
}
