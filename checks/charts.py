"""Chart tables and density curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from access_engine import config
from access_engine.operators import density as D
from access_engine.operators import summary as S
from access_engine.plans import charts as C
from checks import classification
from checks.fixture_sql import COLOUR_CASE, DIGITS, PERCENT, with_views
from checks.order_grid import OrderGrid
from checks.statistics import compare_sql, complete, final, rounded, summary_sql


def chart_lgu_bands(g: OrderGrid) -> DataFrame:
    return C.lgu_bands(classification.share_table(g))


def chart_province_bands(g: OrderGrid) -> DataFrame:
    return C.province_bands(classification.province_band_share(g))


def _bars(level: str):
    def query(g: OrderGrid) -> DataFrame:
        return C.level_bars(S.summarise(complete(g), level), level)

    return query


def _comparison(level: str):
    def query(g: OrderGrid) -> DataFrame:
        return C.level_comparison(S.summarise(complete(g), level), level)

    return query


def _by_season(g: OrderGrid) -> DataFrame:
    return final(g).where(F.col("season").isin(config.NON_WALKING))


def _by_zone(g: OrderGrid) -> DataFrame:
    normal = F.col("season") == config.NORMAL
    return final(g).where(normal & F.col("geog").isNotNull())


def ridge_density_season(g: OrderGrid) -> DataFrame:
    curves = D.density(_by_season(g), ["fac_type", "season"], "trav_cat", "pc_pop")
    return rounded(curves, "x", "density")


def ridge_density_zone(g: OrderGrid) -> DataFrame:
    curves = D.density(_by_zone(g), ["fac_type", "geog"], "trav_cat", "pc_pop")
    return rounded(curves, "x", "density")


def ridge_quartiles(g: OrderGrid) -> DataFrame:
    lines = D.quantile_lines(_by_season(g), ["fac_type", "season"], "trav_cat", "pc_pop")
    return rounded(lines, "q25", "q50", "q75")


def ridge_quartiles_zone(g: OrderGrid) -> DataFrame:
    lines = D.quantile_lines(_by_zone(g), ["fac_type", "geog"], "trav_cat", "pc_pop")
    return rounded(lines, "q25", "q50", "q75")


def chart_ridge_season(g: OrderGrid) -> DataFrame:
    return C.ridge_headings(_by_season(g), "LGU comparison")


def chart_ridge_zone(g: OrderGrid) -> DataFrame:
    return C.ridge_headings(_by_zone(g), "Physiogeographic LGU comparison")


QUERIES = {
    "chart_lgu_bands": chart_lgu_bands,
    "chart_province_bands": chart_province_bands,
    "chart_national": _bars("nation"),
    "chart_province": _bars("province"),
    "chart_zone": _bars("zone"),
    "chart_compare_national": _comparison("nation"),
    "chart_compare_province": _comparison("province"),
    "chart_compare_zone": _comparison("zone"),
    "ridge_density_season": ridge_density_season,
    "ridge_density_zone": ridge_density_zone,
    "ridge_quartiles": ridge_quartiles,
    "ridge_quartiles_zone": ridge_quartiles_zone,
    "chart_ridge_season": chart_ridge_season,
    "chart_ridge_zone": chart_ridge_zone,
}

_LABEL = (
    f"coalesce({PERCENT.format('pc_pop')}, 'NA') || '%' || chr(10) || coalesce({DIGITS.format('cat_pop')}, 'NA') || ' persons'"
)
_BAND = f"trav_value, trav_cat, trav_value as trav_order, {COLOUR_CASE.format('trav_value')} as colour"


def _titles(level: str, compare: bool) -> tuple[str, str]:
    dash = "- " if compare else ""
    if level == "nation":
        return "'Accessibility to '", "'./Charts/National - '"
    if level == "province":
        return (
            f"'Province {dash}' || province || chr(10) || 'Accessibility to '",
            f"'./Charts/Province {dash}' || province || ' - '",
        )
    return "geog || chr(10) || 'Accessibility to '", "'./Charts/' || geog || ' - '"


def _bars_sql(level: str) -> str:
    extra = S.LEVELS[level][0]
    title, stem = _titles(level, False)
    loop = " || ' ' || ".join([*extra, "season", "fac_type"])
    lead = "".join(f"{e}, " for e in extra)
    return (
        f"select {lead}season, fac_type, {_BAND}, coalesce(wtd_pc_pop, 0) as wtd_pc_pop, {loop} as loop, "
        f"{title} || fac_type || chr(10) || 'by Population' as title, {stem} || season || ' - ' || fac_type || '.jpeg' as file_name "
        f"from ({summary_sql(level)}) s"
    )


def _comparison_sql(level: str) -> str:
    extra, whole = S.LEVELS[level]
    title, stem = _titles(level, True)
    loop = " || ' ' || ".join([*extra, "fac_type"])
    lead = "".join(f"{e}, " for e in extra)
    normal = PERCENT.format("coalesce(normal_label, 0)")
    monsoon = PERCENT.format("coalesce(monsoon_label, 0)")
    return (
        f"select {lead}fac_type, {_BAND}, coalesce(normal_share, 0) as normal_share, coalesce(monsoon_share, 0) as monsoon_share, "
        f"{normal} || '%' || chr(10) as normal_text, {monsoon} || '%' as monsoon_text, {loop} as loop, "
        f"{title} || fac_type || chr(10) || 'by Population' as title, {DIGITS.format('total')} || ' persons' as subtitle, "
        f"{stem} || fac_type || '.jpeg' as file_name from ({compare_sql(level, whole)}) c"
    )


def _density_sql(panel: str, where: str) -> str:
    """The curve point by point, kernel by kernel."""
    join = " and ".join("{0}.%s = {1}.%s" % (p, p) for p in panel.split(", "))
    mine = ", ".join(f"p.{c}" for c in panel.split(", "))
    return (
        f"select {panel}, trav_cat, i, round(x, 6) as x, round(density, 6) as density from "
        f"(select *, max(density) over (partition by {panel}) as peak from "
        f"(select {mine}, p.trav_cat, cast(g.i as int) as i, g.i * (cast(1 as double) / 511) as x, "
        "sum(exp(-0.5 * ((g.i * (cast(1 as double) / 511) - p.v) / b.bw) * ((g.i * (cast(1 as double) / 511) - p.v) / b.bw))) "
        "/ (count(*) * b.bw * sqrt(2 * pi())) as density "
        f"from pts p join (select {panel}, avg(case when narrow > 0 then 0.9 * narrow * pow(n, -0.2) end) as bw from "
        f"(select {panel}, trav_cat, n, case when least(sd, iqr) > 0 then least(sd, iqr) else sd end as narrow from "
        f"(select {panel}, trav_cat, count(*) as n, stddev_samp(v) as sd, (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34 as iqr "
        f"from pts group by {panel}, trav_cat) q) r group by {panel}) b on {join.format('p', 'b')} "
        f"cross join range(512) g(i) where b.bw is not null group by {mine}, p.trav_cat, g.i, b.bw having count(*) >= 3) c) d "
        "where density >= 0.01 * peak"
    ), (f"select {panel}, trav_cat, pc_pop as v from fx_final where {where} and pc_pop between 0 and 1")


_SEASONS = "season in ('Normal times', 'Monsoon season')"
_NORMAL = "season = 'Normal times' and geog is not null"


def _ridge_sql(panel: str, where: str) -> str:
    body, points = _density_sql(panel, where)
    return with_views(body, pts=points)


def _heading_sql(where: str, stem: str) -> str:
    return with_views(
        "select fac_type, 'Average travel times to ' || fac_type || chr(10) || 'Density plot of local government averages, per category' as title, "
        f"'Median LGU population: ' || {DIGITS.format('m')} as subtitle, './Charts/{stem} - ' || fac_type || '.jpeg' as file_name from "
        f"(select fac_type, median(adm_pop) as m from fx_final where {where} group by fac_type) t"
    )



def _quartile_sql(panel: str, where: str) -> str:
    cuts = ", ".join(f"round(quantile_cont(pc_pop, {p}), 6) as q{round(100 * p)}" for p in (0.25, 0.5, 0.75))
    return with_views(
        f"select fac_type, {panel}, trav_cat, {cuts} from fx_final where {where} and pc_pop between 0 and 1 "
        f"group by fac_type, {panel}, trav_cat"
    )


ORACLE = {
    "chart_lgu_bands": with_views(
        f"select season, fac_type, adm2_code, adm_name, province, {_BAND}, round_even(pc_pop, 4) as pc_pop, "
        f"{DIGITS.format('cat_pop')} as cat_pop, {_LABEL} as label, 'Province ' || province || ' - ' || adm_name || ' - ' || adm2_code || ' - ' || "
        "lower(season) || '_' || fac_type || '.jpeg' as file_name from fx_labelled"
    ),
    "chart_province_bands": with_views(
        f"select season, fac_type, adm_code, adm_name, {_BAND}, round_even(pc_pop, 4) as pc_pop, {DIGITS.format('cat_pop')} as cat_pop, "
        f"{_LABEL} as label, 'Province ' || adm_name as title, 'Population ' || {DIGITS.format('adm_pop')} as subtitle, "
        "'Province ' || adm_name || ' - ' || lower(season) || '_' || fac_type || '.jpeg' as file_name from fx_province_share"
    ),
    "chart_national": with_views(_bars_sql("nation")),
    "chart_province": with_views(_bars_sql("province")),
    "chart_zone": with_views(_bars_sql("zone")),
    "chart_compare_national": with_views(_comparison_sql("nation")),
    "chart_compare_province": with_views(_comparison_sql("province")),
    "chart_compare_zone": with_views(_comparison_sql("zone")),
    "ridge_density_season": _ridge_sql("fac_type, season", _SEASONS),
    "ridge_density_zone": _ridge_sql("fac_type, geog", _NORMAL),
    "ridge_quartiles": _quartile_sql("season", _SEASONS),
    "ridge_quartiles_zone": _quartile_sql("geog", _NORMAL),
    "chart_ridge_season": _heading_sql(_SEASONS, "LGU comparison"),
    "chart_ridge_zone": _heading_sql(_NORMAL, "Physiogeographic LGU comparison"),
}
