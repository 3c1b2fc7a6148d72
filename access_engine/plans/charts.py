"""The tables behind the charts: values, labels, colours, titles and file names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from access_engine.functions import bands as B
from access_engine.functions.quantiles import group_quantiles
from access_engine.operators.summary import LEVELS, compare_seasons, units_per_zone
from access_engine.sources.results import in_order


def _bar_label(share: Column, people: Column) -> Column:
    """``<percent>%`` over ``<population> persons``; a missing share prints as NA."""
    percent = F.coalesce(B.percent_text(share), F.lit("NA"))
    count = F.coalesce(B.grouped_digits(people), F.lit("NA"))
    return F.concat(percent, F.lit("%\n"), count, F.lit(" persons"))


def _band_columns() -> list[Column]:
    return [
        F.col("trav_value"),
        F.col("trav_cat"),
        B.label_ordinal(F.col("trav_cat")).alias("trav_order"),
        B.band_colour(F.col("trav_value")).alias("colour"),
    ]


def lgu_bands(result: DataFrame) -> DataFrame:
    """Bars per local unit of one dataset: share, label, colour and the unit's file name."""
    dataset = F.concat_ws("_", F.lower("season"), F.col("fac_type"))
    return result.select(
        "season",
        "fac_type",
        "adm2_code",
        "adm_name",
        "province",
        *_band_columns(),
        F.bround("pc_pop", 4).alias("pc_pop"),
        B.grouped_digits(F.col("cat_pop")).alias("cat_pop"),
        _bar_label(F.col("pc_pop"), F.col("cat_pop")).alias("label"),
        F.concat(
            F.lit("Province "),
            "province",
            F.lit(" - "),
            "adm_name",
            F.lit(" - "),
            "adm2_code",
            F.lit(" - "),
            dataset,
            F.lit(".jpeg"),
        ).alias("file_name"),
    )


def province_bands(result: DataFrame) -> DataFrame:
    """Bars per province of one dataset with title and subtitle."""
    dataset = F.concat_ws("_", F.lower("season"), F.col("fac_type"))
    return result.select(
        "season",
        "fac_type",
        "adm_code",
        "adm_name",
        *_band_columns(),
        F.bround("pc_pop", 4).alias("pc_pop"),
        B.grouped_digits(F.col("cat_pop")).alias("cat_pop"),
        _bar_label(F.col("pc_pop"), F.col("cat_pop")).alias("label"),
        F.concat(F.lit("Province "), "adm_name").alias("title"),
        F.concat(F.lit("Population "), B.grouped_digits(F.col("adm_pop"))).alias("subtitle"),
        F.concat(F.lit("Province "), "adm_name", F.lit(" - "), dataset, F.lit(".jpeg")).alias(
            "file_name"
        ),
    )


def _heading(level: str) -> tuple[Column, Column]:
    """Title of the plain chart and stem of its file name."""
    if level == "nation":
        return F.lit("Accessibility to "), F.lit("./Charts/National - ")
    if level == "province":
        return (
            F.concat(F.lit("Province "), "province", F.lit("\nAccessibility to ")),
            F.concat(F.lit("./Charts/Province "), "province", F.lit(" - ")),
        )
    return (
        F.concat("geog", F.lit("\nAccessibility to ")),
        F.concat(F.lit("./Charts/"), "geog", F.lit(" - ")),
    )


def level_bars(summary: DataFrame, level: str) -> DataFrame:
    """Bars of one level per season and facility type; missing numbers count as 0."""
    extra, _ = LEVELS[level]
    title, stem = _heading(level)
    filled = summary.na.fill(0)
    return filled.select(
        *extra,
        "season",
        "fac_type",
        *_band_columns(),
        "wtd_pc_pop",
        F.concat_ws(" ", *extra, "season", "fac_type").alias("loop"),
        F.concat(title, "fac_type", F.lit("\nby Population")).alias("title"),
        F.concat(stem, "season", F.lit(" - "), "fac_type", F.lit(".jpeg")).alias("file_name"),
    )


def level_comparison(summary: DataFrame, level: str) -> DataFrame:
    """Normal share as bar, monsoon share as mark, both labelled, total population as subtitle."""
    extra, whole = LEVELS[level]
    keys = [*extra, "fac_type", "trav_cat", "trav_value"]
    wide = compare_seasons(summary, keys, {"total": whole}).na.fill(0)
    if level == "nation":
        title, stem = F.lit("Accessibility to "), F.lit("./Charts/National - ")
    elif level == "province":
        title = F.concat(F.lit("Province - "), "province", F.lit("\nAccessibility to "))
        stem = F.concat(F.lit("./Charts/Province - "), "province", F.lit(" - "))
    else:
        title, stem = _heading(level)
    return wide.select(
        *extra,
        "fac_type",
        *_band_columns(),
        "normal_share",
        "monsoon_share",
        F.concat(B.percent_text(F.col("normal_label")), F.lit("%\n")).alias("normal_text"),
        F.concat(B.percent_text(F.col("monsoon_label")), F.lit("%")).alias("monsoon_text"),
        F.concat_ws(" ", *extra, "fac_type").alias("loop"),
        F.concat(title, "fac_type", F.lit("\nby Population")).alias("title"),
        F.concat(B.grouped_digits(F.col("total")), F.lit(" persons")).alias("subtitle"),
        F.concat(stem, "fac_type", F.lit(".jpeg")).alias("file_name"),
    )


def ridge_headings(rows: DataFrame, stem: str) -> DataFrame:
    """Title, subtitle and file name of the density chart of each facility type."""
    medians = group_quantiles(rows, ["fac_type"], "adm_pop", {"median_adm_pop": 0.5})
    return medians.select(
        "fac_type",
        F.concat(
            F.lit("Average travel times to "),
            "fac_type",
            F.lit("\nDensity plot of local government averages, per category"),
        ).alias("title"),
        F.concat(
            F.lit("Median LGU population: "), B.grouped_digits(F.col("median_adm_pop"))
        ).alias("subtitle"),
        F.concat(F.lit(f"./Charts/{stem} - "), "fac_type", F.lit(".jpeg")).alias("file_name"),
    )


def labelled_zones(rows: DataFrame) -> DataFrame:
    """Pooled rows of a zone with the number of its units, and the label that heads its chart."""
    known = rows.where(F.col("geog").isNotNull())
    label = F.concat(
        F.col("geog"),
        F.lit("; n="),
        F.col("geog_count").cast("string"),
        F.lit(" P:"),
        B.grouped_digits(F.col("geog_pop")),
    )
    counted = known.join(units_per_zone(rows), ["geog", "fac_type"])
    return counted.withColumn("geog_label", label)


def zone_labels(rows: DataFrame) -> DataFrame:
    """Label, unit count, population and place of every zone and facility type."""
    keys = ["geog", "fac_type", "geog_count", "geog_pop", "geog_label"]
    return labelled_zones(rows).select(*keys).distinct().withColumn("geog_order", B.zone_ordinal(F.col("geog")))


def category_order(columns: Sequence[str]) -> list[Column | str]:
    """The order of a table's rows by season, zone, unit and band, of those it has."""
    places = {
        "level": "level",
        "season": B.season_ordinal(F.col("season")),
        "geog": B.zone_ordinal(F.col("geog")),
        "province": "province",
        "fac_type": "fac_type",
        "adm_code": "adm_code",
        "adm2_code": "adm2_code",
        "trav_value": "trav_value",
        "trav_cat": B.label_ordinal(F.col("trav_cat")),
        "i": "i",
    }
    # names break the ties of what has no place in its category
    names = [c for c in ("season", "geog", "trav_cat") if c in columns]
    return [place for c, place in places.items() if c in columns] + names


def write_chart_tables(
    chart: DataFrame, path: str, keys: Sequence[str], mode: str = "errorifexists"
) -> None:
    """One folder per chart, named by the keys that select it; its rows in category order."""
    rest = [c for c in chart.columns if c not in keys]
    ordered = in_order(chart, *keys, *category_order(rest))
    ordered.write.mode(mode).partitionBy(*keys).parquet(path)
