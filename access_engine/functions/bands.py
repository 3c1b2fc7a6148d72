"""Scalar expressions on travel times, bands, codes and shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from access_engine import config


def band_of(
    hours: Column,
    breaks: Sequence[tuple[float, int]] = tuple(config.BAND_BREAKS),
    default: int = config.BAND_DEFAULT,
) -> Column:
    """Code of the first band whose upper bound lies above ``hours``; NULL stays NULL."""
    first, *rest = breaks
    chain = F.when(hours < F.lit(first[0]), F.lit(first[1]))
    for bound, code in rest:
        chain = chain.when(hours < F.lit(bound), F.lit(code))
    return F.when(hours.isNotNull(), chain.otherwise(F.lit(default)))


def classify_bands(cells: DataFrame, value: str = "hours", out: str = "band") -> DataFrame:
    """Band of every raster cell; nodata cells leave."""
    return cells.where(F.col(value).isNotNull()).withColumn(out, band_of(F.col(value)))


def mapped(key: Column, values: Mapping) -> Column:
    """Value of a fixed code, NULL for any other code."""
    chain = None
    for code, value in values.items():
        step = (key == F.lit(code), F.lit(value))
        chain = F.when(*step) if chain is None else chain.when(*step)
    return chain


def band_label(band: Column) -> Column:
    return mapped(band, config.BAND_LABELS)


def band_colour(band: Column) -> Column:
    return mapped(band, config.BAND_COLOURS)


def label_ordinal(label: Column) -> Column:
    """Position of a band label in band order, NULL outside the levels."""
    return mapped(label, {text: code for code, text in config.BAND_LABELS.items()})


def zone_ordinal(zone: Column) -> Column:
    return mapped(zone, {name: i + 1 for i, name in enumerate(config.ZONE_ORDER)})


def season_ordinal(season: Column) -> Column:
    return mapped(season, {name: i + 1 for i, name in enumerate(config.NON_WALKING)})


def recode(key: Column, values: Mapping) -> Column:
    """Replace known codes, pass unknown ones through."""
    return F.coalesce(mapped(key, values), key)


def dissolve_key(code: Column, band: Column) -> Column:
    """``<admin code>_<band>``; NULL as soon as either part is NULL."""
    return F.concat(code, F.lit("_"), band.cast("string"))


def key_adm2(key: Column) -> Column:
    return F.left(key, F.lit(config.ADM2_CODE_LENGTH))


def key_adm1(key: Column) -> Column:
    return F.left(key, F.lit(config.ADM1_CODE_LENGTH))


def key_province(key: Column) -> Column:
    return F.substring(key, config.PROVINCE_POSITION, 1)


def key_band(key: Column) -> Column:
    return F.right(key, F.lit(1)).try_cast("int")


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` where the whole is positive, else NULL."""
    return F.when(whole > 0, part / whole)


def share_percent_decimal(part: Column, whole: Column) -> Column:
    """Percent held as ``decimal(5,4)``: ten percent and more do not fit and become NULL."""
    return (share(part, whole) * F.lit(100.0)).try_cast("decimal(5,4)")


def grouped_digits(value: Column) -> Column:
    """Whole number with thousands separators, halves rounded to even."""
    return F.format_number(F.bround(value, 0), 0)


def percent_text(value: Column) -> Column:
    """A share rounded to four digits, printed as percent without trailing zeros."""
    percent = F.round(F.bround(value, 4) * F.lit(100.0), 2).cast("string")
    return F.regexp_replace(percent, r"\.0$", "")
