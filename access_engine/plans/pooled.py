"""Pooled statistics over the results of all seasons and facility types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from access_engine import config
from access_engine.functions import bands as B
from access_engine.operators.overlay import lookup
from access_engine.operators.summary import with_denominators
from access_engine.storage import stored


def pool(results: DataFrame, zones: DataFrame) -> DataFrame:
    """Zone of each unit, codes replaced by names; unknown codes stay as they are."""
    by_unit = zones.withColumnRenamed("adm2_code", "unit")
    named = lookup(results, by_unit, F.col("adm2_code") == F.col("unit"), ["geog"])
    return named.withColumn(
        "season", B.recode(F.col("season"), config.SEASON_NAMES)
    ).withColumn("fac_type", B.recode(F.col("fac_type"), config.FACILITY_NAMES))


def final_frame(pooled: DataFrame) -> DataFrame:
    """Pooled results with their denominators.

    The pooled rows feed three totals and every summary; they are written once, or each of them
    would run the raster jobs again. The totals are small and join by broadcast where they are.
    """
    return with_denominators(stored(pooled, "pooled"))


def complete_rows(final: DataFrame) -> DataFrame:
    """Rows without any NULL, joined totals included."""
    return final.na.drop("any")
