"""Population-weighted summaries of pooled unit results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from access_engine.config import MONSOON, NON_WALKING, NORMAL
from access_engine.functions.quantiles import group_quantiles, nested_quantiles, same_keys

BY_BAND = ["season", "fac_type", "trav_cat", "trav_value"]
# keys in front of BY_BAND, and the total each level's share refers to
LEVELS = {
    "nation": ([], "tot_pop"),
    "zone": (["geog"], "geog_pop"),
    "province": (["province"], "prov_pop"),
    "province_zone": (["province", "geog"], "geog_pop"),
}
TOTALS = {"geog": "geog_pop", "province": "prov_pop"}
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def unit_means(pooled: DataFrame, value: str = "adm_pop") -> DataFrame:
    """Sum and count of the unit value per (unit, province, zone): the one pass over the table."""
    return pooled.groupBy("adm2_code", "province", "geog").agg(
        F.sum(value).alias("s"), F.count(value).alias("n")
    )


def unit_total(means: DataFrame, group: Sequence[str], out: str) -> DataFrame:
    """Mean per unit, summed per group; rows without a group or a value stand aside."""
    per_unit = means.groupBy("adm2_code", *group).agg(
        F.try_divide(F.sum("s"), F.sum("n")).alias("x")
    )
    for g in group:
        per_unit = per_unit.where(F.col(g).isNotNull())
    return per_unit.groupBy(*group).agg(F.sum("x").alias(out))


def with_denominators(pooled: DataFrame) -> DataFrame:
    """Add national, zone and province totals, taken before incomplete rows leave."""
    means = unit_means(pooled)
    nation = unit_total(means, [], "tot_pop")
    return (
        pooled.withColumn("tot_pop", nation.scalar())
        .join(unit_total(means, ["geog"], "geog_pop"), "geog", "left")
        .join(unit_total(means, ["province"], "prov_pop"), "province", "left")
    )


def _moments(totals: Sequence[str]) -> list[Column]:
    return [
        F.sum("cat_pop").alias("pop_in_band"),
        F.avg("pc_pop").alias("avg_pc_pop"),
        F.stddev_samp("pc_pop").alias("sd_pc_pop"),
        F.max("pc_pop").alias("max_pc_pop"),
        *[F.avg(t).alias(t) for t in totals],
    ]


def summarise(complete: DataFrame, level: str) -> DataFrame:
    """Weighted share, mean, sd, quartiles and maximum of the unit shares of one level.

    ``complete`` is the pooled table without incomplete rows.
    """
    extra, whole = LEVELS[level]
    keys = [*extra, *BY_BAND]
    moments = complete.groupBy(*keys).agg(*_moments(["tot_pop", *[TOTALS[k] for k in extra]]))
    quartiles = group_quantiles(complete, keys, "pc_pop", QUARTILES)
    stats = (
        moments.alias("m")
        .join(quartiles.alias("q"), same_keys("m", "q", keys))
        .select("m.*", *[f"q.{q}" for q in QUARTILES])
    )
    share = F.try_divide("pop_in_band", whole)
    return stats.withColumn("wtd_pc_pop", share).withColumn(
        "wtd_pc_pop_label", F.bround("wtd_pc_pop", 4)
    )


def one_level(summary: DataFrame, level: str) -> DataFrame:
    """The rows of one level out of :func:`summarise_all`, without the keys it has not."""
    unused = [k for k in TOTALS if k not in LEVELS[level][0]]
    return summary.where(F.col("level") == level).drop("level", *unused)


def summarise_all(complete: DataFrame) -> DataFrame:
    """All four levels in one pass; ``level`` names the level, unused keys are NULL."""
    sets = [[F.col(c) for c in [*extra, *BY_BAND]] for extra, _ in LEVELS.values()]
    every = ["province", "geog", *BY_BAND]
    stats = complete.groupingSets(sets, *every).agg(
        *_moments(["tot_pop", "geog_pop", "prov_pop"]),
        F.grouping("province").alias("no_province"),
        F.grouping("geog").alias("no_geog"),
    )
    province, geog = F.col("no_province") == 0, F.col("no_geog") == 0
    level = (
        F.when(province & geog, "province_zone")
        .when(province, "province")
        .when(geog, "zone")
        .otherwise("nation")
    )
    whole = F.when(geog, F.col("geog_pop")).when(province, F.col("prov_pop")).otherwise(
        F.col("tot_pop")
    )
    extras = {name: extra for name, (extra, _) in LEVELS.items()}
    quartiles = nested_quantiles(complete, BY_BAND, extras, "pc_pop", QUARTILES)
    stats = (
        stats.withColumn("level", level)
        .alias("m")
        .join(quartiles.alias("q"), same_keys("m", "q", ["level", *every]))
        .select("m.*", *[f"q.{q}" for q in QUARTILES])
    )
    return stats.select(
        "level",
        *every,
        *[c for c in _STATS if c not in ("geog_pop", "prov_pop", "wtd_pc_pop", "wtd_pc_pop_label")],
        F.when(geog, F.col("geog_pop")).alias("geog_pop"),
        F.when(province, F.col("prov_pop")).alias("prov_pop"),
        F.try_divide(F.col("pop_in_band"), whole).alias("wtd_pc_pop"),
        F.bround(F.try_divide(F.col("pop_in_band"), whole), 4).alias("wtd_pc_pop_label"),
    )


_STATS = [
    "pop_in_band",
    "avg_pc_pop",
    "sd_pc_pop",
    *QUARTILES,
    "max_pc_pop",
    "tot_pop",
    "geog_pop",
    "prov_pop",
    "wtd_pc_pop",
    "wtd_pc_pop_label",
]


def compare_seasons(
    summary: DataFrame, keys: Sequence[str], carried: Mapping[str, str]
) -> DataFrame:
    """Normal and monsoon share of the same group side by side.

    ``carried`` maps output columns to columns that are equal in both seasons.
    """
    wide = (
        summary.where(F.col("season").isin(NON_WALKING))
        .groupBy(*keys)
        .pivot("season", NON_WALKING)
        .agg(
            F.first("wtd_pc_pop").alias("share"),
            F.first("wtd_pc_pop_label").alias("label"),
            *[F.first(c).alias(out) for out, c in carried.items()],
        )
    )
    return wide.select(
        *keys,
        F.col(f"{NORMAL}_share").alias("normal_share"),
        F.col(f"{MONSOON}_share").alias("monsoon_share"),
        F.col(f"{NORMAL}_label").alias("normal_label"),
        F.col(f"{MONSOON}_label").alias("monsoon_label"),
        *[
            F.coalesce(F.col(f"{NORMAL}_{out}"), F.col(f"{MONSOON}_{out}")).alias(out)
            for out in carried
        ],
    )


def melt(df: DataFrame, ids: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(measures), "variable", "value")


def units_per_zone(pooled: DataFrame) -> DataFrame:
    """Number of different units per (zone, facility type)."""
    return pooled.groupBy("geog", "fac_type").agg(F.count_distinct("adm2_code").alias("geog_count"))
