"""Exact quantiles (linear interpolation) for groups of any size.

The values are counted, ordered over all tasks by a range partitioning, and ranked by adding up
partition totals; no task ever holds more of a group than one range partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from access_engine.storage import stored


def same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    """Null-safe equality of the key columns of two aliased sides."""
    pairs = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    return reduce(lambda a, b: a & b, pairs, F.lit(True))


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """``keys`` + one column per entry of ``probs``; a group without a value has no row."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    )
    # written out, because both the totals and the ranks must see the same partitions
    ordered = stored(
        counted.repartitionByRange(partitions, *keys, value).withColumn(
            "part", F.spark_partition_id()
        ),
        "ranks",
    )
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ordered.groupBy(*keys, "part")
        .agg(F.sum("n").alias("m"))
        .select(
            *keys,
            "part",
            F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"),
            F.sum("m").over(Window.partitionBy(*keys)).alias("total"),
        )
    )
    within = Window.partitionBy(*keys, "part").orderBy(value)
    ranks = (
        ordered.withColumn("upto", F.sum("n").over(within))
        .alias("v")
        .join(totals.alias("t"), same_keys("v", "t", [*keys, "part"]))
        .select(
            *[F.col(f"v.{k}").alias(k) for k in keys],
            F.col(f"v.{value}").alias("value"),
            (F.col("before") + F.col("upto") - F.col("n")).alias("lo"),
            (F.col("before") + F.col("upto")).alias("hi"),
            "total",
        )
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("lo") <= rank) & (rank < F.col("hi")), F.col("value")))

    places = {name: (F.col("total") - 1) * F.lit(float(p)) for name, p in probs.items()}
    found = ranks.groupBy(*keys).agg(
        *[at(F.floor(h)).alias(f"{name}_floor") for name, h in places.items()],
        *[at(F.ceil(h)).alias(f"{name}_ceil") for name, h in places.items()],
        *[F.max(h - F.floor(h)).alias(f"{name}_part") for name, h in places.items()],
    )
    return found.select(*keys, *_between(probs))


def _between(probs: Mapping[str, float]) -> list[Column]:
    """Linear interpolation between the values at the ranks below and above."""
    return [
        (
            F.col(f"{n}_floor") + (F.col(f"{n}_ceil") - F.col(f"{n}_floor")) * F.col(f"{n}_part")
        ).alias(n)
        for n in probs
    ]


def nested_quantiles(
    df: DataFrame,
    base: Sequence[str],
    levels: Mapping[str, Sequence[str]],
    value: str,
    probs: Mapping[str, float],
) -> DataFrame:
    """Quantiles of groupings that share the keys ``base``: ``level, base``, all further keys, ``probs``.

    ``levels`` names the further keys of each level; those it has not are NULL. Values are counted once per finest group
    and put in order once, by ``base`` and value. What the levels differ in are the counts of each group in each range,
    which tell the range that holds a rank; only there the counts of a level's groups are merged and followed to it. No
    row is repeated for a level outside the ranges that hold its ranks.
    """
    extras = list(dict.fromkeys(k for keys in levels.values() for k in keys))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = df.where(F.col(value).isNotNull()).groupBy(*base, *extras, value).agg(F.count(F.lit(1)).alias("n"))
    # written out, because counts and ranks must see the same ranges
    ordered = stored(
        counted.repartitionByRange(partitions, *base, value).withColumn("part", F.spark_partition_id()), "ranks"
    )
    each = F.array(
        *[
            F.struct(
                F.lit(name).alias("level"),
                *[(F.col(k) if k in keys else F.lit(None).cast(df.schema[k].dataType)).alias(k) for k in extras],
                *[F.lit(k in keys).alias(f"by_{k}") for k in extras],
            )
            for name, keys in levels.items()
        ]
    )
    group = ["level", *base, *extras]
    marks = ordered.groupBy(*base, *extras, "part").agg(F.sum("n").alias("m"))
    marks = marks.select(*base, "part", "m", F.inline(each))
    marks = marks.groupBy(*group, *[f"by_{k}" for k in extras], "part").agg(F.sum("m").alias("m"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = marks.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0)))
    placed = placed.withColumn("total", F.sum("m").over(whole))
    ranks = []
    for name, p in probs.items():
        place = (F.col("total") - 1) * F.lit(float(p))
        for side, rank in (("floor", F.floor(place)), ("ceil", F.ceil(place))):
            ranks.append(
                F.struct(F.lit(f"{name}_{side}").alias("name"), rank.alias("rank"), (place - F.floor(place)).alias("share"))
            )
    wanted = placed.select("*", F.inline(F.array(*ranks)))
    wanted = wanted.where("before <= rank AND rank < before + m").withColumn("rank", F.col("rank") - F.col("before"))
    ranges = wanted.select(*group, *[f"by_{k}" for k in extras], "part").distinct()
    same = same_keys("r", "w", [*base, "part"])
    for k in extras:
        same &= ~F.col(f"w.by_{k}") | F.col(f"r.{k}").eqNullSafe(F.col(f"w.{k}"))
    merged = (
        ordered.alias("r")
        .join(ranges.alias("w"), same)
        .groupBy(*[F.col(f"w.{k}").alias(k) for k in group], F.col("w.part").alias("part"), F.col(f"r.{value}").alias("value"))
        .agg(F.sum("n").alias("n"))
    )
    within = Window.partitionBy(*group, "part").orderBy("value")
    merged = merged.withColumn("upto", F.sum("n").over(within))
    hit = (F.col("v.upto") - F.col("v.n") <= F.col("k.rank")) & (F.col("k.rank") < F.col("v.upto"))
    found = (
        merged.alias("v")
        .join(wanted.alias("k"), same_keys("v", "k", [*group, "part"]) & hit)
        .select(*[F.col(f"v.{k}").alias(k) for k in group], "v.value", "k.name", "k.share")
    )

    def at(name: str, column: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col(column)))

    picked = found.groupBy(*group).agg(
        *[at(f"{n}_{side}", "value").alias(f"{n}_{side}") for n in probs for side in ("floor", "ceil")],
        *[at(f"{n}_floor", "share").alias(f"{n}_part") for n in probs],
    )
    return picked.select(*group, *_between(probs))
