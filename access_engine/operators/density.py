"""Gaussian density curves of unit shares, one curve per group, one bandwidth per panel.

Kernels are summed by series: values are counted into boxes one bandwidth wide, and a box keeps moments of its values
about its middle. A box then stands for all its kernels in a Hermite series, so what meets the points of a curve are
boxes, of which a group has few, and never values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from access_engine.functions.quantiles import group_quantiles, same_keys

GRID_POINTS = 512
MIN_POINTS = 3  # smaller groups get no curve
#: Terms of the series. Of each kernel, 1 high at its middle, at most 1.1 * 0.5 ** TERMS / sqrt(TERMS!) is left out,
#: 7e-16, and 2e-16 beyond REACH bandwidths from its box. What is left out adds up over the kernels of a sum.
TERMS = 20
REACH = 8.5


def points_in_limits(df: DataFrame, value: str, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """The axis limits drop what lies outside before any statistic is taken."""
    return df.where(F.col(value).between(lo, hi))


def spreads(points: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Number and standard deviation of the values of every group."""
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp(value).alias("sd")
    )


def bandwidths(points: DataFrame, panel: Sequence[str], group: str, value: str) -> DataFrame:
    """Panel bandwidth: the rule-of-thumb bandwidth of each group, averaged over the groups.

    0.9 * min(sd, iqr / 1.34) * n ** -0.2, the sd alone where the quartiles coincide; a group
    without spread has none and stands aside.
    """
    keys = [*panel, group]
    spread = spreads(points, keys, value)
    quartiles = group_quantiles(points, keys, value, {"q25": 0.25, "q75": 0.75})
    iqr = (F.col("q75") - F.col("q25")) / F.lit(1.34)
    narrow = F.when(F.least("sd", iqr) > 0, F.least("sd", iqr)).otherwise(F.col("sd"))
    joined = spread.alias("a").join(quartiles.alias("b"), same_keys("a", "b", keys))
    own = F.when(narrow > 0, F.lit(0.9) * narrow * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    return joined.select("a.*", own.alias("bw")).groupBy(*panel).agg(F.avg("bw").alias("bw"))


def hermite(terms: int) -> list[list[int]]:
    """Coefficients of the first Hermite polynomials He, lowest power first."""
    rows = [[1], [0, 1]]
    for k in range(1, terms - 1):
        up, down = [0, *rows[k]], [*rows[k - 1], 0, 0]
        rows.append([a - k * b for a, b in zip(up, down)])
    return rows[:terms]


def kernel_sums(
    values: DataFrame, keys: Sequence[str], n: int, lo: float, hi: float
) -> DataFrame:
    """Sum of the kernels of ``values`` (``keys, bw, at``) at ``n`` points from ``lo`` to ``hi``: ``keys, bw, i, x, s``.

    With the distance t of a value from the middle of its box and u of a point from it, both in bandwidths, a kernel is
    exp(-u^2 / 2) times the sum of He_k(u) t^k / k!. A point that no box reaches has no row.
    """
    box = F.floor((F.col("at") - F.lit(lo)) / F.col("bw"))
    middle = F.lit(lo) + (F.col("box") + F.lit(0.5)) * F.col("bw")
    t = (F.col("at") - middle) / F.col("bw")
    power, powers = F.lit(1.0), []
    placed = values.withColumn("box", box).withColumn("t", t)
    for k in range(TERMS):
        powers.append(F.sum(power).alias(f"m{k}"))
        power = power * F.col("t") / F.lit(float(k + 1))
    boxes = placed.groupBy(*keys, "bw", "box").agg(*powers)
    # the series by powers of u: its coefficients are sums of the moments
    rows = hermite(TERMS)
    by_power = [
        sum((F.lit(float(rows[k][j])) * F.col(f"m{k}") for k in range(j, TERMS) if rows[k][j]), F.lit(0.0))
        for j in range(TERMS)
    ]
    step = (hi - lo) / (n - 1)
    around = F.lit(REACH + 0.5) * F.col("bw")
    first = F.greatest(F.ceil((F.col("middle") - around - F.lit(lo)) / F.lit(step)), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col("middle") + around - F.lit(lo)) / F.lit(step)), F.lit(n - 1)).cast("int")
    series = boxes.select(
        *keys, "bw", middle.alias("middle"), *[c.alias(f"c{j}") for j, c in enumerate(by_power)]
    ).withColumns({"first": first, "last": last})
    # few rows that each become many: spread over all cores, whatever their size in bytes
    cores = values.sparkSession.sparkContext.defaultParallelism
    points = (
        series.where("first <= last")
        .repartition(cores)
        .withColumn("i", F.explode(F.sequence("first", "last")))
        .withColumn("x", F.lit(lo) + F.col("i") * F.lit(step))
        .withColumn("u", (F.col("x") - F.col("middle")) / F.col("bw"))
    )
    total = F.lit(0.0)
    for j in reversed(range(TERMS)):
        total = total * F.col("u") + F.col(f"c{j}")
    height = F.exp(F.lit(-0.5) * F.col("u") * F.col("u")) * total
    return points.groupBy(*keys, "bw", "i", "x").agg(F.sum(height).alias("s"))


def density(
    df: DataFrame,
    panel: Sequence[str],
    group: str,
    value: str,
    n: int = GRID_POINTS,
    lo: float = 0.0,
    hi: float = 1.0,
    rel_min: float = 0.01,
    min_points: int = MIN_POINTS,
) -> DataFrame:
    """Curve points ``panel, group, i, x, density``; heights under ``rel_min`` of the panel's peak
    are cut.

    Groups of fewer than ``min_points`` values have no curve.
    """
    points = points_in_limits(df.select(*panel, group, value), value, lo, hi)
    keys = [*panel, group]
    widths = bandwidths(points, panel, group, value)
    sizes = spreads(points, keys, value).where(F.col("n") >= min_points).select(*keys, "n")
    placed = (
        points.alias("p")
        .join(widths.alias("b"), same_keys("p", "b", panel))
        .where(F.col("bw").isNotNull())
        .select("p.*", "bw")
    )
    sums = kernel_sums(placed.withColumnRenamed(value, "at"), keys, n, lo, hi)
    scale = F.col("n") * F.col("bw") * F.lit(math.sqrt(2 * math.pi))
    curves = (
        sums.alias("s")
        .join(sizes.alias("z"), same_keys("s", "z", keys))
        .select(
            *[F.col(f"s.{k}").alias(k) for k in keys],
            "i",
            "x",
            (F.col("s.s") / scale).alias("density"),
        )
    )
    peaks = curves.groupBy(*panel).agg(F.max("density").alias("peak"))
    return (
        curves.alias("c")
        .join(peaks.alias("k"), same_keys("c", "k", panel))
        .where(F.col("density") >= F.lit(rel_min) * F.col("peak"))
        .select("c.*")
    )


def quantile_lines(df: DataFrame, panel: Sequence[str], group: str, value: str) -> DataFrame:
    """Quartiles of every curve's points."""
    points = points_in_limits(df.select(*panel, group, value), value)
    return group_quantiles(
        points, [*panel, group], value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    )
