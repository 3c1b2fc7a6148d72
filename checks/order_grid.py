"""The accessibility layers read off the order tables (see FIXTURES.md).

One raster cell per order on a 125-column grid, population from the order lines, nations as local
government units, regions as provinces, suppliers as diamond-shaped catchments, and one travel-time
layer per season and facility type.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from access_engine import config
from access_engine.operators.grid import Grid, by_rows

NCOLS = 125
EXTENT = 500.0
# --- Fixed values: layer order of the fixture rasters --------------------------------
SEASONS = ["NM", "NMW", "MSN", "MSNW"]
FACILITIES = ["allhf", "allhosp", "dhq", "privhosp", "govhosp", "hps", "banks", "fi"]


LAYERS = [(season, fac) for season in SEASONS for fac in FACILITIES]

# Declared, so that opening a table runs no job to look for its schema.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_totalprice double",
    "lineitem": "l_orderkey bigint, l_quantity double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint",
}
CELL = [
    "o_orderkey as cell",
    f"cast(o_orderkey div {NCOLS} as int) as row_no",
    f"cast(o_orderkey % {NCOLS} as int) as col_no",
]


def spread(scan: DataFrame) -> DataFrame:
    """Give a scan of few splits one partition per core before its rows are multiplied.

    A scan of many splits stays as it is; only a plain scan may be passed, so that counting its
    partitions runs no job.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


class OrderGrid:
    """The layers of one folder of tables; every layer is a plan built at most once."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def grid(self) -> Grid:
        """The raster header: one number (grid height) read from the order keys."""
        nrows = self.table("orders").agg(F.max("o_orderkey")).first()[0] // NCOLS + 1
        return Grid(0.0, EXTENT, EXTENT / NCOLS, EXTENT / nrows, NCOLS, nrows)

    @cached_property
    def population(self) -> DataFrame:
        """Population raster ``cell, row_no, col_no, pop``; an order without lines has 0."""
        lines = self.table("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
        orders = spread(self.table("orders").select("o_orderkey"))
        return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").selectExpr(
            *CELL, "coalesce(q, 0D) as pop"
        )

    @cached_property
    def base_hours(self) -> DataFrame:
        """The travel-time raster all layers scale: ``cell, row_no, col_no, base_hours``."""
        return spread(self.table("orders")).selectExpr(
            *CELL,
            """case when o_orderkey % 97 = 0 then cast(null as double)
                    when o_orderkey % 211 = 0 then 1.01D
                    when o_orderkey % 199 = 0 then 100D
                    else (o_totalprice / 500000D) * (o_totalprice / 500000D)
                         * (o_totalprice / 500000D) * 110D - 2D end as base_hours""",
        )

    @cached_property
    def stack(self) -> DataFrame:
        """All travel-time layers as one multi-layer raster ``cell, row_no, col_no, hours array``.

        ``LAYERS`` names the array positions, as the header of a multi-layer raster file would.
        """
        return self._layered(self.base_hours)

    @cached_property
    def row_stack(self) -> DataFrame:
        """The stack with every raster row in one task, dealt before the layers are there."""
        return self._layered(self.by_rows(self.base_hours))

    def by_rows(self, df: DataFrame) -> DataFrame:
        return by_rows(df, self.grid, len(LAYERS))

    def _layered(self, cells: DataFrame) -> DataFrame:
        n = len(FACILITIES)
        return cells.selectExpr(
            "cell",
            "row_no",
            "col_no",
            f"""transform(sequence(0, {len(LAYERS) - 1}), k -> base_hours
                    * (1D + 0.25D * (k div {n})) * (1D + 0.125D * (k % {n}))) as hours""",
        )

    @cached_property
    def lgu_edges(self) -> DataFrame:
        """Unit outlines as directed edges ``id, seq, x1, y1, x2, y2``; neighbours share corners."""
        # seq, then column and row offset of the two corners of the edge
        steps = "(0, 0, 0, 1, 0), (1, 1, 0, 1, 1), (2, 1, 1, 0, 1), (3, 0, 1, 0, 0)"

        def corner(i: str, j: str) -> list[str]:
            return [
                f"double({along} * 100 + if({along} in (0, 5), 0, ({i} * {a} + {j} * {b}) % 21 - 10))"
                for along, a, b in ((i, 37, 17), (j, 13, 29))
            ]

        (x1, y1), (x2, y2) = corner("i1", "j1"), corner("i2", "j2")
        return (
            self.table("nation")
            .selectExpr(
                "n_nationkey as id",
                "n_nationkey % 5 as i",
                "n_nationkey div 5 as j",
                f"inline(array({steps})) as (seq, a, b, c, d)",
            )
            .selectExpr("id", "seq", "i + a as i1", "j + b as j1", "i + c as i2", "j + d as j2")
            .selectExpr("id", "seq", f"{x1} as x1", f"{y1} as y1", f"{x2} as x2", f"{y2} as y2")
        )

    @cached_property
    def lgu_codes(self) -> DataFrame:
        """Attributes of the units without population: ``id, hlcit_code, lu_name, state``."""
        return self.table("nation").selectExpr(
            "n_nationkey as id",
            """concat('524 ', string(n_regionkey + 1), ' ', lpad(string(n_nationkey), 2, '0'),
                      ' 1 ', lpad(string(n_nationkey), 3, '0')) as hlcit_code""",
            "n_name as lu_name",
            "string(n_regionkey + 1) as state",
        )

    @cached_property
    def zone_lookup(self) -> DataFrame:
        """Zone of each unit by rows of nations; unit 24 has none."""
        zones = F.array(*[F.lit(z) for z in config.ZONE_ORDER])
        place = F.least(F.floor(F.col("id") / 5), F.lit(len(config.ZONE_ORDER) - 1)).cast("int")
        return self.lgu_codes.where("id <> 24").select(
            F.col("hlcit_code").alias("adm2_code"), F.get(zones, place).alias("geog")
        )

    @cached_property
    def catchment_edges(self) -> DataFrame:
        """Facility catchments as directed edges ``id, fac_type, seq, x1, y1, x2, y2``."""
        # seq, then unit offsets of the two corners of the edge
        steps = "(0, 1, 0, 0, 1), (1, 0, 1, -1, 0), (2, -1, 0, 0, -1), (3, 0, -1, 1, 0)"
        names = ", ".join(f"'{f}'" for f in FACILITIES)
        return (
            spread(self.table("supplier"))
            .selectExpr(
                "s_suppkey as id",
                f"get(array({names}), int(s_suppkey % 8)) as fac_type",
                "s_suppkey * 73 % 500 as cx",
                "s_suppkey * 151 % 500 as cy",
                "8 + s_suppkey % 17 as r",
                f"inline(array({steps})) as (seq, a, b, c, d)",
            )
            .selectExpr(
                "id",
                "fac_type",
                "seq",
                "double(cx + a * r) as x1",
                "double(cy + b * r) as y1",
                "double(cx + c * r) as x2",
                "double(cy + d * r) as y2",
            )
        )
