"""Registered queries on the driver tables and the SQL each is compared with."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks import catchment, charts, classification, geometry, sources, statistics
from checks.order_grid import OrderGrid

_PARTS = (classification, catchment, geometry, statistics, charts, sources)


def _on_tables(plan: Callable[[OrderGrid], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: plan(OrderGrid(spark, folder))


QUERIES = {name: _on_tables(plan) for part in _PARTS for name, plan in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
ORACLE["chart_folders"] = ORACLE["chart_lgu_bands"]
