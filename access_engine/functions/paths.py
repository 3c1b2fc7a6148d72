"""Provenance taken from file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _found(path: Column, pattern: str) -> Column:
    text = F.regexp_extract(path, pattern, 1)
    return F.when(F.length(text) > 0, text)


def season_of(path: Column) -> Column:
    """Text before the first slash."""
    return _found(path, "^([^/]*)")


def facility_of(path: Column) -> Column:
    """Text between the first and the last underscore."""
    return _found(path, "_(.*)_")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def chart_season_of(path: Column) -> Column:
    """Text before the first underscore of the file name."""
    return _found(file_name(path), "^([^_]*)")


def chart_type_of(path: Column) -> Column:
    """Text between the first and the last underscore of the file name."""
    return _found(file_name(path), "_(.*)_")


def dataset_of(file: Column) -> Column:
    """File name up to its first dot, then its first two underscore parts."""
    return F.substring_index(F.substring_index(file, ".", 1), "_", 2)
