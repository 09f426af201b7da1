"""Selecting rows by mask, by index and by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equals(column: str, value) -> Column:
    """Equality mask that is false, not NULL, on missing values."""
    return F.col(column).eqNullSafe(F.lit(value))


def select_mask(df: DataFrame, mask: Column) -> DataFrame:
    return df.where(mask)


def mask_positions(df: DataFrame, mask: Column, position: str) -> DataFrame:
    """Positions of the rows a mask selects."""
    return df.where(mask).select(position)


def select_positions(df: DataFrame, wanted: DataFrame, position: str) -> DataFrame:
    """Rows whose position appears in ``wanted``, once per appearance."""
    return df.join(wanted.select(position), position)


def name_matches(column: str, patterns: list[str], regex: bool = False) -> Column:
    """True where the name contains any of the patterns."""
    test = (lambda p: F.col(column).rlike(p)) if regex else (lambda p: F.col(column).contains(p))
    return reduce(lambda a, b: a | b, [test(p) for p in patterns])


def any_all(df: DataFrame, keys: list[str], mask: Column) -> DataFrame:
    """any_true and all_true of a mask per key."""
    return df.groupBy(*keys).agg(F.bool_or(mask).alias("any_true"), F.bool_and(mask).alias("all_true"))
