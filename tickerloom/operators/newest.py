"""Newest row, last N rows, pages and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_first(*columns: str) -> list[Column]:
    """Descending order in which missing values come last."""
    return [F.col(c).desc_nulls_last() for c in columns]


def last_rows(df: DataFrame, keys: list[str], order: list[str], n: int, number: str | None = None) -> DataFrame:
    """The ``n`` newest rows of each key, newest = 1.

    Written as ``row_number() <= n`` because Spark turns that into a per-task
    limit ahead of the shuffle: a hot key sends at most ``n`` rows per task.
    """
    name = number or "_rn"
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first(*order)))
    rows = df.withColumn(name, rank).filter(F.col(name) <= n)
    return rows.withColumn(name, F.col(name).cast("bigint")) if number else rows.drop(name)


def newest_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One newest row per key; name a unique column last in ``order``."""
    return last_rows(df, keys, order, 1)


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Global top ``n`` (planned as one take-ordered step)."""
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a totally ordered result."""
    return df.orderBy(*order).offset(offset).limit(limit)


def numbered(df: DataFrame, order: list[Column], n: int, number: str = "position") -> DataFrame:
    """Top ``n`` with its 1-based position; the window only ever sees ``n`` rows."""
    position = F.row_number().over(Window.orderBy(*order)).cast("bigint")
    return top(df, order, n).withColumn(number, position)
