"""The watchlist: its view and its changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.scalar import iso_time
from tickerloom.operators.merge import delete_keys, delete_report, upsert

KEY = ["ts_code", "market"]


def view(watchlist: DataFrame, instruments: DataFrame, market: str = "a") -> DataFrame:
    """Listed instruments with name and industry; an unknown code stands in for its name."""
    rows = watchlist.filter(F.col("market") == market).join(instruments.select(*KEY, "name", "industry"), KEY, "left")
    return rows.select(
        "ts_code", F.coalesce("name", "ts_code").alias("name"), "industry", F.col("note").alias("notes"), "enabled",
        iso_time("created_at_utc").alias("created_at"),
    )


def add(watchlist: DataFrame, requests: DataFrame) -> DataFrame:
    """Insert new rows; an existing row takes a non-blank note and is enabled, else stays as it is."""
    return upsert(
        watchlist, requests, KEY,
        updates={
            "note": "CASE WHEN c.note <> '' THEN c.note ELSE b.note END",
            "enabled": "CASE WHEN c.note <> '' THEN true ELSE b.enabled END",
        },
        inserts={"enabled": "true"},
    )


def remove(watchlist: DataFrame, requests: DataFrame) -> DataFrame:
    return delete_keys(watchlist, requests, KEY)


def removal_report(watchlist: DataFrame, requests: DataFrame) -> DataFrame:
    return delete_report(watchlist, requests, KEY)


def only_listed(instruments: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Instruments on the list; an empty list gives no rows."""
    return instruments.join(watchlist.select(*KEY), KEY, "left_semi")
