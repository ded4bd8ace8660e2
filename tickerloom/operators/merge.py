"""Changes to keyed tables, written as joins that yield the next table version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.operators.newest import newest_row


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], updates: dict[str, str], inserts: dict[str, str]) -> DataFrame:
    """Merge ``changes`` into ``base`` on ``keys``; both sides unique per key.

    ``updates`` maps a column to the SQL value it takes where the key exists in
    both, ``inserts`` where it is new; in both, ``b`` is the stored and ``c``
    the incoming row.  Columns not named keep the stored (or incoming) value.
    """
    columns = [c for c in base.columns if c not in keys]
    b = base.select(*keys, F.struct(*columns).alias("b"))
    c = changes.select(*keys, F.struct(*[x for x in changes.columns if x not in keys]).alias("c"))
    both = b.join(c, keys, "full_outer")
    incoming = {x for x in changes.columns if x not in keys}

    def value(column: str):
        fresh = inserts.get(column, f"c.{column}" if column in incoming else "NULL")
        kept = updates.get(column, f"b.{column}")
        return (
            F.when(F.col("b").isNull(), F.expr(fresh))
            .when(F.col("c").isNull(), F.col(f"b.{column}"))
            .otherwise(F.expr(kept))
            .alias(column)
        )

    return both.select(*keys, *[value(x) for x in columns])


def newest_wins(base: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Union both versions and keep the newest row of each key."""
    return newest_row(base.unionByName(changes), keys, order)


def delete_keys(base: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``base`` whose key is not in ``doomed``."""
    return base.join(doomed.select(*keys), keys, "left_anti")


def delete_report(base: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    """Per requested key, whether something was there to remove."""
    found = base.select(*keys).distinct().withColumn("removed", F.lit(True))
    requested = doomed.select(*keys).distinct()
    return requested.join(found, keys, "left").withColumn("removed", F.coalesce("removed", F.lit(False)))


def fill_missing(base: DataFrame, arriving: DataFrame, keys: list[str]) -> DataFrame:
    """Arriving rows whose key the base does not hold yet, the newest arrival of each, for a catch-up load."""
    return newest_row(arriving.join(base.select(*keys), keys, "left_anti"), keys, ["loaded_at"])
