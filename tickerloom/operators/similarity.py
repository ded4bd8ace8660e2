"""Most similar earlier vectors: each key's newest vector against its own history.

One query vector per key meets the key's rows, so the work grows linearly with
the rows.  Groups of any size get it through an equality join, which Spark
splits where a key is hot; groups known to be small get it through a window,
which saves the second scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.operators.newest import last_rows, newest_row


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, also where ``body`` uses it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def centred(vector: Column) -> Column:
    """Mean removed, so that the cosine of two vectors is their correlation."""
    return let(total(vector) / F.size(vector), lambda mean: F.transform(vector, lambda x: x - mean))


def closest_to_newest(
    df: DataFrame, keys: list[str], order: str, vector: str, k: int, earlier_than: int = 1, position: str | None = None, bounded: bool = False
) -> DataFrame:
    """The ``k`` rows of each key most similar to the key's newest row.

    ``position`` numbers the rows of a key; rows less than ``earlier_than``
    positions before the newest are not compared (they overlap it).  Similarity
    is rounded to 6 digits before ranking; ties go to the newer row.  Set
    ``bounded`` only where a key's rows fit one task whatever the data size.
    """
    position = position or order
    v = F.col(vector).cast("array<double>")
    rows = df.select(*keys, order, *({position} - {order}), v.alias("_v"), dot(v, v).alias("_vv"))
    if bounded:
        whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        pairs = rows.withColumns({"_q": F.last("_v").over(whole), "_qq": F.last("_vv").over(whole), "_at": F.last(position).over(whole)})
    else:
        asked = newest_row(rows, keys, [order]).select(*keys, F.col("_v").alias("_q"), F.col("_vv").alias("_qq"), F.col(position).alias("_at"))
        pairs = rows.join(asked, keys)
    pairs = pairs.filter(F.col(position) <= F.col("_at") - earlier_than)
    cosine = F.try_divide(dot(F.col("_v"), F.col("_q")), F.sqrt(F.col("_vv")) * F.sqrt(F.col("_qq")))
    # A zero vector has no direction: it is left out before the cosine is taken.
    scored = pairs.filter("_vv > 0 AND _qq > 0").withColumn("similarity", F.round(cosine, 6))
    return last_rows(scored.drop("_v", "_vv", "_q", "_qq", "_at"), keys, ["similarity", order], k, "place")
