"""Decoding of codes by literal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decode(df: DataFrame, column: str, labels: list[tuple[str, str]], out: str, blank: str | None = None) -> DataFrame:
    """Add the label of ``column`` as ``out``: an unknown value keeps its text, a blank or missing one gives ``blank``.

    ``labels`` is a literal list, so its broadcast does not grow with the data.
    """
    table = df.sparkSession.createDataFrame(labels, f"{column} string, {out} string")
    raw = F.nullif(F.col(column), F.lit(""))
    return df.join(F.broadcast(table), column, "left").withColumn(out, F.coalesce(out, raw, F.lit(blank).cast("string")))
