"""Recursive indicators as linear recurrences (formulas are our definitions).

Daily bars of one instrument are bounded by the calendar, so their means share
one shuffle; pass ``chunked=True`` for longer series, which are then cut into
chunks that hand on their last value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.operators.ordered import smoothed

KEYS = ["market", "ts_code"]


def _decay(span: int) -> float:
    """Share of the value before in an exponential mean of ``span`` bars."""
    return 1.0 - 2.0 / (span + 1.0)


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, keys: list[str] = KEYS, order: list[str] = ["trade_date"], chunked: bool = False) -> DataFrame:  # noqa: B006
    """DIF, DEA and 2·(DIF − DEA); every mean starts at its first value.  ``order`` is unique within a key."""
    rows = bars.filter(F.col("close").isNotNull()).select(*keys, *order, "close")
    both = smoothed(rows, keys, order, {"_fast": ("close", _decay(fast), None), "_slow": ("close", _decay(slow), None)}, chunked)
    moved = both.withColumn("dif", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow", "close")
    out = smoothed(moved, keys, order, {"dea": ("dif", _decay(signal), None)}, chunked)
    return out.select(*keys, *order, "dif", "dea", (2.0 * (F.col("dif") - F.col("dea"))).alias("macd"))


def kdj(bars: DataFrame, n: int = 9, seed: float = 50.0) -> DataFrame:
    """K and D smooth the position of the close in the last ``n`` bars by one third, both from ``seed``; J = 3K − 2D."""
    span = Window.partitionBy(*KEYS).orderBy("trade_date").rowsBetween(-n + 1, 0)
    low, high = F.min("low").over(span), F.max("high").over(span)
    position = F.coalesce(F.try_divide((F.col("close") - low) * 100.0, high - low), F.lit(seed))
    rows = bars.filter(F.col("close").isNotNull()).select(*KEYS, "trade_date", position.alias("rsv"))
    k = smoothed(rows, KEYS, ["trade_date"], {"k": ("rsv", 2.0 / 3.0, seed)}, chunked=False)
    out = smoothed(k, KEYS, ["trade_date"], {"d": ("k", 2.0 / 3.0, seed)}, chunked=False)
    return out.select(*KEYS, "trade_date", "k", "d", (3.0 * F.col("k") - 2.0 * F.col("d")).alias("j"))
