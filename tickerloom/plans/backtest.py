"""Backtests of picks and forecasts (formulas and thresholds are our definitions)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.operators.ordered import previous_row
from tickerloom.plans.analytics import lagged_return

HORIZONS = (1, 3, 5)
MOMENTUM_LIMIT, INFLATION_LIMIT = 20.0, 3.0
FAVOURED = ["强烈关注", "关注"]
FLAT_BAND = 0.5


KEY = ["market", "ts_code"]


def forward_bars(dates: DataFrame, prices: DataFrame, horizons=HORIZONS) -> DataFrame:
    """For each distinct (market, ts_code, as_of) with a bar on or before it, that bar's 20-day return and what the next h bars bring.

    That is the lowest low, the highest high and the close at h, as columns
    ``low_h``, ``high_h`` and ``close_h``.  Dates and bars are at most one row per
    code and day before they meet, so no group grows with the number of
    entries behind a date; they move once, and all windows share that move.
    The move is asked for, else the windows by ``asked`` get one of their own.
    """
    asked = dates.select(*KEY, "as_of").distinct()
    level = ["low", "high", "close"]
    timeline = prices.select(*KEY, F.col("trade_date").alias("as_of"), *level, F.lit(False).alias("asked")).unionByName(
        asked.select(*KEY, "as_of", F.lit(True).alias("asked")), allowMissingColumns=True
    ).repartition(*KEY)
    own = Window.partitionBy(*KEY, "asked").orderBy("as_of")
    ahead = {}
    for h in horizons:
        span = own.rowsBetween(1, h)
        ahead |= {f"low_{h}": F.min("low").over(span), f"high_{h}": F.max("high").over(span), f"close_{h}": F.lead("close", h).over(own)}
    bars = timeline.select(*KEY, "as_of", "asked", lagged_return(20, own).alias("ret_20d"), *[c.alias(n) for n, c in ahead.items()])
    upto = Window.partitionBy(*KEY).orderBy("as_of", "asked").rowsBetween(Window.unboundedPreceding, 0)
    columns = ["ret_20d", *ahead]
    bar = F.last(F.when(~F.col("asked"), F.struct(*columns)), ignorenulls=True).over(upto)
    known = bars.select(*KEY, "as_of", "asked", bar.alias("bar")).filter(F.col("asked") & F.col("bar").isNotNull())
    return known.select(*KEY, "as_of", *[F.col(f"bar.{c}").alias(c) for c in columns])


def outcomes(entries: DataFrame, runs: DataFrame, prices: DataFrame, horizons=HORIZONS, market: str = "a", keep: Callable[[DataFrame], DataFrame] = lambda bars: bars) -> DataFrame:
    """Return and level hits of each entry per horizon; horizons the bars do not reach are left out.

    Entries are all of one market, and only its bars are looked at.  ``keep``
    (``session.pin``) writes the coming bars first, so that what was shuffled
    for them is off the disk before the entries move.
    """
    dated = entries.join(runs.select(F.col("id").alias("run_id"), F.col("trade_date_as_of").alias("as_of")), "run_id").withColumn("market", F.lit(market))
    known = keep(forward_bars(dated, prices.filter(F.col("market") == market), horizons))
    ahead = [F.struct(F.lit(h).alias("horizon_days"), *[F.col(f"{c}_{h}").alias(c) for c in ("low", "high", "close")]) for h in horizons]
    rows = dated.join(known, [*KEY, "as_of"]).select(
        F.col("id").alias("entry_id"), "run_id", "ts_code", "rank_in_run", "close_price", "rule_composite_score", "llm_composite_score", "recommendation",
        "predicted_buy_price", "predicted_target_price", "predicted_stop_loss", "ret_20d", F.inline(F.array(*ahead)),
    )
    reached = rows.filter(F.col("close").isNotNull())
    return reached.select(
        "entry_id", "run_id", "ts_code", "rank_in_run", "rule_composite_score", "llm_composite_score", "recommendation", "ret_20d", "horizon_days",
        ((F.try_divide(F.col("close"), F.col("close_price")) - 1.0) * 100.0).alias("return_pct"),
        (F.col("low") <= F.col("predicted_buy_price")).alias("hit_buy"), (F.col("high") >= F.col("predicted_target_price")).alias("hit_target"),
        (F.col("low") <= F.col("predicted_stop_loss")).alias("hit_stop"),
    )


def failed() -> Column:
    return ~F.col("hit_buy") | (F.col("return_pct") < 0)


def run_audit(results: DataFrame, horizon: int = 5, top_rank: int = 10) -> DataFrame:
    """Failure rate, mean forward return and mean model-minus-rule score of each run's best ranks."""
    best = results.filter((F.col("horizon_days") == horizon) & (F.col("rank_in_run") <= top_rank))
    return best.groupBy("run_id").agg(
        F.count("*").alias("entries"), F.avg(failed().cast("double")).alias("fail_rate"), F.avg("return_pct").alias("mean_fwd_return"),
        F.avg(F.col("llm_composite_score") - F.col("rule_composite_score")).alias("mean_delta"),
    )


def failure_labels(results: DataFrame, horizon: int = 5) -> DataFrame:
    """One row per entry and failure label."""
    loss = F.col("return_pct") < 0
    labels = F.array_compact(F.array(
        F.when(F.col("ret_20d") > MOMENTUM_LIMIT, "momentum_chase"),
        F.when(F.col("llm_composite_score") - F.col("rule_composite_score") > INFLATION_LIMIT, "score_inflation"),
        F.when(~F.col("hit_buy"), "buy_unreachable"),
        F.when(F.col("recommendation").isin(FAVOURED) & loss, "generic_bullish"),
        F.when(loss, "forward_loss"),
    ))
    return results.filter(F.col("horizon_days") == horizon).select("run_id", "entry_id", F.explode(labels).alias("label"))


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("entries"))


def compare_audits(audits: DataFrame, runs: DataFrame) -> DataFrame:
    """Each audit beside the previous one of the same run kind."""
    dated = audits.join(runs.select(F.col("id").alias("run_id"), "run_kind", "created_at_utc"), "run_id")
    both = previous_row(dated, ["run_kind"], ["created_at_utc", "run_id"], {"run_id": "previous_run", "fail_rate": "_fail", "mean_fwd_return": "_fwd"})
    return both.select(
        "run_id", "run_kind", "fail_rate", "mean_fwd_return", "previous_run", (F.col("fail_rate") - F.col("_fail")).alias("fail_rate_change"),
        (F.col("mean_fwd_return") - F.col("_fwd")).alias("fwd_return_change"),
    )


def market_days(prices: DataFrame, market: str = "a") -> DataFrame:
    """Mean daily change over a market, one row per trade date."""
    return prices.filter(F.col("market") == market).groupBy("trade_date").agg(F.round(F.avg("pct_chg"), 6).alias("pct"))


def verify_forecasts(forecasts: DataFrame, days: DataFrame, band: float = FLAT_BAND) -> DataFrame:
    """Compare each forecast with the first trade date after it; both sides hold one row per calendar day."""
    asked = forecasts.select(F.col("as_of_date").alias("day"), F.col("id"), "market_direction", F.lit(None).cast("double").alias("pct"), F.lit(1).alias("kind"))
    bars = days.filter(F.col("pct").isNotNull()).select(F.col("trade_date").alias("day"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("market_direction"), "pct", F.lit(0).alias("kind"))
    # Walking backwards, a forecast comes before the bar of its own day, so it only sees later ones.
    back = Window.orderBy(F.col("day").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    seen = asked.unionByName(bars).withColumn("actual_pct_chg", F.last("pct", ignorenulls=True).over(back)).filter("kind = 1")
    pct = F.col("actual_pct_chg")
    direction = F.when(pct > band, "bullish").when(pct < -band, "bearish").when(pct.isNotNull(), "range-bound")
    return seen.select("id", "market_direction", "actual_pct_chg", direction.alias("actual_direction"), (F.col("market_direction") == direction).alias("direction_correct"))
