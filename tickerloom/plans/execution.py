"""Execution plans: summary, stages, calendar and statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.scalar import effective_buy, plan_status, trading_clock
from tickerloom.operators.lookup import decode
from tickerloom.operators.newest import top

# Action labels (a blank action is undecided).
ACTION_LABELS = [
    ("BUY_AT_OPEN", "买入"), ("BUY_ON_PULLBACK", "等回调"), ("WAIT_OBSERVE", "观望"), ("SKIP_TODAY", "放弃"), ("EXIT_SIGNAL", "止损"),
]
NO_ACTION_LABEL = "待定"


def _yes(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(False))


def _acts(action: str) -> Column:
    return F.count_if(F.coalesce(F.col("open_action") == action, F.lit(False)))


def summary(plans: DataFrame) -> DataFrame:
    """Counts per day by action and flag; an exit signal counts only in the total."""
    return plans.groupBy("plan_date").agg(
        F.count("*").alias("total"), _acts("BUY_AT_OPEN").alias("buy_now"), _acts("BUY_ON_PULLBACK").alias("buy_on_pullback"),
        _acts("WAIT_OBSERVE").alias("wait"), _acts("SKIP_TODAY").alias("skip"), F.count_if(_yes("hit_target")).alias("hit_target"),
        F.count_if(_yes("hit_stop")).alias("hit_stop"),
    )


def stages(plans: DataFrame) -> DataFrame:
    """Which stages have left a trace per day."""
    def any_of(condition):
        return F.coalesce(F.bool_or(condition), F.lit(False))

    return plans.groupBy("plan_date").agg(
        any_of(F.col("overnight_adjustment").isNotNull() | F.col("adjusted_buy").isNotNull()).alias("pre_market"),
        any_of(F.col("auction_price").isNotNull()).alias("auction"),
        any_of(F.coalesce(F.col("open_action"), F.lit("")) != "").alias("opening"),
        any_of(F.col("current_price").isNotNull()).alias("intraday"),
    )


def status_of_days(days: DataFrame, decoded: DataFrame) -> DataFrame:
    """The stages of each asked day: (plan_date, weekday, is_weekend, has_snapshot, stage, done).

    A day without a snapshot, or with an unreadable one, has no stage done.
    ``days``: plan_date as dates; ``decoded``: documents with dates as text.
    """
    readable = decoded.filter("error IS NULL").groupBy("plan_date").agg(F.flatten(F.collect_list("plans")).alias("plans"))
    weekday = F.weekday("plan_date")
    asked = days.select(F.date_format("plan_date", "yyyy-MM-dd").alias("plan_date"), weekday.alias("weekday"), (weekday >= 5).alias("is_weekend"))
    found = asked.join(readable, "plan_date", "left").withColumn("has_snapshot", F.col("plans").isNotNull())

    def any_of(test):
        return F.coalesce(F.exists("plans", test), F.lit(False))

    return found.select(
        "plan_date", "weekday", "is_weekend", "has_snapshot",
        any_of(lambda p: p["overnight_adjustment"].isNotNull() | p["adjusted_buy"].isNotNull()).alias("pre_market"),
        any_of(lambda p: p["auction_price"].isNotNull()).alias("auction"),
        any_of(lambda p: F.coalesce(p["open_action"], F.lit("")) != "").alias("opening"),
        any_of(lambda p: p["current_price"].isNotNull()).alias("intraday"),
    ).unpivot(["plan_date", "weekday", "is_weekend", "has_snapshot"], ["pre_market", "auction", "opening", "intraday"], "stage", "done")


def clock_view(times: DataFrame, column: str) -> DataFrame:
    return times.select("*", *[c.alias(n) for n, c in trading_clock(column).items()])


def calendar(decoded: DataFrame, days: int = 5) -> DataFrame:
    """Roll-up of the newest ``days`` days that have documents; a day with a broken one reports the error."""
    def matching(test):
        return F.sum(F.size(F.filter("plans", lambda p: F.coalesce(test(p), F.lit(False)))))

    by_day = decoded.groupBy("plan_date").agg(
        F.sum(F.size("plans")).alias("_total"), matching(lambda p: p["open_action"] == "BUY_AT_OPEN").alias("_buy"),
        matching(lambda p: p["hit_target"]).alias("_target"), F.max("error").alias("error"),
    )
    fine = F.col("error").isNull()
    return top(by_day, [F.col("plan_date").desc()], days).select(
        "plan_date", F.when(fine, F.col("_total")).alias("total_picks"), F.when(fine, F.col("_buy")).alias("buy_signals"),
        F.when(fine, F.col("_target")).alias("hit_target"), "error",
    )


def status_view(plans: DataFrame) -> DataFrame:
    """Effective buy price, overnight adjustment in percent and status of each plan."""
    return plans.select(
        "plan_date", "ts_code", effective_buy("adjusted_buy", "predicted_buy").alias("buy"),
        F.round(F.col("overnight_adjustment") * 100.0, 1).alias("overnight_pct"),
        plan_status("hit_target", "hit_stop", "open_action").alias("status"),
    )


def label_actions(plans: DataFrame) -> DataFrame:
    """Add the action label: unknown actions keep their text, blank ones are undecided."""
    return decode(plans, "open_action", ACTION_LABELS, "action_label", NO_ACTION_LABEL)
