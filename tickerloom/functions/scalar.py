"""Column expressions: numbers, money, clocks, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price per million tokens, in USD.
INPUT_USD_PER_MILLION = 0.27
OUTPUT_USD_PER_MILLION = 1.10


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and both infinities become null."""
    x = col(c)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def zero_if_null(c: str | Column) -> Column:
    """Null becomes 0, while NaN becomes null: the order of the two steps matters."""
    return finite(F.coalesce(col(c), F.lit(0.0)))


def nonzero(c: str | Column) -> Column:
    """Zero and null both count as missing."""
    return F.nullif(col(c), F.lit(0.0))


def token_cost(prompt: str | Column, output: str | Column) -> Column:
    def part(c, price):
        return F.coalesce(col(c), F.lit(0)) / F.lit(1e6) * F.lit(price)

    return part(prompt, INPUT_USD_PER_MILLION) + part(output, OUTPUT_USD_PER_MILLION)


def percent(part: str | Column, whole: str | Column, digits: int = 1) -> Column:
    """100·part/whole, null when ``whole`` is 0."""
    return F.round(F.try_divide(col(part) * F.lit(100.0), col(whole)), digits)


def whole_percent(c: str | Column, count: str | Column) -> Column:
    """Half-up whole percent, 0 when nothing was counted."""
    x = F.floor(F.coalesce(col(c), F.lit(0.0)) + F.lit(0.5))
    return F.when(F.coalesce(col(count), F.lit(0)) == 0, F.lit(0)).otherwise(x).cast("bigint")


def upside(target: str | Column, buy: str | Column) -> Column:
    """(target − buy) / buy in percent, null if either is null or 0."""
    t, b = nonzero(target), nonzero(buy)
    return (t - b) / b * F.lit(100.0)


def score_band(score: str | Column) -> Column:
    x = F.coalesce(col(score), F.lit(0.0))
    return F.when(x >= 70, "strong").when(x >= 55, "fair").otherwise("weak")


def calibration_health(accuracy: str | Column, expected: str | Column) -> Column:
    x = F.coalesce(col(accuracy), F.lit(0.0))
    return F.when(x >= col(expected) * 0.8, "good").when(x >= 50, "fair").otherwise("bad")


def enough_samples(count: str | Column, least: int = 3) -> Column:
    return F.coalesce(col(count), F.lit(0)) >= least


def above(c: str | Column, limit: float) -> Column:
    return F.coalesce(col(c), F.lit(0.0)) > limit


def at_least(c: str | Column, limit: float) -> Column:
    return F.coalesce(col(c), F.lit(0.0)) >= limit


def at_most(c: str | Column, limit: float) -> Column:
    return F.coalesce(col(c), F.lit(0.0)) <= limit


def effective_buy(adjusted: str | Column, predicted: str | Column) -> Column:
    """The adjusted price unless it is null or 0."""
    return F.coalesce(nonzero(adjusted), col(predicted))


def plan_status(hit_target: str | Column, hit_stop: str | Column, action: str | Column) -> Column:
    """Target beats stop, stop beats bought, all else is pending."""
    def yes(c):
        return F.coalesce(col(c), F.lit(False))

    return (
        F.when(yes(hit_target), "已止盈")
        .when(yes(hit_stop), "已止损")
        .when(col(action) == "BUY_AT_OPEN", "已买入")
        .otherwise("待执行")
    )


def beijing(ts: str | Column) -> Column:
    """Wall clock at +08:00 of a UTC time without zone."""
    return col(ts) + F.expr("INTERVAL 8 HOURS")


def trading_clock(ts: str | Column) -> dict[str, Column]:
    """Date, HH:MM, weekday (Monday = 0) and weekend flag on the +08:00 clock."""
    local = beijing(ts)
    weekday = F.weekday(local).cast("bigint")
    return {
        "date": F.date_format(local, "yyyy-MM-dd"),
        "time": F.date_format(local, "HH:mm"),
        "weekday": weekday,
        "is_weekend": weekday >= 5,
    }


def iso_date(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def iso_time(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss")


def since_days(ts: str | Column, as_of: Column, days: int) -> Column:
    """At or after midnight ``days`` days before ``as_of``."""
    return col(ts) >= F.date_sub(F.to_date(as_of), days).cast("timestamp_ntz")


def still_valid(created: str | Column, ttl_seconds: str | Column, as_of: str | Column) -> Column:
    """Age in [0, ttl], both ends included."""
    limit = col(created) + F.make_dt_interval(secs=col(ttl_seconds).cast("decimal(18,6)"))
    return (col(as_of) >= col(created)) & (col(as_of) <= limit)


def title_or_default(title: str | Column, ident: str | Column) -> Column:
    return F.coalesce(F.nullif(col(title), F.lit("")), F.concat(F.lit("会话 "), col(ident).cast("string")))


def instrument_label(name: str | Column, code: str | Column, industry: str | Column) -> Column:
    return F.concat(col(name), F.lit(" ("), col(code), F.lit(") · "), F.coalesce(col(industry), F.lit("-")))
