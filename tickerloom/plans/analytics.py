"""Cross-section and time-series analytics.

Only the names of these results are given, not how they are worked out, so the
formulas and thresholds here are our definitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.operators.neighbours import found_in, settled, unit
from tickerloom.operators.newest import last_rows, top
from tickerloom.operators.ordered import percent_ranks, running_total
from tickerloom.operators.similarity import centred, closest_to_newest
from tickerloom.plans.market import INSTRUMENT, by_instrument, newest_bar, trailing_mean
from tickerloom.session import lent, pin
from tickerloom.sources.sinks import MONTH, stored_months

# Default factor weights of the rule score, and the momentum above which an instrument is dropped.
WEIGHTS = {"ret_20d": 0.4, "high_60d_pct": 0.3, "turnover_rate": 0.3}
MAX_RET_20D = 30.0


def complete_dates(prices: DataFrame, least: int | Column = 1000, market: str | None = None) -> DataFrame:
    """Trade dates with at least ``least`` instruments."""
    rows = prices if market is None else prices.filter(F.col("market") == market)
    counts = rows.groupBy("trade_date").agg(F.count_distinct(*INSTRUMENT).alias("instruments"))
    return counts.filter(F.col("instruments") >= least)


def latest_complete_date(prices: DataFrame, least: int | Column = 1000, market: str | None = None) -> DataFrame:
    return complete_dates(prices, least, market).agg(F.max("trade_date").alias("trade_date"))


def newest_complete_dates(prices: DataFrame, least: int | Column = 1000, days: int = 60) -> DataFrame:
    """The newest ``days`` complete dates, kept so that several steps can use them without another scan."""
    return pin(top(complete_dates(prices, least), [F.col("trade_date").desc()], days).select("trade_date"))


def stored_panel(spark: SparkSession, path: str, schema: str, least: int | Column = 1000, days: int = 60) -> DataFrame:
    """Bars of the newest ``days`` complete dates from a table stored by month, of which only the newest months are read.

    Four months are looked at first, twice as many as long as they hold too
    few complete dates; the months before the oldest date are then pruned.
    """
    stored, months = spark.read.schema(f"{schema}, {MONTH} string").parquet(path), stored_months(spark, path)
    number = 4
    while True:
        recent = stored.filter(F.col(MONTH) >= (months[-number:] or [""])[0])
        dates = newest_complete_dates(recent, least, days)
        if number >= len(months) or dates.count() >= days:
            break
        number *= 2
    oldest = dates.agg(F.date_format(F.min("trade_date"), "yyyy-MM")).scalar()
    return panel(stored.filter(F.col(MONTH) >= oldest), dates).drop(MONTH)


def panel(prices: DataFrame, dates: DataFrame) -> DataFrame:
    """Bars of the given dates (a short list of days), long form."""
    return prices.join(dates, "trade_date", "left_semi")


def coverage_gaps(instruments: DataFrame, prices: DataFrame, since=None) -> DataFrame:
    """(instrument, trade date) pairs without a bar, over all dates that any instrument has, or those from ``since`` on.

    Each instrument's dates are compared with the list of all, which the
    calendar bounds, so only the missing pairs are ever produced.
    """
    if since is not None:
        prices = prices.filter(F.col("trade_date") >= since)
    dates = prices.select("trade_date").distinct()
    wanted = dates.agg(F.sort_array(F.collect_set("trade_date"))).scalar()
    have = prices.groupBy(*INSTRUMENT).agg(F.collect_set("trade_date").alias("have"))
    rows = instruments.select(*INSTRUMENT).join(have, INSTRUMENT, "left")
    none = F.array().cast("array<date>")
    return rows.select(*INSTRUMENT, F.explode(F.array_except(wanted, F.coalesce("have", none))).alias("trade_date"))


def lagged_return(n: int, window=None) -> Column:
    """Change of the close over ``n`` bars, in percent."""
    before = F.lag("close", n).over(window or by_instrument())
    return (F.try_divide(F.col("close"), before) - 1.0) * 100.0


def high_ratio(n: int) -> Column:
    """Close over the highest high of the last ``n`` bars."""
    return F.try_divide(F.col("close"), F.max("high").over(by_instrument().rowsBetween(-n + 1, 0)))


def features(prices: DataFrame) -> DataFrame:
    """Newest bar per instrument with MA5, MA20, 20-bar return and place in the 60-bar high.

    Only the newest 60 bars of each instrument are kept ahead of the windows,
    and all windows share one partitioning.
    """
    recent = last_rows(prices, INSTRUMENT, ["trade_date"], 60, "_back")
    rows = recent.select(
        *INSTRUMENT, "trade_date", "close", "volume", "turnover_rate", "_back", trailing_mean("close", 5).alias("ma5"),
        trailing_mean("close", 20).alias("ma20"), lagged_return(20).alias("ret_20d"), high_ratio(60).alias("high_60d_pct"),
    )
    return rows.filter(F.col("_back") == 1).drop("_back")


def feature_history(prices: DataFrame) -> DataFrame:
    """20-bar return and place in the 60-bar high at every bar."""
    return prices.select(*INSTRUMENT, "trade_date", "close", lagged_return(20).alias("ret_20d"), high_ratio(60).alias("high_60d_pct"))


def cross_signals(prices: DataFrame) -> DataFrame:
    """MA5 against MA20 at every bar: trend and crossing labels."""
    sided = prices.select(*INSTRUMENT, "trade_date", F.signum(trailing_mean("close", 5) - trailing_mean("close", 20)).alias("side"))
    moved = sided.withColumn("before", F.lag("side").over(by_instrument()))
    up, down = F.col("side") > 0, F.col("side") < 0
    labels = F.array_compact(F.array(
        F.when(up, "均线多头").when(down, "均线空头"),
        F.when(up & (F.col("before") <= 0), "均线金叉").when(down & (F.col("before") >= 0), "均线死叉"),
    ))
    return moved.select(*INSTRUMENT, "trade_date", labels.alias("signals"))


def similar_patterns(prices: DataFrame, length: int = 10, k: int = 5) -> DataFrame:
    """For each instrument, the ``k`` earlier stretches of daily returns most like its newest ``length``."""
    bars = prices.filter(F.col("pct_chg").isNotNull())
    place = F.row_number().over(by_instrument())
    stretch = F.collect_list("pct_chg").over(by_instrument().rowsBetween(-length + 1, 0))
    rows = bars.select(*INSTRUMENT, "trade_date", place.alias("bar"), stretch.alias("stretch")).filter(F.size("stretch") == length)
    shaped = rows.withColumn("shape", centred(F.col("stretch")))
    return closest_to_newest(shaped, INSTRUMENT, "trade_date", "shape", k, earlier_than=length, position="bar", bounded=True)


def pattern_rows(prices: DataFrame, length: int = 10) -> DataFrame:
    """Every stretch of ``length`` daily returns, centred and at length one: instrument, trade_date, bar, v."""
    bars = prices.filter(F.col("pct_chg").isNotNull())
    place = F.row_number().over(by_instrument())
    stretch = F.collect_list("pct_chg").over(by_instrument().rowsBetween(-length + 1, 0))
    rows = bars.select(*INSTRUMENT, "trade_date", place.cast("long").alias("bar"), stretch.alias("stretch")).filter(F.size("stretch") == length)
    return rows.select(*INSTRUMENT, "trade_date", "bar", unit(centred(F.col("stretch"))).alias("v")).filter("v IS NOT NULL")


def similar_patterns_across(prices: DataFrame, length: int = 10, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """For each instrument, the ``k`` stretches of any instrument most like its newest one; and what was compared.

    Stretches that overlap the newest one, which only the instrument's own can,
    are left out; ties go to the newer stretch, then to the smaller code.
    """
    # Rows are written once more with their boxes; the first copy is gone before they are compared.
    with lent(pattern_rows(prices, length)) as shaped:
        names = shaped.select(*INSTRUMENT).distinct()
        # Instruments by number, in the order of their codes.
        numbered = pin(running_total(names.withColumns({"_one": F.lit(1).cast("long"), "_all": F.lit(0)}), ["_all"], INSTRUMENT, "_one", "group").select(*INSTRUMENT, "group"))
        rows = shaped.join(numbered, INSTRUMENT).select("group", F.col("bar").alias("place"), (-F.unix_date("trade_date")).cast("long").alias("age"), "v")
        newest = rows.groupBy("group").agg(F.max_by(F.struct("v", "place"), "place").alias("n"))
        asks = newest.select(F.col("group").alias("ask"), F.col("group").alias("ask_group"), (F.col("n.place") - length).alias("ask_upto"), F.col("n.v").alias("q"))
        places = settled(rows, asks)
    found, looked_at = found_in(places, k, ["age", "group"])
    ours = numbered.select(F.col("group").alias("ask"), *[F.col(c) for c in INSTRUMENT])
    theirs = numbered.select("group", *[F.col(c).alias(f"like_{c}") for c in INSTRUMENT])
    named = found.join(ours, "ask").join(theirs, "group").withColumn("trade_date", F.date_from_unix_date((-F.col("age")).cast("int")))
    return named.select(*INSTRUMENT, *[f"like_{c}" for c in INSTRUMENT], "trade_date", "similarity", "position"), looked_at


def rule_scores(prices: DataFrame, as_of: Column, weights: dict[str, float] = WEIGHTS, max_ret_20d: float = MAX_RET_20D) -> DataFrame:
    """Weighted percent ranks of the factors, times 100, over all instruments that traded on ``as_of`` and pass the momentum filter.

    ``as_of`` is mostly the latest complete date; later bars are not looked at.
    """
    upto = features(prices.filter(F.col("trade_date") <= as_of))
    kept = upto.filter((F.col("trade_date") == as_of) & (F.col("ret_20d") <= max_ret_20d))
    ranked = percent_ranks(kept, {f: f"{f}_rank" for f in weights})
    score = sum(F.coalesce(F.col(f"{f}_rank"), F.lit(0.0)) * F.lit(w) for f, w in weights.items())
    return ranked.withColumn("rule_score", score * 100.0)


def score_of(mode: str, llm_share: float = 0.5) -> Column:
    """Ranking score: the rules alone, the model score first, or the rule score moved towards the model's."""
    rule, llm = F.col("rule_composite_score"), F.col("llm_composite_score")
    if mode == "rule":
        return rule
    if mode == "llm_primary":
        return F.coalesce(llm, rule)
    if mode == "adjusted":
        return rule + F.coalesce(llm - rule, F.lit(0.0)) * llm_share
    raise ValueError(f"unknown ranking mode {mode!r}")


def ranked_runs(entries: DataFrame, mode: str = "llm_primary", top_n: int = 300) -> DataFrame:
    """Entries of each run ranked by the mode's score, the best ``top_n``."""
    return last_rows(entries.withColumn("score", score_of(mode)), ["run_id"], ["score", "id"], top_n, "position")


def price_levels(prices: DataFrame, n: int = 20) -> DataFrame:
    """Support and resistance of the last ``n`` bars, with the buy, target and stop they suggest."""
    recent = last_rows(prices, INSTRUMENT, ["trade_date"], n)
    levels = recent.groupBy(*INSTRUMENT).agg(F.min("low").alias("support"), F.max("high").alias("resistance"), F.max_by("close", "trade_date").alias("close"))
    return levels.select("*", F.least(F.col("close"), F.col("support") * 1.02).alias("buy"), F.col("resistance").alias("target"), (F.col("support") * 0.97).alias("stop"))


def concept_breadth(members: DataFrame, prices: DataFrame) -> DataFrame:
    """Members' newest daily change per concept: count, mean, share of advancing ones."""
    bars = newest_bar(prices).select(*INSTRUMENT, "pct_chg").filter(F.col("pct_chg").isNotNull())
    named = members.filter(F.col("concept_name") != "").select(*INSTRUMENT, "concept_name")
    return named.join(bars, INSTRUMENT).groupBy("concept_name").agg(
        F.count("*").alias("members"), F.avg("pct_chg").alias("mean_pct_chg"), F.avg((F.col("pct_chg") > 0).cast("double")).alias("advance_ratio")
    )
