"""Instrument search, bars, news, details and concept boards.

All per-instrument windows run on daily bars, whose groups are bounded by the
trading calendar, and share the partitioning (market, ts_code), so Spark
shuffles once for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.scalar import iso_date, zero_if_null
from tickerloom.functions.text import like_search
from tickerloom.operators.newest import last_rows, newest_first, newest_row, numbered, top

INSTRUMENT = ["market", "ts_code"]


def by_instrument() -> Window:
    return Window.partitionBy(*INSTRUMENT).orderBy("trade_date")


def search(instruments: DataFrame, q: str = "", market: str = "a", limit: int = 20) -> DataFrame:
    """Instruments of a market whose code or name matches ``q``, smallest codes first."""
    rows = instruments.filter(F.col("market") == market)
    if q:
        rows = rows.filter(like_search("ts_code", q) | like_search("name", q))
    return top(
        rows.select("ts_code", "name", "industry", "market", iso_date("listing_date").alias("list_date")),
        [F.col("ts_code")], limit,
    )


def resolve_codes(requests: DataFrame, instruments: DataFrame) -> DataFrame:
    """Add ``code``: the query itself if it is a code, else the instrument of that name, else the raw text."""
    codes = instruments.select(F.col("ts_code").alias("query"), F.col("ts_code").alias("_by_code"))
    names = instruments.groupBy(F.col("name").alias("query")).agg(F.min("ts_code").alias("_by_name"))
    found = requests.join(codes.distinct(), "query", "left").join(names, "query", "left")
    return found.withColumn("code", F.coalesce("_by_code", "_by_name", "query")).drop("_by_code", "_by_name")


def code_of_name(instruments: DataFrame, market: str = "a") -> DataFrame:
    """Exact name to code in one market; the smallest code where a name repeats."""
    return instruments.filter(F.col("market") == market).groupBy("name").agg(F.min("ts_code").alias("ts_code"))


def last_bars(prices: DataFrame, n: int = 120, market: str | None = None, code: str | None = None) -> DataFrame:
    """The newest ``n`` bars of every instrument, or of one, with nulls as 0 and NaN as null."""
    if market is not None:
        prices = prices.filter(F.col("market") == market)
    if code is not None:
        prices = prices.filter(F.col("ts_code") == code)
    numbers = ["open", "high", "low", "close", "volume", "amount", "pct_chg"]
    rows = last_rows(prices, INSTRUMENT, ["trade_date"], n)
    return rows.select(*INSTRUMENT, iso_date("trade_date").alias("trade_date"), *[zero_if_null(c).alias(c) for c in numbers])


def newest_bar(prices: DataFrame) -> DataFrame:
    return newest_row(prices, INSTRUMENT, ["trade_date"])


def linked_news(links: DataFrame, news: DataFrame, source: str = "global_news") -> DataFrame:
    """Links of one source with their news rows."""
    ours = links.filter(F.col("news_source") == source)
    return ours.join(news, ours.news_id == news.id).select(
        *INSTRUMENT, F.col("news_id"), "title", "description", F.col("source_name").alias("source"),
        F.col("article_url").alias("url"), "published_at_utc", "confidence", "event_type",
    )


def all_sources(news: DataFrame, alerts: DataFrame) -> DataFrame:
    """Both news sources in one frame, told apart by ``news_source`` (definition ours)."""
    return news.withColumn("news_source", F.lit("global_news")).unionByName(alerts.withColumn("news_source", F.lit("financial_alerts")))


def linked_news_of_all(links: DataFrame, news: DataFrame) -> DataFrame:
    """Links joined with the news row of their own source."""
    n = news.withColumnRenamed("id", "news_id")
    return links.join(n, ["news_source", "news_id"])


def newest_news(links: DataFrame, news: DataFrame, limit: int = 20) -> DataFrame:
    """The newest ``limit`` linked news of every instrument."""
    return last_rows(linked_news(links, news), INSTRUMENT, ["published_at_utc", "news_id"], limit)


def concepts_of(members: DataFrame) -> DataFrame:
    """Sorted concept names per instrument (at most one per concept)."""
    return members.groupBy(*INSTRUMENT).agg(F.sort_array(F.collect_set("concept_name")).alias("concepts"))


def detail(instruments: DataFrame, members: DataFrame, prices: DataFrame) -> DataFrame:
    """Instrument with its concepts (empty list if none) and its newest bar (null if none)."""
    bar = newest_bar(prices).select(
        *INSTRUMENT,
        F.struct(iso_date("trade_date").alias("trade_date"), "close", "pct_chg", "volume", "turnover_rate").alias("latest"),
    )
    rows = instruments.join(concepts_of(members), INSTRUMENT, "left").join(bar, INSTRUMENT, "left")
    empty = F.array().cast("array<string>")
    return rows.select(
        *INSTRUMENT, "name", "industry", iso_date("listing_date").alias("list_date"),
        F.coalesce("concepts", empty).alias("concepts"), "latest",
    )


def popular_concepts(members: DataFrame, limit: int = 50) -> DataFrame:
    """Concepts with most members over all markets; blank names go after the limit, so fewer may remain."""
    counts = members.groupBy("concept_name").agg(F.count("ts_code").alias("stock_count"))
    best = top(counts, [F.col("stock_count").desc(), F.col("concept_name").asc_nulls_first()], limit)
    return best.filter(F.col("concept_name") != "").select(F.col("concept_name").alias("name"), "stock_count")


def search_concepts(members: DataFrame, q: str, limit: int = 50) -> DataFrame:
    names = members.filter(like_search("concept_name", q)).select(F.col("concept_name").alias("name")).distinct()
    return top(names, [F.col("name")], limit).filter(F.col("name") != "")


def concept_stocks(members: DataFrame, concept: str | None = None, market: str = "a") -> DataFrame:
    """Members of one concept, or of every concept."""
    rows = members.filter(F.col("market") == market)
    if concept is not None:
        rows = rows.filter(F.col("concept_name") == concept)
    return rows.select("concept_name", "ts_code", "name")


def valid_closes(bars: DataFrame) -> DataFrame:
    """Bars whose close is neither null nor 0."""
    return bars.filter(F.col("close").isNotNull() & (F.col("close") != 0))


def trailing_mean(column: str, n: int, window=None) -> Column:
    """Mean of the last ``n`` rows, null until there are ``n``."""
    span = (window or by_instrument()).rowsBetween(-n + 1, 0)
    return F.when(F.count(column).over(span) >= n, F.avg(column).over(span))


def moving_averages(prices: DataFrame, lookback: int = 60) -> DataFrame:
    """MA5, MA20 and the last five closes at each valid bar among the newest ``lookback``."""
    bars = valid_closes(last_rows(prices, INSTRUMENT, ["trade_date"], lookback))
    five = by_instrument().rowsBetween(-4, 0)
    return bars.select(
        *INSTRUMENT, "trade_date", "close", trailing_mean("close", 5).alias("ma5"), trailing_mean("close", 20).alias("ma20"),
        F.collect_list("close").over(five).alias("closes5"),
    )


def price_context(prices: DataFrame, lookback: int = 60) -> DataFrame:
    """One row per instrument: its newest bar, plus MA5, MA20 and last five closes on valid bars."""
    recent = last_rows(prices, INSTRUMENT, ["trade_date"], lookback)
    valid = F.col("close").isNotNull() & (F.col("close") != 0)
    backwards = Window.partitionBy(*INSTRUMENT).orderBy(F.col("trade_date").desc())
    place = F.sum(F.when(valid, 1).otherwise(0)).over(backwards.rowsBetween(Window.unboundedPreceding, 0))
    ranked = recent.withColumn("_place", F.when(valid, place))

    def mean(n):
        taken = F.when(F.col("_place") <= n, F.col("close"))
        return F.when(F.count(taken) >= n, F.avg(taken))

    newest = F.struct("trade_date", "close", "pct_chg", "turnover_rate", "volume", "amount")
    last5 = F.sort_array(F.collect_list(F.when(F.col("_place") <= 5, F.struct("trade_date", "close"))))
    grouped = ranked.groupBy(*INSTRUMENT).agg(
        F.max_by(newest, "trade_date").alias("latest"), mean(5).alias("ma5"), mean(20).alias("ma20"), last5.alias("_last5")
    )
    return grouped.withColumn("closes5", F.col("_last5.close")).drop("_last5")
