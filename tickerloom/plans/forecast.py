"""Market forecasts: the newest one, its parts, and the verified track record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.nested import chart_map, decoded
from tickerloom.functions.scalar import above, iso_time, percent
from tickerloom.operators.lookup import decode
from tickerloom.operators.newest import newest_first, top
from tickerloom.schemas import FORECAST_JSON, INDEX_RESULTS_JSON
from tickerloom.session import pin

# Confidence bins [low, high) with their labels, and index names.
CONFIDENCE_BINS = [(0, 50, "0-50%"), (50, 65, "50-65%"), (65, 80, "65-80%"), (80, 101, "80-100%")]
INDEX_NAMES = [
    ("000001", "上证指数"), ("399001", "深证成指"), ("399006", "创业板指"), ("000688", "科创50"),
    ("000300", "沪深300"), ("000905", "中证500"), ("000852", "中证1000"),
]
DIRECTION_LABELS = [("bullish", "看涨"), ("bearish", "看跌"), ("range-bound", "震荡")]
INDICES_PER_DAY = 7


def newest_forecast(forecasts: DataFrame) -> DataFrame:
    return top(forecasts, newest_first("as_of_date", "id"), 1)


def verified_part() -> Column:
    """The verification fields as one struct, null while unverified."""
    part = F.struct(iso_time("verified_at").alias("at"), "actual_direction", "actual_pct_chg", "direction_correct")
    return F.when(F.col("verified_at").isNotNull(), part)


def forecast_view(forecasts: DataFrame, chart_root: str) -> DataFrame:
    """Forecast rows with decoded documents, chart URLs and the verification part."""
    return forecasts.select(
        "id", F.col("as_of_date").cast("string").alias("as_of_date"), "market_direction", "direction_confidence",
        decoded("forecast_json", FORECAST_JSON).alias("forecast"),
        chart_map(F.nullif("index_charts_json", F.lit("")), chart_root).alias("charts"), "push_sent", verified_part().alias("verified"),
        iso_time("created_at_utc").alias("created_at"),
    )


def charts_of(forecast: DataFrame, chart_root: str, code: Column) -> DataFrame:
    """Charts of one index in each forecast row; an index without charts gives null."""
    return forecast.select("id", code.alias("index_code"), F.try_element_at(
        chart_map(F.nullif("index_charts_json", F.lit("")), chart_root), code).alias("charts"))


def verified_history(forecasts: DataFrame, days: int = 30) -> DataFrame:
    """The newest ``days`` verified forecasts."""
    return top(forecasts.filter(F.col("verified_at").isNotNull()), newest_first("as_of_date", "id"), days)


def history_view(history: DataFrame) -> DataFrame:
    return history.select(
        F.col("as_of_date").cast("string").alias("as_of_date"), F.col("market_direction").alias("predicted"),
        F.col("actual_direction").alias("actual"), F.col("actual_pct_chg").alias("actual_pct"),
        F.col("direction_correct").alias("correct"), F.col("direction_confidence").alias("confidence"),
    )


def _hits(flag: str) -> Column:
    return F.count_if(F.coalesce(F.col(flag), F.lit(False)))


def hit_rate(history: DataFrame) -> DataFrame:
    """Verified count, correct count and accuracy; an unknown result counts as wrong."""
    counted = history.agg(F.count("*").alias("total_verified"), _hits("direction_correct").alias("correct"))
    return counted.withColumn("accuracy_pct", percent("correct", "total_verified"))


def hit_rate_by_direction(history: DataFrame) -> DataFrame:
    direction = F.coalesce(F.nullif("market_direction", F.lit("")), F.lit("unknown")).alias("direction")
    counted = history.groupBy(direction).agg(F.count("*").alias("count"), _hits("direction_correct").alias("correct"))
    return counted.withColumn("accuracy_pct", percent("correct", "count"))


def with_direction_label(rows: DataFrame, column: str = "market_direction") -> DataFrame:
    return decode(rows, column, DIRECTION_LABELS, "direction_label")


def with_index_name(rows: DataFrame, column: str = "code") -> DataFrame:
    return decode(rows, column, INDEX_NAMES, "index_name")


def bin_of(confidence: Column) -> Column:
    """Label of the bin holding the value, null outside all bins; a missing value counts as 0."""
    value = F.coalesce(confidence, F.lit(0.0))
    whens = [F.when((value >= low) & (value < high), label) for low, high, label in CONFIDENCE_BINS]
    return F.coalesce(*whens)


def calibration(history: DataFrame) -> DataFrame:
    """Count and accuracy per confidence bin; empty bins stay."""
    spark = history.sparkSession
    bins = spark.createDataFrame([(label, (low + high) / 2) for low, high, label in CONFIDENCE_BINS], "bin string, bin_expected double")
    found = history.groupBy(bin_of(F.col("direction_confidence")).alias("bin")).agg(
        F.count("*").alias("count"), _hits("direction_correct").alias("accurate")
    )
    zero = F.lit(0).cast("bigint")
    return bins.join(found, "bin", "left").select(
        "bin", F.coalesce("count", zero).alias("count"), F.coalesce("accurate", zero).alias("accurate"),
        percent("accurate", "count").alias("accuracy_pct"), "bin_expected",
    )


def index_hit_rate(evals: DataFrame, days: int = 30) -> DataFrame:
    """Accuracy per index over the newest one-day evaluations; broken rows and elements without code are skipped."""
    recent = top(evals.filter(F.col("horizon_days") == 1), newest_first("forecast_id"), days * INDICES_PER_DAY)
    results = recent.select(F.inline(decoded("index_results_json", INDEX_RESULTS_JSON))).filter(F.col("code").isNotNull())
    counted = results.groupBy("code").agg(F.count("*").alias("total"), _hits("correct").alias("correct"))
    return counted.withColumn("pct", percent("correct", "total"))


def track_record(forecasts: DataFrame, evals: DataFrame, days: int = 30) -> DataFrame:
    """All statistics as one tall frame (section, key, count, correct, pct); the ``days`` history rows are read once."""
    history = pin(verified_history(forecasts, days))

    def rows(df, section, key, count, correct, pct):
        return df.select(F.lit(section).alias("section"), key.alias("key"), F.col(count).alias("count"), F.col(correct).alias("correct"), F.col(pct).alias("pct"))

    parts = [
        rows(hit_rate(history), "overall", F.lit("all"), "total_verified", "correct", "accuracy_pct"),
        rows(hit_rate_by_direction(history), "direction", F.col("direction"), "count", "correct", "accuracy_pct"),
        rows(calibration(history), "confidence", F.col("bin"), "count", "accurate", "accuracy_pct"),
        rows(index_hit_rate(evals, days), "index", F.col("code"), "total", "correct", "pct"),
    ]
    return reduce(DataFrame.unionByName, parts)


# Parts of the decoded forecast document, one row per element.


def evidence_rows(view: DataFrame) -> DataFrame:
    """Evidence for (bull) and against (risk), one row each."""
    d = F.col("forecast.market_direction")
    bull = F.transform(d["evidence"], lambda e: F.struct(
        F.lit("bull").alias("side"), e["type"].alias("kind"), e["signal"].alias("signal"), e["value"].alias("value")))
    risk = F.transform(d["counter_evidence"], lambda t: F.struct(
        F.lit("risk").alias("side"), F.lit("风险").alias("kind"), t.alias("signal"), F.lit(None).cast("string").alias("value")))
    none = F.array().cast("array<struct<side:string,kind:string,signal:string,value:string>>")
    return view.select("id", F.inline(F.concat(F.coalesce(bull, none), F.coalesce(risk, none))))


def index_rows(view: DataFrame) -> DataFrame:
    """Per-index forecasts with their key levels and MACD chart."""
    rows = view.select("id", "charts", F.inline("forecast.index_forecasts"))
    return rows.select("id", "code", "name", "direction", "confidence", F.col("key_levels.support").alias("support"),
                       F.col("key_levels.resistance").alias("resistance"),
                       F.try_element_at(F.try_element_at("charts", F.col("code")), F.lit("macd")).alias("macd_url"))


def scenario_rows(view: DataFrame) -> DataFrame:
    """Next-day scenarios, those above 40 percent flagged as likely."""
    return view.select("id", F.inline("forecast.next_day_scenarios")).withColumn("likely", above("probability", 40))


def sector_rows(view: DataFrame) -> DataFrame:
    rows = view.select("id", F.inline("forecast.sector_calls"))
    joined = F.array_join(F.transform("evidence", lambda e: F.concat(e["signal"], F.lit(": "), e["value"])), "；")
    return rows.select("id", "sector", "direction", "confidence", joined.alias("evidence"))


def concept_rows(view: DataFrame) -> DataFrame:
    return view.select("id", F.inline("forecast.concept_calls"))


def risk_rows(view: DataFrame) -> DataFrame:
    """Risk factors numbered from 1."""
    rows = view.select("id", F.posexplode("forecast.risk_factors").alias("pos", "risk"))
    return rows.select("id", (F.col("pos") + 1).cast("bigint").alias("number"), "risk")


def chart_rows(view: DataFrame) -> DataFrame:
    """One row per index and chart kind."""
    indices = view.select("id", F.explode("charts").alias("code", "kinds"))
    return indices.select("id", "code", F.explode("kinds").alias("kind", "url"))
