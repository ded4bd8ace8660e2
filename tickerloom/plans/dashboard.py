"""Platform totals, daily model cost and data freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.scalar import iso_date, iso_time, since_days
from tickerloom.operators.newest import newest_first, top


def count_of(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("id").alias(name))


def total_cost(messages: DataFrame) -> DataFrame:
    return messages.agg(F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("total_llm_cost_usd"))


def newest_run(runs: DataFrame) -> DataFrame:
    return top(runs, newest_first("created_at_utc", "id"), 1).select(
        "id", "run_kind", iso_date("trade_date_as_of").alias("trade_date"), iso_time("created_at_utc").alias("created_at")
    )


def totals(runs: DataFrame, entries: DataFrame, messages: DataFrame) -> DataFrame:
    """One row: run and entry counts, model cost, newest run."""
    newest = newest_run(runs)
    run = newest.select(F.struct("*").alias("run")).scalar()
    return count_of(runs, "total_runs").select(
        "total_runs", count_of(entries, "total_entries").scalar().alias("total_entries"),
        total_cost(messages).scalar().alias("total_llm_cost_usd"),
        *[run.getField(c).alias(f"latest_{c}") for c in newest.columns],
    )


def daily_cost(messages: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Requests, tokens and cost per day over the last ``days`` days before ``as_of``."""
    recent = messages.filter(since_days("created_at_utc", as_of, days))
    zero = F.lit(0).cast("bigint")
    return recent.groupBy(F.to_date("created_at_utc").cast("string").alias("date")).agg(
        F.count("*").alias("requests"), F.coalesce(F.sum("prompt_tokens"), zero).alias("prompt_tokens"),
        F.coalesce(F.sum("output_tokens"), zero).alias("output_tokens"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("cost_usd"),
    )


def newest_time(df: DataFrame, column: str) -> Column:
    """The newest timestamp in the data, for use as ``as_of``."""
    return df.agg(F.max(column)).scalar()


def freshness(dated: dict[str, tuple[DataFrame, str]], market: str = "a") -> DataFrame:
    """Newest date per dataset of one market: ``{name: (frame, date column)}``."""
    parts = [
        df.filter(F.col("market") == market).agg(F.max(column).cast("string").alias("latest")).select(F.lit(name).alias("dataset"), "latest")
        for name, (df, column) in dated.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def pipeline(prices: DataFrame, snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Newest price date, snapshot date and pick run time."""
    run = newest_run(runs).select(F.concat(F.lit("pick_run:"), "run_kind").alias("dataset"), F.col("created_at").alias("latest"))
    return freshness({"prices": (prices, "trade_date"), "snapshots": (snapshots, "plan_date")}).unionByName(run)
