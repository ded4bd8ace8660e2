"""Batch writers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.scalar import token_cost
from tickerloom.operators.merge import fill_missing
from tickerloom.operators.newest import newest_row
from tickerloom.session import pin, released, swept
from tickerloom.sources.tables import parquet_or_empty

MONTH = "month"
WRITERS = 8  # runs are few and small
TURN = 1 << 26  # entries that are on their way to their months at a time


def _write_by(df: DataFrame, column: str, mode: str, path: str, **options: str) -> None:
    """Partitioned write with few, evenly sized files: rebalancing gathers a day's rows and splits a hot day."""
    with swept(df.sparkSession):
        df.hint("rebalance", column).write.mode(mode).options(**options).partitionBy(column).parquet(path)


def with_month(df: DataFrame, day: str) -> DataFrame:
    """Months keep the number of folders and small files low, and still let a date filter prune."""
    return df.withColumn(MONTH, F.date_format(day, "yyyy-MM"))


def stored_months(spark: SparkSession, path: str) -> list[str]:
    """The months a table is stored by, oldest first, from the names of its folders."""
    new = spark._jvm.org.apache.hadoop.fs.Path
    files = new(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(new(f"{path}/{MONTH}=*")) or []
    return sorted(f.getPath().getName().removeprefix(f"{MONTH}=") for f in found)


def append_messages(messages: DataFrame, path: str) -> None:
    """Append chat messages by day; the cost is worked out while writing."""
    priced = messages.withColumn("cost_usd", token_cost("prompt_tokens", "output_tokens"))
    _write_by(priced.withColumn("dt", F.to_date("created_at_utc")), "dt", "append", path)


def _not_stored(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame | None:
    """Rows whose keys are not stored yet, None if there are none; only keys move, unless some are missing."""
    if stored.isEmpty():
        return rows
    missing = pin(rows.select(*keys).join(stored, keys, "left_anti").distinct())
    if missing.isEmpty():
        return None
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    return rows.alias("r").join(missing.alias("m"), same, "left_semi")


def _turns(rows: DataFrame, most: int) -> Iterator[DataFrame]:
    """``rows`` in parts of whole months with about ``most`` rows each, one part if they are few; months are bounded by the calendar."""
    counts = rows.groupBy(MONTH).count().orderBy(MONTH).collect()
    parts, held = [[]], 0
    for r in counts:
        if held and held + r["count"] > most:
            parts.append([])
            held = 0
        parts[-1].append(r[MONTH] or "")
        held += r["count"]
    for months in parts:
        yield rows if len(parts) == 1 else rows.filter(F.coalesce(MONTH, F.lit("")).isin(months))


def append_pick_run(run: DataFrame, entries: DataFrame, runs_path: str, entries_path: str) -> DataFrame:
    """Append runs and their ranked entries; returns the newest stored entry id of each of these runs.

    Entries go first and the runs last, so nobody sees a run without its
    entries; what is stored already is left out, so a retry adds nothing and
    moves no more than the keys.  New entries move to their run's day and then
    to their month; the first move leaves the disk before the second begins.
    """
    spark = run.sparkSession
    day = run.select(F.col("id").alias("run_id"), F.col("trade_date_as_of").alias("trade_date"))
    held_entries = parquet_or_empty(spark, entries_path, "id string, run_id bigint")
    held_runs = parquet_or_empty(spark, runs_path, "id bigint")
    fresh = _not_stored(entries, held_entries, ["id", "run_id"])
    if fresh is not None:
        with released(spark):
            for part in _turns(pin(with_month(fresh.join(day, "run_id"), "trade_date")), TURN):
                _write_by(part, MONTH, "append", entries_path)
    fresh = _not_stored(run, held_runs, ["id"])
    if fresh is not None:
        with swept(spark):
            fresh.coalesce(WRITERS).write.mode("append").parquet(runs_path)
    stored = spark.read.schema("id string, run_id bigint").parquet(entries_path).join(day.select("run_id"), "run_id", "left_semi")
    return newest_row(stored, ["run_id"], ["id"]).select("run_id", F.col("id").alias("entry_id"))


def catch_up_prices(stored: DataFrame, arriving: DataFrame, path: str) -> None:
    """Append the bars whose instrument and day are not stored yet, newest arrival winning per key.

    Stored bars are only read, so a load that breaks off loses none, and a
    repeated one adds nothing.  ``stored`` is what ``path`` holds; one writer.
    """
    fresh = fill_missing(stored, arriving, ["ts_code", "market", "trade_date"])
    _write_by(with_month(fresh, "trade_date"), MONTH, "append", path)
