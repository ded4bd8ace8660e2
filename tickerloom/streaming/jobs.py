"""Streaming twins of the batch results (definitions ours).

Every job has a watermark, so its state is bounded by the rows inside the
watermark.  Most are append-mode queries, whose closed windows never change
again; running totals are updates, kept in a stored table by day.  Before
the shuffle, aggregates combine, sessions are merged and alerts and deliveries
are thinned out to one row per key and Arrow batch, so a hot key moves few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickerloom.operators.merge import upsert
from tickerloom.plans.execution import stages
from tickerloom.session import scratch_path
from tickerloom.sources.stored import KeyedTable

LATENESS = "1 hour"
MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def timed(df: DataFrame, column: str, lateness: str = LATENESS) -> DataFrame:
    """Add the event time ``at`` (watermarks need a time with zone) and its watermark."""
    return df.withColumn("at", F.col(column).cast("timestamp")).withWatermark("at", lateness)


def span(window: Column | str = "window") -> list[Column]:
    """Window start and end as ISO text."""
    w = F.col(window) if isinstance(window, str) else window
    fmt = "yyyy-MM-dd'T'HH:mm:ss"
    return [F.date_format(w["start"], fmt).alias("window_start"), F.date_format(w["end"], fmt).alias("window_end")]


def daily_cost(messages: DataFrame) -> DataFrame:
    grouped = timed(messages, "created_at_utc").groupBy(F.window("at", "1 day")).agg(
        F.count("*").alias("requests"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd")
    )
    return grouped.select(*span(), "requests", "prompt_tokens", "output_tokens", "cost_usd")


RUNNING = "window_start string, window_end string, requests bigint, prompt_tokens bigint, output_tokens bigint, cost_usd double, batch_id bigint"


def running_table(spark: SparkSession, path: str) -> KeyedTable:
    """The stored running totals, a row per day."""
    return KeyedTable(spark, path, RUNNING, ["window_start"], 16)


def keep_running_totals(messages: DataFrame, path: str, log: str) -> None:
    """Process what has arrived and leave each day's totals so far, the open day's included, at ``path``.

    Each micro-batch puts the days it changed into the table by key, with its
    number: a batch that is played again after a failure writes the same rows,
    and an older number never replaces a newer one.
    """

    def put(batch: DataFrame, number: int) -> None:
        table = running_table(batch.sparkSession, path)
        columns = [c for c in batch.columns if c not in table.keys] + ["batch_id"]
        newer = {c: f"CASE WHEN c.batch_id >= b.batch_id THEN c.{c} ELSE b.{c} END" for c in columns}
        table.change(batch.withColumn("batch_id", F.lit(number).cast("long")), lambda stored, fresh: upsert(stored, fresh, table.keys, newer, {}))

    writer = daily_cost(messages).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", log)
    writer.trigger(availableNow=True).start().awaitTermination()


def tick_bars(ticks: DataFrame, symbol: str, price: str, time: str, ident: str, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Tumbling (or, with ``slide``, sliding) open-high-low-close bars with tick counts."""
    order = F.struct(time, ident)
    window = F.window("at", width, slide) if slide else F.window("at", width)
    grouped = timed(ticks, time).groupBy(window, F.col(symbol).alias("symbol")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").alias("ticks")
    )
    return grouped.select(*span(), "symbol", "open", "high", "low", "close", "ticks")


def touches(ticks: DataFrame, plans: DataFrame, lateness: str | None = LATENESS) -> DataFrame:
    """Ticks that reach the target or the stop of their instrument's plan of the day.

    ``ticks``: ts_code, ts, event_id, price; ``plans``: plan_date, ts_code,
    predicted_target, predicted_stop (static).
    """
    stamped = timed(ticks, "ts", lateness) if lateness else ticks.withColumn("at", F.col("ts").cast("timestamp"))
    dated = stamped.withColumn("plan_date", F.to_date("ts"))
    kind = F.when(F.col("price") >= F.col("predicted_target"), "target").when(F.col("price") <= F.col("predicted_stop"), "stop")
    levels = plans.select("plan_date", "ts_code", "predicted_target", "predicted_stop")
    joined = dated.join(levels, ["plan_date", "ts_code"]).withColumn("touch", kind)
    return joined.filter(F.col("touch").isNotNull()).select("plan_date", "ts_code", "at", "ts", "event_id", "price", "touch")


def first_touch_of_day(ticks: DataFrame, plans: DataFrame) -> DataFrame:
    """First touch per plan, given out once its day is closed."""
    first = F.min_by(F.struct("ts", "price", "touch"), F.struct("ts", "event_id"))
    days = touches(ticks, plans).groupBy(F.window("at", "1 day"), "ts_code").agg(first.alias("first"))
    return days.select(*span(), "ts_code", F.date_format("first.ts", "yyyy-MM-dd'T'HH:mm:ss").alias("touched_at"), "first.price", "first.touch")


def first_touch_of_revised(ticks: DataFrame, arrivals: DataFrame) -> DataFrame:
    """First touch per instrument and day of the plan in force, given out once the day is closed.

    ``arrivals``: plan versions as a stream (ts_code, ts, event_id,
    predicted_target, predicted_stop).  A tick is held against the newest
    version of its day that arrived before it, so a revised plan replaces the
    earlier one from its arrival on.  Both sides have a watermark and a version
    serves its own day only, so neither side is kept longer than a day beyond
    the watermark; a tick meets the versions of its day, not all.
    """
    dated = timed(ticks, "ts").select("ts_code", "at", "event_id", "price")
    versions = arrivals.select(
        F.col("ts_code").alias("_code"), F.col("ts").cast("timestamp").alias("set_at"), F.col("event_id").alias("version"), "predicted_target", "predicted_stop"
    ).withWatermark("set_at", LATENESS)
    met = F.expr("ts_code = _code AND set_at < at AND set_at >= at - INTERVAL 1 DAY AND date_trunc('day', set_at) = date_trunc('day', at)")
    held = dated.join(versions, met)
    newest = F.max_by(F.struct("version", "predicted_target", "predicted_stop"), F.struct("set_at", "version"))
    judged = held.groupBy(F.window("at", "1 day"), "ts_code", "event_id").agg(newest.alias("plan"), F.first("price").alias("price"), F.first("at").alias("tick_at"))
    kind = F.when(F.col("price") >= F.col("plan.predicted_target"), "target").when(F.col("price") <= F.col("plan.predicted_stop"), "stop")
    touched = judged.withColumn("touch", kind).filter(F.col("touch").isNotNull())
    first = F.min_by(F.struct("tick_at", "price", "touch", "plan.version"), F.struct("tick_at", "event_id"))
    days = touched.groupBy(F.window(F.window_time("window"), "1 day"), "ts_code").agg(first.alias("first"))
    return days.select(*span(), "ts_code", F.date_format("first.tick_at", "yyyy-MM-dd'T'HH:mm:ss").alias("touched_at"), "first.price", "first.touch", "first.version")


ALERT = "plan_date date, ts_code string, event_id bigint, price double, touch string"
TOUCH = "plan_date date, ts_code string, at timestamp, event_id bigint, price double, touch string"
PLAN = ["plan_date", "ts_code"]


def one_per_key(keys: list[str], order: list[str]):
    """Keeps one row per key and batch, so that a busy key sends little to its state.

    A function made here travels to the workers by value, so these need not have the package.
    """

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.sort_values(order).drop_duplicates(keys)

    return thin


def touch_alerts(ticks: DataFrame, plans: DataFrame, buckets: int = 64) -> DataFrame:
    """First touch of a plan to arrive (the earliest one of the first micro-batch that has any).

    The plans of a day are dealt into ``buckets`` by code; the state of a
    bucket is the codes alerted so far, dropped after the day.  So a batch
    costs a function call for each day and bucket, not for each plan.

    A touch that arrives later with an earlier time changes nothing; ``first_touch_of_day`` waits for those.

    The watermark is set on the touches, after they are thinned out.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        sent, first = set(state.get[0]) if state.exists else set(), None
        for pdf in batches:
            fresh = pdf[~pdf["ts_code"].isin(sent)]
            if len(fresh):
                both = fresh if first is None else pd.concat([first, fresh])
                first = both.sort_values(["at", "event_id"]).drop_duplicates("ts_code")
        if first is not None:
            state.update((sorted(sent.union(first["ts_code"])),))
        if state.exists:
            # A call clears the time set before.
            day_end = int((pd.Timestamp(key[0]) + pd.Timedelta(days=1)).timestamp() * 1000)
            state.setTimeoutTimestamp(max(day_end, state.getCurrentWatermarkMs() + 1))
        if first is not None:
            yield first.assign(plan_date=key[0])[["plan_date", "ts_code", "event_id", "price", "touch"]]

    rows = touches(ticks, plans, None).select(*PLAN, "at", "event_id", "price", "touch").mapInPandas(one_per_key(PLAN, ["at", "event_id"]), TOUCH)
    dealt = rows.withWatermark("at", LATENESS).withColumn("bucket", F.pmod(F.xxhash64("ts_code"), F.lit(buckets)))
    return dealt.groupBy("plan_date", "bucket").applyInPandasWithState(run, ALERT, "sent array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def stage_flags(arrivals: DataFrame) -> DataFrame:
    """Stage flags per day from arriving plan versions."""
    windowed = timed(arrivals, "ts").drop("plan_date").withColumn("plan_date", F.window("at", "1 day"))
    return stages(windowed).select(*span("plan_date"), "pre_market", "auction", "opening", "intraday")


def message_sessions(messages: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Bursts of messages of a session, ended by a pause longer than ``gap``; each task merges its own before they move."""
    messages.sparkSession.conf.set(MERGE, "true")
    grouped = timed(messages, "created_at_utc").groupBy(F.session_window("at", gap), "session_id").agg(F.count("*").alias("messages"), F.sum("cost_usd").alias("cost_usd"))
    return grouped.select(*span("session_window"), "session_id", "messages", "cost_usd")


def first_deliveries(links: DataFrame, keys: list[str], time: str, lateness: str = "30 days") -> DataFrame:
    """Rows whose key was not delivered before within the watermark."""
    few = links.mapInPandas(one_per_key(keys, [time]), links.schema)
    return timed(few, time, lateness).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process everything that has arrived, append it to a table in the shared folder and read that back."""
    spark = stream.sparkSession
    out, log = scratch_path(spark, name), scratch_path(spark, f"{name}-log")
    running = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", log).trigger(availableNow=True).start(out)
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
