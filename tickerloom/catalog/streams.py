"""Streaming jobs, run over everything that has arrived; the SQL counts only windows the watermark has closed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.catalog.basics import ISO
from tickerloom.catalog.registry import query
from tickerloom.catalog.views import code
from tickerloom.session import pin, scratch_path
from tickerloom.sources.derived import ArrivingResearch, code_of
from tickerloom.streaming import jobs


def arriving(r) -> ArrivingResearch:
    return ArrivingResearch(r.spark, r.folder)


def _ticks(r):
    return arriving(r).given("events").select(code_of("user_id").alias("ts_code"), "ts", "event_id", F.col("value").alias("price"))


CHAT_CLOSED = "(SELECT max(created_at_utc) - INTERVAL '1' HOUR FROM v_chat_messages)"
EVENT_CLOSED = "(SELECT max(ts) - INTERVAL '1' HOUR FROM events)"


@query(
    "str01_daily_cost",
    f"""SELECT strftime(s, {ISO}) AS window_start, strftime(s + INTERVAL '1' DAY, {ISO}) AS window_end, requests, prompt_tokens, output_tokens, cost_usd FROM (
        SELECT date_trunc('day', created_at_utc) AS s, count(*) AS requests, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
        CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost_usd), 6) + 0e0 AS cost_usd FROM v_chat_messages GROUP BY 1) t WHERE s + INTERVAL '1' DAY <= {CHAT_CLOSED}""",
)
def _(r):
    return jobs.run_available(jobs.daily_cost(arriving(r).chat_messages), "daily-cost").withColumn("cost_usd", F.round("cost_usd", 6))


@query(
    "str01_running_cost",
    f"""SELECT strftime(s, {ISO}) AS window_start, requests, prompt_tokens, output_tokens, cost_usd FROM (
        SELECT date_trunc('day', created_at_utc) AS s, count(*) AS requests, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
        CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost_usd), 6) + 0e0 AS cost_usd FROM v_chat_messages GROUP BY 1) t""",
)
def _(r):
    """The totals so far of every day, the open one included."""
    path = scratch_path(r.spark, "running-cost")
    jobs.keep_running_totals(arriving(r).chat_messages, path, scratch_path(r.spark, "running-cost-log"))
    totals = jobs.running_table(r.spark, path).read()
    return totals.select("window_start", "requests", "prompt_tokens", "output_tokens", F.round("cost_usd", 6).alias("cost_usd"))


BAR_SQL = """SELECT strftime(s, {iso}) AS window_start, strftime(s + INTERVAL '1' HOUR, {iso}) AS window_end, event_type AS symbol,
        arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS ticks
        FROM ({rows}) t WHERE s + INTERVAL '1' HOUR <= {closed} GROUP BY s, event_type"""


@query("str02_hourly_bars", BAR_SQL.format(iso=ISO, rows="SELECT *, date_trunc('hour', ts) AS s FROM events", closed=EVENT_CLOSED))
def _(r):
    return jobs.run_available(jobs.tick_bars(arriving(r).given("events"), "event_type", "value", "ts", "event_id"), "hourly-bars")


@query(
    "str02_sliding_bars",
    BAR_SQL.format(
        iso=ISO, closed=EVENT_CLOSED,
        rows="SELECT e.*, time_bucket(INTERVAL '15' MINUTE, ts) - k * INTERVAL '15' MINUTE AS s FROM events e, (VALUES (0), (1), (2), (3)) x(k)",
    ),
)
def _(r):
    return jobs.run_available(jobs.tick_bars(arriving(r).given("events"), "event_type", "value", "ts", "event_id", "1 hour", "15 minutes"), "sliding-bars")


TOUCH = f"""(SELECT *, row_number() OVER (PARTITION BY plan_date, ts_code ORDER BY ts, event_id) AS rn FROM (SELECT p.plan_date, p.ts_code, e.ts, e.event_id, e.value AS price,
CASE WHEN e.value >= predicted_target THEN 'target' WHEN e.value <= predicted_stop THEN 'stop' END AS touch
FROM events e JOIN v_execution_plans p ON p.plan_date = CAST(e.ts AS DATE) AND p.ts_code = {code('e.user_id')}) x WHERE touch IS NOT NULL)"""


@query(
    "str03_first_touch",
    f"""SELECT strftime(plan_date, {ISO}) AS window_start, strftime(plan_date + INTERVAL '1' DAY, {ISO}) AS window_end, ts_code, strftime(ts, {ISO}) AS touched_at, price, touch
        FROM {TOUCH} t WHERE rn = 1 AND plan_date + INTERVAL '1' DAY <= {EVENT_CLOSED}""",
)
def _(r):
    return jobs.run_available(jobs.first_touch_of_day(_ticks(r), pin(r.execution_plans)), "first-touch")


@query("str03_touch_alerts", f"SELECT plan_date, ts_code, event_id, price, touch FROM {TOUCH} t WHERE rn = 1")
def _(r):
    return jobs.run_available(jobs.touch_alerts(_ticks(r), pin(r.execution_plans)), "touch-alerts")


@query(
    "str03_revised_plans",
    f"""WITH v AS (SELECT event_id, {code('user_id')} AS ts_code, ts, value FROM events),
        held AS (SELECT t.*, p.event_id AS version, p.value AS base FROM v t JOIN v p ON p.ts_code = t.ts_code AND p.ts < t.ts AND CAST(p.ts AS DATE) = CAST(t.ts AS DATE)
                 QUALIFY row_number() OVER (PARTITION BY t.event_id ORDER BY p.ts DESC, p.event_id DESC) = 1),
        touched AS (SELECT *, CASE WHEN value >= base * 1.1e0 THEN 'target' WHEN value <= base * 9e-1 THEN 'stop' END AS touch FROM held),
        first AS (SELECT * FROM touched WHERE touch IS NOT NULL QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), ts_code ORDER BY ts, event_id) = 1)
        SELECT strftime(date_trunc('day', ts), {ISO}) AS window_start, strftime(date_trunc('day', ts) + INTERVAL '1' DAY, {ISO}) AS window_end, ts_code,
        strftime(ts, {ISO}) AS touched_at, value AS price, touch, version FROM first WHERE date_trunc('day', ts) + INTERVAL '2' DAY <= {EVENT_CLOSED}""",
)
def _(r):
    """Plans arrive and are revised while ticks do; a day is given out when the watermark is a day past it, as long as the join may still bring rows."""
    return jobs.run_available(jobs.first_touch_of_revised(_ticks(r), arriving(r).plan_arrivals), "revised-plans")


@query(
    "str04_stage_flags",
    f"""SELECT strftime(d, {ISO}) AS window_start, strftime(d + INTERVAL '1' DAY, {ISO}) AS window_end, bool_or(event_id % 4 = 0 OR event_id % 5 IN (0, 1)) AS pre_market,
        bool_or(event_id % 3 <> 0) AS auction, bool_or(event_id % 7 <> 0) AS opening, bool_or(event_id % 8 = 0) AS intraday
        FROM (SELECT date_trunc('day', ts) AS d, * FROM events) t WHERE d + INTERVAL '1' DAY <= {EVENT_CLOSED} GROUP BY d""",
)
def _(r):
    return jobs.run_available(jobs.stage_flags(arriving(r).plan_arrivals), "stage-flags")


@query(
    "str05_message_sessions",
    f"""SELECT strftime(min(created_at_utc), {ISO}) AS window_start, strftime(max(created_at_utc) + INTERVAL '30' MINUTE, {ISO}) AS window_end, session_id,
        count(*) AS messages, round(sum(cost_usd), 6) + 0e0 AS cost_usd FROM (SELECT *, sum(CASE WHEN before IS NULL OR created_at_utc - before > INTERVAL '30' MINUTE THEN 1 ELSE 0 END)
        OVER (PARTITION BY session_id ORDER BY created_at_utc, id) AS burst FROM (SELECT *, lag(created_at_utc) OVER (PARTITION BY session_id ORDER BY created_at_utc, id) AS before
        FROM v_chat_messages) a) b GROUP BY session_id, burst HAVING max(created_at_utc) + INTERVAL '30' MINUTE <= {CHAT_CLOSED}""",
)
def _(r):
    return jobs.run_available(jobs.message_sessions(arriving(r).chat_messages), "message-sessions").withColumn("cost_usd", F.round("cost_usd", 6))


@query("str06_first_deliveries", "SELECT DISTINCT event_type AS news_source, user_id AS news_id FROM events")
def _(r):
    links = arriving(r).given("events").select(F.col("event_type").alias("news_source"), F.col("user_id").alias("news_id"), "ts")
    return jobs.run_available(jobs.first_deliveries(links, ["news_source", "news_id"], "ts").select("news_source", "news_id"), "first-deliveries")
