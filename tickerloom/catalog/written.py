"""Writers, checked by reading back what they wrote to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.catalog.basics import CACHE, ISO
from tickerloom.catalog.registry import query
from tickerloom.functions import scalar
from tickerloom.operators.merge import upsert
from tickerloom.plans import assistant, backtest, watchlist
from tickerloom.schemas import RESEARCH_SCHEMAS
from tickerloom.session import scratch_path
from tickerloom.sources import sinks, tables
from tickerloom.sources.stored import KeyedTable


@query(
    "src05_iteration_ledger",
    """SELECT id AS run_id, CAST(trade_date_as_of AS VARCHAR) AS as_of, CAST(id % 100 / 1e2 AS DOUBLE) AS fail_rate, CAST(NULL AS DOUBLE) AS mean_delta FROM v_pick_runs""",
)
def _(r):
    path = scratch_path(r.spark, "ledger")
    rows = r.pick_runs.select(F.col("id").alias("run_id"), F.col("trade_date_as_of").cast("string").alias("as_of"), (F.col("id") % 100 / F.lit(1e2)).alias("fail_rate"))
    rows.write.json(path)
    return tables.json_lines(r.spark, path, "iteration_ledger").select("run_id", "as_of", "fail_rate", "mean_delta")


@query("snk01_append_messages", "SELECT id, session_id, round(cost_usd, 9) + 0e0 AS cost_usd, CAST(created_at_utc AS DATE) AS dt FROM v_chat_messages")
def _(r):
    path = scratch_path(r.spark, "messages")
    messages = r.chat_messages.drop("cost_usd")
    for rest in (0, 1):
        sinks.append_messages(messages.filter(F.pmod("id", F.lit(2)) == rest), path)
    kind = "id bigint, session_id bigint, cost_usd double, dt date"
    return r.spark.read.schema(kind).parquet(path).withColumn("cost_usd", F.round("cost_usd", 9))


@query(
    "snk02_append_run",
    """SELECT p.id AS run_id, p.trade_date_as_of AS trade_date, count(*) AS entries, max(e.id) AS entry_id FROM v_pick_runs p JOIN v_pick_entries e ON e.run_id = p.id GROUP BY 1, 2""",
)
def _(r):
    runs_path, entries_path = scratch_path(r.spark, "runs"), scratch_path(r.spark, "entries")
    for _ in range(2):  # the second time finds everything stored
        newest = sinks.append_pick_run(r.pick_runs, r.pick_entries, runs_path, entries_path)
    stored = r.spark.read.schema("id string, run_id bigint, trade_date date").parquet(entries_path)
    return stored.groupBy("run_id", "trade_date").agg(F.count("*").alias("entries")).join(newest, "run_id")


@query("snk03_catch_up_prices", "SELECT ts_code, market, trade_date, close FROM v_daily_prices")
def _(r):
    """Half of the instruments of some days are loaded first; the catch-up load then brings all bars, twice over, the older copy with a wrong price."""
    path = scratch_path(r.spark, "prices")
    schema = "ts_code string, market string, close double, loaded_at int, trade_date date"
    fresh = r.daily_prices.select("ts_code", "market", "close", F.lit(2).alias("loaded_at"), "trade_date")
    none = r.spark.createDataFrame([], schema)
    sinks.catch_up_prices(none, fresh.filter((F.dayofmonth("trade_date") % 2 == 0) & (F.col("market") == "a") & (F.substring("ts_code", -1, 1) < "5")), path)
    stored = tables.parquet_or_empty(r.spark, path, schema)
    stale = fresh.withColumn("close", F.lit(-1.0)).withColumn("loaded_at", F.lit(1))
    sinks.catch_up_prices(stored, fresh.unionByName(stale), path)
    return r.spark.read.schema(schema).parquet(path).select("ts_code", "market", "trade_date", "close")


@query(
    "tb14_audit_ledger",
    f"""SELECT run_id, round(fail_rate, 6) + 0e0 AS fail_rate FROM (SELECT run_id, avg(CASE WHEN hit_buy AND return_pct >= 0 THEN 0e0 ELSE 1e0 END) AS fail_rate
        FROM (SELECT e.run_id, o.* FROM v_pick_entries e JOIN v_pick_outcomes o ON o.entry_id = e.id WHERE o.horizon_days = 5 AND e.rank_in_run <= 10) t GROUP BY 1) a""",
)
def _(r):
    """Audit of stored outcomes, kept in and read back from the ledger."""
    path = scratch_path(r.spark, "audit-ledger")
    entries = r.pick_entries.select(F.col("id").alias("entry_id"), "run_id", "rank_in_run", "llm_composite_score", "rule_composite_score")
    audit = backtest.run_audit(entries.join(r.pick_outcomes, "entry_id")).withColumn("as_of", F.lit("2024-07-18"))
    audit.select("run_id", "as_of", "fail_rate", "mean_fwd_return", "mean_delta").write.json(path)
    return tables.json_lines(r.spark, path, "iteration_ledger").select("run_id", F.round("fail_rate", 6).alias("fail_rate"))


def _loaded(r, name, rows, keys):
    """A stored table of ``rows``, put there by its first change set."""
    schema = r.spark.createDataFrame([], RESEARCH_SCHEMAS[name]).select(*rows.columns).schema
    table = KeyedTable(r.spark, scratch_path(r.spark, name), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema), keys)
    table.change(rows, lambda stored, fresh: upsert(stored, fresh, keys, {}, {}))
    return table


@query(
    "mu01_stored_watchlist",
    f"""SELECT coalesce(b.ts_code, c.ts_code) AS ts_code, coalesce(b.market, c.market) AS market,
        CASE WHEN b.ts_code IS NULL THEN c.note WHEN c.note <> '' THEN c.note ELSE b.note END AS note,
        CASE WHEN b.ts_code IS NULL THEN true WHEN c.note <> '' THEN true ELSE b.enabled END AS enabled,
        strftime(coalesce(b.created_at_utc, c.created_at_utc), {ISO}) AS created_at
        FROM v_watchlist b FULL JOIN v_watchlist_changes c ON c.ts_code = b.ts_code AND c.market = b.market
        WHERE NOT EXISTS (SELECT 1 FROM v_watchlist_removals d WHERE d.ts_code = coalesce(b.ts_code, c.ts_code) AND d.market = coalesce(b.market, c.market))""",
)
def _(r):
    """The stored list takes its additions, twice over, and then its removals."""
    table = _loaded(r, "watchlist", r.watchlist, watchlist.KEY)
    for _ in range(2):
        table.change(r.watchlist_changes, watchlist.add)
    table.change(r.watchlist_removals, watchlist.remove)
    return table.read().select("ts_code", "market", "note", "enabled", scalar.iso_time("created_at_utc").alias("created_at"))


@query("mu05_stored_cache", CACHE)
def _(r):
    """Early and late writes reach the stored cache as two change sets, the late ones twice over."""
    writes, early = r.cache_writes, F.col("request_id") % 3 == 0
    table = KeyedTable(r.spark, scratch_path(r.spark, "cache"), "cache_key string, response_json string, ttl_seconds bigint, created_at_utc timestamp_ntz", ["cache_key"])
    for part in (writes.filter(early), writes.filter(~early), writes.filter(~early)):
        table.change(part, assistant.write_cache)
    return table.read().select("cache_key", "response_json", "ttl_seconds", scalar.iso_time("created_at_utc").alias("created_at"))
