"""The end-to-end queries, for every instrument, run, entry and session at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.catalog import basics, expressions
from tickerloom.catalog.basics import HISTORY, HITS, ISO
from tickerloom.catalog.registry import query
from tickerloom.functions import scalar
from tickerloom.plans import assistant, dashboard, execution, forecast, market, picks, watchlist
from tickerloom.sources import snapshots
from tickerloom.sources.derived import CHART_ROOT


@query(
    "q01_instrument_search",
    """SELECT ts_code, name, industry, market, strftime(listing_date, '%Y-%m-%d') AS list_date FROM v_instruments
       WHERE market = 'a' AND (ts_code ILIKE '%Co2%' OR name ILIKE '%Co2%') ORDER BY ts_code LIMIT 20""",
)
def _(r):
    return market.search(r.instruments, "Co2")


query("q02_bars", basics.LAST_BARS.format(n=120))(basics._last_bars(120))


@query(
    "q03_instrument_news",
    f"""SELECT ts_code, market, news_id, title, strftime(published_at_utc, {ISO}) AS published_at, confidence, event_type FROM (
        SELECT l.*, n.title, n.published_at_utc, row_number() OVER (PARTITION BY l.ts_code, l.market ORDER BY published_at_utc DESC, n.id DESC) AS rn
        FROM v_news_links l JOIN v_news n ON n.id = l.news_id AND l.news_source = 'global_news') t WHERE rn <= 20""",
)
def _(r):
    return market.newest_news(r.news_links, r.news, 20).select(
        "ts_code", "market", "news_id", "title", scalar.iso_time("published_at_utc").alias("published_at"), "confidence", "event_type")


query("q04_instrument_detail", basics.DETAIL_SQL)(basics._detail)


@query(
    "q05_concepts",
    """SELECT name, stock_count FROM (SELECT concept_name AS name, count(ts_code) AS stock_count FROM v_concept_members GROUP BY 1
       ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 50) t WHERE name <> ''""",
)
def _(r):
    return market.popular_concepts(r.concept_members, 50)


@query("q06_concept_members", "SELECT concept_name, ts_code, name FROM v_concept_members WHERE market = 'a'")
def _(r):
    return market.concept_stocks(r.concept_members)


@query(
    "q07_runs_page",
    f"""SELECT id, run_kind, strftime(trade_date_as_of, '%Y-%m-%d') AS trade_date, rule_version, llm_enabled, llm_model, summary_customer AS customer,
        strftime(created_at_utc, {ISO}) AS created_at, (SELECT count(*) FROM v_pick_runs WHERE run_kind = 'scan') AS total
        FROM v_pick_runs WHERE run_kind = 'scan' ORDER BY created_at_utc DESC, id DESC LIMIT 20 OFFSET 20""",
)
def _(r):
    return picks.runs_page(r.pick_runs, "scan", 20, 20).withColumn("customer", F.col("summary.customer")).drop("summary")


@query(
    "q08_run_with_entries",
    """SELECT p.id AS run_id, p.run_kind, strftime(p.trade_date_as_of, '%Y-%m-%d') AS trade_date, count(*) OVER (PARTITION BY p.id) AS entry_count,
       e.id, e.ts_code, e.rank_in_run AS rank, e.close_price, e.llm_composite_score, e.qty AS report_qty,
       row_number() OVER (PARTITION BY p.id ORDER BY e.rank_in_run, e.id) AS position
       FROM v_pick_runs p JOIN v_pick_entries e ON e.run_id = p.id""",
)
def _(r):
    return picks.run_entries(r.pick_runs, r.pick_entries).select(
        "run_id", "run_kind", "trade_date", "entry_count", "id", "ts_code", "rank", "close_price", "llm_composite_score", F.col("report.qty").alias("report_qty"), "position")


@query(
    "q09_entry_detail",
    """SELECT e.id, e.ts_code, e.rank_in_run AS rank, o.horizon_days, o.return_pct, o.hit_target, o.hit_stop FROM v_pick_entries e
       LEFT JOIN v_pick_outcomes o ON o.entry_id = e.id""",
)
def _(r):
    rows = picks.outcome_rows(r.pick_entries.select("id", "ts_code", F.col("rank_in_run").alias("rank")), r.pick_outcomes)
    return rows.select("id", "ts_code", "rank", "horizon_days", "return_pct", "hit_target", "hit_stop")


@query(
    "q10_newest_report",
    f"SELECT ts_code, id, rank_in_run AS rank, markdown AS markdown_report, CASE WHEN analysed THEN CAST(qty AS DOUBLE) END AS ret_20d FROM {basics.NEWEST_ENTRY} t WHERE rn = 1",
)
def _(r):
    return picks.entry_view(picks.newest_reports(r.pick_entries)).select("ts_code", "id", "rank", "markdown_report", F.col("analysis.ret_20d").alias("ret_20d"))


@query(
    "q11_latest_ranking",
    f"""SELECT e.run_id, strftime(p.trade_date_as_of, '%Y-%m-%d') AS trade_date, e.id, e.ts_code, e.rank_in_run AS rank, e.final_composite_score
        FROM ({basics.ADEQUATE.format(kind='scan', top=5)}) p JOIN v_pick_entries e ON e.run_id = p.id ORDER BY e.rank_in_run, e.id LIMIT 5""",
)
def _(r):
    return picks.latest_ranking(r.pick_runs, r.pick_entries, "scan", 5).select("run_id", "trade_date", "id", "ts_code", "rank", "final_composite_score")


@query(
    "q12_newest_forecast",
    f"""SELECT id, CAST(as_of_date AS VARCHAR) AS as_of_date, market_direction, direction_confidence, push_sent,
        CASE WHEN readable THEN 'day ' || id END AS reasoning, CASE WHEN verified_at IS NOT NULL THEN actual_direction END AS actual,
        strftime(verified_at, {ISO}) AS verified_at, strftime(created_at_utc, {ISO}) AS created_at
        FROM v_market_forecasts ORDER BY as_of_date DESC, id DESC LIMIT 1""",
)
def _(r):
    v = forecast.forecast_view(forecast.newest_forecast(r.market_forecasts), CHART_ROOT)
    return v.select("id", "as_of_date", "market_direction", "direction_confidence", "push_sent", F.col("forecast.market_direction.reasoning").alias("reasoning"),
                    F.col("verified.actual_direction").alias("actual"), F.col("verified.at").alias("verified_at"), "created_at")


RATE = f"{HITS} AS correct, round({HITS} * 1e2 / nullif(count(*), 0), 1) + 0e0 AS pct"


@query(
    "q13_track_record",
    f"""WITH h AS (SELECT * FROM {HISTORY} t)
        SELECT 'overall' AS section, 'all' AS key, count(*) AS count, {RATE} FROM h
        UNION ALL SELECT 'direction', market_direction, count(*), {RATE} FROM h GROUP BY 2
        UNION ALL SELECT 'confidence', bin, count(h.id), count(h.id) FILTER (WHERE direction_correct),
               round(count(h.id) FILTER (WHERE direction_correct) * 1e2 / nullif(count(h.id), 0), 1)
               FROM {basics.BINS} LEFT JOIN h ON coalesce(direction_confidence, 0) >= lo AND coalesce(direction_confidence, 0) < hi GROUP BY bin
        UNION ALL SELECT 'index', code, total, correct, pct FROM ({basics.INDEX_RATE.format(n=2555)}) i""",
)
def _(r):
    return forecast.track_record(r.market_forecasts, r.forecast_evals, 365)


@query(
    "q13_history",
    f"""SELECT CAST(as_of_date AS VARCHAR) AS as_of_date, market_direction AS predicted, actual_direction AS actual, actual_pct_chg AS actual_pct,
        direction_correct AS correct, direction_confidence AS confidence FROM {HISTORY} h""",
)
def _(r):
    return forecast.history_view(forecast.verified_history(r.market_forecasts, 365))


@query(
    "q14_index_charts",
    """SELECT x.code AS index_code, CASE x.code WHEN '000001' THEN '/charts/d' || id || '/k.png' END AS kline, CASE x.code WHEN '399001' THEN '/charts/d' || id || '.png' END AS plain
       FROM (SELECT * FROM v_market_forecasts ORDER BY as_of_date DESC, id DESC LIMIT 1) f, (VALUES ('000001'), ('399001'), ('399006'), ('000688'), ('000300'), ('000905'), ('000852')) x(code)""",
)
def _(r):
    codes = F.explode(F.array(*[F.lit(c) for c, _ in forecast.INDEX_NAMES]))
    newest = forecast.newest_forecast(r.market_forecasts).withColumn("index_code", codes)
    c = forecast.charts_of(newest, CHART_ROOT, F.col("index_code"))
    return c.select("index_code", F.try_element_at("charts", F.lit("kline")).alias("kline"), F.try_element_at("charts", F.lit("default")).alias("plain"))


def _plans(r):
    return snapshots.plan_rows(snapshots.decode_snapshots(snapshots.read_snapshot_files(r.spark, r.snapshot_folder)))


@query("q15_execution_summary", basics.SUMMARY.format(day="strftime(plan_date, '%Y-%m-%d')", t="v_read_plans"))
def _(r):
    return execution.summary(_plans(r))


@query(
    "q16_execution_stages",
    f"""WITH s AS ({basics.STAGES.format(day="plan_date", t='v_read_plans')}), d AS (
          SELECT CAST(unnest(generate_series(min(ts)::DATE, max(ts)::DATE + 7, INTERVAL '1' DAY)) AS DATE) AS plan_date FROM events)
        SELECT strftime(d.plan_date, '%Y-%m-%d') AS plan_date, CAST((dayofweek(d.plan_date) + 6) % 7 AS INTEGER) AS weekday, dayofweek(d.plan_date) IN (0, 6) AS is_weekend,
          s.plan_date IS NOT NULL AS has_snapshot, x.stage, coalesce(CASE x.stage WHEN 'pre_market' THEN pre_market WHEN 'auction' THEN auction
          WHEN 'opening' THEN opening ELSE intraday END, false) AS done
        FROM d LEFT JOIN s ON s.plan_date = d.plan_date, (VALUES ('pre_market'), ('auction'), ('opening'), ('intraday')) x(stage)""",
)
def _(r):
    # Every day of the events and a week beyond, for which there is no file.
    span = r.given("events").agg(F.to_date(F.min("ts")).alias("a"), F.date_add(F.to_date(F.max("ts")), 7).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("plan_date"))
    return execution.status_of_days(days, snapshots.decode_snapshots(snapshots.read_snapshot_files(r.spark, r.snapshot_folder)))


query("q17_execution_calendar", basics.CALENDAR.format(days=30))(basics._calendar)


@query(
    "q18_platform_totals",
    f"""SELECT (SELECT count(id) FROM v_pick_runs) AS total_runs, (SELECT count(id) FROM v_pick_entries) AS total_entries,
        (SELECT round(coalesce(sum(cost_usd), 0), 4) FROM v_chat_messages) AS total_llm_cost_usd, id AS latest_id, run_kind AS latest_run_kind,
        strftime(trade_date_as_of, '%Y-%m-%d') AS latest_trade_date, strftime(created_at_utc, {ISO}) AS latest_created_at
        FROM v_pick_runs ORDER BY created_at_utc DESC, id DESC LIMIT 1""",
)
def _(r):
    return dashboard.totals(r.pick_runs, r.pick_entries, r.chat_messages)


query("q19_daily_cost", basics.DAILY_COST)(basics._daily_cost)


@query(
    "q20_pipeline_freshness",
    f"""SELECT 'prices' AS dataset, CAST(max(trade_date) AS VARCHAR) AS latest FROM v_daily_prices WHERE market = 'a'
        UNION ALL SELECT 'snapshots', CAST(max(plan_date) AS VARCHAR) FROM v_execution_plans
        UNION ALL SELECT * FROM (SELECT 'pick_run:' || run_kind, strftime(created_at_utc, {ISO}) FROM v_pick_runs ORDER BY created_at_utc DESC, id DESC LIMIT 1) t""",
)
def _(r):
    return dashboard.pipeline(r.daily_prices, r.execution_plans.withColumn("market", F.lit("a")), r.pick_runs)


@query(
    "q21_watchlist_view",
    f"""SELECT w.ts_code, coalesce(i.name, w.ts_code) AS name, i.industry, w.note AS notes, w.enabled, strftime(w.created_at_utc, {ISO}) AS created_at
        FROM v_watchlist w LEFT JOIN v_instruments i ON i.ts_code = w.ts_code AND i.market = w.market WHERE w.market = 'a'""",
)
def _(r):
    return watchlist.view(r.watchlist, r.instruments)


@query(
    "q22_sessions",
    f"""SELECT id, coalesce(nullif(title, ''), '会话 ' || id) AS title, is_active, strftime(created_at_utc, {ISO}) AS created_at, strftime(updated_at_utc, {ISO}) AS updated_at
        FROM v_chat_sessions ORDER BY updated_at_utc DESC, id DESC LIMIT 20 OFFSET 20""",
)
def _(r):
    return assistant.sessions_page(r.chat_sessions, 20, 20)


@query(
    "q22_messages",
    f"SELECT session_id, id, role, content, intent, round(cost_usd, 9) + 0e0 AS cost_usd, elapsed_ms, strftime(created_at_utc, {ISO}) AS created_at FROM v_chat_messages",
)
def _(r):
    return assistant.message_view(r.chat_messages).withColumn("cost_usd", F.round("cost_usd", 9))


@query(
    "q22_message_page",
    f"""SELECT session_id, id, role, content, intent, round(cost_usd, 9) + 0e0 AS cost_usd, elapsed_ms, strftime(created_at_utc, {ISO}) AS created_at FROM v_chat_messages
        WHERE session_id = (SELECT min(session_id) FROM v_chat_messages) ORDER BY created_at_utc, id LIMIT 50 OFFSET 1""",
)
def _(r):
    session = r.chat_messages.agg(F.min("session_id")).scalar()
    return assistant.messages_page(r.chat_messages, session, 50, 1).withColumn("cost_usd", F.round("cost_usd", 9))


@query(
    "q23_message_context",
    rf"""WITH named AS (SELECT id, {expressions.NAME_SQL} AS name FROM v_chat_messages WHERE role = 'user'),
        resolved AS (SELECT c.id, c.session_id, coalesce(own_code, i.ts_code, carried_code) AS ts_code,
             CASE WHEN own_code IS NOT NULL THEN 'own' WHEN i.ts_code IS NOT NULL THEN 'name' WHEN carried_code IS NOT NULL THEN 'carried' END AS code_source
             FROM {basics.CARRIED} c JOIN named n ON n.id = c.id
             LEFT JOIN v_instruments i ON i.market = 'a' AND i.name = n.name AND NOT regexp_matches(n.name, '^\p{{N}}+$')),
        recent AS (SELECT * FROM {basics.RECENT} t WHERE rn <= 60 AND market = 'a'),
        valid AS (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) AS k FROM recent WHERE close IS NOT NULL AND close <> 0),
        ma AS (SELECT ts_code, CASE WHEN count(*) FILTER (WHERE k <= 5) >= 5 THEN avg(close) FILTER (WHERE k <= 5) END AS ma5,
             CASE WHEN count(*) FILTER (WHERE k <= 20) >= 20 THEN avg(close) FILTER (WHERE k <= 20) END AS ma20,
             CAST(count(*) FILTER (WHERE k <= 5) AS BIGINT) AS closes FROM valid GROUP BY 1)
        SELECT s.id, s.session_id, s.ts_code, code_source, i.name, strftime(b.trade_date, '%Y-%m-%d') AS latest_date, b.close AS latest_close,
             round(ma5, 6) + 0e0 AS ma5, round(ma20, 6) + 0e0 AS ma20, coalesce(closes, 0) AS closes
        FROM resolved s LEFT JOIN v_instruments i ON i.ts_code = s.ts_code AND i.market = 'a'
        LEFT JOIN recent b ON b.ts_code = i.ts_code AND b.rn = 1 LEFT JOIN ma ON ma.ts_code = i.ts_code""",
)
def _(r):
    rows = assistant.enriched_messages(r.chat_messages, r.instruments, r.daily_prices)
    return rows.select(
        "id", "session_id", "ts_code", "code_source", "name", scalar.iso_date("latest.trade_date").alias("latest_date"), F.col("latest.close").alias("latest_close"),
        F.round("ma5", 6).alias("ma5"), F.round("ma20", 6).alias("ma20"), F.coalesce(F.size("closes5"), F.lit(0)).cast("bigint").alias("closes"))


@query(
    "q24_response_reuse",
    """WITH first AS (SELECT cache_key, arg_min(ttl_seconds, (created_at_utc, request_id)) AS ttl_seconds FROM v_cache_writes GROUP BY 1),
        stored AS (SELECT cache_key, created_at_utc, arg_max(response_json, request_id) AS response_json FROM v_cache_writes GROUP BY 1, 2)
        SELECT q.request_id, q.cache_key, s.response_json FROM v_model_requests q ASOF JOIN stored s ON s.cache_key = q.cache_key AND q.asked_at >= s.created_at_utc
        JOIN first f ON f.cache_key = q.cache_key WHERE q.asked_at <= s.created_at_utc + f.ttl_seconds * INTERVAL '1' SECOND""",
)
def _(r):
    return assistant.reusable_responses(r.model_requests, r.cache_writes)
