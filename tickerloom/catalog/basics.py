"""Sources, projections, filters, joins, aggregates, windows, sorts and table changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.catalog.registry import query
from tickerloom.functions import nested, scalar, text
from tickerloom.operators import newest
from tickerloom.plans import assistant, dashboard, execution, forecast, market, picks, watchlist
from tickerloom.session import scratch_path
from tickerloom.sources import snapshots, tables
from tickerloom.sources.derived import CHART_ROOT

ISO = "'%Y-%m-%dT%H:%M:%S'"

# --- sources -----------------------------------------------------------------


@query("src01_table_scan", "SELECT ts_code, name, industry, market, listing_date FROM v_instruments")
def _(r):
    return r.instruments


@query(
    "src02_bound_sql",
    """SELECT n.title, n.source_name, l.ts_code, l.confidence FROM v_news_links l JOIN v_news n
       ON l.news_id = n.id AND l.news_source = 'global_news' WHERE l.market = 'hk'""",
)
def _(r):
    return tables.bound_sql(
        r.spark,
        """SELECT n.title, n.source_name, l.ts_code, l.confidence FROM {links} l JOIN {news} n
           ON l.news_id = n.id AND l.news_source = :source WHERE l.market = :market""",
        {"links": r.news_links, "news": r.news}, source="global_news", market="hk",
    )


@query(
    "src03_snapshot_documents",
    """SELECT strftime(plan_date, '%Y-%m-%d') AS plan_date, ts_code, rank, open_action, round(predicted_target, 6) + 0e0 AS predicted_target, hit_target
       FROM v_read_plans""",
)
def _(r):
    rows = snapshots.plan_rows(snapshots.decode_snapshots(snapshots.read_snapshot_files(r.spark, r.snapshot_folder)))
    return rows.select("plan_date", "ts_code", "rank", "open_action", F.round("predicted_target", 6).alias("predicted_target"), "hit_target")


@query("src04_absent_table", "SELECT CAST(count(*) AS BIGINT) AS instruments, CAST(0 AS BIGINT) AS stored FROM supplier")
def _(r):
    absent = tables.research_table(r.spark, f"{r.folder}/no-such-folder", "instruments")
    stored = absent.agg(F.count("*")).scalar()
    return r.instruments.agg(F.count("*").alias("instruments")).select("instruments", stored.alias("stored"))


@query(
    "src06_rule_rows",
    """SELECT e.id, x.action FROM v_company_risk_events e JOIN (VALUES ('dishonest', 'EXCLUDE'), ('execution', 'SCORE_MULTIPLY'),
       ('abnormal', 'EXCLUDE')) x(risk_type, action) ON e.risk_type = x.risk_type""",
)
def _(r):
    return r.company_risk_events.join(r.risk_rules, "risk_type").select("id", "action")


@query(
    "snk04_json_safe_rows",
    """SELECT id, CAST(NULL AS DOUBLE) AS bad, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 6) END AS ratio
       FROM (SELECT e.*, l_discount, l_tax FROM (SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
       CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), strftime(l_shipdate, '%Y%m%d')) AS id, l_discount, l_tax FROM lineitem) e) t""",
)
def _(r):
    l = r.given("lineitem")
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.round(F.col("l_tax") / F.col("l_discount"), 6))
    ids = F.concat_ws("-", *[F.col(c).cast("string") for c in ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]], F.date_format("l_shipdate", "yyyyMMdd"))
    rows = l.select(ids.alias("id"), F.struct(ratio.alias("ratio"), F.array(F.lit(float("nan"))).alias("bad")).alias("body"))
    safe = nested.safe_json_rows(rows)
    back = F.from_json("json", "id string, body struct<ratio:double,bad:array<double>>")
    return safe.select(back.alias("x")).select("x.id", F.col("x.body.ratio").alias("ratio"), F.get("x.body.bad", F.lit(0)).alias("bad"))


# --- projections and filters ---------------------------------------------------


@query("prj01_entry_columns", "SELECT id, rank_in_run AS rank, markdown AS markdown_report, predicted_buy_price FROM v_pick_entries")
def _(r):
    return picks.entry_view(r.pick_entries).select("id", "rank", "markdown_report", "predicted_buy_price")


@query(
    "prj02_verified_part",
    f"""SELECT id, strftime(verified_at, {ISO}) AS at, CASE WHEN verified_at IS NOT NULL THEN actual_direction END AS actual_direction,
        CASE WHEN verified_at IS NOT NULL THEN direction_correct END AS direction_correct FROM v_market_forecasts""",
)
def _(r):
    v = r.market_forecasts.select("id", forecast.verified_part().alias("v"))
    return v.select("id", "v.at", "v.actual_direction", "v.direction_correct")


@query("flt01_equal_market", "SELECT ts_code, name FROM v_instruments WHERE market = 'a'")
def _(r):
    return r.instruments.filter(F.col("market") == "a").select("ts_code", "name")


@query("flt02_search_instruments", "SELECT ts_code, name FROM v_instruments WHERE ts_code ILIKE '%c_1%' OR name ILIKE '%c_1%'")
def _(r):
    q = "c_1"
    return r.instruments.filter(text.like_search("ts_code", q) | text.like_search("name", q)).select("ts_code", "name")


@query(
    "flt03_search_concepts",
    """SELECT name FROM (SELECT DISTINCT concept_name AS name FROM v_concept_members WHERE concept_name ILIKE '%brand#1%'
       ORDER BY name LIMIT 50) t WHERE name <> ''""",
)
def _(r):
    return market.search_concepts(r.concept_members, "brand#1", 50)


@query(
    "flt04_point_lookup",
    "SELECT e.id, e.run_id, p.run_kind FROM v_pick_entries e LEFT JOIN v_pick_runs p ON p.id = e.run_id",
)
def _(r):
    """Batch form: the run of every requested id, null where there is none."""
    runs = r.pick_runs.select(F.col("id").alias("run_id"), "run_kind")
    return r.pick_entries.select("id", "run_id").join(runs, "run_id", "left")


@query("flt05_optional_kind", "SELECT id, run_kind FROM v_pick_runs WHERE run_kind = 'scan'")
def _(r):
    return picks.of_kind(r.pick_runs, "scan").select("id", "run_kind")


@query("flt06_verified_only", "SELECT id FROM v_market_forecasts WHERE verified_at IS NOT NULL")
def _(r):
    return r.market_forecasts.filter(F.col("verified_at").isNotNull()).select("id")


@query("flt07_in_watchlist", "SELECT ts_code, name FROM v_instruments i WHERE EXISTS (SELECT 1 FROM v_watchlist w WHERE w.ts_code = i.ts_code AND w.market = i.market)")
def _(r):
    return watchlist.only_listed(r.instruments, r.watchlist).select("ts_code", "name")


@query(
    "flt08_relative_days",
    "SELECT id FROM v_chat_messages WHERE created_at_utc >= CAST(CAST((SELECT max(created_at_utc) FROM v_chat_messages) AS DATE) - 1 AS TIMESTAMP)",
)
def _(r):
    m = r.chat_messages
    return m.filter(scalar.since_days("created_at_utc", dashboard.newest_time(m, "created_at_utc"), 1)).select("id")


@query(
    "flt09_code_by_name",
    """SELECT 'Co' || user_id AS name, min(i.ts_code) AS ts_code FROM events JOIN v_instruments i ON i.name = 'Co' || user_id
       WHERE i.market = 'a' GROUP BY 1""",
)
def _(r):
    asked = r.given("events").select(F.concat(F.lit("Co"), F.col("user_id").cast("string")).alias("name")).distinct()
    return asked.join(market.code_of_name(r.instruments), "name")


@query(
    "flt10_blank_after_limit",
    """SELECT concept_name AS name FROM (SELECT DISTINCT concept_name FROM v_concept_members ORDER BY concept_name NULLS FIRST LIMIT 5) t
       WHERE concept_name <> ''""",
)
def _(r):
    names = r.concept_members.select(F.col("concept_name").alias("name")).distinct()
    return newest.top(names, [F.col("name").asc_nulls_first()], 5).filter(F.col("name") != "")


@query("flt11_literal_search", "SELECT ts_code, name FROM v_instruments WHERE contains(lower(ts_code), 'co1') OR contains(lower(name), 'co1')")
def _(r):
    return picks.filter_ranking(r.instruments, " CO1 ").select("ts_code", "name")


@query(
    "flt12_notes",
    """SELECT strftime(plan_date, '%Y-%m-%d') AS plan_date, ts_code, event_id % 10 = 0 AS has_signal, event_id % 6 = 0 AS warned FROM v_read_plans
       WHERE event_id % 10 = 0 OR event_id % 6 = 0""",
)
def _(r):
    rows = snapshots.plan_rows(snapshots.decode_snapshots(snapshots.read_snapshot_files(r.spark, r.snapshot_folder))).select(
        "plan_date", "ts_code", nested.not_empty("intraday_notes").alias("has_signal"), nested.any_contains("pre_market_notes", "⚠️").alias("warned")
    )
    return rows.filter(F.col("has_signal") | F.col("warned"))


@query(
    "flt13_map_without_key",
    "SELECT id, code FROM v_market_forecasts, (VALUES ('000001'), ('399001')) x(code) WHERE charted",
)
def _(r):
    v = forecast.forecast_view(r.market_forecasts, CHART_ROOT)
    return v.select("id", F.explode(F.map_keys(nested.without_keys("charts", "sector_heatmap"))).alias("code"))


@query("flt14_valid_closes", "SELECT ts_code, trade_date, close FROM v_daily_prices WHERE close IS NOT NULL AND close <> 0")
def _(r):
    return market.valid_closes(r.daily_prices).select("ts_code", "trade_date", "close")


# --- joins ---------------------------------------------------------------------


@query(
    "jn01_linked_news",
    f"""SELECT l.ts_code, l.market, n.id AS news_id, n.title, n.article_url AS url, strftime(n.published_at_utc, {ISO}) AS published_at, l.event_type
        FROM v_news_links l JOIN v_news n ON n.id = l.news_id AND l.news_source = 'global_news'""",
)
def _(r):
    return market.linked_news(r.news_links, r.news).select(
        "ts_code", "market", "news_id", "title", "url", scalar.iso_time("published_at_utc").alias("published_at"), "event_type")


@query(
    "jn02_watchlist_names",
    """SELECT w.ts_code, w.market, coalesce(i.name, w.ts_code) AS name, i.industry FROM v_watchlist w
       LEFT JOIN v_instruments i ON i.ts_code = w.ts_code AND i.market = w.market""",
)
def _(r):
    w = r.watchlist.select("ts_code", "market")
    rows = w.join(r.instruments.select("ts_code", "market", "name", "industry"), ["ts_code", "market"], "left")
    return rows.withColumn("name", F.coalesce("name", "ts_code"))


@query(
    "jn03_entry_outcomes",
    """SELECT e.id, count(o.entry_id) AS horizons, coalesce(string_agg(CAST(o.horizon_days AS VARCHAR) || ':' || CAST(o.hit_buy AS VARCHAR), ',' ORDER BY o.horizon_days), '') AS hits
       FROM v_pick_entries e LEFT JOIN v_pick_outcomes o ON o.entry_id = e.id GROUP BY e.id""",
)
def _(r):
    hits = F.transform("backtest_outcomes", lambda o: F.concat(o["horizon_days"].cast("string"), F.lit(":"), o["hit_buy"].cast("string")))
    return picks.entry_outcomes(r.pick_entries.select("id"), r.pick_outcomes).select(
        "id", F.size("backtest_outcomes").cast("bigint").alias("horizons"), F.array_join(hits, ",").alias("hits"))


@query(
    "jn04_run_entries",
    """SELECT p.id AS run_id, p.run_kind, e.id, e.rank_in_run AS rank, count(*) OVER (PARTITION BY p.id) AS entry_count,
       row_number() OVER (PARTITION BY p.id ORDER BY e.rank_in_run, e.id) AS position
       FROM v_pick_runs p JOIN v_pick_entries e ON e.run_id = p.id""",
)
def _(r):
    return picks.run_entries(r.pick_runs, r.pick_entries).select("run_id", "run_kind", "id", "rank", "entry_count", "position")


DETAIL_SQL = """
SELECT i.ts_code, i.market, i.name, i.industry, strftime(i.listing_date, '%Y-%m-%d') AS list_date, coalesce(c.concepts, '') AS concepts,
       strftime(b.trade_date, '%Y-%m-%d') AS latest_date, b.close AS latest_close, round(b.pct_chg, 6) + 0e0 AS latest_pct_chg
FROM v_instruments i
LEFT JOIN (SELECT ts_code, market, string_agg(concept_name, ',' ORDER BY concept_name) AS concepts FROM v_concept_members GROUP BY ALL) c
       ON c.ts_code = i.ts_code AND c.market = i.market
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY ts_code, market ORDER BY trade_date DESC) AS rn FROM v_daily_prices) b
       ON b.ts_code = i.ts_code AND b.market = i.market AND b.rn = 1"""


def _detail(r):
    return market.detail(r.instruments, r.concept_members, r.daily_prices).select(
        "ts_code", "market", "name", "industry", "list_date", F.array_join("concepts", ",").alias("concepts"),
        F.col("latest.trade_date").alias("latest_date"), F.col("latest.close").alias("latest_close"),
        F.round("latest.pct_chg", 6).alias("latest_pct_chg"))


query("jn05_star_detail", DETAIL_SQL)(_detail)


@query(
    "jn06_watch_flag",
    "SELECT id, EXISTS (SELECT 1 FROM v_watchlist w WHERE w.market = 'a' AND w.ts_code = e.ts_code) AS watching FROM v_pick_entries e",
)
def _(r):
    return picks.watch_flags(r.pick_entries.select("id", "ts_code"), r.watchlist).select("id", "watching")


@query(
    "jn07_map_lookup",
    "SELECT id, CASE WHEN charted THEN '/charts/d' || id || '/k.png' END AS kline, CAST(NULL AS VARCHAR) AS macd FROM v_market_forecasts",
)
def _(r):
    c = forecast.charts_of(r.market_forecasts, CHART_ROOT, F.lit("000001"))
    return c.select("id", F.try_element_at("charts", F.lit("kline")).alias("kline"), F.try_element_at("charts", F.lit("macd")).alias("macd"))


@query(
    "jn08_label_actions",
    """SELECT plan_date, ts_code, CASE open_action WHEN 'BUY_AT_OPEN' THEN '买入' WHEN 'BUY_ON_PULLBACK' THEN '等回调' WHEN 'WAIT_OBSERVE' THEN '观望'
       WHEN 'SKIP_TODAY' THEN '放弃' WHEN 'EXIT_SIGNAL' THEN '止损' ELSE '待定' END AS action_label FROM v_execution_plans""",
)
def _(r):
    return execution.label_actions(r.execution_plans).select("plan_date", "ts_code", "action_label")


@query(
    "jn08_label_directions",
    "SELECT id, CASE market_direction WHEN 'bullish' THEN '看涨' WHEN 'bearish' THEN '看跌' WHEN 'range-bound' THEN '震荡' END AS direction_label FROM v_market_forecasts",
)
def _(r):
    return forecast.with_direction_label(r.market_forecasts).select("id", "direction_label")


@query(
    "jn08_label_indices",
    """SELECT id, code, CASE code WHEN '000001' THEN '上证指数' WHEN '399001' THEN '深证成指' ELSE code END AS index_name
       FROM v_market_forecasts, (VALUES ('000001'), ('399001'), ('sector_heatmap')) x(code) WHERE charted""",
)
def _(r):
    view = forecast.forecast_view(r.market_forecasts, CHART_ROOT)
    return forecast.with_index_name(view.select("id", F.explode(F.map_keys("charts")).alias("code")))


NEWEST_ENTRY = """(SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY created_at_utc DESC NULLS LAST, id DESC) AS rn FROM v_pick_entries)"""


@query(
    "jn09_newest_report",
    f"""SELECT i.ts_code, e.id AS entry_id, e.final_composite_score AS score, e.recommendation FROM v_instruments i
        LEFT JOIN {NEWEST_ENTRY} e ON e.ts_code = i.ts_code AND e.rn = 1""",
)
def _(r):
    return picks.with_newest_report(r.instruments.select("ts_code"), r.pick_entries)


@query(
    "jn10_confidence_bin",
    """SELECT id, CASE WHEN c >= 0 AND c < 50 THEN '0-50%' WHEN c < 65 THEN '50-65%' WHEN c < 80 THEN '65-80%' WHEN c < 101 THEN '80-100%' END AS bin
       FROM (SELECT id, coalesce(direction_confidence, 0) AS c FROM v_market_forecasts) t""",
)
def _(r):
    return r.market_forecasts.select("id", forecast.bin_of(F.col("direction_confidence")).alias("bin"))


# --- aggregates ----------------------------------------------------------------


@query("ag01_count", "SELECT count(id) AS total_entries FROM v_pick_entries")
def _(r):
    return dashboard.count_of(r.pick_entries, "total_entries")


@query("ag02_total_cost", "SELECT round(coalesce(sum(cost_usd), 0), 4) + 0e0 AS total_llm_cost_usd FROM v_chat_messages")
def _(r):
    return dashboard.total_cost(r.chat_messages)


DAILY_COST = """
SELECT CAST(CAST(created_at_utc AS DATE) AS VARCHAR) AS date, count(*) AS requests, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens,
       CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, round(coalesce(sum(cost_usd), 0), 4) + 0e0 AS cost_usd
FROM v_chat_messages WHERE created_at_utc >= CAST(CAST((SELECT max(created_at_utc) FROM v_chat_messages) AS DATE) - 30 AS TIMESTAMP)
GROUP BY 1"""


def _daily_cost(r):
    m = r.chat_messages
    return dashboard.daily_cost(m, dashboard.newest_time(m, "created_at_utc"), 30)


query("ag03_daily_cost", DAILY_COST)(_daily_cost)


@query(
    "ag04_freshness",
    """SELECT 'prices' AS dataset, CAST(max(trade_date) AS VARCHAR) AS latest FROM v_daily_prices WHERE market = 'a'
       UNION ALL SELECT 'risk', CAST(max(event_date) AS VARCHAR) FROM v_company_risk_events WHERE market = 'a'""",
)
def _(r):
    return dashboard.freshness({"prices": (r.daily_prices, "trade_date"), "risk": (r.company_risk_events, "event_date")})


@query(
    "ag05_popular_concepts",
    """SELECT concept_name AS name, stock_count FROM (SELECT concept_name, count(ts_code) AS stock_count FROM v_concept_members GROUP BY 1
       ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 10) t WHERE concept_name <> ''""",
)
def _(r):
    return market.popular_concepts(r.concept_members, 10)


@query("ag06_page_total", "SELECT count(*) AS total FROM v_pick_runs WHERE run_kind = 'llm_top300'")
def _(r):
    return picks.run_total(r.pick_runs, "llm_top300")


@query(
    "ag07_entries_per_run",
    "SELECT p.id, count(e.id) AS entry_count FROM v_pick_runs p LEFT JOIN v_pick_entries e ON e.run_id = p.id GROUP BY p.id",
)
def _(r):
    return picks.entry_counts(r.pick_runs.select("id"), r.pick_entries)


HISTORY = "(SELECT * FROM v_market_forecasts WHERE verified_at IS NOT NULL ORDER BY as_of_date DESC, id DESC LIMIT 365)"
HITS = "count(*) FILTER (WHERE direction_correct)"


@query(
    "ag08_hit_rate",
    f"SELECT count(*) AS total_verified, {HITS} AS correct, round({HITS} * 1e2 / count(*), 1) + 0e0 AS accuracy_pct FROM {HISTORY} h",
)
def _(r):
    return forecast.hit_rate(forecast.verified_history(r.market_forecasts, 365))


@query(
    "ag09_hit_rate_by_direction",
    f"""SELECT market_direction AS direction, count(*) AS count, {HITS} AS correct, round({HITS} * 1e2 / count(*), 1) + 0e0 AS accuracy_pct
        FROM {HISTORY} h GROUP BY 1""",
)
def _(r):
    return forecast.hit_rate_by_direction(forecast.verified_history(r.market_forecasts, 365))


BINS = "(VALUES (0, 50, '0-50%', 25e0), (50, 65, '50-65%', 57.5e0), (65, 80, '65-80%', 72.5e0), (80, 101, '80-100%', 90.5e0)) b(lo, hi, bin, bin_expected)"


@query(
    "ag10_confidence_calibration",
    f"""SELECT bin, count(h.id) AS count, count(h.id) FILTER (WHERE direction_correct) AS accurate,
        round(count(h.id) FILTER (WHERE direction_correct) * 1e2 / nullif(count(h.id), 0), 1) + 0e0 AS accuracy_pct, bin_expected
        FROM {BINS} LEFT JOIN {HISTORY} h ON coalesce(direction_confidence, 0) >= lo AND coalesce(direction_confidence, 0) < hi
        GROUP BY bin, bin_expected""",
)
def _(r):
    return forecast.calibration(forecast.verified_history(r.market_forecasts, 365))


INDEX_RATE = """
SELECT code, count(*) AS total, count(*) FILTER (WHERE ok) AS correct, round(count(*) FILTER (WHERE ok) * 1e2 / count(*), 1) + 0e0 AS pct
FROM (SELECT json_extract_string(x, '$.code') AS code, CAST(json_extract_string(x, '$.correct') AS BOOLEAN) AS ok
      FROM (SELECT unnest(CAST(index_results_json AS JSON[])) AS x
            FROM (SELECT * FROM v_forecast_evals WHERE horizon_days = 1 ORDER BY forecast_id DESC LIMIT {n}) t
            WHERE json_valid(index_results_json)) u) w WHERE code IS NOT NULL GROUP BY code"""


@query("ag11_index_hit_rate", INDEX_RATE.format(n=2555))
def _(r):
    return forecast.index_hit_rate(r.forecast_evals, 365)


SUMMARY = """
SELECT {day} AS plan_date, count(*) AS total, count(*) FILTER (WHERE open_action = 'BUY_AT_OPEN') AS buy_now,
       count(*) FILTER (WHERE open_action = 'BUY_ON_PULLBACK') AS buy_on_pullback, count(*) FILTER (WHERE open_action = 'WAIT_OBSERVE') AS wait,
       count(*) FILTER (WHERE open_action = 'SKIP_TODAY') AS skip, count(*) FILTER (WHERE hit_target) AS hit_target,
       count(*) FILTER (WHERE hit_stop) AS hit_stop FROM {t} GROUP BY 1"""


@query("ag12_action_counts", SUMMARY.format(day="plan_date", t="v_execution_plans"))
def _(r):
    return execution.summary(r.execution_plans)


STAGES = """
SELECT {day} AS plan_date, bool_or(overnight_adjustment IS NOT NULL OR adjusted_buy IS NOT NULL) AS pre_market,
       bool_or(auction_price IS NOT NULL) AS auction, bool_or(open_action <> '') AS opening, bool_or(current_price IS NOT NULL) AS intraday
FROM {t} GROUP BY 1"""


@query("ag13_stage_flags", STAGES.format(day="plan_date", t="v_execution_plans"))
def _(r):
    return execution.stages(r.execution_plans)


CALENDAR = """
SELECT strftime(plan_date, '%Y-%m-%d') AS plan_date, CASE WHEN fine THEN n END AS total_picks, CASE WHEN fine THEN buys END AS buy_signals,
       CASE WHEN fine THEN targets END AS hit_target, CASE WHEN NOT fine THEN '解析失败' END AS error
FROM (SELECT plan_date, dayofmonth(plan_date) <> 13 AS fine, count(*) AS n, count(*) FILTER (WHERE open_action = 'BUY_AT_OPEN') AS buys,
             count(*) FILTER (WHERE hit_target) AS targets FROM v_execution_plans GROUP BY 1 ORDER BY 1 DESC LIMIT {days}) t"""


def _calendar(r, days=30):
    return execution.calendar(snapshots.decode_snapshots(snapshots.newest_snapshot_files(r.spark, r.snapshot_folder, days)), days)


query("ag14_day_rollup", CALENDAR.format(days=30))(_calendar)


@query("ag15_distinct", "SELECT DISTINCT concept_name FROM v_concept_members")
def _(r):
    return r.concept_members.select("concept_name").distinct()


@query("ag16_concept_lists", "SELECT ts_code, market, coalesce(string_agg(concept_name, ',' ORDER BY concept_name), '') AS concepts FROM v_concept_members GROUP BY 1, 2")
def _(r):
    return market.concepts_of(r.concept_members).withColumn("concepts", F.array_join("concepts", ","))


@query(
    "ag17_whole_percent",
    """SELECT run_kind, CAST(floor(count(*) FILTER (WHERE llm_enabled) * 1e2 / count(*) + 0.5) AS BIGINT) AS pct,
       CAST(floor(count(*) FILTER (WHERE id % 3 = 0) * 1e2 / count(*) + 0.5) AS BIGINT) AS third FROM v_pick_runs GROUP BY 1""",
)
def _(r):
    g = r.pick_runs.groupBy("run_kind").agg(F.count("*").alias("n"), F.count_if("llm_enabled").alias("a"), F.count_if(F.col("id") % 3 == 0).alias("b"))
    pct = lambda c: scalar.whole_percent(F.try_divide(F.col(c) * 100.0, F.col("n")), "n")
    return g.select("run_kind", pct("a").alias("pct"), pct("b").alias("third"))


# --- windows -------------------------------------------------------------------


@query(
    "wn01_newest_bar",
    """SELECT ts_code, market, trade_date, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY ts_code, market ORDER BY trade_date DESC) AS rn
       FROM v_daily_prices) t WHERE rn = 1""",
)
def _(r):
    return market.newest_bar(r.daily_prices).select("ts_code", "market", "trade_date", "close", "volume")


LAST_BARS = """
SELECT ts_code, market, strftime(trade_date, '%Y-%m-%d') AS trade_date, open, high, low, close, volume, round(amount, 4) + 0e0 AS amount,
       round(coalesce(pct_chg, 0), 6) + 0e0 AS pct_chg
FROM (SELECT *, row_number() OVER (PARTITION BY ts_code, market ORDER BY trade_date DESC) AS rn FROM v_daily_prices) t WHERE rn <= {n}"""


def _last_bars(n):
    return lambda r: market.last_bars(r.daily_prices, n).withColumn("amount", F.round("amount", 4)).withColumn("pct_chg", F.round("pct_chg", 6))


query("wn02_last_bars", LAST_BARS.format(n=20))(_last_bars(20))

RECENT = "(SELECT *, row_number() OVER (PARTITION BY ts_code, market ORDER BY trade_date DESC) AS rn FROM v_daily_prices)"
W = "(PARTITION BY ts_code, market ORDER BY trade_date ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)"


@query(
    "wn03_moving_averages",
    f"""SELECT ts_code, trade_date, CASE WHEN count(close) OVER {W.format(k=4)} >= 5 THEN round(avg(close) OVER {W.format(k=4)}, 6) END AS ma5,
        CASE WHEN count(close) OVER {W.format(k=19)} >= 20 THEN round(avg(close) OVER {W.format(k=19)}, 6) END AS ma20
        FROM {RECENT} t WHERE rn <= 60 AND close IS NOT NULL AND close <> 0""",
)
def _(r):
    return market.moving_averages(r.daily_prices).select("ts_code", "trade_date", F.round("ma5", 6).alias("ma5"), F.round("ma20", 6).alias("ma20"))


@query(
    "wn04_last_five_closes",
    f"""SELECT ts_code, trade_date, array_to_string(list_transform(list(close) OVER {W.format(k=4)}, lambda c: CAST(CAST(floor(c) AS BIGINT) AS VARCHAR)), ',') AS closes
        FROM {RECENT} t WHERE rn <= 60 AND close IS NOT NULL AND close <> 0""",
)
def _(r):
    whole = F.transform("closes5", lambda c: F.floor(c).cast("string"))
    return market.moving_averages(r.daily_prices).select("ts_code", "trade_date", F.array_join(whole, ",").alias("closes"))


OWN_CODE = r"nullif(regexp_extract(content, '([0368]\d{5})', 1), '')"
CARRIED = f"""(SELECT *, {OWN_CODE} AS own_code, last_value({OWN_CODE} IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY created_at_utc, id
ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried_code FROM v_chat_messages)"""


@query("wn05_carried_code", f"SELECT id, session_id, own_code, carried_code FROM {CARRIED} t")
def _(r):
    return assistant.carried_codes(r.chat_messages).select("id", "session_id", "own_code", "carried_code")


ADEQUATE = """
SELECT c.*, n AS entry_count FROM (SELECT * FROM v_pick_runs WHERE run_kind = '{kind}' ORDER BY created_at_utc DESC, id DESC LIMIT 20) c
JOIN (SELECT run_id, count(*) AS n FROM v_pick_entries GROUP BY 1) k ON k.run_id = c.id
ORDER BY n >= {top} DESC, CASE WHEN n < {top} THEN n END DESC NULLS LAST, created_at_utc DESC, c.id DESC LIMIT 1"""


@query("wn06_adequate_run", "SELECT id, run_kind, entry_count FROM (" + ADEQUATE.format(kind="llm_top300", top=30) + ") t")
def _(r):
    return picks.adequate_run(r.pick_runs, r.pick_entries, "llm_top300", 30).select("id", "run_kind", "entry_count")


@query(
    "wn07_reply_history",
    """SELECT session_id, id, role, CAST(b - 1 AS BIGINT) AS messages_back FROM (SELECT *, row_number() OVER (PARTITION BY session_id
       ORDER BY created_at_utc DESC, id DESC) AS b FROM v_chat_messages) t WHERE b BETWEEN 2 AND 21 AND content <> ''""",
)
def _(r):
    return assistant.history_for_reply(r.chat_messages).select("session_id", "id", "role", "messages_back")


@query(
    "wn08_newest_verified",
    "SELECT id, as_of_date FROM v_market_forecasts WHERE verified_at IS NOT NULL ORDER BY as_of_date DESC, id DESC LIMIT 10",
)
def _(r):
    return forecast.verified_history(r.market_forecasts, 10).select("id", "as_of_date")


# --- sorts, limits, pages ------------------------------------------------------


@query("st01_newest_entries", "SELECT id FROM v_pick_entries ORDER BY created_at_utc DESC NULLS LAST, id DESC LIMIT 50")
def _(r):
    return newest.top(r.pick_entries, newest.newest_first("created_at_utc", "id"), 50).select("id")


@query("st02_page", "SELECT id, run_kind FROM v_pick_runs ORDER BY created_at_utc DESC, id DESC LIMIT 20 OFFSET 40")
def _(r):
    return newest.page(r.pick_runs, newest.newest_first("created_at_utc", "id"), 20, 40).select("id", "run_kind")


@query("st03_top_by_rank", "SELECT id, rank_in_run FROM v_pick_entries ORDER BY rank_in_run, id LIMIT 30")
def _(r):
    return newest.top(r.pick_entries, [F.col("rank_in_run"), F.col("id")], 30).select("id", "rank_in_run")


@query(
    "st04_by_score",
    """SELECT id, rank_in_run AS rank, coalesce(final_composite_score, 0) AS score, row_number() OVER (ORDER BY coalesce(final_composite_score, 0), id) AS position
        FROM v_pick_entries""",
)
def _(r):
    entries = r.pick_entries.select("id", F.col("rank_in_run").alias("rank"), "final_composite_score")
    return picks.by_score(entries).select("id", "rank", F.coalesce("final_composite_score", F.lit(0.0)).alias("score"), "position")


@query("st05_newest_days", "SELECT DISTINCT strftime(plan_date, '%Y-%m-%d') AS plan_date FROM v_execution_plans ORDER BY 1 DESC LIMIT 5")
def _(r):
    return newest.top(snapshots.snapshot_days(r.spark, r.snapshot_folder).distinct(), [F.col("plan_date").desc()], 5)


@query("st06_limit_with_order", "SELECT ts_code FROM v_instruments WHERE market = 'a' ORDER BY ts_code LIMIT 20")
def _(r):
    return market.search(r.instruments).select("ts_code")


@query("st07_second_page_of_50", "SELECT id FROM v_pick_entries ORDER BY rank_in_run, id LIMIT 50 OFFSET 50")
def _(r):
    return newest.page(r.pick_entries, [F.col("rank_in_run"), F.col("id")], 50, 50).select("id")


# --- table changes ---------------------------------------------------------------


@query(
    "mu01_watchlist_upsert",
    f"""SELECT coalesce(b.ts_code, c.ts_code) AS ts_code, coalesce(b.market, c.market) AS market,
        CASE WHEN b.ts_code IS NULL THEN c.note WHEN c.note <> '' THEN c.note ELSE b.note END AS note,
        CASE WHEN b.ts_code IS NULL THEN true WHEN c.note <> '' THEN true ELSE b.enabled END AS enabled,
        strftime(coalesce(b.created_at_utc, c.created_at_utc), {ISO}) AS created_at
        FROM v_watchlist b FULL JOIN v_watchlist_changes c ON c.ts_code = b.ts_code AND c.market = b.market""",
)
def _(r):
    return watchlist.add(r.watchlist, r.watchlist_changes).select("ts_code", "market", "note", "enabled", scalar.iso_time("created_at_utc").alias("created_at"))


@query(
    "mu02_watchlist_delete",
    """SELECT d.ts_code, d.market, w.ts_code IS NOT NULL AS removed FROM v_watchlist_removals d
       LEFT JOIN v_watchlist w ON w.ts_code = d.ts_code AND w.market = d.market""",
)
def _(r):
    return watchlist.removal_report(r.watchlist, r.watchlist_removals)


@query(
    "mu03_delete_sessions",
    """SELECT 'session' AS kind, id FROM v_chat_sessions WHERE NOT is_active UNION ALL
       SELECT 'message', m.id FROM v_chat_messages m JOIN v_chat_sessions s ON s.id = m.session_id WHERE NOT s.is_active""",
)
def _(r):
    s, m = assistant.delete_sessions(r.chat_sessions, r.chat_messages, r.chat_sessions.filter("is_active").select("id"))
    return s.select(F.lit("session").alias("kind"), "id").unionByName(m.select(F.lit("message").alias("kind"), "id"))


@query(
    "mu04_touch_sessions",
    f"""SELECT s.id, s.title, strftime(CASE WHEN d.doc_id IS NULL THEN s.updated_at_utc ELSE TIMESTAMP '2025-01-01' END, {ISO}) AS updated_at
        FROM v_chat_sessions s LEFT JOIN documents d ON d.doc_id * 2 = s.id
        UNION ALL SELECT 1000000 + doc_id, '新对话', '2025-01-01T00:00:00' FROM documents WHERE NOT EXISTS (SELECT 1 FROM v_chat_sessions s WHERE s.id = doc_id * 2)""",
)
def _(r):
    asked = r.given("documents").select((F.col("doc_id") * 2).alias("id"), (F.col("doc_id") + 1000000).alias("new_id"))
    now = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    return assistant.touch_sessions(r.chat_sessions, asked, now).select("id", "title", scalar.iso_time("updated_at_utc").alias("updated_at"))


CACHE = f"""WITH halves AS (SELECT *, request_id % 3 = 0 AS early FROM v_cache_writes),
        keys AS (SELECT cache_key, bool_or(NOT early) AS late FROM halves GROUP BY 1),
        used AS (SELECT h.* FROM halves h JOIN keys k USING (cache_key) WHERE NOT early OR NOT late),
        first AS (SELECT cache_key, arg_min(ttl_seconds, (NOT early, created_at_utc, request_id)) AS ttl_seconds FROM halves GROUP BY 1)
        SELECT cache_key, arg_max(response_json, (created_at_utc, request_id)) AS response_json, any_value(ttl_seconds) AS ttl_seconds,
        strftime(max(created_at_utc), {ISO}) AS created_at FROM (SELECT u.* EXCLUDE (ttl_seconds), first.ttl_seconds FROM used u JOIN first USING (cache_key)) t GROUP BY 1"""


@query("mu05_cache_newest_wins", CACHE)
def _(r):
    w = r.cache_writes
    early = F.col("request_id") % 3 == 0
    empty = r.spark.createDataFrame([], "cache_key string, response_json string, ttl_seconds bigint, created_at_utc timestamp_ntz")
    merged = assistant.write_cache(assistant.write_cache(empty, w.filter(early)), w.filter(~early))
    return merged.select("cache_key", "response_json", "ttl_seconds", scalar.iso_time("created_at_utc").alias("created_at"))
