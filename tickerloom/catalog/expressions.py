"""Scalar expressions and nested data over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.catalog.basics import HISTORY, ISO
from tickerloom.catalog.registry import query
from tickerloom.functions import nested, scalar, text
from tickerloom.plans import execution, forecast, market, picks
from tickerloom.sources import snapshots
from tickerloom.sources.derived import CHART_ROOT, MODEL, SYSTEM_PROMPT

# --- numbers ---------------------------------------------------------------------


@query("sc01_token_cost", "SELECT id, round(cost_usd, 9) + 0e0 AS cost FROM v_chat_messages")
def _(r):
    return r.chat_messages.select("id", F.round(scalar.token_cost("prompt_tokens", "output_tokens"), 9).alias("cost"))


@query(
    "sc02_finite",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount <> 0 THEN round(l_tax / l_discount, 6) END AS ratio,
       CAST(CASE WHEN l_tax <> 0 THEN l_quantity END AS DOUBLE) AS quantity FROM lineitem""",
)
def _(r):
    l = r.given("lineitem")
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("-inf"))).otherwise(F.round(F.col("l_tax") / F.col("l_discount"), 6))
    quantity = F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", scalar.finite(ratio).alias("ratio"), scalar.finite(quantity).alias("quantity"))


@query("sc03_zero_if_null", "SELECT ts_code, trade_date, round(coalesce(pct_chg, 0), 6) + 0e0 AS pct_chg FROM v_daily_prices")
def _(r):
    return r.daily_prices.select("ts_code", "trade_date", F.round(scalar.zero_if_null("pct_chg"), 6).alias("pct_chg"))


@query(
    "sc04_percent",
    "SELECT run_id, round(count(*) FILTER (WHERE llm_composite_score IS NOT NULL) * 1e2 / count(*), 1) + 0e0 AS pct FROM v_pick_entries GROUP BY 1",
)
def _(r):
    g = r.pick_entries.groupBy("run_id").agg(F.count("llm_composite_score").alias("k"), F.count("*").alias("n"))
    return g.select("run_id", scalar.percent("k", "n").alias("pct"))


@query(
    "sc14_upside",
    "SELECT id, round((predicted_target_price - predicted_buy_price) / nullif(predicted_buy_price, 0) * 1e2, 6) + 0e0 AS upside FROM v_pick_entries",
)
def _(r):
    return r.pick_entries.select("id", F.round(scalar.upside("predicted_target_price", "predicted_buy_price"), 6).alias("upside"))


@query(
    "sc15_score_band",
    """SELECT id, CASE WHEN coalesce(llm_composite_score, 0) >= 70 THEN 'strong' WHEN coalesce(llm_composite_score, 0) >= 55 THEN 'fair'
       ELSE 'weak' END AS band FROM v_pick_entries""",
)
def _(r):
    return r.pick_entries.select("id", scalar.score_band("llm_composite_score").alias("band"))


@query(
    "sc17_effective_buy",
    """SELECT plan_date, ts_code, round(CASE WHEN adjusted_buy <> 0 THEN adjusted_buy ELSE predicted_buy END, 6) + 0e0 AS buy,
       round(overnight_adjustment * 1e2, 1) + 0e0 AS overnight_pct FROM v_execution_plans""",
)
def _(r):
    return execution.status_view(r.execution_plans).select("plan_date", "ts_code", F.round("buy", 6).alias("buy"), "overnight_pct")


@query(
    "sc18_plan_status",
    """SELECT plan_date, ts_code, CASE WHEN hit_target THEN '已止盈' WHEN hit_stop THEN '已止损' WHEN open_action = 'BUY_AT_OPEN' THEN '已买入'
       ELSE '待执行' END AS status FROM v_execution_plans""",
)
def _(r):
    return execution.status_view(r.execution_plans).select("plan_date", "ts_code", "status")


@query("sc19_volume_wan", "SELECT ts_code, trade_date, volume / 1e4 AS volume_wan FROM v_daily_prices")
def _(r):
    return r.daily_prices.select("ts_code", "trade_date", (F.col("volume") / 1e4).alias("volume_wan"))


@query(
    "sc20_trading_clock",
    """SELECT event_id, strftime(t, '%Y-%m-%d') AS date, strftime(t, '%H:%M') AS time, CAST(isodow(t) - 1 AS BIGINT) AS weekday, isodow(t) >= 6 AS is_weekend
       FROM (SELECT event_id, ts + INTERVAL '8' HOUR AS t FROM events) x""",
)
def _(r):
    return execution.clock_view(r.given("events").select("event_id", "ts"), "ts").drop("ts")


@query("sc21_iso_texts", f"SELECT id, strftime(trade_date_as_of, '%Y-%m-%d') AS trade_date, strftime(created_at_utc, {ISO}) AS created_at FROM v_pick_runs")
def _(r):
    return r.pick_runs.select("id", scalar.iso_date("trade_date_as_of").alias("trade_date"), scalar.iso_time("created_at_utc").alias("created_at"))


@query("sc22_session_title", "SELECT id, coalesce(nullif(title, ''), '会话 ' || id) AS title FROM v_chat_sessions")
def _(r):
    return r.chat_sessions.select("id", scalar.title_or_default("title", "id").alias("title"))


@query(
    "sc23_calibration_health",
    f"""SELECT bin, CASE WHEN pct >= expected * 8e-1 THEN 'good' WHEN pct >= 50 THEN 'fair' ELSE 'bad' END AS health FROM (
        SELECT bin, expected, round(count(h.id) FILTER (WHERE direction_correct) * 1e2 / nullif(count(h.id), 0), 1) + 0e0 AS pct
        FROM (VALUES (0, 50, '0-50%', 25e0), (50, 65, '50-65%', 57.5e0), (65, 80, '65-80%', 72.5e0), (80, 101, '80-100%', 90.5e0)) b(lo, hi, bin, expected)
        LEFT JOIN {HISTORY} h ON coalesce(direction_confidence, 0) >= lo AND coalesce(direction_confidence, 0) < hi GROUP BY 1, 2) t""",
)
def _(r):
    c = forecast.calibration(forecast.verified_history(r.market_forecasts, 365))
    return c.select("bin", scalar.calibration_health("accuracy_pct", "bin_expected").alias("health"))


@query(
    "sc24_enough_samples",
    "SELECT ts_code, count(*) AS n, count(*) >= 3 AS enough FROM v_execution_plans WHERE hit_target GROUP BY 1",
)
def _(r):
    return r.execution_plans.filter("hit_target").groupBy("ts_code").agg(F.count("*").alias("n")).withColumn("enough", scalar.enough_samples("n"))


@query("sc26_instrument_label", "SELECT ts_code, name || ' (' || ts_code || ') · ' || coalesce(industry, '-') AS label FROM v_instruments")
def _(r):
    return r.instruments.select("ts_code", scalar.instrument_label("name", "ts_code", "industry").alias("label"))


@query("sc27_date_part", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def _(r):
    return r.given("events").select("event_id", F.to_date("ts").alias("day"))


@query(
    "sc28_threshold_flags",
    """SELECT f.id, coalesce(direction_confidence, 0) > 60 AS confident, coalesce(actual_pct_chg, 0) >= 0 AS rising FROM v_market_forecasts f""",
)
def _(r):
    return r.market_forecasts.select("id", scalar.above("direction_confidence", 60).alias("confident"), scalar.at_least("actual_pct_chg", 0).alias("rising"))


@query("sc28_rank_flags", "SELECT id, rank_in_run <= 3 AS podium FROM v_pick_entries")
def _(r):
    return r.pick_entries.select("id", scalar.at_most("rank_in_run", 3).alias("podium"))


# --- text ----------------------------------------------------------------------------

TRIM = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
INTENT = """
CASE WHEN contains(line, '评分') OR contains(line, '选股') OR contains(line, '推荐') OR contains(line, '打分') OR contains(line, '技术面') OR contains(line, '综合评分') THEN 'pick'
     WHEN regexp_matches(line, '^\\s*\\d{6}\\s*$') OR contains(line, '分析') THEN 'pick'
     WHEN contains(line, '新闻') OR contains(line, '资讯') OR contains(line, '快讯') OR contains(line, '最新') THEN 'info_query'
     WHEN contains(line, '筛选') OR contains(line, '题材') OR contains(line, '概念') OR contains(line, '板块') THEN 'screen'
     WHEN contains(line, '帮助') OR contains(line, 'help') THEN 'help' ELSE 'chat' END"""


@query(
    "sc05_intent",
    f"""SELECT id, {INTENT} AS intent FROM (SELECT id, substr(split_part({TRIM.format(x='content')}, chr(10), 1), 1, 100) AS line FROM v_chat_messages) t
        UNION ALL SELECT -1 - id, {INTENT} FROM (SELECT doc_id AS id, substr(split_part({TRIM.format(x='text')}, chr(10), 1), 1, 100) AS line FROM documents) t""",
)
def _(r):
    said = r.chat_messages.select("id", "content").unionByName(r.given("documents").select((-1 - F.col("doc_id")).alias("id"), F.col("text").alias("content")))
    return said.select("id", text.intent("content").alias("intent"))


@query(
    "sc06_stock_code",
    r"""SELECT id, nullif(regexp_extract(content, '([0368]\d{5})', 1), '') AS code FROM v_chat_messages UNION ALL
        SELECT -1 - doc_id, nullif(regexp_extract(text, '([0368]\d{5})', 1), '') FROM documents""",
)
def _(r):
    said = r.chat_messages.select("id", "content").unionByName(r.given("documents").select((-1 - F.col("doc_id")).alias("id"), F.col("text").alias("content")))
    return said.select("id", text.stock_code("content").alias("code"))


NAME_SQL = r"""coalesce(nullif(regexp_extract(content, '(?:分析|查看|看看|研究|查)[\s\p{Z}]*[：:\s\p{Z}]*([一-鿿\p{L}\p{N}_]{2,8})', 1), ''),
nullif(regexp_extract(content, '([一-鿿\p{L}\p{N}_]{2,8})[\s\p{Z}]*(?:分析|怎么样|如何|走势|行情)', 1), ''))"""


@query(
    "sc07_stock_name",
    f"SELECT id, CASE WHEN NOT regexp_matches(name, '^\\p{{N}}+$') THEN name END AS name FROM (SELECT id, {NAME_SQL} AS name FROM v_chat_messages) t",
)
def _(r):
    return r.chat_messages.select("id", text.stock_name("content").alias("name"))


@query(
    "sc08_resolve_code",
    """SELECT query, coalesce(i.ts_code, n.ts_code, query) AS code FROM (SELECT DISTINCT 'Co' || user_id AS query FROM events UNION SELECT ts_code FROM v_execution_plans) q
       LEFT JOIN v_instruments i ON i.ts_code = query LEFT JOIN (SELECT name, min(ts_code) AS ts_code FROM v_instruments GROUP BY 1) n ON n.name = query""",
)
def _(r):
    names = r.given("events").select(F.concat(F.lit("Co"), F.col("user_id").cast("string")).alias("query"))
    asked = names.unionByName(r.execution_plans.select(F.col("ts_code").alias("query"))).distinct()
    return market.resolve_codes(asked, r.instruments)


@query("sc09_cache_key", "SELECT id, sha256('assistant-v1:research:' || content) AS cache_key FROM v_chat_messages")
def _(r):
    return r.chat_messages.select("id", text.cache_key(F.lit(MODEL), F.lit(SYSTEM_PROMPT), "content").alias("cache_key"))


@query(
    "sc10_still_valid",
    """SELECT request_id, created_at_utc <= asked AND asked <= created_at_utc + ttl_seconds * INTERVAL '1' SECOND AS valid
       FROM (SELECT w.*, created_at_utc + (request_id % 9 * 600) * INTERVAL '1' SECOND AS asked FROM v_cache_writes w) t""",
)
def _(r):
    from tickerloom.sources.derived import seconds

    asked = F.col("created_at_utc") + seconds(F.col("request_id") % 9 * 600)
    return r.cache_writes.select("request_id", scalar.still_valid("created_at_utc", "ttl_seconds", asked).alias("valid"))


@query(
    "sc11_chart_url",
    "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/charts/' || page_id || '.png' END AS url FROM pages",
)
def _(r):
    n = F.col("page_id")
    folder = F.when(n % 2 == 0, f"{CHART_ROOT}/charts/").otherwise("/tmp/charts/")
    return r.given("pages").select("page_id", text.chart_url(F.concat(folder, n.cast("string"), F.lit(".png")), CHART_ROOT).alias("url"))


@query(
    "sc12_without_mention",
    f"SELECT doc_id, {TRIM.format(x='text')} AS body FROM documents",
)
def _(r):
    d = r.given("documents").select("doc_id", F.concat(F.lit("@bot  "), F.col("text")).alias("text"))
    return d.select("doc_id", text.without_mention("text").alias("body"))


@query(
    "sc13_clipped",
    "SELECT doc_id, substr(text, 1, 1800) AS reply, substr(text, 1, 500) AS log, substr(text, 1, 200) AS error FROM documents",
)
def _(r):
    return r.given("documents").select(
        "doc_id", text.clipped("text", text.REPLY_CHARS).alias("reply"), text.clipped("text", text.LOG_CHARS).alias("log"),
        text.clipped("text", text.ERROR_CHARS).alias("error"))


@query(
    "sc16_signal_polarity",
    """SELECT id, CASE WHEN qty >= 25 THEN '均线多头' ELSE '均线空头' END AS signal, CASE WHEN qty >= 25 THEN 'bull' ELSE 'bear' END AS side FROM v_pick_entries WHERE analysed
       UNION ALL SELECT id, CASE WHEN plain THEN 'MACD死叉' ELSE 'MACD金叉' END, CASE WHEN plain THEN 'bear' ELSE 'bull' END FROM v_pick_entries WHERE analysed""",
)
def _(r):
    rows = picks.entry_view(r.pick_entries).select("id", nested.signal_polarity("analysis.signals").alias("s"))
    return rows.select("id", F.inline("s"))


@query("sc25_date_in_file_name", "SELECT strftime(plan_date, '%Y-%m-%d') AS plan_date, count(*) > 0 AS filled FROM v_execution_plans GROUP BY 1")
def _(r):
    files = snapshots.read_snapshot_files(r.spark, r.snapshot_folder)
    return files.select("plan_date", (F.length("document") > 0).alias("filled"))


# --- nested data -----------------------------------------------------------------------


def _view(r):
    return forecast.forecast_view(r.market_forecasts, CHART_ROOT)


READABLE = "FROM v_market_forecasts WHERE readable"


@query(
    "ns01_safe_decode",
    """SELECT id, CASE WHEN readable THEN market_direction END AS direction, CASE WHEN readable THEN CAST(id * 37 % 101 AS DOUBLE) END AS confidence
       FROM v_market_forecasts""",
)
def _(r):
    d = F.col("forecast.market_direction")
    return _view(r).select("id", d["direction"].alias("direction"), d["confidence"].alias("confidence"))


CHART_ROWS = """
SELECT id, '000001' AS code, 'kline' AS kind, '/charts/d' || id || '/k.png' AS url FROM v_market_forecasts WHERE charted
UNION ALL SELECT id, '000001', 'macd', NULL FROM v_market_forecasts WHERE charted
UNION ALL SELECT id, '399001', 'default', '/charts/d' || id || '.png' FROM v_market_forecasts WHERE charted
UNION ALL SELECT id, 'sector_heatmap', 'default', '/charts/heat.png' FROM v_market_forecasts WHERE charted"""


@query("ns02_chart_map", CHART_ROWS)
def _(r):
    return forecast.chart_rows(_view(r))


@query(
    "ns03_evidence",
    f"""SELECT id, 'bull' AS side, 'flow' AS kind, 'north' AS signal, CAST(id % 7 AS VARCHAR) AS value {READABLE}
        UNION ALL SELECT id, 'bull', 'trend', 'ma', CAST(id % 5 AS VARCHAR) {READABLE}
        UNION ALL SELECT id, 'risk', '风险', 'risk ' || (id % 3), NULL {READABLE}""",
)
def _(r):
    return forecast.evidence_rows(_view(r))


@query(
    "ns04_index_forecasts",
    f"""SELECT id, '000001' AS code, '上证指数' AS name, '偏多' AS direction, CAST(id % 100 AS DOUBLE) AS confidence, CAST(id % 1000 AS DOUBLE) AS support,
        CAST(id % 1000 + 50 AS DOUBLE) AS resistance, CAST(NULL AS VARCHAR) AS macd_url {READABLE}
        UNION ALL SELECT id, '399001', '深证成指', '偏空', CAST(id % 90 AS DOUBLE), NULL, NULL, NULL {READABLE}""",
)
def _(r):
    return forecast.index_rows(_view(r))


@query(
    "ns05_scenarios",
    f"""SELECT id, 'up' AS scenario, CAST(id % 101 AS DOUBLE) AS probability, 'volume' AS trigger, id % 101 > 40 AS likely {READABLE}
        UNION ALL SELECT id, 'down', CAST(100 - id % 101 AS DOUBLE), 'break', 100 - id % 101 > 40 {READABLE}""",
)
def _(r):
    return forecast.scenario_rows(_view(r))


@query(
    "ns06_sector_calls",
    f"SELECT id, 'S' || (id % 12) AS sector, '看多' AS direction, CAST(id % 80 AS DOUBLE) AS confidence, 'a: 1；b: ' || (id % 4) AS evidence {READABLE}",
)
def _(r):
    return forecast.sector_rows(_view(r))


@query("ns07_risk_factors", f"SELECT id, CAST(1 AS BIGINT) AS number, 'r' || (id % 6) AS risk {READABLE} UNION ALL SELECT id, 2, 'r9' {READABLE}")
def _(r):
    return forecast.risk_rows(_view(r))


@query("ns07_concept_calls", f"SELECT id, 'C' || (id % 9) AS concept, '看多' AS direction, 'hot' AS reasoning {READABLE}")
def _(r):
    return forecast.concept_rows(_view(r))


@query(
    "ns08_pick_analysis",
    """SELECT id, CASE WHEN analysed THEN 'line ' || rank_in_run END AS summary, CASE WHEN analysed THEN CAST(qty AS DOUBLE) END AS ret_20d,
       CAST(NULL AS DOUBLE) AS high_60d_pct, CASE WHEN analysed THEN CAST(rank_in_run AS DOUBLE) END AS kdj_k FROM v_pick_entries""",
)
def _(r):
    a = F.col("analysis")
    return picks.entry_view(r.pick_entries).select(
        "id", a["llm_brief"]["summary"].alias("summary"), a["ret_20d"].alias("ret_20d"), a["high_60d_pct"].alias("high_60d_pct"), a["kdj"]["k"].alias("kdj_k"))


@query("ns09_chart_kinds", f"SELECT code, kind, count(*) AS n FROM ({CHART_ROWS}) t GROUP BY 1, 2")
def _(r):
    return forecast.chart_rows(_view(r)).groupBy("code", "kind").agg(F.count("*").alias("n"))
