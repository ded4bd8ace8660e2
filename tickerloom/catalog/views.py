"""The derived research tables again, as independent SQL for the DuckDB check."""

from __future__ import annotations

import re


def code(n: str) -> str:
    return f"lpad(CAST({n} AS VARCHAR), greatest(length(CAST({n} AS VARCHAR)), 6)::INT, '0')"


def market(n: str) -> str:
    return f"CASE WHEN {n} % 10 = 9 THEN 'hk' ELSE 'a' END"


ENTRY_ID = (
    "concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), "
    "CAST(l_suppkey AS VARCHAR), strftime(l_shipdate, '%Y%m%d'))"
)

VIEWS = {
    "v_instruments": f"""
SELECT {code('s_suppkey')} AS ts_code, 'Co' || s_suppkey AS name, n_name AS industry, {market('s_suppkey')} AS market,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE DATE '1990-01-01' + CAST(s_suppkey % 1000 AS INT) END AS listing_date
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "v_concept_members": """
SELECT i.ts_code, i.name, i.market, CASE WHEN p_brand = 'Brand#25' THEN NULL ELSE p_brand END AS concept_name
FROM (SELECT * FROM (SELECT *, m * count(*) OVER own > sum(m) OVER own AS above
      FROM (SELECT l_suppkey, p_brand, sum(l_quantity) AS m FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) g
      WINDOW own AS (PARTITION BY l_suppkey)) h WHERE above) b
JOIN v_instruments i ON i.name = 'Co' || l_suppkey""",
    "v_daily_prices": f"""
SELECT b.ts_code, i.market, trade_date, open, high, low, close, volume, amount,
       (close / lag(close) OVER (PARTITION BY b.ts_code ORDER BY trade_date) - 1e0) * 1e2 AS pct_chg,
       volume / 1e4 * 1e2 AS turnover_rate
FROM (SELECT ts_code, trade_date, max(CASE WHEN rn_open = 1 THEN px END) AS open, max(px) AS high, min(px) AS low,
             max(CASE WHEN rn_close = 1 THEN px END) AS close, sum(qty) AS volume, sum(amt) AS amount
      FROM (SELECT {code('l_suppkey')} AS ts_code, CAST(l_shipdate AS DATE) AS trade_date,
                   l_extendedprice / l_quantity AS px, l_quantity AS qty, l_extendedprice AS amt,
                   row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)
                                      ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn_open,
                   row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)
                                      ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS rn_close
            FROM lineitem) t GROUP BY ts_code, trade_date) b JOIN v_instruments i ON i.ts_code = b.ts_code""",
    "v_pick_runs": """
SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'scan' WHEN 'O' THEN 'llm_top300' ELSE 'report' END AS run_kind,
       CAST(o_orderdate AS DATE) AS trade_date_as_of, concat('v', o_orderpriority) AS rule_version,
       o_orderstatus = 'O' AS llm_enabled, CASE WHEN o_orderstatus = 'O' THEN 'model-a' END AS llm_model,
       CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS summary_customer,
       o_orderdate + (o_orderkey % 86400) * INTERVAL '1' SECOND AS created_at_utc
FROM orders""",
    "v_pick_entries": f"""
SELECT {ENTRY_ID} AS id, l_orderkey AS run_id, i.ts_code, i.name, CAST(l_linenumber AS BIGINT) AS rank_in_run,
       l_extendedprice / l_quantity AS close_price, l_quantity * 2e0 AS rule_composite_score,
       CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity * 2e0 + (l_discount - 5e-2) * 2e2 END AS llm_composite_score,
       CASE WHEN l_returnflag = 'R' THEN l_quantity * 2e0 ELSE l_quantity * 2e0 + (l_discount - 5e-2) * 2e2 END AS final_composite_score,
       CASE WHEN l_quantity >= 45 THEN '强烈关注' WHEN l_quantity >= 30 THEN '关注'
            WHEN l_quantity >= 15 THEN '观望' ELSE '回避' END AS recommendation,
       CASE WHEN l_linestatus = 'O' THEN 'keep' ELSE 'drop' END AS verdict,
       l_extendedprice / l_quantity * (1e0 - l_discount) AS predicted_buy_price,
       l_extendedprice / l_quantity * (1e0 + l_tax + 5e-2) AS predicted_target_price,
       l_extendedprice / l_quantity * 9.2e-1 AS predicted_stop_loss,
       '# ' || i.name AS markdown, CAST(l_quantity AS BIGINT) AS qty, l_orderkey % 6 <> 0 AS analysed, l_returnflag = 'R' AS plain,
       CASE WHEN l_orderkey % 50 <> 0 THEN l_shipdate + (l_orderkey % 86400) * INTERVAL '1' SECOND END AS created_at_utc
FROM lineitem JOIN v_instruments i ON i.name = 'Co' || l_suppkey""",
    "v_pick_outcomes": f"""
SELECT {ENTRY_ID} AS entry_id, CAST(h AS INT) AS horizon_days, round((l_discount - l_tax) * 1e2 * h, 4) + 0e0 AS return_pct,
       l_discount <= 5e-2 AS hit_buy, (l_discount - l_tax) * h > 1e-1 AS hit_target, l_tax * h > 2e-1 AS hit_stop
FROM lineitem JOIN (VALUES (1), (3), (5)) x(h) ON h <= l_linenumber + 1""",
    "v_market_forecasts": """
SELECT u.id, as_of_date, kind AS market_direction,
       CASE WHEN id % 13 = 0 THEN NULL ELSE CAST(id * 37 % 101 AS DOUBLE) END AS direction_confidence,
       id % 23 <> 0 AS readable, id % 29 <> 0 AS charted, id % 2 = 0 AS push_sent,
       CASE WHEN id % 10 <> 0 THEN CAST(as_of_date AS TIMESTAMP) + INTERVAL '42' HOUR END AS verified_at,
       actual AS actual_direction, pct AS actual_pct_chg,
       CASE WHEN id % 31 <> 0 THEN kind = actual END AS direction_correct,
       CAST(as_of_date AS TIMESTAMP) + INTERVAL '17' HOUR AS created_at_utc
FROM (SELECT t.*, CASE status WHEN 'F' THEN 'bullish' WHEN 'O' THEN 'bearish' ELSE 'range-bound' END AS kind,
             CASE WHEN pct > 5e-1 THEN 'bullish' WHEN pct < -5e-1 THEN 'bearish' ELSE 'range-bound' END AS actual
      FROM (SELECT CAST(o_orderdate AS DATE) AS as_of_date, o_orderkey AS id, o_orderstatus AS status,
                   ((o_orderkey * 7919) % 601 - 300) / 1e2 AS pct,
                   row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS rn
            FROM orders) t WHERE rn = 1) u""",
    "v_forecast_evals": """
SELECT id AS forecast_id, CASE WHEN id % 4 = 0 THEN 3 ELSE 1 END AS horizon_days,
       CASE WHEN id % 17 = 0 THEN '{bad' WHEN id % 19 = 0 THEN NULL
            ELSE concat('[{"code":"000001","correct":', CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END,
                        '},{"code":"399001","correct":', CASE WHEN id % 3 = 0 THEN 'true' ELSE 'false' END,
                        '},{"correct":true}]') END AS index_results_json
FROM v_market_forecasts""",
    "v_chat_messages": f"""
SELECT conv_id * 100 + turn AS id, conv_id AS session_id, role,
       CASE WHEN role = 'user' AND turn % 3 = 0 AND conv_id % 3 = 0 THEN concat('分析 ', {code('conv_id')}, ' ', text)
            WHEN role = 'user' AND turn % 3 = 0 AND conv_id % 3 = 1 THEN concat('看看 Co', conv_id, ' ', text)
            ELSE text END AS content,
       CASE WHEN role = 'assistant' THEN 'chat' END AS intent, CAST(length(text) AS BIGINT) AS prompt_tokens,
       CAST(CASE WHEN role = 'assistant' THEN length(text) * 2 END AS BIGINT) AS output_tokens,
       length(text) / 1e6 * 2.7e-1
         + CASE WHEN role = 'assistant' THEN length(text) * 2 ELSE 0 END / 1e6 * 1.1e0 AS cost_usd,
       CAST(CASE WHEN role = 'assistant' THEN length(text) * 3 END AS BIGINT) AS elapsed_ms,
       TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 1800 + turn * 60) * INTERVAL '1' SECOND AS created_at_utc
FROM conversations""",
    "v_chat_sessions": """
SELECT session_id AS id, CASE session_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'talk ' || session_id END AS title,
       session_id % 2 = 0 AS is_active, min(created_at_utc) AS created_at_utc, max(created_at_utc) AS updated_at_utc
FROM v_chat_messages GROUP BY session_id""",
    "v_news": """
SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS description, source AS source_name,
       'https://example.com/n/' || doc_id AS article_url,
       TIMESTAMP '2024-01-01 00:00:00' + (doc_id * 977 % 2592000) * INTERVAL '1' SECOND AS published_at_utc
FROM documents""",
    "v_alerts": """
SELECT page_id AS id, url AS title, url AS description, 'alerts' AS source_name, url AS article_url,
       TIMESTAMP '2024-01-15 00:00:00' + (page_id * 613 % 1296000) * INTERVAL '1' SECOND AS published_at_utc
FROM pages""",
    "v_news_links": """
SELECT DISTINCT d.doc_id AS news_id, CASE WHEN d.doc_id % 11 = 0 THEN 'financial_alerts' ELSE 'global_news' END AS news_source,
       i.ts_code, i.market, (d.doc_id * 31 % 100) / 1e2 AS confidence,
       CASE WHEN b.toxic = 1 THEN 'risk' WHEN b.quality = 1 THEN 'report' ELSE 'other' END AS event_type
FROM lineitem JOIN documents d ON l_orderkey = d.doc_id JOIN v_instruments i ON i.name = 'Co' || l_suppkey
LEFT JOIN labels b ON b.doc_id = d.doc_id""",
    "v_execution_plans": f"""
SELECT CAST(ts AS DATE) AS plan_date, {code('user_id')} AS ts_code, 'Co' || user_id AS name, event_id % 40 + 1 AS rank,
       CASE WHEN event_id % 7 = 0 THEN '' ELSE CASE event_type WHEN 'purchase' THEN 'BUY_AT_OPEN' WHEN 'click' THEN 'BUY_ON_PULLBACK'
            WHEN 'view' THEN 'WAIT_OBSERVE' WHEN 'signup' THEN 'SKIP_TODAY' ELSE 'EXIT_SIGNAL' END END AS open_action,
       value AS predicted_buy, CASE event_id % 5 WHEN 0 THEN value * 9.8e-1 WHEN 1 THEN 0e0 END AS adjusted_buy,
       CASE WHEN event_id % 4 = 0 THEN (event_id % 9 - 4) / 1e2 END AS overnight_adjustment,
       CASE WHEN event_id % 3 <> 0 THEN value END AS auction_price, CASE WHEN event_id % 8 = 0 THEN value * 1.01e0 END AS current_price,
       value * 1.1e0 AS predicted_target, value * 9e-1 AS predicted_stop,
       value >= 69 AS hit_target, value <= 14 AS hit_stop, event_id
FROM (SELECT *, row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) t
WHERE rn = 1""",
    "v_read_plans": "SELECT * FROM v_execution_plans WHERE dayofmonth(plan_date) <> 13",
    "v_watchlist": f"""
SELECT {code('user_id')} AS ts_code, {market('user_id')} AS market, CASE WHEN user_id % 4 = 0 THEN 'old note' END AS note,
       user_id % 3 <> 0 AS enabled, min(ts) AS created_at_utc
FROM events WHERE event_type = 'view' GROUP BY user_id""",
    "v_watchlist_changes": f"""
SELECT {code('user_id')} AS ts_code, {market('user_id')} AS market,
       CASE WHEN event_id % 2 = 0 THEN 'note ' || event_id ELSE '' END AS note, ts AS created_at_utc
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM events WHERE event_type = 'click') t WHERE rn = 1""",
    "v_watchlist_removals": f"""
SELECT {code('user_id')} AS ts_code, {market('user_id')} AS market
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) t WHERE rn = 1 AND event_type = 'error'""",
    "v_model_requests": """
SELECT id AS request_id, sha256('assistant-v1:research:' || CASE WHEN id % 2 = 0 THEN 'ask ' || (id % 20) ELSE content END) AS cache_key, created_at_utc AS asked_at
FROM v_chat_messages WHERE role = 'user'""",
    "v_cache_writes": """
SELECT cache_key, '{"text":"' || request_id || '"}' AS response_json, (request_id % 13 + 1) * 600 AS ttl_seconds,
       asked_at - (request_id % 7 * 1000) * INTERVAL '1' SECOND AS created_at_utc, request_id
FROM v_model_requests""",
    "v_company_profile_feed": f"""
SELECT {code('s_suppkey')} AS ts_code, {market('s_suppkey')} AS market, CASE WHEN s_suppkey % 5 <> 0 THEN 'K' || s_suppkey END AS key_no,
       'Co' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '股份有限公司' WHEN 1 THEN '有限公司' ELSE '集团股份有限公司' END AS full_name,
       CAST(floor(abs(s_acctbal)) AS BIGINT) || CASE s_suppkey % 3 WHEN 0 THEN '亿元' WHEN 1 THEN '万元' ELSE '元' END AS registered_capital,
       CASE WHEN v = 2 THEN '变更' ELSE '存续' END AS status,
       CASE WHEN s_suppkey % 11 = 0 THEN '000000' ELSE {code('s_suppkey')} END AS stock_number,
       DATE '2024-01-01' + CAST(v * 30 AS INT) AS synced_on, floor(abs(s_acctbal)) AS capital_number, s_suppkey
FROM supplier JOIN (VALUES (1), (2)) x(v) ON v = 1 OR s_suppkey % 4 = 0""",
    "v_company_shareholders": f"""
SELECT {code('l_suppkey')} AS ts_code, {market('l_suppkey')} AS market, shareholder_name,
       round(held * 1e2 / sum(held) OVER (PARTITION BY l_suppkey, synced_on), 4) + 0e0 AS stock_percent, synced_on
FROM (SELECT l_suppkey, CAST(date_trunc('year', l_shipdate) AS DATE) AS synced_on,
             CASE c_mktsegment WHEN 'BUILDING' THEN '国资控股' WHEN 'MACHINERY' THEN '社保基金' WHEN 'AUTOMOBILE' THEN '张三'
                  ELSE c_mktsegment END AS shareholder_name, sum(l_quantity) AS held
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL) t""",
    "v_company_risk_events": f"""
SELECT event_id AS id, {code('user_id')} AS ts_code, {market('user_id')} AS market,
       CASE event_type WHEN 'error' THEN 'dishonest' WHEN 'purchase' THEN 'execution' WHEN 'click' THEN 'abnormal'
            WHEN 'view' THEN 'court' ELSE 'serious' END AS risk_type,
       'case ' || event_id AS title, value AS involved_amount, CAST(ts AS DATE) - CAST(user_id * 37 % 2000 AS INT) AS event_date, ts AS seen_at_utc
FROM events""",
    "v_patents": f"""
SELECT {code('l_suppkey')} AS ts_code, {market('l_suppkey')} AS market, l_partkey AS patent_id FROM lineitem WHERE l_returnflag = 'R'""",
    "v_business_scopes": f"""
SELECT {code('l_suppkey')} AS ts_code, {market('l_suppkey')} AS market,
       string_agg(p_brand, '、' ORDER BY p_brand) AS business_scope
FROM (SELECT * FROM (SELECT *, m * count(*) OVER own > sum(m) OVER own AS above
      FROM (SELECT l_suppkey, p_brand, count(*) AS m FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) g
      WINDOW own AS (PARTITION BY l_suppkey)) h WHERE above) t
GROUP BY l_suppkey""",
}

_NAME = re.compile(r"\bv_\w+")


def with_views(body: str) -> str:
    """``body`` preceded by the views it names, directly or through other views."""
    wanted: set[str] = set()
    pending = [body]
    while pending:
        for name in set(_NAME.findall(pending.pop())) & VIEWS.keys() - wanted:
            wanted.add(name)
            pending.append(VIEWS[name])
    body = body.strip()
    parts = [f"{name} AS ({text})" for name, text in VIEWS.items() if name in wanted]
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = re.sub(r"^WITH(\s+RECURSIVE)?\s+", "", body, flags=re.I)
        parts.append(body)
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts)
    return (f"WITH {', '.join(parts)}\n" if parts else "") + body
