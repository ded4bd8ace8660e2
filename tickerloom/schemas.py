"""Declared schemas; no reader in this package infers one."""

from __future__ import annotations

# The given input tables.
INPUT_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# The research tables every plan in this package works on.
RESEARCH_SCHEMAS = {
    "instruments": "ts_code string, name string, industry string, market string, listing_date date",
    "concept_members": "ts_code string, name string, market string, concept_name string",
    "daily_prices": "ts_code string, market string, trade_date date, open double, high double, low double, "
    "close double, volume double, amount double, pct_chg double, turnover_rate double",
    "news": "id bigint, title string, description string, source_name string, article_url string, "
    "published_at_utc timestamp_ntz",
    "news_links": "news_id bigint, news_source string, ts_code string, market string, confidence double, "
    "event_type string",
    "pick_runs": "id bigint, run_kind string, trade_date_as_of date, rule_version string, llm_enabled boolean, "
    "llm_model string, summary_json string, created_at_utc timestamp_ntz",
    "pick_entries": "id string, run_id bigint, ts_code string, name string, rank_in_run bigint, close_price double, "
    "rule_composite_score double, llm_composite_score double, final_composite_score double, "
    "recommendation string, verdict string, predicted_buy_price double, predicted_target_price double, "
    "predicted_stop_loss double, report_json string, markdown string, analysis_process_json string, "
    "created_at_utc timestamp_ntz",
    "pick_outcomes": "entry_id string, horizon_days int, return_pct double, hit_buy boolean, hit_target boolean, "
    "hit_stop boolean",
    "watchlist": "ts_code string, market string, note string, enabled boolean, created_at_utc timestamp_ntz",
    "market_forecasts": "id bigint, as_of_date date, market_direction string, direction_confidence double, "
    "forecast_json string, index_charts_json string, push_sent boolean, verified_at timestamp_ntz, "
    "actual_direction string, actual_pct_chg double, direction_correct boolean, created_at_utc timestamp_ntz",
    "forecast_evals": "forecast_id bigint, horizon_days int, index_results_json string",
    "chat_sessions": "id bigint, title string, is_active boolean, created_at_utc timestamp_ntz, "
    "updated_at_utc timestamp_ntz",
    "chat_messages": "id bigint, session_id bigint, role string, content string, intent string, "
    "prompt_tokens bigint, output_tokens bigint, cost_usd double, elapsed_ms bigint, "
    "created_at_utc timestamp_ntz",
    "response_cache": "cache_key string, response_json string, prompt_tokens bigint, output_tokens bigint, "
    "ttl_seconds bigint, created_at_utc timestamp_ntz",
    "company_profile": "ts_code string, market string, key_no string, full_name string, registered_capital string, "
    "business_scope string, status string, stock_number string, synced_on date",
    "company_shareholder": "ts_code string, market string, shareholder_name string, stock_percent double, "
    "synced_on date",
    "company_risk_event": "ts_code string, market string, risk_type string, case_no string, title string, "
    "involved_amount double, event_date date",
    "iteration_ledger": "run_id bigint, as_of string, fail_rate double, mean_fwd_return double, mean_delta double",
}

# JSON documents kept in text columns.
PLAN_JSON = (
    "struct<ts_code:string,name:string,rank:bigint,close_yesterday:double,predicted_buy:double,"
    "predicted_target:double,predicted_stop:double,adjusted_buy:double,overnight_adjustment:double,"
    "auction_price:double,open_price:double,open_action:string,current_price:double,recommendation:string,"
    "hit_target:boolean,hit_stop:boolean,intraday_notes:array<string>,pre_market_notes:array<string>>"
)
FORECAST_JSON = (
    "struct<market_direction:struct<direction:string,confidence:double,reasoning:string,"
    "evidence:array<struct<type:string,signal:string,value:string>>,counter_evidence:array<string>>,"
    "index_forecasts:array<struct<code:string,name:string,direction:string,confidence:double,"
    "similar_patterns_verdict:string,key_levels:struct<support:double,resistance:double>>>,"
    "next_day_scenarios:array<struct<scenario:string,probability:double,trigger:string>>,"
    "sector_calls:array<struct<sector:string,direction:string,confidence:double,reasoning:string,"
    "evidence:array<struct<signal:string,value:string>>>>,"
    "concept_calls:array<struct<concept:string,direction:string,reasoning:string>>,risk_factors:array<string>>"
)
ANALYSIS_JSON = (
    "struct<signals:array<string>,llm_brief:struct<recommendation:string,risks:string,opportunities:string,"
    "summary:string>,ret_20d:double,high_60d_pct:double,kdj:struct<k:double>>"
)
INDEX_RESULTS_JSON = "array<struct<code:string,correct:boolean>>"
