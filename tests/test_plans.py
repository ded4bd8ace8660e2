"""Plans on small literal tables: empty inputs, ties, defects of naive versions, invariants."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tickerloom.functions.nested import decoded
from tickerloom.plans import analytics, assistant, backtest, company, dashboard, execution, forecast, market, picks, watchlist
from tickerloom.schemas import INDEX_RESULTS_JSON, RESEARCH_SCHEMAS
from tickerloom.sources import tables

DAY = dt.date(2024, 1, 1)


def table(spark, name, rows):
    """Rows given as dicts, missing columns null."""
    schema = spark.createDataFrame([], RESEARCH_SCHEMAS[name]).schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)


def values(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


# --- picks ---------------------------------------------------------------------


def ranking_tables(spark, counts):
    """Runs numbered by age, oldest first, with the given numbers of entries."""
    runs = table(spark, "pick_runs", [{"id": i, "run_kind": "scan", "created_at_utc": at(i), "trade_date_as_of": DAY} for i in range(len(counts))])
    entries = [{"id": f"{i}-{k}", "run_id": i, "rank_in_run": k} for i, n in enumerate(counts) for k in range(1, n + 1)]
    return runs, table(spark, "pick_entries", entries)


@pytest.mark.parametrize(
    "counts, top_n, want",
    [([5, 9, 3], 4, 1), ([9, 5, 5, 3], 4, 2), ([2, 3, 3, 1], 4, 2), ([0, 0], 4, None), ([9] + [1] * 20, 4, 20), ([], 4, None)],
)
def test_adequate_run(spark, counts, top_n, want):
    """Newest run with enough entries, else the fullest, among the newest 20; empty runs never."""
    got = values(picks.adequate_run(*ranking_tables(spark, counts), "scan", top_n), "id")
    assert got == ([] if want is None else [(want,)])


def test_latest_ranking_is_cut_by_rank(spark):
    runs, entries = ranking_tables(spark, [7])
    assert [r[0] for r in values(picks.latest_ranking(runs, entries, "scan", 3), "rank")] == [1, 2, 3]


def test_all_entries_are_placed_by_score(spark):
    """Entries of every run, more than one page of them; null counts as 0 and equal scores go by id."""
    scores = [None if i % 9 == 0 else float(i * 37 % 23 - 5) for i in range(80)]
    entries = spark.createDataFrame([(f"e{i:02d}", i % 4, s) for i, s in enumerate(scores)], "id string, run_id bigint, final_composite_score double").repartition(5)
    want = sorted((s or 0.0, f"e{i:02d}") for i, s in enumerate(scores))
    assert values(picks.by_score(entries), "position", "id") == [(n, i) for n, (_, i) in enumerate(want, 1)]


def test_runs_page_total_ignores_the_page(spark):
    runs, _ = ranking_tables(spark, [1] * 7)
    assert values(picks.runs_page(runs, "scan", 2, 2), "id", "total") == [(4, 7), (3, 7)]
    assert values(picks.runs_page(runs, None, 2, 9), "id") == []


def test_entry_counts_and_empty_outcomes(spark):
    runs, entries = ranking_tables(spark, [2, 0])
    assert sorted(values(picks.entry_counts(runs, entries), "id", "entry_count")) == [(0, 2), (1, 0)]
    outcomes = table(spark, "pick_outcomes", [{"entry_id": "0-1", "horizon_days": h, "return_pct": float(h)} for h in (5, 1)])
    got = {r["id"]: [o["horizon_days"] for o in r["backtest_outcomes"]] for r in picks.entry_outcomes(entries, outcomes).collect()}
    assert got == {"0-1": [1, 5], "0-2": []}


def test_entry_view_drops_nan_and_keeps_the_analysis(spark):
    rows = [{"id": "a", "close_price": float("nan"), "final_composite_score": float("inf"), "analysis_process_json": '{"ret_20d": 2}', "report_json": ""}]
    r = picks.entry_view(table(spark, "pick_entries", rows)).first()
    assert (r["close_price"], r["final_composite_score"], r["analysis"]["ret_20d"], r["report"]) == (None, None, 2.0, None)


def test_filter_ranking_is_literal_and_null_safe(spark):
    rows = table(spark, "pick_entries", [{"ts_code": "920001", "name": "A_b"}, {"ts_code": "000920", "name": None}, {"ts_code": "1", "name": "AxB"}])
    assert len(values(picks.filter_ranking(rows, "920"))) == 2
    assert len(values(picks.filter_ranking(rows, "a_B"))) == 1
    assert len(values(picks.filter_ranking(rows, "  "))) == 3


# --- forecast ----------------------------------------------------------------------


def forecasts(spark):
    rows = []
    for i in range(40):
        rows.append({
            "id": i, "as_of_date": DAY + dt.timedelta(days=i), "market_direction": [None, "bullish", "range-bound", ""][i % 4],
            "direction_confidence": [None, 0.0, 49.9, 50.0, 80.0, 100.0, 101.0, -1.0][i % 8], "verified_at": at(i) if i % 5 else None,
            "direction_correct": [True, False, None][i % 3],
        })
    return table(spark, "market_forecasts", rows)


def test_track_record_invariants(spark):
    history = forecast.verified_history(forecasts(spark), 30)
    total, correct, pct = values(forecast.hit_rate(history))[0]
    by_direction = values(forecast.hit_rate_by_direction(history))
    assert {d for d, *_ in by_direction} == {"unknown", "bullish", "range-bound"}
    assert (sum(r[1] for r in by_direction), sum(r[2] for r in by_direction)) == (total, correct) and pct == round(correct * 100 / total, 1)
    bins = values(forecast.calibration(history))
    assert [b[4] for b in sorted(bins)] == [25.0, 57.5, 72.5, 90.5] and len(bins) == 4
    inside = sum(1 for r in history.collect() if 0 <= (r["direction_confidence"] or 0) < 101)
    assert sum(b[1] for b in bins) == inside < total
    assert dict((b[0], (b[1], b[3])) for b in bins)["65-80%"] == (0, None)


def test_no_history_gives_null_accuracy(spark):
    none = forecast.verified_history(forecasts(spark).filter("verified_at IS NULL"))
    assert values(forecast.hit_rate(none)) == [(0, 0, None)]


def test_index_hit_rate_skips_only_what_is_broken(spark):
    docs = ['[{"code":"a","correct":true},{"correct":true},{"code":"b"}]', "{bad", None, "", '[{"code":"a","correct":false}]']
    evals = table(spark, "forecast_evals", [{"forecast_id": i, "horizon_days": 1, "index_results_json": d} for i, d in enumerate(docs)])
    assert sorted(values(forecast.index_hit_rate(evals))) == [("a", 2, 1, 50.0), ("b", 1, 0, 0.0)]
    assert evals.select(decoded("index_results_json", INDEX_RESULTS_JSON)).count() == 5


def test_newest_forecast_and_missing_charts(spark):
    f = table(spark, "market_forecasts", [
        {"id": 1, "as_of_date": DAY, "index_charts_json": '{"000001": {"kline": "/r/charts/a.png"}}'},
        {"id": 2, "as_of_date": DAY + dt.timedelta(days=1), "index_charts_json": ""},
    ])
    assert values(forecast.newest_forecast(f), "id") == [(2,)]
    assert sorted(values(forecast.charts_of(f, "/r", F.lit("000001")), "id", F.col("charts")["kline"])) == [(1, "/charts/a.png"), (2, None)]


# --- execution ---------------------------------------------------------------------


def plans(spark, rows):
    kind = ("plan_date string, ts_code string, open_action string, adjusted_buy double, overnight_adjustment double, auction_price double, "
            "current_price double, hit_target boolean, hit_stop boolean")
    return spark.createDataFrame(rows, kind)


def test_summary_and_stages(spark):
    df = plans(spark, [
        ("d1", "a", "BUY_AT_OPEN", None, None, None, None, True, None), ("d1", "b", "EXIT_SIGNAL", None, None, 1.0, None, False, True),
        ("d2", "c", "", None, 0.0, None, None, None, None), ("d2", "d", None, None, None, None, None, None, None),
    ])
    assert sorted(values(execution.summary(df))) == [("d1", 2, 1, 0, 0, 0, 1, 1), ("d2", 2, 0, 0, 0, 0, 0, 0)]
    assert sorted(values(execution.stages(df))) == [("d1", False, True, True, False), ("d2", True, False, False, False)]
    labels = dict(values(execution.label_actions(df), "ts_code", "action_label"))
    assert labels == {"a": "买入", "b": "止损", "c": "待定", "d": "待定"}


# --- chat ----------------------------------------------------------------------------


def messages(spark, texts, session=1):
    return table(spark, "chat_messages", [{"id": i, "session_id": session, "role": "user", "content": t, "created_at_utc": at(i)} for i, t in enumerate(texts)])


def test_code_is_carried_over_a_long_session(spark):
    """More than 40 messages after the mention: the whole session counts, newest mention wins."""
    texts = ["看 600519", "换 000001"] + ["后续"] * 60
    m = messages(spark, texts).unionByName(messages(spark, ["空"], session=2).withColumn("id", F.lit(999).cast("bigint")))
    got = {r["id"]: r["carried_code"] for r in assistant.carried_codes(m).collect()}
    assert got[0] == "600519" and got[61] == "000001" and got[999] is None


def test_code_resolution_order(spark):
    inst = table(spark, "instruments", [{"ts_code": "000002", "name": "茅台", "market": "a"}, {"ts_code": "000003", "name": "港股", "market": "hk"}])
    m = messages(spark, ["分析 茅台", "600519 茅台", "分析 茅台", "分析 港股", "分析 不存在"])
    got = {r["id"]: (r["ts_code"], r["code_source"]) for r in assistant.resolved_messages(m, inst).collect()}
    assert got == {0: ("000002", "name"), 1: ("600519", "own"), 2: ("000002", "name"), 3: ("600519", "carried"), 4: ("600519", "carried")}


def test_reply_history_keeps_the_latest(spark):
    m = messages(spark, [f"m{i}" if i % 10 else "" for i in range(50)])
    got = sorted(r["id"] for r in assistant.history_for_reply(m).collect())
    assert got == [i for i in range(29, 49) if i % 10]


def test_sessions_touch_create_delete(spark):
    sessions = table(spark, "chat_sessions", [{"id": i, "title": f"t{i}", "updated_at_utc": at(i)} for i in (1, 2)])
    asked = spark.createDataFrame([(1, 10), (7, 11), (None, 12)], "id bigint, new_id bigint")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    got = {r["id"]: (r["title"], r["updated_at_utc"].month) for r in assistant.touch_sessions(sessions, asked, now).collect()}
    assert got == {1: ("t1", 2), 2: ("t2", 1), 11: ("新对话", 2), 12: ("新对话", 2)}
    s, m = assistant.delete_sessions(sessions, messages(spark, ["a"]), spark.createDataFrame([(1,)], "id bigint"))
    assert (values(s, "id"), values(m, "id")) == ([(2,)], [])


def test_cache_keeps_its_first_ttl_and_takes_the_newest_response(spark):
    kind = "cache_key string, response_json string, ttl_seconds bigint, created_at_utc timestamp_ntz"
    cache = spark.createDataFrame([("k", "old", 60, at(0))], kind)
    writes = spark.createDataFrame([("k", "mid", 999, at(1), 1), ("k", "new", 999, at(2), 2), ("z", "first", 5, at(0), 3)], kind + ", request_id bigint")
    stored = assistant.write_cache(cache, writes)
    assert sorted(values(stored, "cache_key", "response_json", "ttl_seconds")) == [("k", "new", 60), ("z", "first", 5)]


def test_repeated_writes_of_a_new_key_keep_the_first_ttl(spark):
    kind = "cache_key string, response_json string, ttl_seconds bigint, created_at_utc timestamp_ntz"
    writes = spark.createDataFrame([("k", "b", 9999, at(2), 2), ("k", "a", 100, at(1), 1)], kind + ", request_id bigint")
    stored = assistant.write_cache(spark.createDataFrame([], kind), writes)
    assert values(stored, "response_json", "ttl_seconds") == [("b", 100)]


def test_response_reuse_looks_at_the_time_of_asking(spark):
    """A key written again later still serves the requests in between, and a key asked for very often is no problem."""
    kind = "cache_key string, response_json string, ttl_seconds bigint, created_at_utc timestamp_ntz, request_id bigint"
    writes = spark.createDataFrame([("k", "old", 120, at(0), 1), ("k", "new", 9999, at(10), 2), ("z", "first", 5, at(0), 3)], kind)
    asked = [(1, "k", at(1)), (2, "k", at(3)), (3, "z", at(0)), (4, "q", at(0)), (5, "k", at(11)), (6, "k", at(13))] + [(100 + n, "k", at(2)) for n in range(500)]
    rows = spark.createDataFrame(asked, "request_id bigint, cache_key string, asked_at timestamp_ntz")
    got = dict(values(assistant.reusable_responses(rows, writes), "request_id", "response_json"))
    assert got == {1: "old", 3: "first", 5: "new"} | {100 + n: "old" for n in range(500)}


# --- market, watchlist, dashboard -----------------------------------------------------


def prices(spark, closes, code="000001", market_name="a", start=DAY):
    return table(spark, "daily_prices", [
        {"ts_code": code, "market": market_name, "trade_date": start + dt.timedelta(days=i), "open": c, "high": c, "low": c, "close": c, "volume": 1.0, "amount": c}
        for i, c in enumerate(closes)
    ])


def test_price_context_skips_null_and_zero_closes(spark):
    closes = [float(i) for i in range(1, 24)] + [0.0, None]
    r = market.price_context(prices(spark, closes)).first()
    assert r["latest"]["close"] is None and r["closes5"] == [19.0, 20.0, 21.0, 22.0, 23.0]
    assert r["ma5"] == 21.0 and r["ma20"] == 13.5


def test_short_history_still_has_a_context(spark):
    r = market.price_context(prices(spark, [1.0, 2.0, 3.0])).first()
    assert (r["ma5"], r["ma20"], r["closes5"], r["latest"]["close"]) == (None, None, [1.0, 2.0, 3.0], 3.0)


def test_bars_map_volume_null_to_zero_and_nan_to_null(spark):
    df = prices(spark, [1.0, float("nan"), None])
    got = sorted(values(market.last_bars(df, 2), "trade_date", "close", "volume", "pct_chg"))
    assert got == [("2024-01-02", None, 1.0, 0.0), ("2024-01-03", 0.0, 1.0, 0.0)]
    assert values(market.last_bars(df, 2, code="none")) == []


def test_popular_concepts_blank_goes_after_the_limit(spark):
    m = table(spark, "concept_members", [{"ts_code": str(i), "concept_name": c} for i, c in enumerate([None, None, None, "b", "b", "a", "a", "c"])])
    assert values(market.popular_concepts(m, 2)) == [("a", 2)]


def test_resolve_codes(spark):
    inst = table(spark, "instruments", [{"ts_code": "000002", "name": "X"}, {"ts_code": "000001", "name": "X"}])
    asked = spark.createDataFrame([("000002",), ("X",), ("?",)], "query string")
    assert sorted(values(market.resolve_codes(asked, inst))) == [("000002", "000002"), ("?", "?"), ("X", "000001")]


def test_instrument_search_and_empty_query(spark):
    inst = table(spark, "instruments", [
        {"ts_code": "600519", "name": "贵州茅台", "market": "a"}, {"ts_code": "920001", "name": "北交", "market": "a"}, {"ts_code": "600520", "name": "港", "market": "hk"},
    ])
    assert values(market.search(inst, "600519"), "name") == [("贵州茅台",)]
    assert values(market.search(inst, "茅台"), "ts_code") == [("600519",)]
    assert [r[0] for r in values(market.search(inst), "ts_code")] == ["600519", "920001"]


def test_watchlist_round_trip(spark):
    w = table(spark, "watchlist", [{"ts_code": "1", "market": "a", "note": "n", "enabled": False}])
    asked = spark.createDataFrame([("1", "a", "", at(1)), ("2", "a", "x", at(1))], "ts_code string, market string, note string, created_at_utc timestamp_ntz")
    got = watchlist.add(w, asked)
    assert sorted(values(got, "ts_code", "note", "enabled")) == [("1", "n", False), ("2", "x", True)]
    inst = table(spark, "instruments", [{"ts_code": "2", "market": "a", "name": "Two", "industry": "i"}])
    assert sorted(values(watchlist.view(got, inst), "name", "industry")) == [("1", None), ("Two", "i")]
    assert values(watchlist.only_listed(inst, w.limit(0))) == []


def test_cost_of_nothing_is_zero(spark):
    none = messages(spark, [])
    assert values(dashboard.total_cost(none)) == [(0.0,)]
    assert values(dashboard.daily_cost(none, F.lit("2024-01-01").cast("timestamp_ntz"))) == []


# --- analytics, backtest, company --------------------------------------------------------


def test_coverage_gaps_equal_brute_force(spark):
    full = prices(spark, [1.0] * 6, "000001")
    part = prices(spark, [1.0] * 3, "000002")
    inst = table(spark, "instruments", [{"ts_code": c, "market": "a"} for c in ("000001", "000002", "000003")])
    bars = full.unionByName(part)
    got = {(r["ts_code"], r["trade_date"].day) for r in analytics.coverage_gaps(inst, bars).collect()}
    assert got == {("000002", d) for d in (4, 5, 6)} | {("000003", d) for d in range(1, 7)}
    got = {(r["ts_code"], r["trade_date"].day) for r in analytics.coverage_gaps(inst, bars, dt.date(2024, 1, 3)).collect()}
    assert got == {("000002", d) for d in (4, 5, 6)} | {("000003", d) for d in (3, 4, 5, 6)}
    assert values(analytics.latest_complete_date(bars, 2)) == [(dt.date(2024, 1, 3),)]


def test_ranking_modes_disagree_only_where_scores_do(spark):
    e = table(spark, "pick_entries", [
        {"id": "a", "run_id": 1, "rule_composite_score": 90.0, "llm_composite_score": 10.0}, {"id": "b", "run_id": 1, "rule_composite_score": 50.0, "llm_composite_score": 60.0},
        {"id": "c", "run_id": 1, "rule_composite_score": 55.0},
    ])
    order = lambda mode: [r["id"] for r in analytics.ranked_runs(e, mode).orderBy("position").collect()]
    assert (order("rule"), order("llm_primary"), order("adjusted")) == (["a", "c", "b"], ["b", "c", "a"], ["c", "b", "a"])


def test_outcomes_equal_brute_force(spark):
    closes = [10.0, 11.0, 9.0, 12.0, 8.0, 10.0, 11.0]
    bars = prices(spark, closes, start=dt.date(2024, 1, 2))
    runs = table(spark, "pick_runs", [{"id": i, "trade_date_as_of": dt.date(2024, 1, 1) + dt.timedelta(days=i)} for i in range(9)])
    entries = table(spark, "pick_entries", [
        {"id": f"e{i}", "run_id": i, "ts_code": "000001", "close_price": 10.0, "predicted_buy_price": 9.5, "predicted_target_price": 11.5, "predicted_stop_loss": 8.5} for i in range(9)
    ])
    want = set()
    for i in range(1, 9):
        b = min(i - 1, len(closes) - 1)
        for h in (1, 3, 5):
            ahead = closes[b + 1: b + 1 + h]
            if len(ahead) == h:
                want.add((f"e{i}", h, round((ahead[-1] / 10 - 1) * 100, 6), min(ahead) <= 9.5, max(ahead) >= 11.5, min(ahead) <= 8.5))
    got = backtest.outcomes(entries, runs, bars)
    assert {(r["entry_id"], r["horizon_days"], round(r["return_pct"], 6), r["hit_buy"], r["hit_target"], r["hit_stop"]) for r in got.collect()} == want


def test_forecast_is_compared_with_the_next_day_only(spark):
    f = table(spark, "market_forecasts", [{"id": i, "as_of_date": DAY + dt.timedelta(days=i), "market_direction": "bullish"} for i in range(3)])
    days = spark.createDataFrame([(DAY, 9.0), (DAY + dt.timedelta(days=1), 0.2), (DAY + dt.timedelta(days=2), 0.7)], "trade_date date, pct double")
    got = {r["id"]: (r["actual_pct_chg"], r["actual_direction"], r["direction_correct"]) for r in backtest.verify_forecasts(f, days).collect()}
    assert got == {0: (0.2, "range-bound", False), 1: (0.7, "bullish", True), 2: (None, None, None)}


def test_names_match_as_by_comparing_all_pairs(spark):
    """Prefixes first, then the nearest by edit distance, also for one character and for names in the middle."""
    full = ["平安银行股份有限公司", "平安银行理财有限公司", "平安", "中国平安保险集团股份有限公司", "贵州茅台酒股份有限公司"]
    short = ["平安银行", "平安", "中国平安", "茅台", "贵州茅台酒", "平", "茅台酒股份", "无此"]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for s in short:
        starts = sorted((len(c), c) for c in full if c.startswith(s))
        near = sorted((edits(s, c), c) for c in full)
        want[s] = (starts[0][1], starts[0][0] - len(s)) if starts else (near[0][1], near[0][0])
    got = company.match_names(spark.createDataFrame([(s,) for s in short], "name string"), spark.createDataFrame([(c,) for c in full], "full_name string"))
    rows = {r["name"]: r for r in got.collect()}
    assert {k: (r["full_name"], r["distance"]) for k, r in rows.items()} == want
    assert want["无此"] == ("平安", 2)
    assert (rows["贵州茅台酒"]["exact"], rows["中国平安"]["exact"], rows["茅台"]["exact"]) == (True, False, False)


def test_bars_of_a_backtest_have_no_move_of_their_own(spark):
    """The windows by ``asked`` use the move by instrument, and bars that are kept leave it behind."""
    kind = "market string, ts_code string, trade_date date, low double, high double, close double"
    bars = spark.createDataFrame([("a", "1", DAY + dt.timedelta(days=i), 1.0, 1.0, 1.0 + i) for i in range(3)], kind)
    dates = spark.createDataFrame([("a", "1", DAY)], "market string, ts_code string, as_of date")
    ahead = backtest.forward_bars(spark.createDataFrame(dates.rdd, dates.schema), spark.createDataFrame(bars.rdd, bars.schema), (1,))
    moves = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", ahead._jdf.queryExecution().executedPlan().toString())
    assert not [m for m in moves if "asked" in m] and values(ahead, "close_1") == [(2.0,)]
    kept = []
    runs = table(spark, "pick_runs", [{"id": 1, "trade_date_as_of": DAY}])
    entries = table(spark, "pick_entries", [{"id": "e", "run_id": 1, "ts_code": "1", "close_price": 1.0}])
    got = backtest.outcomes(entries, runs, bars, (1,), keep=lambda df: kept.append(df) or df)
    assert len(kept) == 1 and values(got, "entry_id", "return_pct") == [("e", 100.0)]


def test_bars_and_dates_of_a_backtest_move_once_by_instrument(spark):
    """All windows over bars and asked dates share one shuffle."""
    import re

    entries = spark.createDataFrame([], "id string, run_id bigint, ts_code string, rank_in_run bigint, close_price double, rule_composite_score double, llm_composite_score double, "
                                    "recommendation string, predicted_buy_price double, predicted_target_price double, predicted_stop_loss double")
    runs = spark.createDataFrame([], "id bigint, trade_date_as_of date")
    tables = [spark.createDataFrame(df.rdd, df.schema) for df in (entries, runs, spark.createDataFrame([], "market string, ts_code string, trade_date date, low double, high double, close double"))]
    plan = backtest.outcomes(*tables)._jdf.queryExecution().sparkPlan().toString()
    prepared = backtest.outcomes(*tables)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and len(re.findall(r"Exchange hashpartitioning\(market#\d+, ts_code#\d+, \d+\)", prepared)) == 1


def test_names_with_typing_errors_match_the_nearest(spark):
    """Every name against all companies by brute force: typing errors, shared suffixes, and names that nothing is near to."""
    import random

    rng = random.Random(3)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    def typed(c):
        for _ in range(rng.randint(1, 4)):
            k = rng.randrange(len(c))
            c = c[:k] + rng.choice(["", rng.choice("abcdez"), rng.choice("abcdez") + c[k]]) + c[k + 1 :] or "z"
        return c

    full = ["ABzzzzzzz", "yyyyBCyyyy", "xxCDE", "CDqqqqqq", "DErrrrrr"] + sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(3, 14))) + rng.choice(["", "Co", "HoldingCo"]) for _ in range(120)})
    short = sorted({"ABCDE", "ZZZZ", "Q", "ZZZZZZZZZZZZZZZZZZZZZZZZZ", "公", *[typed(rng.choice(full)) for _ in range(150)]})
    want = {}
    for s in short:
        near = sorted((edits(s, c), c) for c in full)
        starts = sorted((len(c), c) for c in full if c.startswith(s))
        want[s] = starts[0][1] if starts else near[0][1]
    assert want["ABCDE"] == "xxCDE"
    got = company.match_names(spark.createDataFrame([(s,) for s in short], "name string"), spark.createDataFrame([(c,) for c in full], "full_name string"))
    assert {r["name"]: r["full_name"] for r in got.collect()} == want


def test_names_with_a_common_legal_form_meet_few_companies(spark, monkeypatch):
    """No row per name and company, though all companies share first letters and legal form; names are as near as by brute force."""
    import random

    rng = random.Random(9)
    full = [f"Co{n}{f}" for n in range(100, 700) for f in ("有限公司", "股份有限公司")[n % 2 : n % 2 + 1]]
    names = [f"Co{rng.randrange(7000, 9999)}" for _ in range(60)] + [c[2:] for c in full[::20]]
    compared = []

    def counted(df, *keys):
        if len(keys) == 1 and str(keys[0]) == "name":
            compared.append(df.count())
        return group(df, *keys)

    listed = spark.createDataFrame([(c,) for c in full], "full_name string")
    group = type(listed).groupBy
    monkeypatch.setattr(type(listed), "groupBy", counted)
    got = company.nearest_names(spark.createDataFrame([(n,) for n in names], "name string"), listed).collect()
    monkeypatch.undo()
    assert max(compared) < len(set(names)) * len(full) / 4
    pairs = spark.createDataFrame([(n,) for n in set(names)], "name string").crossJoin(listed)
    want = pairs.groupBy("name").agg(F.min(F.struct(F.levenshtein("name", "full_name").alias("distance"), "full_name")).alias("near")).collect()
    assert {r.name: tuple(r.near) for r in got} == {r.name: tuple(r.near) for r in want}


@pytest.mark.parametrize("share", [0, 16])
def test_long_names_and_open_characters_match_the_nearest(spark, monkeypatch, share):
    """Companies too long to spell out, also without a legal form, and such that hold the sign of an open character; crowded pairs are compared in blocks."""
    import random

    rng = random.Random(4)
    monkeypatch.setattr(company._by_segments, "__defaults__", (share,))
    monkeypatch.setattr(company._in_blocks, "__defaults__", (7,))
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    full = sorted({word(rng.randint(15, 30)) + rng.choice(["", "有限公司", "集团股份有限公司"]) for _ in range(60)} | {"a\0", "\0b有限公司", "ab", "有限公司"})
    names = {"", "x\0", "b\0公司", "ax", "公司"} | {word(25) for _ in range(5)}
    for c in full:
        k = rng.randrange(len(c))
        names |= {c[1:k] + "z" + c[k + 2 :], c[: k // 2] + c[k:]}
    listed, asked = spark.createDataFrame([(c,) for c in full], "full_name string"), spark.createDataFrame([(n,) for n in names], "name string")
    got = company.nearest_names(asked, listed).collect()
    want = asked.crossJoin(listed).groupBy("name").agg(F.min(F.struct(F.levenshtein("name", "full_name").alias("distance"), "full_name")).alias("near")).collect()
    assert {r.name: tuple(r.near) for r in got} == {r.name: tuple(r.near) for r in want}


def test_exploded_names_are_not_broadcast(spark):
    """Spark takes spellings for as small as the companies they are made of; sent to the driver, they would fill it."""
    listed = spark.createDataFrame([("Co1有限公司", "Co1", "有限公司")], "full_name string, base string, kind string")
    parts = spark.createDataFrame([("Co2", "有限公司", "Co2", 0, 1)], "name string, kind string, part string, cost int, left int")
    pairs = spark.createDataFrame([("Co2", "有限公司", (9, "Co1有限公司"))], "name string, kind string, near struct<distance:int,full_name:string>")
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("bB")) > 0
    for met in (company._by_spelling(parts, listed, 1), company._in_blocks(pairs, listed)):
        plan = met._jdf.queryExecution().sparkPlan().toString()
        assert re.findall(r"SortMergeJoin \[(?:kind|_a)", plan), plan
    matched = company.match_names(spark.createDataFrame([("Co1",)], "name string"), listed.select("full_name"))
    assert "Broadcast" not in matched._jdf.queryExecution().sparkPlan().toString()


def test_names_without_companies_and_nulls(spark):
    none = spark.createDataFrame([], "full_name string")
    some = spark.createDataFrame([("a",), (None,), ("",)], "name string")
    assert {(r["name"], r["full_name"], r["distance"], r["exact"]) for r in company.match_names(some, none).collect()} == {("a", None, None, False), (None, None, None, False), ("", None, None, False)}
    one = spark.createDataFrame([("Acme",), (None,)], "full_name string")
    assert {(r["name"], r["full_name"], r["distance"]) for r in company.match_names(some, one).collect()} == {("a", "Acme", 4), (None, None, None), ("", "Acme", 4)}


def test_rules_apply_with_their_look_back(spark):
    rules = tables.risk_rules(spark, company.RISK_RULES)
    as_of = F.lit("2024-12-31").cast("date")
    day = lambda n: dt.date(2024, 12, 31) - dt.timedelta(days=n)
    events = spark.createDataFrame(
        [("1", "a", "dishonest", day(365)), ("2", "a", "dishonest", day(366)), ("3", "a", "abnormal", day(181)), ("4", "a", "execution", day(5000)), ("4", "a", "execution", day(1))],
        "ts_code string, market string, risk_type string, event_date date")
    rows = spark.createDataFrame([(str(i), "a") for i in range(1, 5)], "ts_code string, market string")
    assert sorted(values(company.exclude_risky(rows, events, rules, as_of), "ts_code")) == [("2",), ("3",), ("4",)]
    assert values(company.score_multipliers(events, rules, as_of), "ts_code", "multiplier") == [("4", 0.5)]


def test_controller_changes(spark):
    h = [("1", "a", n, p, dt.date(y, 1, 1)) for y, n, p in [(2020, "A", 60.0), (2020, "B", 40.0), (2021, "A", 45.0), (2021, "B", 55.0), (2022, "B", 30.0), (2022, "A", 20.0)]]
    holders = spark.createDataFrame(h, "ts_code string, market string, shareholder_name string, stock_percent double, synced_on date")
    c = company.controllers(holders)
    assert sorted(values(c, "synced_on", "holder", "is_controlling")) == [(dt.date(2020, 1, 1), "A", True), (dt.date(2021, 1, 1), "B", True), (dt.date(2022, 1, 1), "B", False)]
    assert values(company.controller_changes(c), "synced_on", "previous_holder", "holder") == [(dt.date(2021, 1, 1), "A", "B")]




def test_chart_maps_of_mixed_nested_and_broken_values(one):
    from tickerloom.functions.nested import chart_map

    cases = {
        '{"a": "/r/charts/x.png", "b": {"kline": "/r/charts/k.png", "other": "/elsewhere/o.png"}}': {"a": {"default": "/charts/x.png"}, "b": {"kline": "/charts/k.png", "other": None}},
        '{"a": {"deep": {"er": "/r/charts/x.png"}, "n": 5, "l": ["/r/charts/x.png"]}, "c": 7, "d": null, "e": [1]}': {
            "a": {"deep": None, "n": None, "l": None}, "c": {"default": None}, "d": {"default": None}, "e": {"default": None}},
        "{}": {}, "{broken": None, "": None, "[1, 2]": None, None: None,
    }
    got = one("t string", [(t,) for t in cases], chart_map("t", "/r"))
    assert [g[0] for g in got] == list(cases.values())


def test_rule_scores_leave_out_instruments_that_did_not_trade_on_the_date(spark):
    from tickerloom.plans import analytics

    days = [dt.date(2024, 1, 1) + dt.timedelta(days=d) for d in range(30)]
    # "old" stopped a week earlier, "late" has one bar after the date asked for.
    rows = [(c, "a", d, 10.0 + k + i * 0.1, 0.5 * k) for k, c in enumerate(("x", "y", "old", "late")) for i, d in enumerate(days) if not (c == "old" and i > 20)]
    rows.append(("late", "a", dt.date(2024, 2, 5), 99.0, 1.0))
    prices = spark.createDataFrame(rows, "ts_code string, market string, trade_date date, close double, turnover_rate double").withColumns(
        {"high": F.col("close"), "low": F.col("close"), "volume": F.lit(1.0)})
    as_of = analytics.latest_complete_date(prices, 3).scalar()
    got = {r.ts_code: r.trade_date for r in analytics.rule_scores(prices, as_of).collect()}
    assert got == {c: days[-1] for c in ("x", "y", "late")}
