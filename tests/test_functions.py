"""Scalar, text and nested expressions on literal rows: nulls, NaN, blanks, boundaries."""

import datetime as dt
import hashlib
import json
import math
import re

from pyspark.sql import functions as F

from tickerloom.functions import nested, scalar, text
from tickerloom.schemas import ANALYSIS_JSON, FORECAST_JSON

NAN, INF = float("nan"), float("inf")


def test_finite_and_zero_if_null_differ_on_null_and_nan(one):
    rows = [(1.5,), (None,), (NAN,), (INF,), (-INF,), (0.0,)]
    got = one("x double", rows, scalar.finite("x"), scalar.zero_if_null("x"))
    assert got == [(1.5, 1.5), (None, 0.0), (None, None), (None, None), (None, None), (0.0, 0.0)]


def test_token_cost_counts_missing_tokens_as_zero(one):
    got = one("p bigint, o bigint", [(1_000_000, 1_000_000), (None, 500_000), (None, None)], scalar.token_cost("p", "o"))
    assert [round(x[0], 9) for x in got] == [1.37, 0.55, 0.0]


def test_percent_guards_zero_and_rounds_half_up(one):
    got = one("a bigint, b bigint", [(1, 3), (0, 0), (1, 16)], scalar.percent("a", "b"))
    assert got == [(33.3,), (None,), (6.3,)]


def test_whole_percent(one):
    got = one("x double, n bigint", [(49.5, 2), (49.4, 2), (80.0, 0), (None, 3)], scalar.whole_percent("x", "n"))
    assert got == [(50,), (49,), (0,), (0,)]


def test_upside_band_and_buy(one):
    rows = [(12.0, 10.0), (None, 10.0), (12.0, 0.0), (0.0, 10.0)]
    assert [None if x[0] is None else round(x[0], 6) for x in one("t double, b double", rows, scalar.upside("t", "b"))] == [20.0, None, None, None]
    assert one("s double", [(70.0,), (69.9,), (55.0,), (None,)], scalar.score_band("s")) == [("strong",), ("fair",), ("fair",), ("weak",)]
    assert one("a double, p double", [(9.0, 8.0), (0.0, 8.0), (None, 8.0)], scalar.effective_buy("a", "p")) == [(9.0,), (8.0,), (8.0,)]


def test_plan_status_order(one):
    rows = [(True, True, "BUY_AT_OPEN"), (False, True, "BUY_AT_OPEN"), (None, None, "BUY_AT_OPEN"), (None, False, "SKIP_TODAY"), (None, None, None)]
    got = one("t boolean, s boolean, a string", rows, scalar.plan_status("t", "s", "a"))
    assert [x[0] for x in got] == ["已止盈", "已止损", "已买入", "待执行", "待执行"]


def test_trading_clock_crosses_midnight_and_weekend(one):
    rows = [(dt.datetime(2024, 1, 5, 15, 59),), (dt.datetime(2024, 1, 5, 16, 0),), (None,)]
    got = one("t timestamp_ntz", rows, *scalar.trading_clock("t").values())
    assert got == [("2024-01-05", "23:59", 4, False), ("2024-01-06", "00:00", 5, True), (None, None, None, None)]


def test_since_days_starts_at_midnight(one):
    rows = [(dt.datetime(2024, 1, 1, 0, 0),), (dt.datetime(2023, 12, 31, 23, 59),)]
    as_of = F.lit("2024-01-03 18:00:00").cast("timestamp_ntz")
    assert one("t timestamp_ntz", rows, scalar.since_days("t", as_of, 2)) == [(True,), (False,)]


def test_ttl_is_inclusive_at_both_ends(one):
    made = dt.datetime(2024, 1, 1)
    rows = [(made, 60, made + dt.timedelta(seconds=s)) for s in (-1, 0, 60, 61)]
    got = one("c timestamp_ntz, ttl bigint, a timestamp_ntz", rows, scalar.still_valid("c", "ttl", "a"))
    assert [x[0] for x in got] == [False, True, True, False]


def test_labels_titles_and_flags(one):
    assert one("t string, i bigint", [("x", 1), ("", 2), (None, 3)], scalar.title_or_default("t", "i")) == [("x",), ("会话 2",), ("会话 3",)]
    assert one("n string, c string, i string", [("A", "000001", None)], scalar.instrument_label("n", "c", "i")) == [("A (000001) · -",)]
    assert one("x double", [(61.0,), (60.0,), (None,)], scalar.above("x", 60)) == [(True,), (False,), (False,)]
    assert one("a double, e double", [(20.0, 25.0), (50.0, 90.5), (49.0, 90.5), (None, 25.0)], scalar.calibration_health("a", "e")) == [
        ("good",), ("fair",), ("bad",), ("bad",)]
    assert one("n bigint", [(3,), (2,), (None,)], scalar.enough_samples("n")) == [(True,), (False,), (False,)]


def test_intent_order_and_first_line(one):
    cases = {
        "综合评分 新闻": "pick", "  600519 ": "pick", "请分析大盘": "pick", "今日新闻 板块": "info_query", "哪些板块": "screen", "帮助": "help",
        "help me": "help", "hello\n选股": "chat", "x" * 100 + "选股": "chat", "6005190": "chat", "": "chat",
    }
    got = one("t string", [(c,) for c in cases], text.intent("t"))
    assert [x[0] for x in got] == list(cases.values())


def test_stock_code_takes_first_match_without_word_border(one):
    got = one("t string", [("看 600519 和 000001",), ("a9300750b",), ("123456",), (None,)], text.stock_code("t"))
    assert got == [("600519",), ("300750",), (None,), (None,)]


def test_stock_name_patterns(one):
    cases = {"分析 贵州茅台": "贵州茅台", "看看：平安银行 吧": "平安银行", "Co42 怎么样": "Co42", "分析 123456": None, "你好": None, "查　东方财富走势": "东方财富走势"}
    got = one("t string", [(c,) for c in cases], text.stock_name("t"))
    assert [x[0] for x in got] == list(cases.values())


def test_searches_differ_in_wildcards(one):
    rows = [("a_b",), ("axb",), ("A%B",), (None,)]
    assert one("c string", rows, text.like_search("c", "A_B"), text.literal_search("c", " A_B ")) == [
        (True, True), (True, False), (True, False), (None, False)]


def test_mention_and_clip(one):
    got = one("t string", [("@bot  hi ",), ("@bot",), ("hi @bot",), ("  x ",)], text.without_mention("t"))
    assert got == [("hi",), ("@bot",), ("hi @bot",), ("x",)]
    assert one("t string", [("茅台茅台",)], text.clipped("t", 3)) == [("茅台茅",)]


def test_cache_key_matches_sha256(one):
    want = hashlib.sha256("m:s:你好".encode()).hexdigest()
    assert one("u string", [("你好",)], text.cache_key(F.lit("m"), F.lit("s"), "u")) == [(want,)]


def test_chart_url_only_below_folder(one):
    rows = [("/srv/r/charts/a/b.png",), ("/srv/r/chartsX/b.png",), ("/tmp/b.png",), ("",), (None,)]
    assert one("p string", rows, text.chart_url("p", "/srv/r/")) == [("/charts/a/b.png",), (None,), (None,), (None,), (None,)]


def test_capital_units(one):
    got = one("t string", [("1,234.5万元",), ("2亿元",), ("50000元",), ("无",), (None,)], text.capital_wan("t"))
    assert [None if x[0] is None else round(x[0], 6) for x in got] == [1234.5, 20000.0, 5.0, None, None]


def test_date_in_file_name(one):
    got = one("n string", [("execution_2024-01-02.json",), ("other.json",)], text.date_in_file_name("n"))
    assert got == [("2024-01-02",), (None,)]


def test_decode_is_null_on_broken_or_blank(one):
    got = one("t string", [('{"ret_20d": 3, "kdj": {"k": 9}}',), ("{bad",), ("",), (None,)], nested.decoded("t", ANALYSIS_JSON)["kdj"]["k"])
    assert got == [(9.0,), (None,), (None,), (None,)]
    sample = json.dumps({"market_direction": {"direction": "bullish", "confidence": 70}, "risk_factors": ["a"]})
    assert one("t string", [(sample,)], nested.decoded("t", FORECAST_JSON)["market_direction"]["direction"]) == [("bullish",)]


def test_chart_map_takes_maps_and_plain_paths(one):
    doc = '{"000001": {"kline": "/r/charts/k.png", "macd": "/x.png"}, "heat": "/r/charts/h.png"}'
    got = one("t string", [(doc,), ("{bad",)], F.to_json(nested.chart_map("t", "/r"), {"ignoreNullFields": "false"}))
    assert json.loads(got[0][0]) == {"000001": {"kline": "/charts/k.png", "macd": None}, "heat": {"default": "/charts/h.png"}}


def test_arrays_and_maps(one):
    rows = [(["⚠️ gap", "x"], {"a": 1, "b": 2}), ([], {"a": 1}), (None, None)]
    got = one("n array<string>, m map<string,int>", rows, nested.not_empty("n"), nested.any_contains("n", "⚠️"), F.map_keys(nested.without_keys("m", "a")))
    assert got == [(True, True, ["b"]), (False, False, []), (False, False, None)]
    assert one("s array<string>", [(["MACD死叉", "均线多头"],)], nested.signal_polarity("s")["side"]) == [(["bear", "bull"],)]


def test_json_rows_have_no_nan(spark):
    df = spark.createDataFrame([(1, (NAN, [1.0, INF]), {"k": -INF})], "id int, s struct<a:double,b:array<double>>, m map<string,double>")
    out = nested.safe_json_rows(df).first()[0]
    assert json.loads(out) == {"id": 1, "s": {"a": None, "b": [1.0, None]}, "m": {"k": None}}
    assert not re.search("NaN|Infinity", out) and math.isnan(NAN)
