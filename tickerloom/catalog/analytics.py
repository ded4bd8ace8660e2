"""Time-series, backtest and company queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.catalog.basics import ISO, RECENT, W
from tickerloom.catalog.registry import query
from tickerloom.functions import scalar
from tickerloom.operators import indicators, neighbours, similarity
from tickerloom.plans import analytics, backtest, company, market
from tickerloom.session import pin, scratch_path
from tickerloom.sources import sinks

QUARTER = "(SELECT count(*) * 25e-2 FROM v_instruments)"
COMPLETE = f"(SELECT trade_date, count(DISTINCT ts_code) AS instruments FROM v_daily_prices GROUP BY 1 HAVING count(DISTINCT ts_code) >= {QUARTER})"


def _quarter(r):
    """A quarter of the universe stands for the absolute threshold of full-size data."""
    return r.instruments.agg(F.count("*") * F.lit(0.25)).scalar()


def _dates(r):
    return analytics.newest_complete_dates(r.daily_prices, _quarter(r), 60)


def rounded(df, digits=6, keep=()):
    """Doubles rounded, except the columns in ``keep``, which are stored values and need none."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


@query("tb01_complete_dates", f"SELECT trade_date, instruments FROM {COMPLETE} t")
def _(r):
    return analytics.complete_dates(r.daily_prices, _quarter(r))


@query("tb01_latest_complete_date", f"SELECT max(trade_date) AS trade_date FROM {COMPLETE} t")
def _(r):
    return analytics.latest_complete_date(r.daily_prices, _quarter(r))


DATES60 = f"(SELECT trade_date FROM {COMPLETE} t ORDER BY trade_date DESC LIMIT 60)"


@query("tb02_panel", f"SELECT trade_date, ts_code, close, volume FROM v_daily_prices WHERE trade_date IN {DATES60}")
def _(r):
    return analytics.panel(r.daily_prices, _dates(r)).select("trade_date", "ts_code", "close", "volume")


@query("tb02_stored_panel", f"SELECT trade_date, ts_code, close, volume FROM v_daily_prices WHERE trade_date IN {DATES60}")
def _(r):
    """From a stored table, of which only the newest months are read."""
    path = scratch_path(r.spark, "prices-by-month")
    schema = "ts_code string, market string, trade_date date, close double, volume double"
    none = r.spark.createDataFrame([], f"{schema}, loaded_at int")
    sinks.catch_up_prices(none, r.daily_prices.select("ts_code", "market", "trade_date", "close", "volume", F.lit(1).alias("loaded_at")), path)
    return analytics.stored_panel(r.spark, path, schema, _quarter(r)).select("trade_date", "ts_code", "close", "volume")


FEATURES = f"""
SELECT ts_code, market, trade_date, close, volume, turnover_rate, CASE WHEN n5 >= 5 THEN ma5 END AS ma5, CASE WHEN n20 >= 20 THEN ma20 END AS ma20, ret_20d, high_60d_pct
FROM (SELECT *, avg(close) OVER {W.format(k=4)} AS ma5, count(close) OVER {W.format(k=4)} AS n5, avg(close) OVER {W.format(k=19)} AS ma20,
             count(close) OVER {W.format(k=19)} AS n20, (close / lag(close, 20) OVER (PARTITION BY ts_code, market ORDER BY trade_date) - 1e0) * 1e2 AS ret_20d,
             close / max(high) OVER {W.format(k=59)} AS high_60d_pct FROM {RECENT} b) t WHERE rn = 1"""


LATEST = f"(SELECT max(trade_date) FROM {COMPLETE} t)"
# The bars up to the latest complete date, newest first.
UPTO = f"(SELECT *, row_number() OVER (PARTITION BY ts_code, market ORDER BY trade_date DESC) AS rn FROM v_daily_prices WHERE trade_date <= {LATEST})"


@query(
    "tb03_lagged_returns",
    f"""SELECT ts_code, market, trade_date, close, volume, round(turnover_rate, 6) + 0e0 AS turnover_rate, round(ma5, 6) + 0e0 AS ma5, round(ma20, 6) + 0e0 AS ma20,
        round(ret_20d, 6) + 0e0 AS ret_20d, round(high_60d_pct, 6) + 0e0 AS high_60d_pct FROM ({FEATURES}) f""",
)
def _(r):
    return rounded(analytics.features(r.daily_prices), keep=["close"])


@query(
    "tb04_high_ratio",
    f"""SELECT ts_code, trade_date, round(close / max(high) OVER {W.format(k=59)}, 6) + 0e0 AS high_60d_pct,
        round((close / lag(close, 20) OVER (PARTITION BY ts_code, market ORDER BY trade_date) - 1e0) * 1e2, 6) + 0e0 AS ret_20d FROM v_daily_prices""",
)
def _(r):
    return rounded(analytics.feature_history(r.daily_prices)).select("ts_code", "trade_date", "high_60d_pct", "ret_20d")


BARS = """WITH RECURSIVE bars AS MATERIALIZED (SELECT ts_code, market, trade_date, close, {extra} CAST(row_number() OVER w AS BIGINT) AS i FROM v_daily_prices WHERE close IS NOT NULL
WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date), w9 AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 8 PRECEDING AND CURRENT ROW))"""


@query(
    "tb05_kdj",
    BARS.format(extra="coalesce((close - min(low) OVER w9) * 1e2 / nullif(max(high) OVER w9 - min(low) OVER w9, 0), 5e1) AS rsv,")
    + """, kd AS (SELECT ts_code, i, 5e1 * 2e0 / 3e0 + rsv / 3e0 AS k, 5e1 * 2e0 / 3e0 + (5e1 * 2e0 / 3e0 + rsv / 3e0) / 3e0 AS d FROM bars WHERE i = 1
         UNION ALL SELECT b.ts_code, b.i, k * 2e0 / 3e0 + rsv / 3e0, d * 2e0 / 3e0 + (k * 2e0 / 3e0 + rsv / 3e0) / 3e0 FROM kd JOIN bars b ON b.ts_code = kd.ts_code AND b.i = kd.i + 1)
       SELECT b.ts_code, b.market, b.trade_date, round(k, 6) + 0e0 AS k, round(d, 6) + 0e0 AS d, round(3 * k - 2 * d, 6) + 0e0 AS j FROM kd JOIN bars b ON b.ts_code = kd.ts_code AND b.i = kd.i""",
)
def _(r):
    return rounded(indicators.kdj(r.daily_prices))


@query(
    "tb06_macd",
    BARS.format(extra="")
    + """, e AS (SELECT ts_code, i, close AS f, close AS s, 0e0 AS dea FROM bars WHERE i = 1
         UNION ALL SELECT b.ts_code, b.i, f * 11e0 / 13e0 + close * 2e0 / 13e0, s * 25e0 / 27e0 + close * 2e0 / 27e0,
               dea * 8e-1 + ((f * 11e0 / 13e0 + close * 2e0 / 13e0) - (s * 25e0 / 27e0 + close * 2e0 / 27e0)) * 2e-1
         FROM e JOIN bars b ON b.ts_code = e.ts_code AND b.i = e.i + 1)
       SELECT b.ts_code, b.market, b.trade_date, round(f - s, 5) + 0e0 AS dif, round(dea, 5) + 0e0 AS dea, round(2 * (f - s - dea), 5) + 0e0 AS macd FROM e JOIN bars b ON b.ts_code = e.ts_code AND b.i = e.i""",
)
def _(r):
    return rounded(indicators.macd(r.daily_prices), 5)


@query(
    "tb06_tick_macd",
    """WITH RECURSIVE t AS MATERIALIZED (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
       e AS (SELECT event_type, i, value AS f, value AS s, 0e0 AS dea FROM t WHERE i = 1
         UNION ALL SELECT t.event_type, t.i, f * 11e0 / 13e0 + value * 2e0 / 13e0, s * 25e0 / 27e0 + value * 2e0 / 27e0,
               dea * 8e-1 + ((f * 11e0 / 13e0 + value * 2e0 / 13e0) - (s * 25e0 / 27e0 + value * 2e0 / 27e0)) * 2e-1
         FROM e JOIN t ON t.event_type = e.event_type AND t.i = e.i + 1)
       SELECT t.event_type, t.event_id, round(f - s, 5) + 0e0 AS dif, round(dea, 5) + 0e0 AS dea FROM e JOIN t USING (event_type, i)""",
)
def _(r):
    """Over single ticks, of which a few types have all: a series is cut into chunks."""
    ticks = r.given("events").select("event_type", "ts", "event_id", F.col("value").alias("close"))
    return rounded(indicators.macd(ticks, keys=["event_type"], order=["ts", "event_id"], chunked=True).select("event_type", "event_id", "dif", "dea"), 5)


@query(
    "tb07_similar_patterns",
    """WITH p AS (SELECT ts_code, market, trade_date, row_number() OVER w AS bar, list(pct_chg) OVER (PARTITION BY ts_code, market ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS x
            FROM v_daily_prices WHERE pct_chg IS NOT NULL WINDOW w AS (PARTITION BY ts_code, market ORDER BY trade_date)),
       q AS (SELECT *, row_number() OVER (PARTITION BY ts_code, market ORDER BY trade_date DESC) AS rn FROM p WHERE len(x) = 10),
       s AS (SELECT h.ts_code, h.market, h.trade_date, h.bar, round(list_cosine_similarity(list_transform(h.x, lambda v: v - list_avg(h.x)), list_transform(n.x, lambda v: v - list_avg(n.x))), 6) + 0e0 AS similarity
            FROM q h JOIN q n ON n.ts_code = h.ts_code AND n.market = h.market AND n.rn = 1 AND h.bar <= n.bar - 10)
       SELECT ts_code, market, trade_date, CAST(bar AS INT) AS bar, similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY ts_code, market ORDER BY similarity DESC, trade_date DESC) AS place FROM s
            WHERE NOT isnan(similarity)) t WHERE place <= 5""",
)
def _(r):
    return analytics.similar_patterns(r.daily_prices)


@query(
    "tb07_patterns_across",
    """WITH p AS (SELECT ts_code, market, trade_date, row_number() OVER w AS bar, list(pct_chg) OVER (PARTITION BY ts_code, market ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS x
            FROM v_daily_prices WHERE pct_chg IS NOT NULL WINDOW w AS (PARTITION BY ts_code, market ORDER BY trade_date)),
       c AS (SELECT * EXCLUDE (x), list_transform(x, lambda v: v - list_avg(x)) AS x, row_number() OVER (PARTITION BY ts_code, market ORDER BY trade_date DESC) AS rn FROM p WHERE len(x) = 10),
       s AS (SELECT n.ts_code, n.market, h.ts_code AS like_ts_code, h.market AS like_market, h.trade_date, round(list_cosine_similarity(h.x, n.x), 6) + 0e0 AS similarity
            FROM c n JOIN c h ON n.rn = 1 AND (h.ts_code <> n.ts_code OR h.market <> n.market OR h.bar <= n.bar - 10))
       SELECT *, row_number() OVER (PARTITION BY ts_code, market ORDER BY similarity DESC, trade_date DESC, like_market, like_ts_code) AS position FROM s
       WHERE NOT isnan(similarity) QUALIFY position <= 5""",
)
def _(r):
    return analytics.similar_patterns_across(r.daily_prices)[0].withColumn("position", F.col("position").cast("long"))


@query("tb08_vector_neighbours")
def _(r):
    """Every vector whose id is divisible by 20 against all of them."""
    e = r.given("embeddings")
    return neighbours.vector_neighbours(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding")


@query(
    "tb08_nearest_vectors",
    """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rn FROM embeddings),
       s AS (SELECT a.label, a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) + 0e0 AS similarity FROM v a JOIN v b ON a.label = b.label AND b.rn = 1 AND a.vec_id < b.vec_id)
       SELECT label, vec_id, similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id DESC) AS place FROM s) t WHERE place <= 5""",
)
def _(r):
    return similarity.closest_to_newest(r.given("embeddings"), ["label"], "vec_id", "embedding", 5)


@query(
    "tb09_cross_signals",
    f"""WITH m AS (SELECT ts_code, market, trade_date, CASE WHEN count(close) OVER {W.format(k=19)} >= 20 THEN sign(avg(close) OVER {W.format(k=4)} - avg(close) OVER {W.format(k=19)}) END AS side FROM v_daily_prices),
        l AS (SELECT *, lag(side) OVER (PARTITION BY ts_code, market ORDER BY trade_date) AS before FROM m)
        SELECT ts_code, market, trade_date, concat_ws(',', CASE WHEN side > 0 THEN '均线多头' WHEN side < 0 THEN '均线空头' END,
               CASE WHEN side > 0 AND before <= 0 THEN '均线金叉' WHEN side < 0 AND before >= 0 THEN '均线死叉' END) AS signals FROM l""",
)
def _(r):
    return analytics.cross_signals(r.daily_prices).withColumn("signals", F.array_join("signals", ","))


@query(
    "tb10_rule_scores",
    f"""SELECT ts_code, market, round(100 * (4e-1 * percent_rank() OVER (ORDER BY ret_20d) + 3e-1 * percent_rank() OVER (ORDER BY high_60d_pct) + 3e-1 * percent_rank() OVER (ORDER BY turnover_rate)), 6) + 0e0 AS rule_score
        FROM ({FEATURES.replace(RECENT, UPTO)}) f WHERE ret_20d <= 30 AND trade_date = {LATEST}""",
)
def _(r):
    as_of = analytics.latest_complete_date(r.daily_prices, _quarter(r)).scalar()
    return rounded(analytics.rule_scores(r.daily_prices, as_of).select("ts_code", "market", "rule_score"))


@query(
    "tb11_ranked_runs",
    """SELECT run_id, id, round(score, 6) + 0e0 AS score, position FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, id DESC) AS position
       FROM (SELECT *, coalesce(llm_composite_score, rule_composite_score) AS score FROM v_pick_entries) e) t WHERE position <= 300""",
)
def _(r):
    return rounded(analytics.ranked_runs(r.pick_entries).select("run_id", "id", "score", "position"))


@query(
    "tb12_price_levels",
    f"""SELECT ts_code, market, support, resistance, close, least(close, support * 1.02e0) AS buy, resistance AS target, support * 9.7e-1 AS stop FROM (SELECT ts_code, market, min(low) AS support, max(high) AS resistance, max(CASE WHEN rn = 1 THEN close END) AS close
        FROM {RECENT} b WHERE rn <= 20 GROUP BY 1, 2) t""",
)
def _(r):
    return analytics.price_levels(r.daily_prices)


FORWARD = """(SELECT ts_code, trade_date, (close / lag(close, 20) OVER w - 1e0) * 1e2 AS ret_20d,
min(low) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS low1, max(high) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS high1, lead(close, 1) OVER w AS close1,
min(low) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS low3, max(high) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS high3, lead(close, 3) OVER w AS close3,
min(low) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS low5, max(high) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS high5, lead(close, 5) OVER w AS close5
FROM v_daily_prices WHERE market = 'a' WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date))"""
OUTCOMES = f"""
SELECT j.id AS entry_id, run_id, ts_code, rank_in_run, rule_composite_score, llm_composite_score, recommendation, ret_20d, h AS horizon_days,
       (c / close_price - 1e0) * 1e2 AS return_pct, lo <= predicted_buy_price AS hit_buy, hi >= predicted_target_price AS hit_target, lo <= predicted_stop_loss AS hit_stop
FROM (SELECT e.*, b.ret_20d, x.h, CASE x.h WHEN 1 THEN low1 WHEN 3 THEN low3 ELSE low5 END AS lo, CASE x.h WHEN 1 THEN high1 WHEN 3 THEN high3 ELSE high5 END AS hi,
             CASE x.h WHEN 1 THEN close1 WHEN 3 THEN close3 ELSE close5 END AS c
      FROM (SELECT t.*, p.trade_date_as_of AS as_of FROM v_pick_entries t JOIN v_pick_runs p ON p.id = t.run_id) e
      ASOF JOIN {FORWARD} b ON b.ts_code = e.ts_code AND e.as_of >= b.trade_date
      CROSS JOIN (VALUES (1), (3), (5)) x(h)) j WHERE c IS NOT NULL"""


def _outcomes(r, *horizons):
    return backtest.outcomes(r.pick_entries, r.pick_runs, r.daily_prices, horizons or backtest.HORIZONS, keep=pin)


@query(
    "tb13_backtest_outcomes",
    f"SELECT entry_id, horizon_days, round(return_pct, 6) + 0e0 AS return_pct, hit_buy, hit_target, hit_stop FROM ({OUTCOMES}) o",
)
def _(r):
    return rounded(_outcomes(r).select("entry_id", "horizon_days", "return_pct", "hit_buy", "hit_target", "hit_stop"))


AUDIT = f"""
SELECT run_id, count(*) AS entries, avg(CASE WHEN NOT hit_buy OR return_pct < 0 THEN 1e0 ELSE 0e0 END) AS fail_rate, avg(return_pct) AS mean_fwd_return,
       avg(llm_composite_score - rule_composite_score) AS mean_delta FROM ({OUTCOMES}) o WHERE horizon_days = 5 AND rank_in_run <= 10 GROUP BY 1"""


@query(
    "tb14_run_audit",
    f"SELECT run_id, entries, round(fail_rate, 6) + 0e0 AS fail_rate, round(mean_fwd_return, 6) + 0e0 AS mean_fwd_return, round(mean_delta, 6) + 0e0 AS mean_delta FROM ({AUDIT}) a",
)
def _(r):
    return rounded(backtest.run_audit(_outcomes(r, 5)))


@query(
    "tb15_failure_labels",
    f"""WITH o AS MATERIALIZED (SELECT * FROM ({OUTCOMES}) t WHERE horizon_days = 5)
        SELECT label, entries FROM (SELECT 'momentum_chase' AS label, count(*) FILTER (WHERE ret_20d > 20) AS entries FROM o
        UNION ALL SELECT 'score_inflation', count(*) FILTER (WHERE llm_composite_score - rule_composite_score > 3) FROM o
        UNION ALL SELECT 'buy_unreachable', count(*) FILTER (WHERE NOT hit_buy) FROM o
        UNION ALL SELECT 'generic_bullish', count(*) FILTER (WHERE return_pct < 0 AND recommendation IN ('强烈关注', '关注')) FROM o
        UNION ALL SELECT 'forward_loss', count(*) FILTER (WHERE return_pct < 0) FROM o) t WHERE entries > 0""",
)
def _(r):
    return backtest.label_counts(backtest.failure_labels(_outcomes(r, 5)))


@query(
    "tb16_compare_audits",
    f"""SELECT run_id, run_kind, round(fail_rate, 6) + 0e0 AS fail_rate, round(mean_fwd_return, 6) + 0e0 AS mean_fwd_return, lag(run_id) OVER w AS previous_run,
        round(fail_rate - lag(fail_rate) OVER w, 6) + 0e0 AS fail_rate_change, round(mean_fwd_return - lag(mean_fwd_return) OVER w, 6) + 0e0 AS fwd_return_change
        FROM ({AUDIT}) a JOIN v_pick_runs p ON p.id = a.run_id WINDOW w AS (PARTITION BY run_kind ORDER BY created_at_utc, run_id)""",
)
def _(r):
    return rounded(backtest.compare_audits(backtest.run_audit(_outcomes(r, 5)), r.pick_runs))


@query(
    "tb17_verify_forecasts",
    """WITH d AS (SELECT trade_date, round(avg(pct_chg), 6) + 0e0 AS pct FROM v_daily_prices WHERE market = 'a' GROUP BY 1),
       j AS (SELECT f.id, f.market_direction, d.pct AS p FROM v_market_forecasts f ASOF LEFT JOIN (SELECT * FROM d WHERE pct IS NOT NULL) d ON f.as_of_date < d.trade_date)
       SELECT id, market_direction, p AS actual_pct_chg, a AS actual_direction, market_direction = a AS direction_correct
       FROM (SELECT *, CASE WHEN p > 5e-1 THEN 'bullish' WHEN p < -5e-1 THEN 'bearish' WHEN p IS NOT NULL THEN 'range-bound' END AS a FROM j) t""",
)
def _(r):
    return backtest.verify_forecasts(r.market_forecasts, backtest.market_days(r.daily_prices))


@query(
    "tb18_concept_breadth",
    f"""SELECT concept_name, count(*) AS members, round(avg(pct_chg), 6) + 0e0 AS mean_pct_chg, round(avg(CASE WHEN pct_chg > 0 THEN 1e0 ELSE 0e0 END), 6) + 0e0 AS advance_ratio
        FROM v_concept_members m JOIN {RECENT} b ON b.ts_code = m.ts_code AND b.market = m.market AND b.rn = 1 WHERE concept_name <> '' AND pct_chg IS NOT NULL GROUP BY 1""",
)
def _(r):
    return rounded(analytics.concept_breadth(r.concept_members, r.daily_prices))


@query(
    "tb19_news_of_all_sources",
    f"""SELECT l.ts_code, l.market, l.news_source, l.news_id, n.title, strftime(n.published_at_utc, {ISO}) AS published_at FROM v_news_links l
        JOIN (SELECT *, 'global_news' AS src FROM v_news UNION ALL SELECT *, 'financial_alerts' FROM v_alerts) n ON n.id = l.news_id AND n.src = l.news_source""",
)
def _(r):
    rows = market.linked_news_of_all(r.news_links, market.all_sources(r.news, r.alerts))
    return rows.select("ts_code", "market", "news_source", "news_id", "title", scalar.iso_time("published_at_utc").alias("published_at"))


@query(
    "tb20_coverage_gaps",
    """SELECT i.ts_code, i.market, d.trade_date FROM v_instruments i CROSS JOIN (SELECT DISTINCT trade_date FROM v_daily_prices) d
        WHERE NOT EXISTS (SELECT 1 FROM v_daily_prices p WHERE p.ts_code = i.ts_code AND p.market = i.market AND p.trade_date = d.trade_date)""",
)
def _(r):
    return analytics.coverage_gaps(r.instruments, r.daily_prices)


# --- company ------------------------------------------------------------------------

PROFILES = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts_code, market ORDER BY synced_on DESC) AS rn FROM v_company_profile_feed) f WHERE rn = 1)"
AS_OF = "DATE '2024-07-18'"
EXCLUDED = f"(SELECT ts_code, market FROM v_company_risk_events WHERE risk_type = 'dishonest' AND event_date >= {AS_OF} - 365 OR risk_type = 'abnormal' AND event_date >= {AS_OF} - 180)"


def _as_of():
    return F.lit("2024-07-18").cast("date")


def _rules(r):
    return r.risk_rules


@query("tc01_profile_upsert", f"SELECT ts_code, market, full_name, status, synced_on FROM {PROFILES} p")
def _(r):
    f = r.company_profile_feed
    first = F.col("status") == "存续"
    return company.upsert_profiles(f.filter(first), f.filter(~first)).select("ts_code", "market", "full_name", "status", "synced_on")


@query("tc02_exclude_risky", f"SELECT ts_code, name FROM v_instruments i WHERE NOT EXISTS (SELECT 1 FROM {EXCLUDED} x WHERE x.ts_code = i.ts_code AND x.market = i.market)")
def _(r):
    return company.exclude_risky(r.instruments, r.company_risk_events, _rules(r), _as_of()).select("ts_code", "name")


@query(
    "tc03_risk_adjusted_scores",
    """SELECT id, round(final_composite_score * CASE WHEN EXISTS (SELECT 1 FROM v_company_risk_events r WHERE r.risk_type = 'execution' AND r.market = 'a' AND r.ts_code = e.ts_code) THEN 5e-1 ELSE 1e0 END, 6) + 0e0 AS adjusted_score
       FROM v_pick_entries e""",
)
def _(r):
    m = company.score_multipliers(r.company_risk_events, _rules(r), _as_of())
    return rounded(company.risk_adjusted(r.pick_entries, m).select("id", "adjusted_score"))


@query("tc04_code_mismatch", f"SELECT ts_code, market, stock_number <> ts_code AS code_mismatch FROM {PROFILES} p")
def _(r):
    return company.code_mismatches(company.current_profiles(r.company_profile_feed)).select("ts_code", "market", "code_mismatch")


def one(name: str) -> str:
    """The name with one byte per character, as the SQL side's edit distance counts bytes."""
    return f"translate({name}, '集团股份有限公司', 'abcdefghi')"


@query(
    "tc05_match_names",
    f"""WITH p AS (SELECT DISTINCT full_name FROM {PROFILES} q),
        n AS (SELECT name FROM v_instruments UNION ALL SELECT substr(full_name, 3) FROM p WHERE full_name LIKE '%3%')
        SELECT name, full_name, CAST(levenshtein({one('name')}, {one('full_name')}) AS BIGINT) AS distance, coalesce(regexp_replace(full_name, '(集团股份有限公司|股份有限公司|有限公司)$', '') = name, false) AS exact
        FROM (SELECT n.name, p.full_name, row_number() OVER (PARTITION BY n.name ORDER BY NOT starts_with(p.full_name, n.name),
                  CASE WHEN starts_with(p.full_name, n.name) THEN length(p.full_name) ELSE levenshtein({one('n.name')}, {one('p.full_name')}) END, p.full_name) AS rn FROM n CROSS JOIN p) t WHERE rn = 1""",
)
def _(r):
    profiles = company.current_profiles(r.company_profile_feed)
    cut = profiles.filter(F.contains("full_name", F.lit("3"))).select(F.substring("full_name", F.lit(3), F.length("full_name")).alias("name"))
    return company.match_names(r.instruments.select("name").union(cut), profiles)


@query(
    "tc05_match_rate",
    f"""SELECT count(*) AS names, count(*) FILTER (WHERE hit) AS matched, round(count(*) FILTER (WHERE hit) * 1e2 / count(*), 1) + 0e0 AS match_pct
        FROM (SELECT DISTINCT 'Co' || user_id AS name, EXISTS (SELECT 1 FROM {PROFILES} p WHERE starts_with(p.full_name, 'Co' || user_id)) AS hit FROM events) t""",
)
def _(r):
    asked = r.given("events").select(F.concat(F.lit("Co"), F.col("user_id").cast("string")).alias("name")).distinct()
    return company.match_rate(company.match_names(asked, company.current_profiles(r.company_profile_feed)))


CONTROLLER = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts_code, market, synced_on ORDER BY stock_percent DESC, shareholder_name DESC) AS rn FROM v_company_shareholders) h WHERE rn = 1)"""


@query("tc06_controllers", f"SELECT ts_code, market, synced_on, shareholder_name AS holder, stock_percent, stock_percent >= 25 AS is_controlling FROM {CONTROLLER} c")
def _(r):
    return company.controllers(r.company_shareholders, 25.0)


@query("tc07_unmapped", f"SELECT ts_code, name FROM v_instruments i WHERE NOT EXISTS (SELECT 1 FROM {PROFILES} p WHERE p.ts_code = i.ts_code AND p.key_no IS NOT NULL)")
def _(r):
    return company.unmapped(r.instruments, company.current_profiles(r.company_profile_feed)).select("ts_code", "name")


@query(
    "tc08_risk_alerts",
    f"""SELECT source_name, id, title, strftime(published_at_utc, {ISO}) AS published_at FROM v_alerts
        UNION ALL SELECT 'company_risk', id, title, strftime(seen_at_utc, {ISO}) FROM v_company_risk_events""",
)
def _(r):
    rows = r.alerts.unionByName(company.risk_alerts(r.company_risk_events))
    return rows.select("source_name", "id", "title", scalar.iso_time("published_at_utc").alias("published_at"))


@query(
    "tc09_capital_numbers",
    f"SELECT ts_code, round(capital_number * CASE s_suppkey % 3 WHEN 0 THEN 1e4 WHEN 1 THEN 1e0 ELSE 1e-4 END, 6) + 0e0 AS registered_capital_num FROM {PROFILES} p",
)
def _(r):
    return rounded(company.with_capital_number(company.current_profiles(r.company_profile_feed)).select("ts_code", "registered_capital_num"))


@query(
    "tc10_controller_changes",
    f"""SELECT ts_code, market, synced_on, previous_holder, holder FROM (SELECT ts_code, market, synced_on, shareholder_name AS holder,
        lag(shareholder_name) OVER (PARTITION BY ts_code, market ORDER BY synced_on) AS previous_holder FROM {CONTROLLER} c) t WHERE holder <> previous_holder""",
)
def _(r):
    return company.controller_changes(company.controllers(r.company_shareholders))


@query(
    "tc11_scope_match",
    """SELECT m.ts_code, m.market, count(*) AS concepts, count(*) FILTER (WHERE contains(business_scope, concept_name)) AS confirmed,
       round(avg(CASE WHEN contains(business_scope, concept_name) THEN 1e0 ELSE 0e0 END), 6) + 0e0 AS match_ratio
       FROM v_concept_members m JOIN v_business_scopes s ON s.ts_code = m.ts_code AND s.market = m.market WHERE concept_name <> '' GROUP BY 1, 2""",
)
def _(r):
    return company.scope_match(r.concept_members, r.business_scopes)


@query(
    "tc12_patent_ranks",
    """SELECT ts_code, market, patents, round(percent_rank() OVER (ORDER BY patents), 6) + 0e0 AS patent_rank FROM (SELECT i.ts_code, i.market, count(p.patent_id) AS patents
       FROM v_instruments i LEFT JOIN v_patents p ON p.ts_code = i.ts_code AND p.market = i.market GROUP BY 1, 2) t""",
)
def _(r):
    return rounded(company.patent_ranks(r.instruments, r.patents))


@query(
    "tc13_holder_flags",
    """SELECT ts_code, market, bool_or(regexp_matches(shareholder_name, '国资|国有|财政')) AS has_state_holder,
       bool_or(regexp_matches(shareholder_name, '社保|基金|保险|信托')) AS has_institution FROM v_company_shareholders GROUP BY 1, 2""",
)
def _(r):
    return company.holder_flags(r.company_shareholders)
