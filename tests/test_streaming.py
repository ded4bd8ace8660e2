"""Streaming jobs fed file by file must end in the rows of the batch result."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickerloom.streaming import jobs

START = dt.datetime(2024, 1, 1)
TICKS = "ts timestamp_ntz, event_id bigint, ts_code string, price double"


def ticks(n=600, late=False):
    """About four days of ticks; a third of them belong to one code."""
    rng = random.Random(1)
    rows = []
    for i in range(n):
        code = "hot" if rng.random() < 0.34 else f"c{rng.randrange(6)}"
        rows.append((START + dt.timedelta(minutes=10 * i, seconds=rng.randrange(60)), i, code, round(rng.uniform(5, 15), 2)))
    return rows


@pytest.fixture()
def feed(spark, tmp_path):
    """Write rows as several files that arrive one per batch; returns a stream reader."""

    def build(rows, schema, files=5):
        folder = str(tmp_path / "in")
        size = -(-len(rows) // files)
        for f in range(files):
            part = rows[f * size: (f + 1) * size]
            if part:
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return build


def found(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def iso(t):
    return t.strftime("%Y-%m-%dT%H:%M:%S")


def test_hourly_bars_equal_batch_for_closed_windows(feed):
    rows = ticks()
    got = jobs.run_available(jobs.tick_bars(feed(rows, TICKS), "ts_code", "price", "ts", "event_id"), "t-bars")
    closed = max(r[0] for r in rows) - dt.timedelta(hours=1)
    groups = {}
    for t, i, c, p in rows:
        groups.setdefault((t.replace(minute=0, second=0), c), []).append((t, i, p))
    want = set()
    for (h, c), g in groups.items():
        if h + dt.timedelta(hours=1) <= closed:
            g.sort()
            prices = [p for *_, p in g]
            want.add((iso(h), c, prices[0], max(prices), min(prices), prices[-1], len(g)))
    assert found(got, "window_start", "symbol", "open", "high", "low", "close", "ticks") == want and want


def test_rows_beyond_the_watermark_are_dropped(feed):
    rows = ticks(120)
    very_late = (START, 9999, "hot", 1.0)
    got = jobs.run_available(jobs.tick_bars(feed(rows + [very_late], TICKS, 6), "ts_code", "price", "ts", "event_id"), "t-late")
    assert 1.0 not in {r["low"] for r in got.collect()}


def plan_rows(spark):
    days = [START.date() + dt.timedelta(days=d) for d in range(5)]
    rows = [(d, c, 13.0, 7.0) for d in days for c in ["hot"] + [f"c{i}" for i in range(5)]]
    return spark.createDataFrame(rows, "plan_date date, ts_code string, predicted_target double, predicted_stop double")


def first_touches(rows):
    want = {}
    for t, i, c, p in sorted(rows):
        if c != "c5" and (p >= 13 or p <= 7):
            want.setdefault((t.date(), c), (i, p, "target" if p >= 13 else "stop"))
    return want


def test_alerts_come_once_per_plan(spark, feed):
    rows = ticks()
    got = jobs.run_available(jobs.touch_alerts(feed(rows, TICKS), plan_rows(spark)), "t-alerts").collect()
    want = first_touches(rows)
    assert {(r["plan_date"], r["ts_code"]): (r["event_id"], r["price"], r["touch"]) for r in got} == want and len(got) == len(want)


def test_alert_state_grows_by_day_and_bucket_not_by_plan(spark, tmp_path):
    """Three files of one day, each of which touches every plan: one alert a plan, that of the first file."""
    codes = [f"p{i:03d}" for i in range(300)]
    for k in range(3):
        rows = [(START + dt.timedelta(hours=k, seconds=i), 1000 * k + i, c, 20.0) for i, c in enumerate(codes)]
        spark.createDataFrame(rows, TICKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    plans = spark.createDataFrame([(START.date(), c, 13.0, 7.0) for c in codes], "plan_date date, ts_code string, predicted_target double, predicted_stop double")
    feed = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = jobs.touch_alerts(feed, plans).writeStream.outputMode("append").format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    running.awaitTermination()
    got = [(r["ts_code"], r["event_id"]) for r in spark.table("alerts").collect()]
    assert len({e // 1000 for _, e in got}) == 1 and sorted((c, e % 1000) for c, e in got) == [(c, i) for i, c in enumerate(codes)]
    assert 0 < running.lastProgress["stateOperators"][0]["numRowsTotal"] <= 64


def test_first_touch_of_closed_days(spark, feed):
    rows = ticks()
    got = jobs.run_available(jobs.first_touch_of_day(feed(rows, TICKS), plan_rows(spark)), "t-touch")
    last = max(r[0] for r in rows) - dt.timedelta(hours=1)
    want = {(iso(dt.datetime.combine(d, dt.time())), c, p, k) for (d, c), (_, p, k) in first_touches(rows).items() if dt.datetime.combine(d, dt.time()) + dt.timedelta(days=1) <= last}
    assert found(got, "window_start", "ts_code", "price", "touch") == want and want


def test_message_sessions_split_at_gaps(feed):
    kind = "id bigint, session_id bigint, created_at_utc timestamp_ntz, cost_usd double"
    minutes = [0, 10, 39, 69, 100, 200, 400]  # a gap of exactly 30 minutes still belongs together
    rows = [(i, 1, START + dt.timedelta(minutes=m), 1.0) for i, m in enumerate(minutes)]
    got = jobs.run_available(jobs.message_sessions(feed(rows, kind, 3)), "t-sessions")
    assert found(got, "window_start", "messages") == {("2024-01-01T00:00:00", 4), ("2024-01-01T01:40:00", 1), ("2024-01-01T03:20:00", 1)}


def test_daily_cost_and_deliveries(feed, spark):
    kind = "id bigint, created_at_utc timestamp_ntz, prompt_tokens bigint, output_tokens bigint, cost_usd double"
    rows = [(i, START + dt.timedelta(hours=6 * i), 2, None, 0.5) for i in range(10)]
    got = jobs.run_available(jobs.daily_cost(feed(rows, kind)), "t-cost")
    assert found(got, "window_start", "requests", "prompt_tokens", "output_tokens", "cost_usd") == {(f"2024-01-0{d}T00:00:00", 4, 8, None, 2.0) for d in (1, 2)}


def test_repeated_deliveries_are_dropped(feed):
    kind = "news_id bigint, ts timestamp_ntz"
    rows = [(i % 7, START + dt.timedelta(hours=i)) for i in range(60)]
    got = jobs.run_available(jobs.first_deliveries(feed(rows, kind), ["news_id"], "ts").select("news_id", F.col("ts")), "t-news")
    assert sorted(r["news_id"] for r in got.collect()) == list(range(7))


MESSAGES = "id bigint, created_at_utc timestamp_ntz, prompt_tokens bigint, output_tokens bigint, cost_usd double"


def test_running_totals_equal_batch_after_every_file_and_a_replay_changes_nothing(spark, tmp_path):
    folder, table, log = (str(tmp_path / x) for x in ("in", "totals", "log"))
    rng = random.Random(4)
    rows = [(i, START + dt.timedelta(minutes=37 * i - rng.randrange(50)), i % 9, None if i % 4 else i, 0.25 * (i % 5)) for i in range(180)]
    stored = lambda: {(r.window_start, r.requests, r.prompt_tokens, r.output_tokens, r.cost_usd) for r in jobs.running_table(spark, table).read().collect()}
    for n in range(0, 180, 45):
        spark.createDataFrame(rows[n : n + 45], MESSAGES).coalesce(1).write.mode("append").parquet(folder)
        jobs.keep_running_totals(spark.readStream.schema(MESSAGES).parquet(folder), table, log)
        days = {}
        for _, at, a, b, c in rows[: n + 45]:
            days.setdefault(iso(dt.datetime.combine(at.date(), dt.time())), []).append((a, b, c))
        want = {(d, len(g), sum(x[0] for x in g), sum(x[1] or 0 for x in g) if any(x[1] is not None for x in g) else None, sum(x[2] for x in g)) for d, g in days.items()}
        assert stored() == want
    files = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "totals").rglob("*.parquet")}
    # The last batch is played again, as after a failure before its commit.
    last = max(int(p.name) for p in (tmp_path / "log/commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "log/commits").glob(f"*{last}*"):
        p.unlink()
    jobs.keep_running_totals(spark.readStream.schema(MESSAGES).parquet(folder), table, log)
    assert stored() == want and files.keys() == {p.name for p in (tmp_path / "totals").rglob("*.parquet")}


def test_an_older_batch_never_replaces_a_newer_one(spark, tmp_path):
    folder, table = str(tmp_path / "in"), str(tmp_path / "totals")
    spark.createDataFrame([(1, START, 1, 1, 1.0)], MESSAGES).write.parquet(folder)
    kind = jobs.RUNNING
    newer = spark.createDataFrame([(iso(START), iso(START), 99, 9, 9, 9.0, 7)], kind)
    jobs.running_table(spark, table).change(newer, lambda stored, fresh: fresh)
    jobs.keep_running_totals(spark.readStream.schema(MESSAGES).parquet(folder), table, str(tmp_path / "log"))
    assert [r.requests for r in jobs.running_table(spark, table).read().collect()] == [99]


def test_revised_plans_serve_from_their_arrival(spark, tmp_path):
    rng = random.Random(8)
    tick_rows = ticks(800)
    plan_kind = "ts timestamp_ntz, event_id bigint, ts_code string, predicted_target double, predicted_stop double"
    plans = [(START + dt.timedelta(minutes=rng.randrange(6 * 1440)), k, rng.choice(["hot", "hot", "c1", "c2", "c9"]), rng.uniform(11, 14), rng.uniform(6, 9)) for k in range(250)]
    versions = {}
    for p in plans:
        versions.setdefault((p[2], p[0].date()), []).append(p)
    want = {}
    for t, i, c, price in sorted(tick_rows):
        earlier = [p for p in versions.get((c, t.date()), []) if p[0] < t]
        if earlier:
            p = max(earlier)
            touch = "target" if price >= p[3] else "stop" if price <= p[4] else None
            if touch:
                want.setdefault((iso(dt.datetime.combine(t.date(), dt.time())), c), (iso(t), price, touch, p[1]))
    # Rows of either side come up to 50 minutes out of order, in eight files each.
    def feed_of(name, rows, kind):
        mixed = sorted(rows, key=lambda r: r[0] + dt.timedelta(minutes=rng.randrange(50)))
        for k in range(8):
            spark.createDataFrame(mixed[k * len(mixed) // 8 : (k + 1) * len(mixed) // 8], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))

    job = jobs.first_touch_of_revised(feed_of("ticks", tick_rows, TICKS), feed_of("plans", plans, plan_kind))
    running = job.writeStream.outputMode("append").format("memory").queryName("revised").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    running.awaitTermination()
    got = {(r.window_start, r.ts_code): (r.touched_at, r.price, r.touch, r.version) for r in spark.table("revised").collect()}
    last = min(max(r[0] for r in rows) for rows in (tick_rows, plans)) - dt.timedelta(hours=1)
    closed = {k: v for k, v in want.items() if dt.datetime.fromisoformat(k[0]) + dt.timedelta(days=2) <= last}
    assert got == closed and any(k[1] == "hot" for k in got) and len({v[3] for v in got.values()}) > 5
    # Versions and ticks more than a day behind the watermark are gone from the state of the join.
    state = running.lastProgress["stateOperators"]
    recent = sum(r[0] > last - dt.timedelta(days=1, hours=1) for r in tick_rows + plans)
    assert max(s["numRowsTotal"] for s in state) <= 2 * recent < 2 * len(tick_rows + plans)


def test_a_delivery_that_returns_after_the_watermark_comes_again(feed):
    kind = "news_id bigint, ts timestamp_ntz"
    rng = random.Random(9)
    rows = sorted(((rng.randrange(5), START + dt.timedelta(hours=6 * i, minutes=rng.randrange(300))) for i in range(80)), key=lambda r: r[1])
    got = jobs.run_available(jobs.first_deliveries(feed(rows, kind, 8), ["news_id"], "ts", "2 days").select("news_id", "ts"), "t-return").collect()
    times = {}
    for r in sorted(got, key=lambda r: r["ts"]):
        times.setdefault(r["news_id"], []).append(r["ts"])
    # Every key comes at its first time, never again within two days, and again some time after those.
    assert {i: t[0] for i, t in times.items()} == {i: min(t for j, t in rows if j == i) for i in range(5)}
    assert all(b - a > dt.timedelta(days=2) for t in times.values() for a, b in zip(t, t[1:]))
    assert all(len(t) > 1 for t in times.values()) and len(got) < len(rows) / 2
