"""Readers and writers on files."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tickerloom import session
from tickerloom.catalog import QUERIES
from tickerloom.plans import execution
from tickerloom.schemas import INPUT_SCHEMAS
from tickerloom.sources import sinks, snapshots, tables


def test_snapshot_files_in_both_shapes_and_broken(spark, tmp_path):
    plan = {"ts_code": "000001", "open_action": "BUY_AT_OPEN", "hit_target": True, "unknown": 1}
    documents = {
        "2024-01-02": json.dumps([plan, {**plan, "open_action": None, "hit_target": None}], indent=1),
        "2024-01-03": json.dumps({"plans": [plan]}), "2024-01-04": "{broken", "2024-01-05": json.dumps({"other": 1}), "2024-01-06": "[]",
    }
    for day, text in documents.items():
        (tmp_path / f"execution_{day}.json").write_text(text, encoding="utf-8")
    (tmp_path / "other.json").write_text("[1]")
    decoded = snapshots.decode_snapshots(snapshots.read_snapshot_files(spark, str(tmp_path)))
    got = {r["plan_date"]: (r["total_picks"], r["buy_signals"], r["hit_target"], r["error"]) for r in execution.calendar(decoded, 30).collect()}
    assert got == {
        "2024-01-02": (2, 1, 1, None), "2024-01-03": (1, 1, 1, None), "2024-01-04": (None, None, None, "解析失败"),
        "2024-01-05": (0, 0, 0, None), "2024-01-06": (0, 0, 0, None),
    }
    assert [r["plan_date"] for r in execution.calendar(decoded, 2).collect()] == ["2024-01-06", "2024-01-05"]
    assert snapshots.plan_rows(decoded).count() == 3


def plans_of(spark, days):
    rows = [(d, f"{k:06d}", k, "BUY_AT_OPEN" if k % 2 else None, k * 1.5) for d in days for k in range(1, 6)]
    return spark.createDataFrame(rows, "plan_date string, ts_code string, rank int, open_action string, predicted_buy double").withColumn("plan_date", F.to_date("plan_date"))


def test_snapshots_are_written_one_file_a_day_and_read_back(spark, tmp_path):
    path = str(tmp_path / "snaps")
    plans = plans_of(spark, ["2024-02-28", "2024-02-29", "2024-03-01"])
    snapshots.write_snapshot_files(snapshots.document_lines(plans, ["rank"], F.dayofmonth("plan_date") == 29), path)
    assert sorted(p.name for p in (tmp_path / "snaps").iterdir() if not p.name.startswith(".")) == [f"execution_2024-{d}.json" for d in ("02-28", "02-29", "03-01")]
    first = json.loads((tmp_path / "snaps/execution_2024-02-28.json").read_text())
    assert [p["rank"] for p in first] == [1, 2, 3, 4, 5] and len(json.loads((tmp_path / "snaps/execution_2024-02-29.json").read_text())["plans"]) == 5
    back = snapshots.plan_rows(snapshots.decode_snapshots(snapshots.read_snapshot_files(spark, path)))
    assert sorted(tuple(r) for r in back.select("plan_date", "ts_code", "rank", "predicted_buy").collect()) == sorted((str(r.plan_date), r.ts_code, r["rank"], r.predicted_buy) for r in plans.collect())
    # A day written again is replaced, the others stay as they are.
    before = (tmp_path / "snaps/execution_2024-02-28.json").stat().st_mtime_ns
    snapshots.write_snapshot_files(snapshots.document_lines(plans_of(spark, ["2024-03-01"]).filter("rank < 3"), ["rank"]), path)
    assert len(json.loads((tmp_path / "snaps/execution_2024-03-01.json").read_text())) == 2
    assert (tmp_path / "snaps/execution_2024-02-28.json").stat().st_mtime_ns == before


def files_opened(df):
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    leaf = plan.collectLeaves().head()
    return leaf.metrics().apply("numFiles").value()


def test_only_files_of_the_days_asked_for_are_opened(spark, tmp_path):
    for k in range(1, 10):
        (tmp_path / f"execution_2024-01-0{k}.json").write_text("[]")
    path = str(tmp_path)
    assert files_opened(snapshots.read_snapshot_files(spark, path)) == 9
    assert files_opened(snapshots.read_snapshot_files(spark, path, "2024-01-03", "2024-01-04")) == 2
    newest = snapshots.newest_snapshot_files(spark, path, 3)
    assert files_opened(newest) == 3 and sorted(r.plan_date for r in newest.collect()) == ["2024-01-07", "2024-01-08", "2024-01-09"]
    # Names come from the listing; the content is not part of what is read.
    listed = snapshots.snapshot_days(spark, path)
    assert listed.count() == 9 and "content" not in listed._jdf.queryExecution().executedPlan().toString()


def test_days_without_or_with_unreadable_snapshot(spark, tmp_path):
    (tmp_path / "execution_2024-01-05.json").write_text('[{"ts_code": "1", "auction_price": 2.0, "open_action": ""}]')
    (tmp_path / "execution_2024-01-06.json").write_bytes(b"[{\xff\xfe")
    days = spark.sql("SELECT explode(sequence(date'2024-01-04', date'2024-01-06')) AS plan_date")
    decoded = snapshots.decode_snapshots(snapshots.read_snapshot_files(spark, str(tmp_path)))
    got = {(r.plan_date, r.stage): (r.weekday, r.is_weekend, r.has_snapshot, r.done) for r in execution.status_of_days(days, decoded).collect()}
    assert len(got) == 12 and got["2024-01-05", "auction"] == (4, False, True, True) and got["2024-01-05", "opening"] == (4, False, True, False)
    assert {v[2:] for k, v in got.items() if k[0] != "2024-01-05"} == {(False, False)} and got["2024-01-06", "intraday"][1]
    assert decoded.filter("error IS NOT NULL").count() == 1


def test_absent_table_is_empty_but_other_errors_show(spark, tmp_path):
    empty = tables.research_table(spark, str(tmp_path), "watchlist")
    assert empty.columns == ["ts_code", "market", "note", "enabled", "created_at_utc"] and empty.count() == 0
    with pytest.raises(Exception):
        tables.parquet_or_empty(spark, str(tmp_path), "not a schema !")


def test_sql_parameters_are_bound(spark):
    df = spark.createDataFrame([("a",), ("x' OR '1'='1",)], "c string")
    hit = tables.bound_sql(spark, "SELECT c FROM {t} WHERE c = :q", {"t": df}, q="x' OR '1'='1")
    assert [r["c"] for r in hit.collect()] == ["x' OR '1'='1"]


def test_messages_are_priced_while_appended(spark, tmp_path):
    kind = "id bigint, prompt_tokens bigint, output_tokens bigint, created_at_utc timestamp_ntz"
    path = str(tmp_path / "m")
    for day in (1, 1, 2):
        sinks.append_messages(spark.createDataFrame([(day, 1_000_000, None, dt.datetime(2024, 1, day))], kind), path)
    assert sorted((str(r["dt"]), r["cost_usd"]) for r in spark.read.parquet(path).collect()) == [("2024-01-01", 0.27), ("2024-01-01", 0.27), ("2024-01-02", 0.27)]


def test_catch_up_fills_only_missing_days_and_can_repeat(spark, tmp_path):
    path, kind = str(tmp_path / "p"), "ts_code string, market string, close double, loaded_at int, trade_date date"
    day = lambda n: dt.date(2024, 1 + n // 20, 1 + n % 20)
    first = spark.createDataFrame([("1", "a", 1.0, 1, day(n)) for n in (0, 1, 25)], kind)
    sinks.catch_up_prices(spark.createDataFrame([], kind), first, path)
    later = spark.createDataFrame([("1", "a", 9.0, 2, day(n)) for n in (0, 1, 2)] + [("1", "a", 8.0, 1, day(2))], kind)
    for _ in range(2):
        sinks.catch_up_prices(tables.parquet_or_empty(spark, path, kind), later, path)
        got = sorted((r["trade_date"], r["close"]) for r in spark.read.schema(kind).parquet(path).collect())
        assert got == [(day(0), 1.0), (day(1), 1.0), (day(2), 9.0), (day(25), 1.0)]


def test_catch_up_completes_a_day_that_is_stored_in_part(spark, tmp_path):
    path, kind = str(tmp_path / "p"), "ts_code string, market string, close double, loaded_at int, trade_date date"
    day = dt.date(2024, 1, 2)
    sinks.catch_up_prices(spark.createDataFrame([], kind), spark.createDataFrame([("h1", "hk", 1.0, 1, day)], kind), path)
    more = spark.createDataFrame([("h1", "hk", 9.0, 2, day), ("h2", "hk", 2.0, 2, day), ("h1", "a", 3.0, 2, day)], kind)
    sinks.catch_up_prices(tables.parquet_or_empty(spark, path, kind), more, path)
    got = sorted((r["ts_code"], r["market"], r["close"]) for r in spark.read.schema(kind).parquet(path).collect())
    assert got == [("h1", "a", 3.0), ("h1", "hk", 1.0), ("h2", "hk", 2.0)]


def test_appending_a_run_again_adds_nothing(spark, tmp_path):
    run = spark.createDataFrame([(7, dt.date(2024, 1, 5))], "id bigint, trade_date_as_of date")
    entries = spark.createDataFrame([("a", 7), ("b", 7)], "id string, run_id bigint")
    for _ in range(2):
        newest = sinks.append_pick_run(run, entries, str(tmp_path / "r"), str(tmp_path / "e"))
    assert [tuple(r) for r in newest.collect()] == [(7, "b")]
    assert (spark.read.parquet(str(tmp_path / "r")).count(), spark.read.parquet(str(tmp_path / "e")).count()) == (1, 2)


def test_a_run_stored_already_moves_no_entries(spark, tmp_path, monkeypatch):
    run = spark.createDataFrame([(7, dt.date(2024, 1, 5)), (8, dt.date(2024, 2, 5))], "id bigint, trade_date_as_of date")
    entries = spark.createDataFrame([("a", 7, "x"), ("b", 7, "y"), ("c", 8, "z"), ("c", 8, "z")], "id string, run_id bigint, report_json string")
    paths = str(tmp_path / "r"), str(tmp_path / "e")
    sinks.append_pick_run(run, entries.filter("id = 'b'"), *paths)
    sinks.append_pick_run(run, entries, *paths)
    written = []
    monkeypatch.setattr(sinks, "_write_by", lambda *args, **options: written.append(args))
    newest = sinks.append_pick_run(run, entries, *paths)
    assert written == [] and sorted(tuple(r) for r in newest.collect()) == [(7, "b"), (8, "c")]
    assert sorted((r["id"], r["report_json"], r["month"]) for r in spark.read.parquet(paths[1]).collect()) == [("a", "x", "2024-01"), ("b", "y", "2024-01"), ("c", "z", "2024-02"), ("c", "z", "2024-02")]


def test_entries_go_to_their_months_in_turns(spark, tmp_path, monkeypatch):
    """A month is in one turn, also that of no date; the first move's rows are gone afterwards."""
    days = [dt.date(2024, 1, 5), dt.date(2024, 2, 5), dt.date(2024, 3, 5), None]
    run = spark.createDataFrame(list(enumerate(days)), "id bigint, trade_date_as_of date")
    entries = spark.createDataFrame([(f"{i}-{k}", i) for i in range(4) for k in range(3)], "id string, run_id bigint")
    written, write = [], sinks._write_by
    monkeypatch.setattr(sinks, "TURN", 6)
    monkeypatch.setattr(sinks, "_write_by", lambda df, *args: written.append(df.count()) or write(df, *args))
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path / "shared"))
    sinks.append_pick_run(run, entries, str(tmp_path / "r"), str(tmp_path / "e"))
    stored = spark.read.schema("id string, run_id bigint, month string").parquet(str(tmp_path / "e")).collect()
    assert written == [6, 6] and not list((tmp_path / "shared").rglob("*.parquet"))
    assert {(r.id, r.month) for r in stored} == {(f"{i}-{k}", days[i] and f"{days[i]:%Y-%m}") for i in range(4) for k in range(3)} and len(stored) == 12


def test_what_was_shuffled_for_a_pinned_table_is_not_kept(spark):
    """The setting holds while the table is written, and ends with it."""
    before = spark.conf.get(session.SWEEP, None)
    with session.swept(spark):
        assert spark.conf.get(session.SWEEP) == "true"
    rows = spark.range(5).repartition(2, "id")
    assert rows.sparkSession.conf.get(session.SWEEP, None) == before
    with session.lent(rows) as held:
        assert held.count() == 5
        path = held.inputFiles()[0].removeprefix("file://")
    assert not os.path.exists(path) and spark.conf.get(session.SWEEP, None) == before


def test_run_and_entries_share_an_id(spark, tmp_path):
    run = spark.createDataFrame([(7, dt.date(2024, 1, 5))], "id bigint, trade_date_as_of date")
    entries = spark.createDataFrame([("a", 7), ("b", 7), ("c", 8)], "id string, run_id bigint")
    newest = sinks.append_pick_run(run, entries, str(tmp_path / "r"), str(tmp_path / "e"))
    assert [tuple(r) for r in newest.collect()] == [(7, "b")]
    assert sorted((r["id"], r["month"]) for r in spark.read.parquet(str(tmp_path / "e")).collect()) == [("a", "2024-01"), ("b", "2024-01")]


def test_shared_folder_is_the_named_one(spark, monkeypatch):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        assert session.scratch_path(spark, "x").startswith(folder)
    pinned = session.pin(spark.range(5).withColumn("r", F.rand()))
    assert [r["r"] for r in pinned.collect()] == [r["r"] for r in pinned.collect()]


def test_pinned_tables_are_removed_after_a_released_block(spark, tmp_path):
    from pathlib import Path

    outside = session.pin(spark.range(3))
    result = str(tmp_path / "result")
    with session.released(spark) as folder:
        kept = session.pin(spark.range(5))
        with session.released(spark) as inner:
            assert inner.startswith(folder)
            session.pin(spark.range(2)).write.parquet(f"{result}-inner")
        assert not Path(inner).exists() and kept.count() == 5
        kept.join(outside, "id").write.parquet(result)
        assert session.scratch_path(spark, "x").startswith(folder) and Path(folder).is_dir()
    assert not Path(folder).exists()
    assert not session.scratch_path(spark, "x").startswith(folder)
    assert outside.count() == 3 and spark.read.parquet(result).count() == 3 and spark.read.parquet(f"{result}-inner").count() == 2
    with pytest.raises(ValueError), session.released(spark) as failed:
        session.pin(spark.range(1))
        raise ValueError
    assert not Path(failed).exists()
    with session.released(spark):
        pass


def test_stored_panel_reads_the_newest_months_alone(spark, tmp_path):
    from tickerloom.plans import analytics

    schema = "ts_code string, market string, trade_date date, close double"
    path = tmp_path / "p"
    days = spark.sql("SELECT explode(sequence(date'2022-01-01', date'2024-06-30')) AS trade_date")
    bars = days.crossJoin(spark.range(6)).select(F.col("id").cast("string").alias("ts_code"), F.lit("a").alias("market"), "trade_date", F.lit(1.0).alias("close"), F.lit(1).alias("loaded_at"))
    # The newest two days are not complete.
    bars = bars.filter("trade_date < date'2024-06-29' OR id < 2")
    sinks.catch_up_prices(spark.createDataFrame([], f"{schema}, loaded_at int"), bars, str(path))
    # Months that no read may open: they hold no parquet at all.
    for month in path.glob("month=202[23]-*"):
        for file in month.glob("*.parquet"):
            file.write_bytes(b"not a table")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    got = analytics.stored_panel(spark, str(path), schema, 4, 60)
    rows = got.collect()
    assert len(rows) == 360 and max(r.trade_date for r in rows) == dt.date(2024, 6, 28) and min(r.trade_date for r in rows) == dt.date(2024, 4, 30)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert any("month" in p.split("]")[0] for p in plan.split("PartitionFilters: [")[1:])
    with pytest.raises(Exception):
        analytics.stored_panel(spark, str(path), schema, 4, 400).collect()


def test_the_calendar_shows_a_month_of_days(spark, tmp_path):
    start = dt.datetime(2024, 3, 1, 9)
    rows = [(i, start + dt.timedelta(days=i % 12), i % 4, "view", 10.0, "") for i in range(60)]
    spark.createDataFrame(rows, INPUT_SCHEMAS["events"]).write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["q17_execution_calendar"](spark, str(tmp_path)).collect()
    assert sorted(r["plan_date"] for r in got) == [f"2024-03-{d:02d}" for d in range(1, 13)]
