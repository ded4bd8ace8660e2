"""Stored keyed tables: what a change set rewrites and what it leaves alone."""

from pyspark.sql import functions as F

from tickerloom.operators.merge import delete_keys, upsert
from tickerloom.plans import watchlist
from tickerloom.sources.stored import KeyedTable


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def put(stored, changes):
    return upsert(stored, changes, ["k"], {"v": "c.v"}, {})


def table_of(spark, path, n=500, buckets=16):
    table = KeyedTable(spark, str(path), "k bigint, v string", ["k"], buckets)
    table.change(spark.range(n).select(F.col("id").alias("k"), F.lit("old").alias("v")), put)
    return table


def changed(before, after):
    return {name.split("/")[0] for name in before.keys() ^ after.keys()}


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = table_of(spark, tmp_path / "t")
    before = files(tmp_path / "t")
    assert len({n.split("/")[0] for n in before}) == 16
    changes = spark.createDataFrame([(3, "new"), (1000, "fresh")], "k bigint, v string")
    table.change(changes, put)
    after = files(tmp_path / "t")
    assert 1 <= len(changed(before, after)) <= 2
    assert all(before[n] == after[n] for n in before.keys() & after.keys())
    rows = {r.k: r.v for r in table.read().collect()}
    assert len(rows) == 501 and rows[3] == "new" and rows[1000] == "fresh" and rows[4] == "old"
    # The same change set once more, and one that says what is stored, write nothing.
    table.change(changes, put)
    table.change(spark.createDataFrame([(4, "old")], "k bigint, v string"), put)
    table.change(changes.limit(0), put)
    assert files(tmp_path / "t") == after


def test_a_bucket_that_loses_all_rows_goes(spark, tmp_path):
    table = table_of(spark, tmp_path / "t", n=3, buckets=64)
    assert len(files(tmp_path / "t")) == 3
    doomed = spark.createDataFrame([(1,), (77,)], "k bigint")
    table.change(doomed, lambda stored, d: delete_keys(stored, d, ["k"]))
    assert sorted(r.k for r in table.read().collect()) == [0, 2] and len(files(tmp_path / "t")) == 2
    table.change(doomed, lambda stored, d: delete_keys(stored, d, ["k"]))
    assert table.read().count() == 2


def test_lookup_reads_the_buckets_of_its_keys(spark, tmp_path):
    table = table_of(spark, tmp_path / "t", n=2000, buckets=32)
    found = table.lookup(spark.createDataFrame([(7,), (7,), (9999,)], "k bigint"))
    assert [(r.k, r.v) for r in found.collect()] == [(7, "old")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_watchlist_rows_survive_as_the_merge_says(spark, tmp_path):
    kind = "ts_code string, market string, note string, enabled boolean, created_at_utc timestamp_ntz"
    table = KeyedTable(spark, str(tmp_path / "w"), kind, watchlist.KEY, 8)
    ask = spark.createDataFrame([("000001", "a", ""), ("000001", "hk", "x"), ("000002", "a", None)], "ts_code string, market string, note string").withColumn("created_at_utc", F.lit("2024-01-01").cast("timestamp_ntz"))
    table.change(ask, watchlist.add)
    table.change(ask.withColumn("note", F.lit("later")).filter("market = 'hk'"), watchlist.add)
    got = {(r.ts_code, r.market): (r.note, r.enabled) for r in table.read().collect()}
    assert got == {("000001", "a"): ("", True), ("000001", "hk"): ("later", True), ("000002", "a"): (None, True)}
