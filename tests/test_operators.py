"""Ordered scans, newest rows, merges, indicators and similarity against plain computations."""

import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickerloom.operators import indicators, merge, newest, ordered, similarity


@pytest.fixture(autouse=True)
def many_chunks(spark):
    """Keep the small test data in several partitions, as large data would be."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def hot_rows(n=4000):
    """A third of all rows has one key."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.34 else f"k{rng.randrange(200)}"
        rows.append((key, rng.randrange(50), i, rng.choice([None, None, f"v{i}"]), rng.randrange(10)))
    return rows


def frame(spark):
    return spark.createDataFrame(hot_rows(), "k string, t int, id int, v string, n int").repartition(6)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_hot_key_is_cut_into_chunks(spark):
    chunks = ordered.ordered_chunks(frame(spark), ["k"], ["t", "id"])
    assert chunks.select(ordered.CHUNK).distinct().count() > 1
    assert chunks.filter("k = 'hot'").select(ordered.CHUNK).distinct().count() > 1


def test_carry_forward_equals_window(spark):
    df = frame(spark)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumn("out", F.last("v", ignorenulls=True).over(w))
    assert rows_of(ordered.carry_forward(df, ["k"], ["t", "id"], "v", "out").na.fill("-"), "k", "id", "out") == rows_of(plain.na.fill("-"), "k", "id", "out")


def test_previous_row_with_and_without_key(spark):
    df = frame(spark)
    for keys in (["k"], []):
        w = Window.partitionBy(*keys).orderBy("t", "id")
        plain = df.withColumn("before", F.lag("id").over(w)).na.fill(-1)
        got = ordered.previous_row(df, keys, ["t", "id"], {"id": "before"}).na.fill(-1)
        assert rows_of(got, "id", "before") == rows_of(plain, "id", "before")


def test_previous_row_keeps_a_null_of_the_row_before(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "id int, v string")
    got = ordered.previous_row(df, [], ["id"], {"v": "p"})
    assert rows_of(got.na.fill("-"), "id", "p") == [(1, "-"), (2, "-"), (3, "x")]


def test_running_total_equals_window(spark):
    df = frame(spark)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumn("s", F.sum("n").over(w))
    assert rows_of(ordered.running_total(df, ["k"], ["t", "id"], "n", "s"), "id", "s") == rows_of(plain, "id", "s")


def test_percent_ranks_equal_window_with_ties_and_nulls(spark):
    rows = [(i, float(i % 7) if i % 5 else None, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    got = ordered.percent_ranks(df, {"a": "ra", "b": "rb"})
    some = df.filter("a IS NOT NULL").withColumn("ra", F.percent_rank().over(Window.orderBy("a")))
    assert rows_of(got.filter("ra IS NOT NULL"), "id", "ra") == rows_of(some, "id", "ra")
    assert got.filter("a IS NULL AND ra IS NOT NULL").count() == 0
    assert rows_of(got, "id", "rb") == rows_of(df.withColumn("rb", F.percent_rank().over(Window.orderBy("b"))), "id", "rb")


def test_percent_rank_of_a_single_value_is_zero(spark):
    df = spark.createDataFrame([(1, 5.0)], "id int, a double")
    assert ordered.percent_ranks(df, {"a": "r"}).first()["r"] == 0.0


def test_newest_row_puts_missing_times_last_and_breaks_ties(spark):
    df = spark.createDataFrame([("a", None, 9), ("a", 1, 1), ("a", 1, 2), ("b", None, 4), ("b", None, 5)], "k string, t int, id int")
    assert rows_of(newest.newest_row(df, ["k"], ["t", "id"]), "k", "id") == [("a", 2), ("b", 5)]


def test_last_rows_limits_before_the_shuffle(spark):
    plan = newest.last_rows(frame(spark), ["k"], ["t", "id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_pages_join_up_to_the_full_sort(spark):
    df = frame(spark)
    order = [F.col("t").desc(), F.col("id")]
    full = [r["id"] for r in df.orderBy(*order).limit(90).collect()]
    pages = [r["id"] for o in (0, 30, 60) for r in newest.page(df, order, 30, o).collect()]
    assert pages == full
    assert [r["position"] for r in newest.numbered(df, order, 5).orderBy("position").collect()] == [1, 2, 3, 4, 5]


def test_upsert_and_delete(spark):
    base = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "c", False)], "id int, note string, enabled boolean")
    changes = spark.createDataFrame([(2, "new"), (3, ""), (4, "x")], "id int, note string")
    rule = {"note": "CASE WHEN c.note <> '' THEN c.note ELSE b.note END", "enabled": "CASE WHEN c.note <> '' THEN true ELSE b.enabled END"}
    got = merge.upsert(base, changes, ["id"], rule, {"enabled": "true"})
    assert rows_of(got, "id", "note", "enabled") == [(1, "a", True), (2, "new", True), (3, "c", False), (4, "x", True)]
    assert rows_of(merge.delete_keys(base, changes, ["id"]), "id") == [(1,)]
    assert rows_of(merge.delete_report(base, changes, ["id"]), "id", "removed") == [(2, True), (3, True), (4, False)]


def bars(spark, closes, code="000001"):
    days = pd.bdate_range("2024-01-01", periods=len(closes)).date
    rows = [("a", code, d, float(c), float(c) + 1, float(c) - 1) for d, c in zip(days, closes)]
    return spark.createDataFrame(rows, "market string, ts_code string, trade_date date, close double, high double, low double")


def test_macd_recursion(spark):
    rng = random.Random(3)
    closes = [100 + rng.uniform(-5, 5) for _ in range(60)]
    fast = slow = closes[0]
    dea, want = 0.0, []
    for i, c in enumerate(closes):
        if i:
            fast, slow = fast * 11 / 13 + c * 2 / 13, slow * 25 / 27 + c * 2 / 27
            dea = dea * 0.8 + (fast - slow) * 0.2
        want.append((round(fast - slow, 8), round(dea, 8)))
    got = [(round(r["dif"], 8), round(r["dea"], 8)) for r in indicators.macd(bars(spark, closes)).orderBy("trade_date").collect()]
    assert got == want


@pytest.mark.parametrize(("n", "block"), [(1, 4), (7, 4), (500, 4), (500, 128)])
def test_a_series_in_many_chunks_and_blocks_is_smoothed_as_in_one_pass(spark, n, block):
    rng = random.Random(n)
    values = {"hot": [rng.uniform(0, 9) for _ in range(n)], "few": [rng.uniform(0, 9) for _ in range(3)]}
    rows = [(k, i, v, "extra") for k, vs in values.items() for i, v in enumerate(vs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, u double, note string")
    means = {"plain": ("u", 0.9, None), "seeded": ("u", 0.5, 50.0)}
    want = {}
    for k, vs in values.items():
        a, b = vs[0], 50.0
        for i, v in enumerate(vs):
            a, b = (a if i == 0 else a * 0.9 + v * 0.1), b * 0.5 + v * 0.5
            want[k, i] = (pytest.approx(a, rel=1e-12), pytest.approx(b, rel=1e-12), "extra")
    for chunked in (True, False):
        got = ordered.smoothed(df, ["k"], ["i"], means, chunked, block)
        if chunked and n == 500:
            assert got.filter("k = 'hot'").select(ordered.CHUNK).distinct().count() > 1
        found = got.collect()
        assert len(found) == len(rows) and {(r.k, r.i): (r.plain, r.seeded, r.note) for r in found} == want


def test_kdj_recursion_and_flat_prices(spark):
    rng = random.Random(4)
    closes = [50 + rng.uniform(-5, 5) for _ in range(30)]
    k = d = 50.0
    want = []
    for i, c in enumerate(closes):
        span = closes[max(0, i - 8): i + 1]
        low, high = min(span) - 1, max(span) + 1
        k = k * 2 / 3 + (c - low) / (high - low) * 100 / 3
        d = d * 2 / 3 + k / 3
        want.append((round(k, 6), round(d, 6)))
    got = [(round(r["k"], 6), round(r["d"], 6)) for r in indicators.kdj(bars(spark, closes)).orderBy("trade_date").collect()]
    assert got == want
    flat = bars(spark, [5.0] * 4).withColumn("high", F.lit(5.0)).withColumn("low", F.lit(5.0))
    assert {round(r["k"], 9) for r in indicators.kdj(flat).collect()} == {50.0}


def test_closest_vectors_equal_brute_force_in_both_forms(spark):
    rng = random.Random(5)
    rows = [(i % 3, i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(90)] + [(0, -1, [0.0] * 8)]

    def cosine(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y))
        return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5

    want = set()
    for label in range(3):
        own = sorted((r for r in rows if r[0] == label), key=lambda r: r[1])
        scored = sorted(((round(cosine(r[2], own[-1][2]), 6), r[1]) for r in own[:-1] if any(r[2])), reverse=True)[:4]
        want |= {(label, ident, place) for place, (_, ident) in enumerate(scored, 1)}
    df = spark.createDataFrame(rows, "label int, id int, v array<double>")
    for bounded in (False, True):
        got = similarity.closest_to_newest(df, ["label"], "id", "v", 4, bounded=bounded)
        assert {(r["label"], r["id"], r["place"]) for r in got.collect()} == want
