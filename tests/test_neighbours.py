"""Neighbours across keys against comparing all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import neighbours
from tickerloom.sources.tables import input_table


def exact(ids, v, asked, k):
    """{asked id: [(neighbour, similarity)]}, equal vectors as one named by the smallest id."""
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    _, first, entry = np.unique(unit, axis=0, return_index=True, return_inverse=True)
    name = np.array([ids[entry == e].min() for e in range(len(first))])
    u = unit[first]
    out = {}
    for i in asked:
        own = entry[np.flatnonzero(ids == i)[0]]
        near = np.round(u @ u[own], 6)
        order = [e for e in np.lexsort((name, -near)) if e != own][:k]
        out[int(i)] = [(int(name[e]), float(near[e])) for e in order]
    return out


def table(spark, ids, v):
    return spark.createDataFrame([(int(i), [float(x) for x in e]) for i, e in zip(ids, v, strict=True)], "vec_id bigint, embedding array<double>")


def found(df):
    out = {}
    for r in df.orderBy("vec_id", "position").collect():
        out.setdefault(r.vec_id, []).append((r.neighbour, r.similarity))
    return out


@pytest.mark.parametrize("block", [neighbours.BLOCK, 7])
def test_with_all_cells_probed_every_neighbour_is_found(spark, monkeypatch, block):
    r = np.random.default_rng(2)
    monkeypatch.setattr(neighbours.compared, "__defaults__", (block,))
    v = r.normal(size=(300, 8)).round(1)
    v[100:140] = v[3]  # copies share an entry
    ids = np.arange(300)
    df = table(spark, ids, v)
    extra = spark.createDataFrame([(1000, [0.0] * 8), (1001, None)], df.schema)
    got = neighbours.vector_neighbours(df.union(extra), df.filter("vec_id % 20 = 0"), "vec_id", "embedding", 5, probes=100)
    want = exact(ids, v, ids[::20], 5)
    assert {i: [(n, pytest.approx(s)) for n, s in x] for i, x in want.items()} == found(got)
    assert {r.copies for r in got.filter("neighbour = 3").collect()} <= {41}


def test_recall_on_the_given_vectors(spark):
    e = input_table(spark, "/root/testdata/sf0.01", "embeddings")
    got = found(neighbours.vector_neighbours(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding"))
    rows = e.collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = exact(ids, v, [i for i in ids if i % 20 == 0], 10)
    assert got.keys() == want.keys()
    hits = sum(len({n for n, _ in got[i]} & {n for n, _ in x}) for i, x in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert neighbours.vector_neighbours(none, none, "vec_id", "embedding").isEmpty()


def test_grid_finds_all_and_leaves_cells_out(spark):
    r = np.random.default_rng(6)
    v = np.cumsum(r.normal(size=(6000, 10)), axis=1)
    v -= v.mean(axis=1, keepdims=True)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[50:90] = v[7]
    group, place = np.arange(6000) % 25, np.arange(6000) // 25
    rows = spark.createDataFrame([(int(g), int(p), [float(x) for x in e]) for g, p, e in zip(group, place, v, strict=True)], "group bigint, place bigint, v array<double>")
    asks = rows.filter("place = 239").select(F.col("group").alias("ask"), F.col("group").alias("ask_group"), F.lit(229).cast("long").alias("ask_upto"), F.col("v").alias("q"))
    got, looked = neighbours.exact_neighbours(rows, asks, 5, ["place", "group"], enough=100)
    result = {}
    for x in got.orderBy("ask", "position").collect():
        result.setdefault(x.ask, []).append((x.place, x.group, x.similarity))
    for ask in range(25):
        own = v[group == ask][place[group == ask] == 239][0]
        near = np.round(v @ own, 6)
        near[(group == ask) & (place > 229)] = -2
        order = np.lexsort((group, place, -near))[:5]
        assert result[ask] == [(place[i], group[i], pytest.approx(near[i])) for i in order]
    pairs = looked.agg(F.sum(F.col("rows") * F.col("asks"))).first()[0]
    assert pairs < 0.5 * 6000 * 25


def test_segment_means_bound_the_distance():
    r = np.random.default_rng(1)
    v = r.normal(size=(400, 10))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    means = neighbours.segment_means(v, 5)
    cells, of = np.unique(neighbours._grid(means), return_inverse=True)
    gap = neighbours._gaps(means, cells)
    true = ((v[:, None] - v[None]) ** 2).sum(axis=2)
    assert all(gap[i, of[j]] <= true[i, j] + 1e-9 for i in range(400) for j in range(400))


def test_a_crowded_grid_cell_is_cut_into_boxes(spark):
    """Vectors that differ less than a grid cell is wide: all neighbours are found, and few of the pairs are compared."""
    r = np.random.default_rng(8)
    v = np.tile([0.2, 0.2, -0.2, -0.2], 3)[:10] + 0.05 * r.normal(size=(8000, 3)) @ r.normal(size=(3, 10))
    v -= v.mean(axis=1, keepdims=True)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[300:900] = v[7]  # a cut cannot part these
    group, place = np.arange(8000) % 40, np.arange(8000) // 40
    rows = spark.createDataFrame([(int(g), int(p), [float(x) for x in e]) for g, p, e in zip(group, place, v, strict=True)], "group bigint, place bigint, v array<double>")
    asks = rows.filter("place = 199").select(F.col("group").alias("ask"), F.col("group").alias("ask_group"), F.lit(189).cast("long").alias("ask_upto"), F.col("v").alias("q"))
    got, looked = neighbours.exact_neighbours(rows, asks, 5, ["place", "group"], enough=100)
    result = {}
    for x in got.orderBy("ask", "position").collect():
        result.setdefault(x.ask, []).append((x.place, x.group, x.similarity))
    for ask in range(40):
        near = np.round(v @ v[199 * 40 + ask], 6)
        near[(group == ask) & (place > 189)] = -2
        order = np.lexsort((group, place, -near))[:5]
        assert result[ask] == [(place[i], group[i], pytest.approx(near[i])) for i in order]
    pairs, cells = looked.agg(F.sum(F.col("rows") * F.col("asks")), F.count("*")).first()
    assert pairs < 0.2 * 8000 * 40 and cells > 30


def test_no_rows_to_be_near_to(spark):
    rows = spark.createDataFrame([], "group bigint, place bigint, v array<double>")
    asks = spark.createDataFrame([(1, 1, 0, [0.6, -0.8])], "ask bigint, ask_group bigint, ask_upto bigint, q array<double>")
    assert neighbours.exact_neighbours(rows, asks, 5, ["place", "group"], segments=1)[0].isEmpty()


def test_rows_in_boxes_do_not_need_the_first_copy(spark):
    """Found the same after the rows that were put into boxes are gone from the disk."""
    from tickerloom.session import lent

    r = np.random.default_rng(8)
    rows = [(int(g), int(p), [float(x) for x in v / np.linalg.norm(v)]) for g in range(6) for p, v in enumerate(r.normal(size=(40, 10)))]
    frame = spark.createDataFrame(rows, "group bigint, place bigint, v array<double>")
    asked = frame.filter("place = 39").select(F.col("group").alias("ask"), F.col("group").alias("ask_group"), F.lit(29).cast("long").alias("ask_upto"), F.col("v").alias("q"))
    want = sorted(tuple(x) for x in neighbours.exact_neighbours(frame, asked, 3, ["place", "group"])[0].collect())
    with lent(frame) as held:
        places = neighbours.settled(held, asked.select("*"), enough=20)
    assert sorted(tuple(x) for x in neighbours.found_in(places, 3, ["place", "group"])[0].collect()) == want and len(want) == 18
