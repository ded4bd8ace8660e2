"""Most similar vectors of other keys: rows dealt into cells, of which a question looks at few.

Cells come from k-means on a bounded sample (``vector_neighbours``, a few cells
per question, nearly all neighbours found) or from a grid over segment means
(``exact_neighbours``, as many cells as a lower bound asks for, all found; a
crowded one is cut further, so that cells get smaller as rows get more).
What meets in a cell is cut into blocks on both sides, so no task holds more
than a block of rows and one of questions, however large a cell is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.operators.newest import last_rows
from tickerloom.operators.similarity import dot, let
from tickerloom.session import pin

BLOCK = 4096  # rows, and questions, of one comparison
BINS, WIDTH = 8, 0.25  # of a segment mean, which lies between -1 and 1
ROUNDING = 1e-6


def unit(vector: Column) -> Column:
    """The vector at length one; null if it has no direction."""
    v = vector.cast("array<double>")
    return let(F.sqrt(dot(v, v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)))


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy().reshape(len(values), -1) if len(values) else np.zeros((0, 1))


def _kind(field) -> str:
    return f"`{field.name}` {field.dataType.simpleString()}"


def compared(rows: DataFrame, asks: DataFrame, k: int, ties: list[str], block: int = BLOCK) -> DataFrame:
    """The ``k`` most similar rows of each question in each cell and block: (ask columns, row columns, similarity).

    ``rows``: cell, unit vector ``v`` and further columns, by whose ``ties``
    equal similarities (to 6 digits) are ordered; ``asks``: cell, unit vector
    ``q`` and further columns, all starting with ``ask``.  A row is not held
    against a question whose ``ask_group`` is its ``group``, unless its
    ``place`` is at most the question's ``ask_upto``.
    """
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    questions = asks.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("_asks"))
    both = sizes.join(questions, "cell")
    deal = lambda n: F.pmod(F.xxhash64(*[F.col(c) for c in ties]), F.col(n)).cast("int")
    left = rows.join(both, "cell").withColumn("_b", deal("_blocks")).withColumn("_a", F.explode(F.sequence(F.lit(0), F.col("_asks") - 1))).drop("_blocks", "_asks")
    right = asks.join(both, "cell").withColumn("_a", F.pmod(F.xxhash64("ask"), F.col("_asks")).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks", "_asks")
    told = [f for f in asks.schema.fields if f.name == "ask"] + [f for f in rows.schema.fields if f.name not in ("cell", "v")]
    schema = ", ".join([*map(_kind, told), "similarity double"])

    def run(some: pa.Table, asked: pa.Table) -> pa.Table:
        some = some.sort_by([(t, "ascending") for t in ties])
        v = _matrix(some.column("v"))
        group, place = some.column("group").to_numpy(), some.column("place").to_numpy()
        ask_group, upto = asked.column("ask_group").to_numpy(), asked.column("ask_upto").to_numpy()
        which, whose, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        q = _matrix(asked.column("q"))
        for i in range(0, len(q) if len(v) else 0, 256):
            near = np.round(q[i : i + 256] @ v.T, 6)
            near[(group[None, :] == ask_group[i : i + 256, None]) & (place[None, :] > upto[i : i + 256, None])] = -np.inf
            for j, line in enumerate(near):
                least = -np.inf if len(line) <= k else np.partition(line, len(line) - k)[len(line) - k]
                good = np.flatnonzero((line >= least) & (line > -np.inf))
                # Rows stand in the order of their ties, and the sort keeps that.
                good = good[np.argsort(-line[good], kind="stable")[:k]]
                which.append(np.full(len(good), i + j))
                whose.append(good)
                value.append(line[good])
        out = {"ask": asked.column("ask").take(pa.array(np.concatenate(which)))}
        for f in told[1:]:
            out[f.name] = some.column(f.name).take(pa.array(np.concatenate(whose)))
        return pa.table({**out, "similarity": pa.array(np.concatenate(value))})

    return left.groupBy("cell", "_b", "_a").cogroup(right.groupBy("cell", "_b", "_a")).applyInArrow(run, schema)


def _best(found: DataFrame, k: int, ties: list[str]) -> DataFrame:
    order = found.withColumn("_o", F.struct("similarity", *[(-F.col(t)).alias(f"_{t}") for t in ties]))
    return last_rows(order, ["ask"], ["_o"], k, "position").drop("_o")


# ---------------------------------------------------------------- k-means cells
def centres(vectors: DataFrame, cells: int, sample: int = 16_384, rounds: int = 12) -> np.ndarray:
    """Cell centres by k-means over directions, from at most ``sample`` vectors chosen by hash from all rows."""
    picked = vectors.orderBy(F.xxhash64("v"), "v").select("v").limit(sample).toArrow()
    points = _matrix(picked.column("v"))
    if not len(points):
        return np.zeros((0, 1))
    out = points[:: max(1, len(points) // cells)][:cells].copy()
    for _ in range(rounds):
        nearest = np.argmax(points @ out.T, axis=1)
        total = np.zeros_like(out)
        np.add.at(total, nearest, points)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        out = np.where(length > 0, total / np.where(length > 0, length, 1), out)
    return out


def _celled(df: DataFrame, vector: str, means: np.ndarray, probes: int) -> DataFrame:
    """``df`` once for each of the ``probes`` cells nearest to its vector."""
    shared = df.sparkSession.sparkContext.broadcast(means)  # most_cells rows at most
    schema = ", ".join([*map(_kind, df.schema.fields), "cell long"])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near = _matrix(batch.column(vector)) @ shared.value.T
            n = min(probes, near.shape[1])
            cell = np.argpartition(-near, n - 1, axis=1)[:, :n]
            rows = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), n)))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell.ravel().astype(np.int64))], names=[*rows.schema.names, "cell"])

    return df.mapInArrow(run, schema)


def probes_for(rows: DataFrame, questions: DataFrame, means: np.ndarray, k: int, recall: float, tried: int = 64) -> int:
    """The fewest cells to look at that find a share ``recall`` of the true neighbours of ``tried`` questions, chosen by hash.

    Those few questions are held against all rows; what comes to the driver is
    their ``k`` neighbours' cells.
    """
    some = pin(questions.orderBy(F.xxhash64("ask"), "ask").limit(tried))
    true = _best(compared(rows.withColumn("home", F.col("cell")), _celled(some, "q", means, len(means)), k, ["neighbour"]), k, ["neighbour"])
    asked = some.select("ask", "q").toArrow()
    order = np.argsort(-(_matrix(asked.column("q")) @ means.T), axis=1)
    rank = {a: np.argsort(o) for a, o in zip(asked.column("ask").to_pylist(), order, strict=True)}
    places = sorted(int(rank[r.ask][r.home]) for r in true.select("ask", "home").collect())
    return places[max(0, int(np.ceil(recall * len(places))) - 1)] + 1 if places else 1


def vector_neighbours(
    vectors: DataFrame, asked: DataFrame, key: str, vector: str, k: int = 10, recall: float = 0.95, probes: int | None = None, most_cells: int = 4096, sample: int = 16_384
) -> DataFrame:
    """(ask, neighbour, copies, similarity, position): the ``k`` vectors most like that of each id in ``asked``, of all keys.

    Every row is in the index; equal vectors are one entry, named by the
    smallest id, with the number of its ``copies``, and an id's own entry is
    left out.  Vectors without direction are in no cell.  There are about
    ``sqrt`` as many cells as entries, at most ``most_cells``; each question
    looks at the nearest ``probes`` of them, by default as many as find
    ``recall`` of the true neighbours of some questions.  Vectors that
    lie in no clusters need most cells for that.  Similarity is exact, to 6
    digits, ties go to the smaller id.
    """
    entries = vectors.select(F.col(key).cast("long").alias("id"), unit(F.col(vector)).alias("v")).filter("v IS NOT NULL AND id IS NOT NULL")
    distinct = pin(entries.groupBy("v").agg(F.min("id").alias("neighbour"), F.count("*").alias("copies")))
    number = distinct.count()
    means = centres(distinct, max(1, min(most_cells, int(number**0.5))), sample)
    if not len(means):
        means = np.zeros((1, 1))
    rows = pin(_celled(distinct.withColumns({"group": F.col("neighbour"), "place": F.lit(1).cast("long")}), "v", means, 1))
    named = entries.join(asked.select(F.col(key).cast("long").alias("id")).distinct(), "id", "left_semi")
    # Ids with equal vectors ask once.
    own = pin(named.select(F.col("id").alias("_id"), "v").join(distinct.select("v", "neighbour"), "v").select("_id", "neighbour", "v"))
    questions = own.groupBy("neighbour").agg(F.first("v").alias("q")).withColumnsRenamed({"neighbour": "ask"})
    questions = pin(questions.withColumns({"ask_group": F.col("ask"), "ask_upto": F.lit(0).cast("long")}))
    if probes is None:
        probes = probes_for(rows, questions, means, k, recall)
    found = _best(compared(rows, pin(_celled(questions, "q", means, probes)), k, ["neighbour"]), k, ["neighbour"])
    back = own.select(F.col("_id").alias(key), F.col("neighbour").alias("ask"))
    return back.join(found, "ask").select(key, "neighbour", "copies", "similarity", "position")


# ---------------------------------------------------------------- grid cells and a lower bound
def segment_means(v: np.ndarray, segments: int) -> np.ndarray:
    """Means of equal stretches, scaled so that their distance is at most that of the vectors."""
    n = v.shape[1] // segments
    return v[:, : n * segments].reshape(len(v), segments, n).mean(axis=2) * n**0.5


def _grid(means: np.ndarray) -> np.ndarray:
    bins = np.clip(np.floor((means + 1) / WIDTH), 0, BINS - 1).astype(np.int64)
    return bins @ (BINS ** np.arange(means.shape[1]))


def _gaps(means: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Squared distance between segment means and the boxes of cells: no vector in a cell is nearer."""
    low = np.stack([(cells // BINS**j) % BINS for j in range(means.shape[1])], axis=1) * WIDTH - 1
    out = np.zeros((len(means), len(cells)))
    for j in range(means.shape[1]):
        x = means[:, j : j + 1]
        out += np.maximum(np.maximum(low[None, :, j] - x, x - low[None, :, j] - WIDTH), 0) ** 2
    return out


def gridded(df: DataFrame, segments: int) -> DataFrame:
    """``df`` with ``cell``, that of the segment means of its unit vector ``v``."""
    schema = ", ".join([*map(_kind, df.schema.fields), "cell long"])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cell = _grid(segment_means(_matrix(batch.column("v")), segments))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class Boxes:
    """Grid cells (``cells``, ``roots``) cut into boxes: nodes with the dimension and the place of their cut (-1: a box), and the nodes on both sides."""

    segments: int
    cells: np.ndarray
    roots: np.ndarray
    dim: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def of(self, v: np.ndarray) -> np.ndarray:
        """The box of each vector."""
        x = _turned(v, self.segments)
        node = self.roots[np.searchsorted(self.cells, _grid(x[:, : self.segments]))]
        while (self.dim[node] >= 0).any():
            dim = self.dim[node]
            side = np.where(x[np.arange(len(x)), dim] < self.cut[node], self.below[node], self.above[node])
            node = np.where(dim >= 0, side, node)
        return node


def _turned(v: np.ndarray, segments: int) -> np.ndarray:
    """The segment means and, at right angles to them, what they leave out; distances stay the same."""
    width = v.shape[1]
    n = width // segments
    means = np.zeros((width, segments))
    means[np.arange(segments * n), np.arange(segments * n) // n] = n**-0.5
    return np.hstack([segment_means(v, segments), v @ np.linalg.qr(means, mode="complete")[0][:, segments:]])


def boxes(cells: np.ndarray, count: np.ndarray, sample: np.ndarray, segments: int, most: int) -> Boxes:
    """Cells of more than about ``most`` of their ``count`` rows are halved at medians of a sample of all rows, across the widest dimension."""
    x = _turned(sample, segments) if len(sample) else np.zeros((0, segments))
    home = _grid(x[:, :segments])
    order = np.argsort(home, kind="stable")
    start, end = np.searchsorted(home[order], cells, "left"), np.searchsorted(home[order], cells, "right")
    dims = x.shape[1]
    dim, cut, below, above, low, high = [], [], [], [], [], []

    def node(lo, hi) -> int:
        for column, value in ((dim, -1), (cut, 0.0), (below, -1), (above, -1), (low, lo), (high, hi)):
            column.append(value)
        return len(dim) - 1

    roots = []
    for i, cell in enumerate(cells):
        lo, hi = np.full(dims, -np.inf), np.full(dims, np.inf)
        lo[:segments] = (cell // BINS ** np.arange(segments)) % BINS * WIDTH - 1
        # The means may pass the outer edges by a rounding error.
        hi[:segments] = lo[:segments] + WIDTH
        roots.append(node(lo, hi))
        todo = [(roots[-1], order[start[i] : end[i]], float(count[i]))]
        while todo:
            at, some, rows = todo.pop()
            if rows <= most or len(some) < 4:
                continue
            spread = x[some].max(axis=0) - x[some].min(axis=0)
            d = int(np.argmax(spread))
            if spread[d] <= ROUNDING:
                continue
            values = np.sort(x[some, d])
            place = values[len(values) // 2]
            if place == values[0]:
                place = values[np.searchsorted(values, place, "right")]
            left = x[some, d] < place
            dim[at], cut[at] = d, place
            lo, hi = low[at], high[at]
            below[at] = node(lo, np.where(np.arange(dims) == d, np.minimum(hi, place), hi))
            above[at] = node(np.where(np.arange(dims) == d, np.maximum(lo, place), lo), hi)
            todo += [(below[at], some[left], rows * left.mean()), (above[at], some[~left], rows * (1 - left.mean()))]
    return Boxes(segments, cells, np.array(roots, np.int64), *(np.array(c) for c in (dim, cut, below, above)), np.array(low), np.array(high))


def _boxed(df: DataFrame, shared) -> DataFrame:
    """``df`` with ``cell``, the box of its unit vector ``v``."""
    schema = ", ".join([*map(_kind, df.schema.fields), "cell long"])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.of(_matrix(batch.column("v"))))], names=[*batch.schema.names, "cell"])

    return df.mapInArrow(run, schema)


def _looked_at(asks: DataFrame, shared, table: tuple[np.ndarray, np.ndarray], enough: int, second: bool) -> DataFrame:
    """``asks`` once for each box to look at: first the nearest ones that hold ``enough`` rows, then all others within ``reach``."""
    held = asks.sparkSession.sparkContext.broadcast(table)  # boxes with rows, in order, and their rows
    kept = [f for f in asks.schema.fields if f.name != "reach"]
    schema = ", ".join([*map(_kind, kept), "cell long"])

    def run(batches):
        tree, (box, count) = shared.value, held.value
        if not len(box):
            return
        # Boxes were numbered cell by cell, so those of a cell stand together.
        home = np.searchsorted(tree.roots, box, "right") - 1
        start, end = np.searchsorted(home, np.arange(len(tree.roots)), "left"), np.searchsorted(home, np.arange(len(tree.roots)), "right")
        total = np.add.reduceat(np.append(count, 0), start) * (end > start)
        low, high = tree.low[box], tree.high[box]

        def within(cells: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The boxes of some cells and the squared distance to them."""
            which = np.concatenate([np.zeros(0, np.int64), *(np.arange(start[c], end[c]) for c in cells)])
            return which, (np.maximum(np.maximum(low[which] - x, x - high[which]), 0) ** 2).sum(axis=1)

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                q = _matrix(part.column("q"))
                turned, gaps = _turned(q, tree.segments), _gaps(segment_means(q, tree.segments), tree.cells)
                reach = part.column("reach").to_numpy(zero_copy_only=False)
                ask, looked = [], []
                for j, gap in enumerate(gaps):
                    order = np.argsort(gap, kind="stable")
                    before = np.cumsum(total[order]) - total[order]
                    which, far = within(order[before < enough], turned[j])
                    nearest = np.argsort(far, kind="stable")
                    which = which[nearest]
                    first = which[np.cumsum(count[which]) - count[which] < enough]
                    if second:
                        which, far = within(np.flatnonzero(gap <= reach[j]), turned[j])
                        first = np.setdiff1d(which[far <= reach[j]], first, assume_unique=True)
                    ask.append(np.full(len(first), j))
                    looked.append(box[first])
                rows = part.take(pa.array(np.concatenate(ask)))
                yield pa.RecordBatch.from_arrays([*[rows.column(f.name) for f in kept], pa.array(np.concatenate(looked))], names=[*(f.name for f in kept), "cell"])

    return asks.mapInArrow(run, schema)


def exact_neighbours(rows: DataFrame, asks: DataFrame, k: int, ties: list[str], segments: int = 5, enough: int = 512, sample: int = 131_072) -> tuple[DataFrame, DataFrame]:
    """The ``k`` rows most like each question, of all keys, and (cell, rows, asks) of what was compared.

    ``rows`` and ``asks`` as in ``compared``, without cells.  The nearest cells
    give each question ``k`` rows; the farthest of those bounds the distance
    of any better row, and so the cells that are left to look at.  A question
    with fewer than ``k`` rows so far looks at all.  Cells are those of a grid,
    crowded ones cut into boxes of about ``enough`` rows, as far as some
    ``sample`` rows, chosen by hash from all, tell where: they decide
    how many cells are looked at, not what is found.
    """
    return found_in(settled(rows, asks, segments, enough, sample), k, ties)


@dataclass(frozen=True)
class Settled:
    """Pinned rows and questions, the boxes (broadcast), which of them hold how many rows, and how many are enough at first."""

    rows: DataFrame
    asks: DataFrame
    boxes: Broadcast
    held: tuple[np.ndarray, np.ndarray]
    enough: int


def settled(rows: DataFrame, asks: DataFrame, segments: int = 5, enough: int = 512, sample: int = 131_072) -> Settled:
    """Every row in its box, as in ``exact_neighbours``; ``rows`` and ``asks`` themselves are not read after this."""
    # At most BINS ** segments cells, whatever the rows.
    table = gridded(rows.select("v"), segments).groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").toArrow()
    cells, count = table.column("cell").to_numpy(), table.column("n").to_numpy()
    picked = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "v"]), F.lit(1 << 40)) < int((1 << 40) * min(1.0, sample / max(1, count.sum())))
    some = rows.filter(picked).select("v").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(boxes(cells, count, _matrix(some.column("v")), segments, enough))
    rows = pin(_boxed(rows, shared))
    # Not many more boxes than cells or a quarter of the sample.
    table = rows.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").toArrow()
    held = table.column("cell").to_numpy(), table.column("n").to_numpy()
    return Settled(rows, pin(asks), shared, held, enough)


def found_in(places: Settled, k: int, ties: list[str]) -> tuple[DataFrame, DataFrame]:
    """What ``exact_neighbours`` returns, of rows in their boxes."""
    rows, asks, shared, held, enough = places.rows, places.asks, places.boxes, places.held, places.enough
    near = pin(_looked_at(asks.withColumn("reach", F.lit(0.0)), shared, held, enough, False))
    first = pin(_best(compared(rows, near, k, ties), k, ties))
    kth = first.groupBy("ask").agg(F.when(F.count("*") == k, F.min("similarity")).alias("_least"))
    reach = F.coalesce(2.0 - 2.0 * F.col("_least") + 2 * ROUNDING, F.lit(9.0))
    bounded = asks.join(kth, "ask", "left").withColumn("reach", reach).drop("_least")
    far = pin(_looked_at(bounded, shared, held, enough, True))
    found = _best(first.drop("position").union(compared(rows, far, k, ties)), k, ties)
    asked = near.select("cell").union(far.select("cell")).groupBy("cell").agg(F.count("*").alias("asks"))
    return found, rows.groupBy("cell").agg(F.count("*").alias("rows")).join(asked, "cell", "left").na.fill(0, ["asks"])
