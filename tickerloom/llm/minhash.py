"""Near-duplicate groups: banded MinHash for candidates, Odd sketches to screen them, full sets to confirm them.

A document is a set of word shingles.  Documents with equal sets form a class
and only one of each class goes on.  Classes that agree on a band of MinHash
values are candidates; each candidate pair is screened by its Odd sketches
(parity bitmaps of the MinHash samples, whose XOR tells how many samples
differ) and then confirmed on the whole sets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.bytetext import Texts, Words, chunks, mix, windows
from tickerloom.llm.components import connected
from tickerloom.session import pin


# Classes of a bucket that are compared at a time.
CHUNK = 384


@dataclass(frozen=True)
class Settings:
    """``percent``: link pairs whose Jaccard similarity is at least this.

    With 20 bands of 4 values a pair at 0.8 is missed 26 times in a million, one
    at 0.85 once in two million.
    The screen lets a pair pass unless its sketches differ by ``deviations``
    standard deviations more than those of a pair at the limit would.
    """

    width: int = 5
    percent: int = 80
    bands: int = 20
    rows: int = 4
    bins: int = 2048  # bins of the sketch's MinHash samples and bits of the sketch
    deviations: float = 4.5

    @property
    def words(self) -> int:
        return self.bins // 64


def shingle_sets(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as 64-bit values in ascending order, and where each text's begin."""
    keys, owner, _ = windows(Words(texts, lower=True), width, short_as_one=True)
    bits = np.uint64(max(1, int(texts.n - 1).bit_length()))
    # Owner in front, so that one plain sort orders all sets at once.
    tagged = (owner.astype(np.uint64) << (np.uint64(64) - bits)) | (keys >> bits)
    tagged.sort()
    if len(tagged):
        tagged = tagged[np.concatenate(([True], tagged[1:] != tagged[:-1]))]
    at = np.searchsorted(tagged, np.arange(texts.n, dtype=np.uint64) << (np.uint64(64) - bits))
    # The owner's bits are dropped again and the rest brought to one width for every chunk.
    values = (tagged << bits) >> np.uint64(16)
    return values, np.append(at, len(tagged))


def _hash_parameters(n: int) -> np.ndarray:
    return mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def samples(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash values of each set (rows); sets must not be empty."""
    mixed = mix(values.copy())
    p = _hash_parameters(n)
    out = np.empty((len(at) - 1, n), np.uint64)
    for k in range(n):
        out[:, k] = np.minimum.reduceat(mixed * p[k] + p[n + k], at[:-1])
    return out


def odd_sketches(values: np.ndarray, at: np.ndarray, bins: int) -> np.ndarray:
    """Parity bitmaps: the smallest value of each bin of a set's hash range flips the bit that a hash of it names.

    The values of a set ascend, so a bin's smallest is the first with its high bits.
    """
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    bin_of = (values >> np.uint64(48 - bins.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(values), bool)
    first[1:] = (bin_of[1:] != bin_of[:-1]) | (owner[1:] != owner[:-1])
    sample, row = values[first], owner[first]
    place = (mix(sample + np.uint64(0xA24BAED4963EE407)) % np.uint64(bins)).astype(np.int64)
    parity = (np.bincount(row * bins + place, minlength=n * bins) & 1).astype(np.uint8).reshape(n, bins)
    return np.packbits(parity, axis=1, bitorder="little").view("<u8")


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(minima), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(minima), b + 1, np.uint64)
        for r in range(rows):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + minima[:, b * rows + r])
        out[:, b] = acc
    return out


def _lists(matrix: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """Row ``owner[i]`` of ``n`` gets row i of ``matrix`` as a list; the others are empty."""
    lengths = np.zeros(n + 1, np.int32)
    lengths[owner + 1] = matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), pa.array(matrix.ravel().view(np.int64)))


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_a, set_b, bands, sketch) of every whole text; an empty set has no bands."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = Texts(part.column("text"))
                values, at = shingle_sets(texts, s.width)
                size = np.diff(at)
                full = np.flatnonzero(size)
                some = np.append(at[:-1][full], len(values))
                minima = samples(values, some, s.bands * s.rows) if len(full) else np.zeros((0, s.bands * s.rows), np.uint64)
                sketches = odd_sketches(values, some, s.bins) if len(full) else np.zeros((0, s.words), np.uint64)
                prints = np.zeros((2, texts.n), np.uint64)
                if len(full):
                    prints[0, full] = np.add.reduceat(mix(values.copy()), some[:-1])
                    prints[1, full] = np.add.reduceat(mix(values + np.uint64(0x51ED270B)), some[:-1])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("text_key"), pa.array(size.astype(np.int64)), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)),
                    _lists(band_keys(minima, s.bands, s.rows), full, texts.n), _lists(sketches, full, texts.n),
                ], names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text_key long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>")


def _most_flips(m, n, s: Settings, f):
    """Most differing bits that the screen lets through, for set sizes ``m`` and ``n``; ``f`` is numpy or pyspark.sql.functions.

    For sets of m and n elements with Jaccard similarity J the union has
    u = (m + n) / (1 + J), and bins filled by k elements are
    N(k) = B (1 - exp(-k / B)).  The union's bins agree with probability J, so
    X = N(m) + N(n) - 2 J N(u) samples differ, which set
    B / 2 (1 - exp(-2 X / B)) bits of the XOR on average.  The variance is that
    of the differing samples, which vanishes where every element is a sample,
    carried over, and that of X balls' parities in B bins.
    """
    j, bins = s.percent / 100, float(s.bins)

    def filled(k):
        return (1 - f.exp(-k / bins)) * bins

    u = (m + n) / (1 + j)
    union = filled(u)
    differing = filled(m) + filled(n) - union * (2 * j)
    decay = f.exp(differing * (-4 / bins))
    variance = decay * union * (1 - union / u) * (4 * j * (1 - j)) + (1 - decay) * (bins / 4) - differing * decay
    return (1 - f.exp(differing * (-2 / bins))) * (bins / 2) + f.sqrt(variance + 1) * s.deviations + 2


def _alike(a: str, b: str, s: Settings):
    """Whether sketch and size of classes ``a`` and ``b`` allow for the wanted similarity."""
    m, n = F.col(f"n_{a}").cast("double"), F.col(f"n_{b}").cast("double")
    sizes = 100 * F.least(m, n) >= s.percent * F.greatest(m, n)
    flips = F.aggregate(F.zip_with(f"sketch_{a}", f"sketch_{b}", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return sizes & (flips <= _most_flips(m, n, s, F))


def confirm(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Those (a, b) whose whole sets have 100 * intersection >= percent * union."""
    both = (
        pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )

    def run(batches):
        for batch in batches:
            # A few pairs at a time; the two texts of a pair are much alike in size.
            for part in chunks(batch, "text_a", 1 << 19, 128):
                left, at_l = shingle_sets(Texts(part.column("text_a")), s.width)
                right, at_r = shingle_sets(Texts(part.column("text_b")), s.width)
                keep = np.zeros(part.num_rows, bool)
                for k in range(part.num_rows):
                    keep[k] = _similar(left[at_l[k] : at_l[k + 1]], right[at_r[k] : at_r[k + 1]], s)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, pairs.select("a", "b").schema)


def near_duplicates(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Words are runs of characters other than space and tab to carriage return,
    A-Z lower-cased; a shorter text is one shingle, a text without words (or
    null) has none and links with nothing.  ``component_id`` is the smallest
    id reachable over links, ``kept`` marks the document with that id.  Rows
    that share an id are one document, linked where any of them is; a null id
    links with nothing, has a null component and is kept.  An empty table
    gives no rows; other columns are not looked at.

    No bucket is turned into all its pairs.  Each bucket first offers its
    members to one leader, which settles groups of near copies of any size in
    one pass; in buckets whose members are then still in different components
    the pairs across these are compared in blocks.
    """
    body = F.col(text).cast("string")
    # A class is named by the smallest (id, hash of the text) among its rows.
    source = docs.select(F.col(key).alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("text_key"))
    signed = pin(signatures(source, s))
    alive = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").withColumn("node", F.struct("doc_id", "text_key"))
    sets = ["n_shingles", "set_a", "set_b"]
    first = F.min_by(F.struct("bands", "sketch"), "node")
    classes = pin(alive.groupBy(*sets).agg(F.min("node").alias("node"), first.alias("_first")).select(*sets, "node", "_first.bands", "_first.sketch"))
    members = classes.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("many")).filter("many > 1")
    crowded = pin(members.join(shared, "bucket").distinct())
    # The most central class, the one with the most company over all its buckets, leads each bucket.
    company = crowded.groupBy("node").agg(F.sum("many").alias("company"))
    sketches = pin(classes.select("node", F.col("n_shingles").alias("n"), "sketch").join(company, "node"))
    placed = crowded.select("bucket", "node").join(sketches.select("node", "company"), "node")
    leaders = placed.groupBy("bucket").agg(F.max(F.struct("company", "node")).alias("_top")).select("bucket", F.col("_top.node").alias("a"))
    led = crowded.join(leaders, "bucket").filter("a <> node").select("a", F.col("node").alias("b")).distinct()
    offered = led.join(_side(sketches, "b"), "b").join(_side(sketches, "a"), "a").filter(_alike("a", "b", s))
    # Whole texts of classes with a candidate only, once.
    whole = source.filter("doc_id IS NOT NULL").select(F.struct("doc_id", "text_key").alias("node"), "text")
    texts = pin(whole.join(sketches.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    same = _links_by_id(alive, classes)
    links = pin(confirm(offered.select("a", "b"), texts, s).union(same))
    groups = connected(links)
    more = pin(_across(crowded, groups, sketches, texts, s))
    if not more.isEmpty():
        groups = connected(links.union(more))

    found = classes.select(*sets, "node").join(groups, "node", "left").select(*sets, F.coalesce("component.doc_id", "node.doc_id").alias("component_id"))
    out = signed.select("doc_id", *sets).join(found, sets, "left")
    found_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", found_id.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _side(sketches: DataFrame, name: str) -> DataFrame:
    return sketches.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}"))


def _unlike_components(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sketch bits and sizes aside, which pairs of a group are to be compared: of different components and, in a mixed cell, of its two chunks."""
    component = group.column("component_key").to_numpy()
    own = group.column("own").to_numpy()
    differ = np.triu(component[:, None] != component[None, :], 1)
    if group.column("lo")[0].as_py() != group.column("hi")[0].as_py():
        differ &= own[:, None] != own[None, :]
    return np.nonzero(differ)


def _screened(group: pa.Table, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (rows a, b of the group) that the screen lets pass, and how many bits of their sketches differ."""
    a, b = _unlike_components(group)
    n = group.column("n").to_numpy().astype(float)
    fits = 100 * np.minimum(n[a], n[b]) >= s.percent * np.maximum(n[a], n[b])
    a, b = a[fits], b[fits]
    sketch = group.column("sketch").combine_chunks()
    sketch = (sketch.chunk(0) if isinstance(sketch, pa.ChunkedArray) else sketch).flatten().to_numpy().view(np.uint64).reshape(-1, s.words)
    flips = np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(sketch[a[i : i + 8192]] ^ sketch[b[i : i + 8192]]).sum(1, dtype=np.int64) for i in range(0, len(a), 8192))])
    good = flips <= _most_flips(n[a], n[b], s, np)
    return a[good], b[good], flips[good]


def _across(crowded: DataFrame, groups: DataFrame, sketches: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """All links between different components inside the buckets, as far as they are needed to join these.

    A bucket is cut into chunks of about ``CHUNK`` classes and every two
    chunks meet in a cell of their own, so no task holds a bucket whole.  A
    cell first screens its pairs by their sketches and hands on only the
    classes that have a partner left; the whole sets of these then decide,
    most alike first, and only pairs that join two components come out.
    """
    held = crowded.join(groups, "node", "left").select("bucket", "many", "node", F.xxhash64(F.coalesce("component", "node")).alias("component_key"))
    mixed = held.groupBy("bucket").agg(F.min("component_key").alias("_lo"), F.max("component_key").alias("_hi")).filter("_lo < _hi").select("bucket")
    rows = pin(held.join(mixed, "bucket", "left_semi").join(sketches.select("node", "n", "sketch"), "node"))
    chunks_ = F.ceil(F.col("many") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(5)), chunks_).cast("int")
    cells = rows.withColumn("own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), chunks_ - 1))).select(
        "bucket", F.least("own", "_other").alias("lo"), F.greatest("own", "_other").alias("hi"), "own", "node", "component_key", "n", "sketch")

    def screen(group: pa.Table) -> pa.Table:
        a, b, _ = _screened(group, s)
        return group.take(pa.array(np.unique(np.concatenate((a, b)))))

    def settle(group: pa.Table) -> pa.Table:
        a, b, flips = _screened(group, s)
        order = np.argsort(flips, kind="stable")
        parent = {int(c): int(c) for c in group.column("component_key").to_numpy()}
        component = group.column("component_key").to_numpy()

        def root(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        values, at = shingle_sets(Texts(_one(group.column("text"))), s.width)
        found = []
        for k in order.tolist():
            x, y = root(int(component[a[k]])), root(int(component[b[k]]))
            if x != y and _similar(values[at[a[k]] : at[a[k] + 1]], values[at[b[k]] : at[b[k] + 1]], s):
                parent[x] = y
                found.append(k)
        node = _one(group.column("node"))
        return pa.table({"a": node.take(pa.array(a[found])), "b": node.take(pa.array(b[found]))})

    cell = ["bucket", "lo", "hi"]
    left = pin(cells.groupBy(*cell).applyInArrow(screen, cells.schema))
    kind = crowded.schema["node"].dataType.simpleString()
    return left.join(texts, "node").groupBy(*cell).applyInArrow(settle, f"a {kind}, b {kind}")


def _one(column) -> pa.Array:
    column = column.combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _similar(x: np.ndarray, y: np.ndarray, s: Settings) -> bool:
    """Whether two ascending sets have 100 * intersection >= percent * union."""
    if not len(x) or not len(y):
        return False
    place = np.searchsorted(x, y)
    place[place == len(x)] = 0
    common = int((x[place] == y).sum())
    return 100 * common >= s.percent * (len(x) + len(y) - common)


def _links_by_id(alive: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id."""
    spread = alive.groupBy("doc_id").agg(F.min("text_key").alias("_lo"), F.max("text_key").alias("_hi")).filter("_lo < _hi").select("doc_id")
    sets = ["n_shingles", "set_a", "set_b"]
    rows = alive.join(spread, "doc_id", "left_semi").select("doc_id", *sets).join(classes.select(*sets, "node"), sets)
    low = rows.groupBy("doc_id").agg(F.min("node").alias("a"))
    return rows.join(low, "doc_id").filter("a < node").select("a", F.col("node").alias("b")).distinct()
