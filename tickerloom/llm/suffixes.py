"""Removal of repeated passages: suffix sorting of everything that could repeat.

A 50-byte string names an anchor inside itself: of its 28-byte pieces the one
with the smallest hash.  Equal strings name equal anchors, so a string can
only repeat across documents if its anchor does.  The steps are

1. texts are packed into blocks of some megabytes and written once;
2. each block sends the hashes of its anchors, once each, to hash buckets,
   which answer with those that more than one document has;
3. each block sends the surroundings of those anchors, once each and with the
   smallest document id that has them, to buckets again;
4. each bucket sorts all suffixes of its surroundings by external induced
   sorting; suffixes that share 50 bytes or more are occurrences of one
   string, whose smallest document id goes back to the blocks.  Equal
   surroundings are sorted as one, and the only surroundings of an anchor not
   at all, as their strings can equal no others;
5. each block removes the bytes of strings that a smaller id has.

What a hot passage sends is one entry per block, however many documents of
the block have it.  An anchor with too many surroundings is lengthened: half
the bytes a string has besides it come from its left where the string has
them, else from its right.  Equal strings name equal longer anchors, which go
to buckets of their own; step 2 runs again for them, five times at most until
an anchor is the whole string and has but one surroundings.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.bytetext import BYTES, Texts, chunks, hash_runs, mix, powers
from tickerloom.llm.induced import sort_suffixes
from tickerloom.llm.tokens import gather
from tickerloom.session import pin

LENGTH, PIECE = 50, 28
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
SEGMENT = 1 << 18
# Surroundings of one anchor that one bucket takes; bytes that a string has besides its anchor, level by level.
MOST_SURROUNDINGS = 1 << 16
SLACK = (LENGTH - PIECE, 11, 5, 2, 1, 0)


def _packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


# ---------------------------------------------------------------- anchors
def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, key, place): the strings that start at low to high - 1 have one anchor, which starts at ``place`` and whose hash has 48 bits ``key``.

    Strings lie within one text (stretches of ``at``).
    """
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    crossing = np.zeros(len(data) + 1, np.int8)
    ends = at[1:][at[1:] > at[:-1]]
    begins = np.maximum(at[:-1][at[1:] > at[:-1]], ends - LENGTH + 1)
    crossing[begins] += 1
    crossing[ends] -= 1
    valid = np.cumsum(crossing[:n], dtype=np.int8) == 0
    span = LENGTH - PIECE + 1
    lows, highs, keys, places = [], [], [], []
    for s in range(0, n, SEGMENT):
        m = min(SEGMENT, n - s)
        part = data[s : s + m + LENGTH - 1]
        p = powers(_BASE, len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTES[False][part] * p[: len(part)], out=total[1:])
        value = mix((total[PIECE:] - total[:-PIECE]) * powers(_INV, len(part) + 1)[: len(total) - PIECE])
        # Leftmost smallest of ``span`` neighbours by the highest 32 bits, by doubling.
        least = (value >> np.uint64(32)).astype(np.uint32)
        where, width = np.zeros(len(value), np.uint8), 1
        while width < span:
            step = min(width, span - width)
            later = least[step:] < least[:-step]
            where = np.where(later, where[step:] + np.uint8(step), where[:-step])
            least = np.minimum(least[step:], least[:-step])
            width += step
        anchor = where[:m] + np.arange(m)
        ok = valid[s : s + m]
        new = ok.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[:-1]
        low = np.flatnonzero(new)
        stop = np.flatnonzero(~ok)
        high = np.append(low[1:], m)
        # A run also ends where strings would cross into the next text.
        cut = np.append(stop, m)[np.searchsorted(stop, low)]
        lows.append(low + s)
        highs.append(np.minimum(high, cut) + s)
        # Smallest hashes are small numbers, so they are scrambled again.
        keys.append(mix(value[anchor[low]] ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(16))
        places.append(anchor[low] + s)
    return np.concatenate(lows), np.concatenate(highs), np.concatenate(keys), np.concatenate(places)


def lengthened(data: np.ndarray, low: np.ndarray, high: np.ndarray, place: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The strings of anchors of ``level`` by their anchors of the next one, as ``anchors`` returns them."""
    grow = SLACK[level] - SLACK[level + 1]
    between = np.clip(place - grow + 1, low, high)
    low, high = np.concatenate((low, between)), np.concatenate((between, high))
    place = np.concatenate((place - grow, place))
    some = np.flatnonzero(low < high)
    some = some[np.argsort(place[some], kind="stable")]
    low, high, place = low[some], high[some], place[some]
    prints = _rolled_ranges(data, place, np.full(len(place), LENGTH - SLACK[level + 1]))
    return low, high, mix(prints ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(16), place


def _is_in(key: np.ndarray, packed: list[bytes]) -> np.ndarray:
    """Which keys are among those of ``packed``."""
    known = np.sort(np.concatenate([np.zeros(0, np.uint64), *map(_keys_of, packed)]))
    if not len(known):
        return np.zeros(len(key), bool)
    place = np.searchsorted(known, key)
    place[place == len(known)] = 0
    return known[place] == key


def _bytes_of(keys: np.ndarray) -> bytes:
    """48-bit keys byte by byte, highest first, which packs well when they ascend."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 5::-1].T).tobytes()


def _keys_of(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, 5::-1] = planes.T
    return out.reshape(-1).view("<u8").astype(np.uint64)


# ---------------------------------------------------------------- blocks
def blocks_of(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """(block, ids, at, data): texts end to end, packed, at least ``size`` bytes together but for a task's last block."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        ids, lengths, parts, held = [], [], [], 0

        def flush():
            at = np.concatenate(([0], np.cumsum(np.concatenate(lengths))))
            row = [(task << 32) + number], [np.concatenate(ids)], [at], [_packed(b"".join(parts))]
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1], pa.list_(pa.int64())), pa.array(row[2], pa.list_(pa.int64())), pa.array(row[3], pa.binary())], names=["block", "ids", "at", "data"])

        for batch in batches:
            for part in chunks(batch, "text", size // 4, 1 << 20):
                texts = Texts(part.column("text"))
                ids.append(part.column("doc_id").to_numpy())
                lengths.append(np.diff(texts.at))
                parts.append(texts.data.tobytes())
                held += len(texts.data)
                if held >= size:
                    yield flush()
                    number, held = number + 1, 0
                    ids, lengths, parts = [], [], []
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "block long, ids array<long>, at array<long>, data binary")


def _block(row: pa.Table, i: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = _unpacked(row.column("data")[i].as_py(), np.uint8)
    return np.array(row.column("ids")[i].values, np.int64), np.array(row.column("at")[i].values, np.int64), data


def _slices(keys: np.ndarray, bits: int):
    """(bucket, first, last) of ascending 48-bit keys by their highest bits."""
    bucket = (keys >> np.uint64(48 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(keys)).tolist(), strict=True):
        if b > a:
            yield int(bucket[a]), a, b


def _offer(block: int, ids: np.ndarray, at: np.ndarray, data: np.ndarray, runs, bits: int):
    """Rows (bucket, block, keys, many, kinds) of the runs of one block: its distinct anchors in ascending order.

    ``many`` marks the anchors that several documents of the block have;
    ``kinds`` is for those with more than one surroundings in the block: which
    of the row's anchors, and how many.
    """
    low, high, key, _ = runs
    who = ids[np.searchsorted(at, low, side="right") - 1]
    order = np.argsort(key)
    of_key, who = key[order], who[order]
    first = np.flatnonzero(np.append(True, of_key[1:] != of_key[:-1]))
    many = np.minimum.reduceat(who, first) < np.maximum.reduceat(who, first)
    times = np.diff(np.append(first, len(order)))
    key = of_key[first]
    again = order[np.repeat(times > 1, times)]
    again = again[np.argsort(low[again])]
    prints = _rolled_ranges(data, low[again], high[again] - low[again] + LENGTH - 1)
    place = np.searchsorted(key, runs[2][again])
    by = np.lexsort((prints, place))
    place, prints = place[by], prints[by]
    new = np.ones(len(by), bool)
    new[1:] = (place[1:] != place[:-1]) | (prints[1:] != prints[:-1])
    kinds = np.bincount(place[new], minlength=len(key))
    for b, x, y in _slices(key, bits):
        several = np.flatnonzero(kinds[x:y] > 1)
        yield b, block, _bytes_of(key[x:y]), np.packbits(many[x:y]).tobytes(), np.concatenate((several, kinds[x:y][several])).astype(np.int32).tobytes()


_OFFERS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("many", pa.binary()), ("kinds", pa.binary())])
_OFFERED = "bucket long, block long, keys binary, many binary, kinds binary"


def _rows(rows, schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.table({f.name: pa.array(c, f.type) for f, c in zip(schema, columns, strict=True)})


def offered(blocks: DataFrame, bits: int) -> DataFrame:
    """(bucket, block, keys, many, kinds): each block's distinct anchors, as ``_offer`` gives them."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, at, data = _block(batch, i)
                runs = anchors(data, at)
                if len(runs[0]):
                    yield from _rows(_offer(batch.column("block")[i].as_py(), ids, at, data, runs, bits), _OFFERS).to_batches()

    return blocks.mapInArrow(run, _OFFERED)


def offered_longer(blocks: DataFrame, found: list[DataFrame], bits: int) -> DataFrame:
    """The same for the longer anchors of the last level's crowded ones."""
    level = len(found)

    def run(block: pa.Table, wanted: pa.Table) -> pa.Table:
        rows = []
        if block.num_rows and wanted.num_rows:
            ids, at, data = _block(block)
            runs = _levels(data, at, wanted, level)[-1]
            if len(runs[0]):
                rows = list(_offer(block.column("block")[0].as_py(), ids, at, data, runs, bits))
        return _rows(rows, _OFFERS)

    crowded = _all(found).filter("n_crowded > 0").withColumn("keys", F.lit(b""))
    return blocks.groupBy("block").cogroup(crowded.groupBy("block")).applyInArrow(run, _OFFERED)


def shared(offers: DataFrame, level: int, most: int) -> DataFrame:
    """(block, level, keys, crowded, n_crowded): the anchors of each block that more than one document of the corpus has.

    Those that blocks have more than ``most`` surroundings of, added up, are ``crowded``.
    """
    lengthens = level + 1 < len(SLACK)

    def run(table: pa.Table) -> pa.Table:
        keys = [_keys_of(k.as_py()) for k in table.column("keys")]
        many = [np.unpackbits(np.frombuffer(m.as_py(), np.uint8), count=len(k)).astype(bool) for m, k in zip(table.column("many"), keys, strict=True)]
        size = np.array(list(map(len, keys)))
        key, flag = np.concatenate(keys), np.concatenate(many)
        del keys, many
        ends = np.cumsum(size)
        order = np.argsort(key, kind="stable")
        k = key[order]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        del k
        count = np.diff(np.append(first, len(order)))
        good = (count > 1) | np.logical_or.reduceat(flag[order], first)
        keep = np.zeros(len(key), bool)
        keep[order] = np.repeat(good, count)
        hot = np.zeros(len(key), bool)
        if lengthens:
            kinds = np.ones(len(key), np.int32)
            for e, n, x in zip(ends.tolist(), size.tolist(), table.column("kinds"), strict=True):
                which, times = np.frombuffer(x.as_py(), np.int32).reshape(2, -1)
                kinds[e - n + which] = times
            hot[order] = np.repeat(good & (np.add.reduceat(kinds[order], first, dtype=np.int64) > most), count)
        rows = []
        for block, e, n in zip(table.column("block").to_pylist(), ends.tolist(), size.tolist(), strict=True):
            ours, few, lots = key[e - n : e], keep[e - n : e] & ~hot[e - n : e], hot[e - n : e]
            if few.any() or lots.any():
                rows.append((block, level, _bytes_of(ours[few]), _bytes_of(ours[lots]), int(lots.sum())))
        return _rows(rows, pa.schema([("block", pa.int64()), ("level", pa.int32()), ("keys", pa.binary()), ("crowded", pa.binary()), ("n_crowded", pa.int64())]))

    return offers.groupBy("bucket").applyInArrow(run, "block long, level int, keys binary, crowded binary, n_crowded long")


def _all(found: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, found)


def shared_anchors(blocks: DataFrame, bits: int, most: int) -> DataFrame:
    """The shared anchors of all levels; a level is looked at if the one before has crowded anchors."""
    found = [pin(shared(offered(blocks, bits), 0, most))]
    while not found[-1].filter("n_crowded > 0").isEmpty():
        found.append(pin(shared(offered_longer(blocks, found, bits), len(found), most)))
    return _all(found)


def _levels(data: np.ndarray, at: np.ndarray, wanted: pa.Table, last: int | None = None) -> list[tuple]:
    """A block's runs of strings by anchor, level by level; a further level has those of crowded anchors of the one before."""
    level, crowded = wanted.column("level").to_pylist(), wanted.column("crowded").to_pylist()
    out = [anchors(data, at)]
    for i in range(max(level) if last is None else last):
        low, high, key, place = out[-1]
        hot = _is_in(key, [c for n, c in zip(level, crowded, strict=True) if n == i])
        out.append(lengthened(data, low[hot], high[hot], place[hot], i))
    return out


class _Surroundings:
    """The strings of a block whose anchors are shared, those with equal surroundings together.

    ``low``, ``high``, ``text``: each run's string starts and its document's
    index; ``group``: its group.  Groups ascend by key: ``key``, ``start`` and
    ``length`` of one run's surroundings, ``least``: smallest document id.
    """

    def __init__(self, ids: np.ndarray, at: np.ndarray, data: np.ndarray, wanted: pa.Table):
        level, keys = wanted.column("level").to_pylist(), wanted.column("keys").to_pylist()
        parts = []
        for i, (low, high, key, _) in enumerate(_levels(data, at, wanted)):
            ours = _is_in(key, [k for n, k in zip(level, keys, strict=True) if n == i])
            parts.append((low[ours], high[ours], key[ours]))
        self.low, self.high, key = map(np.concatenate, zip(*parts, strict=True))
        if len(parts) > 1:
            order = np.argsort(self.low, kind="stable")
            self.low, self.high, key = self.low[order], self.high[order], key[order]
        self.text = np.searchsorted(at, self.low, side="right") - 1
        length = self.high - self.low + LENGTH - 1
        prints = _rolled_ranges(data, self.low, length)
        order = np.lexsort((self.low, prints, key))
        k, f = key[order], prints[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (f[1:] != f[:-1])
        self.group = np.empty(len(k), np.int64)
        self.group[order] = np.cumsum(new) - 1
        first = order[new]
        self.key, self.start, self.length = key[first], self.low[first], length[first]
        at_first = np.flatnonzero(new)
        self.least = np.minimum.reduceat(ids[self.text][order], at_first) if len(at_first) else np.zeros(0, np.int64)


def _hash_ranges(data: np.ndarray, start: np.ndarray, length: np.ndarray, some: int = 1 << 15) -> np.ndarray:
    """Hash of each stretch of bytes and its length."""
    out = np.zeros(len(start), np.uint64)
    for i in range(0, len(start), some):
        n = length[i : i + some]
        out[i : i + some] = hash_runs(gather(data, start[i : i + some], n), np.cumsum(n) - n) ^ mix(n.astype(np.uint64))
    return out


def _rolled_ranges(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The same for overlapping stretches with ascending starts, from running sums over a segment of the bytes."""
    out = np.zeros(len(start), np.uint64)
    first = 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(start, start[first] + SEGMENT)))
        a, b = int(start[first]), int((start[first:last] + length[first:last]).max())
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(BYTES[False][data[a:b]] * powers(_BASE, b - a + 1)[:-1], out=total[1:])
        at, n = start[first:last] - a, length[first:last]
        out[first:last] = mix((total[at + n] - total[at]) * powers(_INV, b - a + 1)[at]) ^ mix(n.astype(np.uint64))
        first = last
    return out


def surroundings(blocks: DataFrame, found: DataFrame, bits: int) -> DataFrame:
    """(bucket, block, anchors, data, lengths, least): each block's distinct surroundings of shared anchors."""

    def run(block: pa.Table, wanted: pa.Table) -> pa.Table:
        rows = []
        if block.num_rows and wanted.num_rows:
            ids, at, data = _block(block)
            s = _Surroundings(ids, at, data, wanted)
            for bucket, a, b in _slices(s.key, bits):
                rows.append((bucket, block.column("block")[0].as_py(), _packed(_bytes_of(s.key[a:b])), _packed(gather(data, s.start[a:b], s.length[a:b]).tobytes()), _packed(s.length[a:b].astype(np.int32).tobytes()), _packed(s.least[a:b].tobytes())))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.table({n: pa.array(c, pa.int64() if n in ("bucket", "block") else pa.binary()) for n, c in zip(("bucket", "block", "anchors", "data", "lengths", "least"), columns, strict=True)})

    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, "bucket long, block long, anchors binary, data binary, lengths binary, least binary")


# ---------------------------------------------------------------- suffixes
def smallest_owners(data: np.ndarray, length: np.ndarray, least: np.ndarray, budget: int = 16 << 20) -> tuple[np.ndarray, np.ndarray]:
    """For every string start of distinct passages the smallest owner of that string, and where each passage's begin.

    All suffixes of the passages, apart by separators, come in descending
    order with the length they share with the one before; a run that shares
    ``LENGTH`` or more is one string.
    """
    text = np.ones(len(data) + len(length) + 1, np.uint16)
    start = np.cumsum(length) - length + np.arange(len(length))
    owner = np.repeat(np.arange(len(length), dtype=np.int32), length + 1)
    inside = np.ones(len(text), bool)
    inside[start + length] = False
    inside[-1] = False
    text[inside] = data
    text[inside] += 2
    text[-1] = 0
    del inside
    strings = length - LENGTH + 1
    first = np.concatenate(([0], np.cumsum(strings)))
    places, groups, runs = [], [], 0

    def take(pos, lcp):
        nonlocal runs
        group = runs + np.cumsum(lcp < LENGTH)
        runs = int(group[-1]) if len(group) else runs
        inside = pos < len(owner)
        who = owner[np.where(inside, pos, 0)]
        offset = pos - start[who]
        good = inside & (offset < strings[who])
        places.append((first[who] + offset)[good].astype(np.int32))
        groups.append(group[good].astype(np.int32))

    sort_suffixes(text, 258, take, budget)
    place, group = np.concatenate(places), np.concatenate(groups)
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    passage = np.searchsorted(first, place, side="right") - 1
    smallest = np.minimum.reduceat(least[passage], begin)
    out = np.empty(len(place), np.int64)
    out[place] = np.repeat(smallest, np.diff(np.append(begin, len(place))))
    return out, first


def resolved(passages: DataFrame) -> DataFrame:
    """(block, bucket, keys): for each of a block's surroundings the runs of string starts with one smallest owner, packed."""

    def run(table: pa.Table) -> pa.Table:
        lengths = [_unpacked(x.as_py(), np.int32).astype(np.int64) for x in table.column("lengths")]
        n = np.array(list(map(len, lengths)))
        length = np.concatenate(lengths)
        data = np.concatenate([_unpacked(x.as_py(), np.uint8) for x in table.column("data")])
        least = np.concatenate([_unpacked(x.as_py(), np.int64) for x in table.column("least")])
        anchor = np.concatenate([_keys_of(zstandard.ZstdDecompressor().decompress(x.as_py())) for x in table.column("anchors")])
        # Passages that several blocks sent count once, for the smallest of their owners.
        begin = np.cumsum(length) - length
        prints = _hash_ranges(data, begin, length)
        order = np.lexsort((prints, anchor))
        prints = prints[order]
        key = anchor[order]
        new = np.ones(len(order), bool)
        new[1:] = (prints[1:] != prints[:-1]) | (key[1:] != key[:-1])
        at = np.flatnonzero(new)
        kept = order[at]
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        own = np.minimum.reduceat(least[order], at)
        strings = length[kept] - LENGTH + 1
        first = np.concatenate(([0], np.cumsum(strings)))
        owners = np.repeat(own, strings)
        _, which, many = np.unique(key[at], return_inverse=True, return_counts=True)
        compared = np.flatnonzero(many[which] > 1)
        if len(compared):
            found, _ = smallest_owners(gather(data, begin[kept[compared]], length[kept[compared]]), length[kept[compared]], own[compared])
            of_compared = np.zeros(len(kept), bool)
            of_compared[compared] = True
            owners[np.repeat(of_compared, strings)] = found
        # Runs of equal owners within each passage.
        cut = np.ones(len(owners), bool)
        cut[1:] = owners[1:] != owners[:-1]
        cut[first[:-1]] = True
        run_at = np.flatnonzero(cut)
        run_size = np.diff(np.append(run_at, len(owners)))
        run_owner = owners[run_at]
        of_passage = np.searchsorted(run_at, first)
        ends = np.cumsum(n)
        rows = []
        for e, k in zip(ends.tolist(), n.tolist(), strict=True):
            ours = back[e - k : e]
            count = of_passage[ours + 1] - of_passage[ours]
            which = gather(np.arange(len(run_at)), of_passage[ours], count)
            rows.append(_packed(b"".join((np.array([k, len(which)], np.int64).tobytes(), count.astype(np.int64).tobytes(), run_size[which].tobytes(), run_owner[which].tobytes()))))
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "keys": pa.array(rows, pa.binary())})

    return passages.groupBy("bucket").applyInArrow(run, "block long, bucket long, keys binary")


def _answers(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of runs of each surroundings, and all runs' sizes and owners, buckets in order."""
    parts = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for one in packed:
        values = _unpacked(one, np.int64)
        k, m = int(values[0]), int(values[1])
        for part, a, b in zip(parts, (2, 2 + k, 2 + k + m), (2 + k, 2 + k + m, 2 + k + 2 * m), strict=True):
            part.append(values[a:b])
    return tuple(map(np.concatenate, parts))


def removed(blocks: DataFrame, found: DataFrame, answers: DataFrame, keep_text: bool) -> DataFrame:
    """Each document's counts, and what is left of it."""
    back = found.select("block", F.lit(0).cast("long").alias("bucket"), "level", "keys", "crowded").union(answers.select("block", "bucket", F.lit(-1).alias("level"), "keys", F.lit(b"").alias("crowded")))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text

    def run(block: pa.Table, wanted: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds, strict=True)})
        ids, at, data = _block(block)
        gone = np.zeros(len(data), bool)
        if wanted.num_rows:
            answer = pc.equal(wanted.column("level"), -1)
            s = _Surroundings(ids, at, data, wanted.filter(pc.invert(answer)))
            count, size, owner = _answers(wanted.filter(answer).sort_by("bucket").column("keys").to_pylist())
            begin = np.cumsum(count) - count
            # Where each run of owners starts among its surroundings' strings.
            ahead = np.cumsum(size) - size
            ahead -= np.repeat(ahead[begin], count)
            times = count[s.group]
            which = gather(np.arange(len(size)), begin[s.group], times)
            low = np.repeat(s.low, times) + ahead[which]
            smaller = owner[which] < np.repeat(ids[s.text], times)
            low, high = low[smaller], (low + size[which] + LENGTH - 1)[smaller]
            depth = np.bincount(low, minlength=len(data) + 1) - np.bincount(high, minlength=len(data) + 1)
            gone = np.cumsum(depth[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = at[(at > 0) & (at < len(data))]
        begins[inner] = gone[inner]
        lost, spans = (np.concatenate(([0], np.cumsum(x)))[at] for x in (gone, begins))
        left = data[~gone]
        to = at - lost
        kept = [left[a:b].tobytes() for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
        columns = [ids, np.diff(at), np.diff(lost), np.diff(spans), [hashlib.sha256(k).hexdigest() for k in kept]] + [kept] * keep_text
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, schema)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False, most: int = MOST_SURROUNDINGS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row of ``docs``.

    Every byte goes that lies in a 50-byte string which also starts in a
    document with a smaller id; texts are UTF-8 bytes and whole, a null text
    is empty, strings lie within one text and are judged on the input.  Ids
    are whole numbers; rows that share an id never take from each other; a row
    with a null id takes from none and keeps all.  An empty table gives no
    rows; other columns are not looked at.  ``most``: surroundings of one anchor
    that are sorted together; the result does not depend on it.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    blocks = pin(blocks_of(source.filter("doc_id IS NOT NULL")))
    total = blocks.agg(F.sum(F.element_at("at", -1))).first()[0] or 0
    # Buckets grow in number, not in size.
    bits = max(3, int(-(-total // BUCKET_BYTES) - 1).bit_length() if total else 0)
    found = shared_anchors(blocks, bits, most)
    answers = pin(resolved(surroundings(blocks, found, bits)))
    out = removed(blocks, found, answers, keep_text)
    body = F.col("text").cast("binary")
    lone = source.filter("doc_id IS NULL").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(body, 256).alias("kept_sha256"), *([body.alias("kept")] if keep_text else []))
    return out.union(lone)
