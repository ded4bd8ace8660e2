"""Removal of repeated word sequences by relative Lempel-Ziv parsing.

A document's stretch of words is factored greedily against an indexed
reference block: each factor is the longest sequence that the block has at
some other place.  A window of ``WINDOW`` words that another place has lies
within one factor, or crosses just one factor boundary, because a factor that
starts inside it reaches its end.  So factors of ``WINDOW`` words or more give
repeated windows, and only windows across a boundary have to be checked.

Which reference blocks a stretch can match at all is known beforehand: a
window names an anchor, of its ``PIECE``-word pieces the one with the smallest
hash, and equal windows name equal anchors.  Neighbouring windows with one
anchor form a passage; reference blocks are made of the passages of a range
of anchors, so a document meets every block that could hold its windows, and
no other.  The steps are

1. texts are packed into blocks of some megabytes and written once;
2. each block offers its anchors; those that two places have come back;
3. each block sends its distinct passages of those anchors to the reference
   blocks, which parse them and answer with the repeated windows;
4. each block removes the words of repeated windows.

An anchor with more than ``HOT`` different passages would make one reference
block large; its windows are dealt out one by one, by their own hashes, and a
window that two places have is a factor by itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.bytetext import Texts, Words, chunks, mix, powers
from tickerloom.llm.tokens import gather
from tickerloom.session import pin

WINDOW, PIECE = 35, 8
SPAN = WINDOW - PIECE + 1  # windows of one passage at most
HOT = 4096
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 4 << 20
LEVELS = 6  # 2 ** 6 words are more than any passage has
_BASE = 0xD1342543DE82EF95
_INV = pow(_BASE, -1, 1 << 64)
_LOW48 = np.uint64((1 << 48) - 1)


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _planes(keys: np.ndarray) -> bytes:
    """48-bit keys byte by byte, highest first, which packs well where they ascend."""
    return _packed(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 5::-1].T)


def _from_planes(data: bytes) -> np.ndarray:
    planes = _unpacked(data, np.uint8).reshape(6, -1)
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
            names = pa.concat_arrays(ids)
            every = [
                pa.array([(task << 32) + number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                pa.array([at], pa.list_(pa.int64())), pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(parts))], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(every, names=["block", "ids", "at", "data"])

        for batch in batches:
            for part in chunks(batch, "text", size // 4, 1 << 20):
                texts = Texts(part.column("text"))
                ids.append(part.column("doc_id"))
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


class Block:
    """The texts of a block, its words, and its passages: neighbouring windows with one anchor.

    ``low``, ``high``: first windows' numbers (those of their first words);
    ``key``: 48 bits of the anchor's hash; ``seen``: hash of the whole passage.
    """

    def __init__(self, row, i: int = 0):
        self.data = _unpacked(row.column("data")[i].as_py(), np.uint8)
        self.at = np.array(row.column("at")[i].values, np.int64)
        self.ids = row.column("ids")[i].values
        self.n = len(self.ids)
        self.words = Words(self)
        total = len(self.words)
        self.rolled = np.zeros(total + 1, np.uint64)
        np.cumsum(self.words.key * powers(_BASE, total + 1)[:total], out=self.rolled[1:])
        self._passages(total)

    def hashed(self, start: np.ndarray, length) -> np.ndarray:
        """Hash of the ``length`` words from each start."""
        return mix((self.rolled[start + length] - self.rolled[start]) * powers(_INV, len(self.rolled))[start])

    def _passages(self, total: int) -> None:
        m = total - WINDOW + 1
        if m <= 0:
            self.low = self.high = np.zeros(0, np.int64)
            self.key = self.seen = np.zeros(0, np.uint64)
            return
        value = self.hashed(np.arange(total - PIECE + 1), PIECE)
        where, width = np.zeros(len(value), np.uint8), 1
        pieces = value
        while width < SPAN:
            step = min(width, SPAN - width)
            later = value[step:] < value[:-step]
            where = np.where(later, where[step:] + np.uint8(step), where[:-step])
            value = np.minimum(value[step:], value[:-step])
            width += step
        anchor = where + np.arange(m)
        left = np.repeat(self.words.first + self.words.per_text, self.words.per_text) - np.arange(total)
        ok = left[:m] >= WINDOW
        new = ok.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[:-1]
        self.low = np.flatnonzero(new)
        stop = np.append(np.flatnonzero(~ok), m)
        self.high = np.minimum(np.append(self.low[1:], m), stop[np.searchsorted(stop, self.low)])
        # Smallest hashes are small numbers, so they are scrambled again.
        self.key = mix(pieces[anchor[self.low]] ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(16)
        size = self.high - self.low + WINDOW - 1
        self.seen = self.hashed(self.low, size) ^ mix(size.astype(np.uint64))

    def select(self, which: np.ndarray) -> None:
        """Goes on with some of the passages."""
        self.low, self.high, self.key, self.seen = self.low[which], self.high[which], self.key[which], self.seen[which]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, many, group): one of each kind of passage by key and hash, whether there are more, and each passage's kind."""
        order = np.lexsort((self.seen, self.key))
        k, s = self.key[order], self.seen[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        begin = np.flatnonzero(new)
        group = np.empty(len(k), np.int64)
        group[order] = np.cumsum(new) - 1
        return order[begin], np.diff(np.append(begin, len(k))) > 1, group


def _slices(keys: np.ndarray, bits: int):
    """(bucket, first, last) of ascending 48-bit keys by their highest bits."""
    bucket = (keys >> np.uint64(48 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(keys)).tolist(), strict=True):
        if b > a:
            yield int(bucket[a]), a, b


# ---------------------------------------------------------------- anchors
def offered(blocks: DataFrame, bits: int) -> DataFrame:
    """(bucket, block, keys, kinds, many): each block's anchors, how many different passages each has, and whether there are two or more of them."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i)
                if not len(block.key):
                    continue
                first, many, _ = block.distinct()
                key = block.key[first]
                begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                kinds = np.diff(np.append(begin, len(key)))
                several = (kinds > 1) | np.logical_or.reduceat(many, begin)
                key, kinds = key[begin], np.minimum(kinds, 65_535).astype(np.uint16)
                rows = [(b, _planes(key[x:y]), _packed(kinds[x:y]), np.packbits(several[x:y]).tobytes()) for b, x, y in _slices(key, bits)]
                bucket, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket, pa.int64()), pa.array([batch.column("block")[i].as_py()] * len(rows), pa.int64()), *[pa.array(c, pa.binary()) for c in rest]
                ], names=["bucket", "block", "keys", "kinds", "many"])

    return blocks.mapInArrow(run, "bucket long, block long, keys binary, kinds binary, many binary")


def shared(offers: DataFrame, hot: int) -> DataFrame:
    """(block, keys, hot): the anchors of each block that two places of the corpus have, and which have more than ``hot`` kinds of passages."""

    def run(table: pa.Table) -> pa.Table:
        keys = [_from_planes(k.as_py()) for k in table.column("keys")]
        size = np.array(list(map(len, keys)))
        key = np.concatenate(keys)
        kinds = np.concatenate([_unpacked(k.as_py(), np.uint16) for k in table.column("kinds")]).astype(np.int64)
        many = np.concatenate([np.unpackbits(np.frombuffer(m.as_py(), np.uint8), count=n).astype(bool) for m, n in zip(table.column("many"), size.tolist(), strict=True)])
        order = np.argsort(key, kind="stable")
        k = key[order]
        begin = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        count = np.diff(np.append(begin, len(k)))
        good, heavy = np.zeros(len(key), bool), np.zeros(len(key), bool)
        good[order] = np.repeat((count > 1) | np.logical_or.reduceat(many[order], begin), count)
        heavy[order] = np.repeat(np.add.reduceat(kinds[order], begin) > hot, count)
        ends = np.cumsum(size).tolist()
        found = [(key[e - n : e][good[e - n : e]], heavy[e - n : e][good[e - n : e]]) for e, n in zip(ends, size.tolist(), strict=True)]
        made = {"block": table.column("block"), "keys": pa.array([_planes(a) for a, _ in found], pa.binary()), "hot": pa.array([np.packbits(b).tobytes() for _, b in found], pa.binary())}
        return pa.table(made).filter(pa.array([len(a) > 0 for a, _ in found]))

    return offers.groupBy("bucket").applyInArrow(run, "block long, keys binary, hot binary")


def _wanted(block: Block, found: pa.Table) -> np.ndarray:
    """Keeps the block's passages with shared anchors; which of them are hot."""
    keys = [_from_planes(k.as_py()) for k in found.column("keys")]
    known = np.concatenate([np.zeros(0, np.uint64), *keys])
    hot = np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(h.as_py(), np.uint8), count=len(k)).astype(bool) for h, k in zip(found.column("hot"), keys, strict=True)]])
    order = np.argsort(known)
    known, hot = known[order], hot[order]
    place = np.searchsorted(known, block.key)
    place[place == len(known)] = 0
    ours = known[place] == block.key if len(known) else np.zeros(len(block.key), bool)
    block.select(ours)
    return hot[place[ours]]


def _windows(block: Block, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and 48-bit hashes of all windows of some passages."""
    n = block.high[which] - block.low[which]
    start = np.repeat(block.low[which], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return start, block.hashed(start, WINDOW) >> np.uint64(16)


def passages(blocks: DataFrame, found: DataFrame, bits: int) -> DataFrame:
    """(kind, bucket, block, keys, lengths, many, words): each block's distinct passages of shared anchors (kind 0), and windows of hot ones (kind 1)."""

    def run(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and wanted.num_rows:
            block, number = Block(rows), rows.column("block")[0].as_py()
            hot = _wanted(block, wanted)
            _, window = _windows(block, np.flatnonzero(hot))
            window, times = np.unique(window, return_counts=True)
            for b, x, y in _slices(window, bits):
                out.append((1, b, number, _planes(window[x:y]), None, np.packbits(times[x:y] > 1).tobytes(), None))
            block.select(~hot)
            first, many, _ = block.distinct()
            size = (block.high - block.low)[first] + WINDOW - 1
            for b, x, y in _slices(block.key[first], bits):
                body = gather(block.words.key, block.low[first[x:y]], size[x:y]) & _LOW48
                out.append((0, b, number, _planes(block.key[first[x:y]]), _packed(size[x:y].astype(np.uint8)), np.packbits(many[x:y]).tobytes(), _packed(body.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])))
        columns = list(zip(*out, strict=True)) or [[]] * 7
        kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("kind", "bucket", "block", "keys", "lengths", "many", "words"), columns, kinds, strict=True)})

    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, "kind int, bucket long, block long, keys binary, lengths binary, many binary, words binary")


# ---------------------------------------------------------------- parsing
class Reference:
    """A reference block: stretches of words, sorted by what follows each word, with the longest match elsewhere.

    Names of stretches of 1, 2, 4, ... words give the order; a stretch's end
    sorts before any word.  ``match``: words from each place on that some
    other place of the block has as well, within its stretch.
    """

    def __init__(self, words: np.ndarray, length: np.ndarray):
        n = len(words)
        left = np.repeat(np.cumsum(length), length) - np.arange(n)
        name = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
        names = [name]
        for k in range(LEVELS):
            width = 1 << k
            after = np.zeros(n, np.int64)
            after[: n - width] = np.where(left[: n - width] > width, name[width:], 0) if n > width else 0
            both = name * (n + 1) + after
            order = np.argsort(both, kind="stable")
            new = np.ones(n, np.int64)
            new[1:] = both[order[1:]] != both[order[:-1]]
            name = np.empty(n, np.int64)
            name[order] = np.cumsum(new)
            names.append(name)
            if n and name[order[-1]] == n:
                break
        order = np.argsort(names[-1], kind="stable")
        a, b = order[:-1].copy(), order[1:].copy()
        same = np.zeros(max(0, n - 1), np.int64)
        limit = np.minimum(left[a], left[b])
        for k in reversed(range(len(names))):
            inside = np.flatnonzero(same < limit)
            x, y = a[inside] + same[inside], b[inside] + same[inside]
            same[inside[names[k][x] == names[k][y]]] += 1 << k
        same = np.minimum(same, limit)
        self.match = np.zeros(n, np.int64)
        self.match[order[1:]] = same
        self.match[order[:-1]] = np.maximum(self.match[order[:-1]], same)


def factors(match: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, first, last): the greedy factors of the stretches ``start`` to ``end``, each at least one word, in order."""
    owner, at = np.arange(len(start)), start.copy()
    found = []
    while len(owner):
        upto = np.minimum(at + np.maximum(match[at], 1), end[owner])
        found.append((owner, at, upto))
        on = upto < end[owner]
        owner, at = owner[on], upto[on]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    owner, first, last = map(np.concatenate, zip(*found, strict=True))
    order = np.lexsort((first, owner))
    return owner[order], first[order], last[order]


def repeated_windows(match: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Flags the places where a window starts that the reference block has elsewhere, by the stretches' factors."""
    owner, first, last = factors(match, start, end)
    out = np.zeros(len(match) + 1, np.int64)
    long = last - first >= WINDOW
    np.add.at(out, first[long], 1)
    np.add.at(out, last[long] - WINDOW + 1, -1)
    flags = np.cumsum(out[:-1]) > 0
    # Windows that begin in a factor and end in the next one.
    next_ = np.flatnonzero(owner[1:] == owner[:-1])
    low = np.maximum(first[next_], last[next_] - WINDOW + 1)
    high = np.minimum(last[next_], last[next_ + 1] - WINDOW + 1)
    n = np.maximum(high - low, 0)
    across = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    flags[across[match[across] >= WINDOW]] = True
    return flags


def _parsed(key: np.ndarray, length: np.ndarray, many: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each passage that was sent, its repeated windows as bits, the first lowest."""
    begin = np.cumsum(length) - length
    rolled = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words) * powers(_BASE, len(words) + 1)[:-1], out=rolled[1:])
    seen = mix((rolled[begin + length] - rolled[begin]) * powers(_INV, len(words) + 1)[begin]) ^ mix(length.astype(np.uint64))
    order = np.lexsort((seen, key))
    k, s = key[order], seen[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    group = np.empty(len(k), np.int64)
    group[order] = np.cumsum(new) - 1
    several = (np.diff(np.append(at, len(k))) > 1) | np.logical_or.reduceat(many[order], at)
    one = order[at]
    # A passage that two places have is one factor; passages alone with their anchor match nothing else.
    bits = np.where(several, (np.uint64(1) << (length[one] - WINDOW + 1).astype(np.uint64)) - np.uint64(1), np.uint64(0)).astype(np.uint32)
    _, which, count = np.unique(key[one], return_inverse=True, return_counts=True)
    member = np.flatnonzero(count[which] > 1)
    if len(member):
        size = length[one[member]]
        block = Reference(gather(words, begin[one[member]], size), size)
        start = np.cumsum(size) - size
        asked = np.flatnonzero(~several[member])
        flags = repeated_windows(block.match, start[asked], (start + size)[asked])
        n = size[asked] - WINDOW + 1
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        value = flags[np.repeat(start[asked], n) + offset].astype(np.int64) << offset
        bits[member[asked]] = np.add.reduceat(value, np.cumsum(n) - n).astype(np.uint32) if len(asked) else 0
    return bits[group]


def answers(sent: DataFrame) -> DataFrame:
    """(block, kind, bucket, bits): the repeated windows of each block's passages, and which of its hot windows are repeated."""

    def run(table: pa.Table) -> pa.Table:
        keys = [_from_planes(k.as_py()) for k in table.column("keys")]
        size = list(map(len, keys))
        key = np.concatenate(keys)
        many = np.concatenate([np.unpackbits(np.frombuffer(m.as_py(), np.uint8), count=n).astype(bool) for m, n in zip(table.column("many"), size, strict=True)])
        if table.column("kind")[0].as_py():
            _, which, count = np.unique(key, return_inverse=True, return_counts=True)
            bits = ((count > 1) | (np.bincount(which, many) > 0))[which].astype(np.uint32)
        else:
            length = np.concatenate([_unpacked(x.as_py(), np.uint8) for x in table.column("lengths")]).astype(np.int64)
            words = np.zeros((int(length.sum()), 8), np.uint8)
            done = 0
            for x in table.column("words"):
                part = _unpacked(x.as_py(), np.uint8).reshape(-1, 6)
                words[done : done + len(part), :6] = part
                done += len(part)
            bits = _parsed(key, length, many, words.reshape(-1).view("<u8").astype(np.uint64))
        ends = np.cumsum(size).tolist()
        made = pa.array([_packed(bits[e - n : e]) for e, n in zip(ends, size, strict=True)], pa.binary())
        return pa.table({"block": table.column("block"), "kind": table.column("kind"), "bucket": table.column("bucket"), "bits": made})

    return sent.groupBy("kind", "bucket").applyInArrow(run, "block long, kind int, bucket long, bits binary")


# ---------------------------------------------------------------- removal
def _joined(block: Block, kept: np.ndarray) -> list[bytes]:
    """Each text's kept words, joined by one space."""
    start, size = block.words.start[kept], block.words.end[kept] - block.words.start[kept]
    to = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    some = 1 << 16
    for i in range(0, len(start), some):
        n, t = size[i : i + some], to[i : i + some]
        out[np.repeat(t - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = gather(block.data, start[i : i + some], n)
    which = np.flatnonzero(kept)
    first = np.searchsorted(which, np.append(block.words.first, len(kept)))
    ends = np.append(to, len(out))
    return [out[ends[a] : ends[b] - 1].tobytes() if b > a else b"" for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def removed(blocks: DataFrame, found: DataFrame, answered: DataFrame, keep_text: bool) -> DataFrame:
    """Each document's counts, and what is left of it."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text
    kinds = [pa.int64()] * 3 + [pa.string()] + [pa.string()] * keep_text
    back = found.select("block", F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("bucket"), "keys", "hot", F.lit(None).cast("binary").alias("bits")).union(
        answered.select("block", "kind", "bucket", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("hot"), "bits"))

    def run(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds, strict=True)})
        block = Block(rows)
        total = len(block.words)
        depth = np.zeros(total + 1, np.int64)
        if wanted.num_rows:
            kind = wanted.column("kind").to_numpy()
            hot = _wanted(block, wanted.filter(pa.array(kind == -1)))

            def said(k: int) -> np.ndarray:
                part = wanted.filter(pa.array(kind == k)).sort_by("bucket").column("bits")
                return np.concatenate([np.zeros(0, np.uint32), *[_unpacked(b.as_py(), np.uint32) for b in part]])

            start, window = _windows(block, np.flatnonzero(hot))
            repeated = start[said(1)[np.unique(window, return_inverse=True)[1]] > 0] if len(start) else start
            block.select(~hot)
            if len(block.key):
                bits = said(0)[block.distinct()[2]].astype(np.int64)
                n = block.high - block.low
                offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                flagged = (np.repeat(bits, n) >> offset) & 1 == 1
                repeated = np.concatenate((repeated, (np.repeat(block.low, n) + offset)[flagged]))
            depth += np.bincount(repeated, minlength=total + 1)
            depth -= np.bincount(repeated + WINDOW, minlength=total + 1)
        kept = np.cumsum(depth[:-1]) == 0
        left = _joined(block, kept)
        gone = np.concatenate(([0], np.cumsum(~kept)))[np.append(block.words.first, total)]
        columns = [block.ids, pa.array(block.words.per_text), pa.array(np.diff(gone)), [hashlib.sha256(t).hexdigest() for t in left]] + [[t.decode() for t in left]] * keep_text
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, schema)


def remove_repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) of every row of ``docs``.

    Every word goes that lies in a window of 35 consecutive words whose
    sequence starts at another place too, in the same text or any other; words
    are runs of characters other than space and tab to carriage return, windows
    lie within one text and are judged on the input.  What is kept is joined by
    one space.  Null and empty texts have no words; rows that share an id, are
    equal, or have a null id are texts of their own; an empty table gives no
    rows; other columns are not looked at.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    blocks = pin(blocks_of(source))
    total = blocks.agg(F.sum(F.element_at("at", -1))).first()[0] or 0
    # Reference blocks grow in number, not in size.
    bits = max(3, int(-(-total // BUCKET_BYTES) - 1).bit_length() if total else 0)
    found = pin(shared(offered(blocks, bits), hot))
    return removed(blocks, found, pin(answers(passages(blocks, found, bits))), keep_text)
