"""Suffix sorting by external induced sorting, with common-prefix lengths.

A text's suffixes are of type L (greater than the next suffix) or S.  From
the sorted leftmost S suffixes (LMS) all L suffixes follow in one ascending
pass and from those all S suffixes in one descending pass: each suffix popped
from a priority queue pushes the one that begins a character earlier.  The
LMS suffixes themselves are sorted by naming their substrings, found by the
same two passes, and sorting the text of names recursively.

The queues are monotone: they are popped in order of their first character
and, for equal ones, in order of arrival.  They are kept as one spool per
range of characters; when what they hold in memory passes the budget, the
largest spools are written to the task's own temporary folder, which goes with
the task.  All steps work on whole arrays: a batch ends before the first
character that its own members push to.  Next to each suffix travels the
length of its common prefix with its neighbour.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable

import numpy as np

CAP = 254  # common prefixes are counted up to this
SAME = 255  # in the naming passes: equal LMS substrings
BATCH = 1 << 16
PER_NAME = 12  # bytes of the queues for each suffix


class Spools:
    """First-in-first-out lists of (char, position, common prefix), one per range of characters, on disk beyond a budget."""

    def __init__(self, ranges: int, budget: int):
        self.kept: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(ranges)]
        self.files: list[list[str]] = [[] for _ in range(ranges)]
        self.size = np.zeros(ranges, np.int64)
        self.budget, self.folder, self.written, self.total = budget, None, 0, 0

    def push(self, r: int, char: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.kept[r].append((char, pos, lcp))
        added = char.nbytes + pos.nbytes + lcp.nbytes
        self.size[r] += added
        self.total += added
        if self.total > self.budget:
            self._spill()
            self.total = int(self.size.sum())

    def split(self, char: np.ndarray, pos: np.ndarray, lcp: np.ndarray, range_of: Callable) -> None:
        """Pushes entries sorted by char to their ranges."""
        if not len(char):
            return
        r = range_of(char)
        cut = np.flatnonzero(np.diff(r)) + 1
        for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(r)).tolist(), strict=True):
            self.push(int(r[a]), char[a:b], pos[a:b], lcp[a:b])

    def _spill(self) -> None:
        if self.folder is None:
            self.folder = tempfile.mkdtemp(prefix="induced-")
        for r in np.argsort(-self.size):
            if self.size.sum() <= self.budget // 2 or not self.size[r]:
                break
            path = f"{self.folder}/{self.written}.npz"
            np.savez(path, *map(np.concatenate, zip(*self.kept[r], strict=True)))
            self.written += 1
            self.files[r].append(path)
            self.kept[r], self.size[r] = [], 0

    def pop(self, r: int) -> list[tuple[np.ndarray, ...]]:
        """All that was pushed to a range, in order; the range is empty then."""
        out = []
        for path in self.files[r]:
            with np.load(path) as f:
                out.append((f["arr_0"], f["arr_1"], f["arr_2"]))
        out += self.kept[r]
        self.total -= int(self.size[r])
        self.kept[r], self.files[r], self.size[r] = [], [], 0
        return out

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


def _joined(parts: list[tuple[np.ndarray, ...]], char, place) -> tuple[np.ndarray, ...]:
    if not parts:
        return np.zeros(0, char), np.zeros(0, place), np.zeros(0, np.uint8)
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


class _Minima:
    """Smallest of ``values[a..b]`` for many a <= b at once."""

    def __init__(self, values: np.ndarray):
        rows, width = [values], 1
        while 2 * width <= len(values):
            last = rows[-1]
            row = last.copy()
            np.minimum(last[:-width], last[width:], out=row[:-width])
            rows.append(row)
            width *= 2
        self.rows = np.stack(rows)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        return np.minimum(self.rows[level, a], self.rows[level, b - (1 << level) + 1])


class _Pushes:
    """Turns popped suffixes into the pushes of their predecessors, with common prefixes.

    Siblings pushed one after the other to a character share one more than
    the least common prefix between their parents.  Parents with different
    first characters share nothing, so minima are only kept within a bucket.
    """

    def __init__(self, alphabet: int):
        self.least = np.full(alphabet, SAME, np.uint8)
        self.touched = np.zeros(0, np.int64)

    def new_bucket(self) -> None:
        self.least[self.touched] = SAME
        self.touched = np.zeros(0, np.int64)

    def __call__(self, lcp: np.ndarray, who: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order by char of the parents ``who``, whose predecessors begin with ``char``, and the children's common prefixes."""
        order = np.argsort(char, kind="stable")
        w, c = who[order], char[order]
        minima = _Minima(lcp)
        out = np.zeros(len(w), np.uint8)
        first = np.ones(len(w), bool)
        first[1:] = c[1:] != c[:-1]
        later = np.flatnonzero(~first)
        out[later] = minima(w[later - 1] + 1, w[later])
        heads = np.flatnonzero(first)
        c_heads = c[heads]
        known = np.isin(c_heads, self.touched, kind="sort") if len(self.touched) else np.zeros(len(heads), bool)
        back = heads[known]
        out[back] = np.minimum(self.least[c[back]], minima(np.zeros(len(back), np.int64), w[back]))
        # What later siblings in this bucket have to count in.
        self.least[self.touched] = np.minimum(self.least[self.touched], lcp.min())
        tails = np.append(heads[1:], len(w)) - 1 if len(heads) else heads
        rest = w[tails] + 1
        inside = rest < len(lcp)
        self.least[c_heads] = SAME
        self.least[c_heads[inside]] = minima(rest[inside], np.full(int(inside.sum()), len(lcp) - 1))
        self.touched = np.union1d(self.touched, c_heads)
        return order, _longer(out)


def _place_type(n: int):
    return np.int32 if n < 1 << 31 else np.int64


def _types(text: np.ndarray) -> np.ndarray:
    """True for S; the last character is a unique smallest one and of type S."""
    n = len(text)
    step = np.ones(n, np.int8)
    step[:-1] = (text[1:] > text[:-1]).astype(np.int8) - (text[1:] < text[:-1])
    at = np.where(step != 0, np.arange(n, dtype=_place_type(n)), _place_type(n)(n))
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes at a and b, known to share ``start`` characters, up to CAP."""
    if len(a) > 4 * BATCH:
        some = range(0, len(a), 4 * BATCH)
        return np.concatenate([_common(text, *(x[i : i + 4 * BATCH] for x in (a, b, start))) for i in some])
    out = np.minimum(start, CAP)
    live = np.flatnonzero(out < CAP)
    n = len(text)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        live = live[text[x] == text[y]]
        out[live] += 1
        live = live[out[live] < CAP]
    return out.astype(np.uint8)


class _Level:
    def __init__(self, text: np.ndarray, alphabet: int, budget: int):
        self.text, self.alphabet, self.budget = text, alphabet, budget
        # A character each for small alphabets; else not too many ranges, as every batch pushes to most of them.
        self.small = alphabet <= 512
        self.ranges = alphabet if self.small else min(256, max(16, len(text) >> 14))
        self.kind, self.place = text.dtype, _place_type(len(text))

    def range_of(self, char: np.ndarray) -> np.ndarray:
        return char if self.small else char.astype(np.int64) * self.ranges // self.alphabet

    def _before(self, pos: np.ndarray) -> np.ndarray:
        return self.text[np.maximum(pos - 1, 0)]

    def _border(self, a: int, b: int) -> int:
        return int(_common(self.text, np.array([a]), np.array([b]), np.array([1]))[0])

    def induce(self, seeds: np.ndarray, shared: np.ndarray, naming: bool, emit: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """All suffixes from the largest to the smallest to ``emit``, each with its common prefix with the one before.

        ``seeds``: the LMS suffixes ascending (when naming: by first character
        only), ``shared``: each one's common prefix with the one before it.
        """
        chars = self.text[seeds]
        seed_at = np.searchsorted(self.range_of(chars), np.arange(self.ranges + 1))
        lefts, done = Spools(self.ranges, self.budget), Spools(self.ranges, self.budget)
        rights = Spools(self.ranges, self.budget)
        try:
            for r in range(self.ranges):
                a, b = seed_at[r], seed_at[r + 1]
                self._pass(r, lefts, (chars[a:b], seeds[a:b], shared[a:b]), naming, True, lambda c, p, v, r=r: done.push(r, c, p, v), seeds_too=False)
            # The last character is the one S suffix that no other pushes.
            rights.push(0, self.text[-1:], np.array([len(self.text) - 1], self.place), np.zeros(1, np.uint8))
            for r in range(self.ranges - 1, -1, -1):
                ended = tuple(x[::-1] for x in _joined(done.pop(r), self.kind, self.place))
                # Descending: each one's common prefix with the one before is what the next one had with it.
                lcp = np.zeros(len(ended[2]), np.uint8)
                lcp[1:] = ended[2][:-1]
                self._pass(r, rights, (ended[0], ended[1], lcp), naming, False, lambda c, p, v: emit(p, v))
        finally:
            for s in (lefts, done, rights):
                s.close()

    def _pass(self, r: int, queue: Spools, seeds: tuple, naming: bool, left: bool, emit: Callable, seeds_too: bool = True) -> None:
        """Pops one range of characters: the queue's entries of each character, then the seeds of that character.

        ``left``: the ascending pass, whose seeds are LMS suffixes; else the descending one, whose seeds are L suffixes.
        """
        pushes = _Pushes(self.alphabet)
        waiting = _joined(queue.pop(r), self.kind, self.place)
        if not self.small:
            order = np.argsort(waiting[0] if left else -waiting[0].astype(np.int64), kind="stable")
            waiting = tuple(x[order] for x in waiting)
        while len(waiting[0]) or len(seeds[0]):
            heads = [int(x[0][0]) for x in (waiting, seeds) if len(x[0])]
            char = min(heads) if left else max(heads)
            if not self.small:
                took = self._many(r, queue, waiting, seeds, char, left, naming, emit, seeds_too)
                if took is not None:
                    waiting, seeds = took
                    continue
            # One character: its queue entries in waves (they may push to their own bucket), then its seeds.
            n_w, n_s = _leading(waiting[0], char, left), _leading(seeds[0], char, left)
            wave, rest = tuple(x[:n_w] for x in waiting), tuple(x[n_w:] for x in waiting)
            ours, seeds = tuple(x[:n_s] for x in seeds), tuple(x[n_s:] for x in seeds)
            if n_w + n_s <= BATCH:
                waiting = self._one(r, queue, wave, ours, rest, char, left, naming, emit, seeds_too)
                continue
            pushes.new_bucket()
            more, last, started = [], None, False
            stages = [(wave, True)]
            while stages:
                (c, p, v), queued = stages.pop()
                own = []
                for i in range(0, len(p), BATCH):
                    cc, pp, vv = c[i : i + BATCH], p[i : i + BATCH], v[i : i + BATCH]
                    if not started:
                        vv = vv.copy()
                        vv[0] = 0
                        started = True
                    elif last is not None and not queued and i == 0:
                        # Between the queue's last entry and the first seed.
                        vv = vv.copy()
                        vv[0] = 0 if naming else self._border(last, int(pp[0]))
                    if queued or seeds_too:
                        emit(cc, pp, vv)
                    before = self._before(pp)
                    ok = self._pushed(before, char, queued, left) & (pp > 0)
                    who = np.flatnonzero(ok)
                    if len(who):
                        order, lcp = pushes(vv, who, before[who])
                        child = before[who][order], pp[who][order] - 1, lcp
                        same = child[0] == char
                        own.append(tuple(x[same] for x in child))
                        others = tuple(x[~same] for x in child)
                        more.append(others)
                    elif len(vv) and len(pushes.touched):
                        pushes.least[pushes.touched] = np.minimum(pushes.least[pushes.touched], vv.min())
                if len(p):
                    last = int(p[-1])
                own = [x for x in own if len(x[0])]
                if own:
                    stages.append((_joined(own, self.kind, self.place), True))
                elif queued and len(ours[0]):
                    stages.append((ours, False))
                    ours = tuple(x[:0] for x in ours)
            waiting = rest
            for child in more:
                here = self.range_of(child[0]) == r
                if not self.small and here.any():
                    waiting = self._merged(waiting, tuple(x[here] for x in child), left)
                    child = tuple(x[~here] for x in child)
                queue.split(*child, self.range_of)

    def _one(self, r, queue, wave, ours, rest, char, left, naming, emit, seeds_too):
        """All of one character at once; what the queue's entries push to their own bucket comes wave by wave."""
        waves, carry, first = [], SAME, True
        while len(wave[1]):
            c, p, v = wave
            if first:
                v = v.copy()
                v[0], first = 0, False
            waves.append((c, p, v))
            own = np.flatnonzero((self._before(p) == char) & (p > 0))
            if not len(own):
                break
            # Least common prefix since the parent before; no other child comes between.
            least = np.minimum.reduceat(v[: own[-1] + 1], np.append(0, own[:-1] + 1))
            least[0] = min(least[0], carry) if len(waves) > 1 else least[0]
            carry = v[own[-1] + 1 :].min(initial=SAME)
            wave = c[: len(own)], p[own] - 1, _longer(least)
        n_w = sum(len(x[1]) for x in waves)
        if len(ours[1]):
            v = ours[2].copy()
            v[0] = 0 if naming or not n_w else self._border(int(waves[-1][1][-1]), int(ours[1][0]))
            waves.append((ours[0], ours[1], v))
        c, p, v = _joined(waves, self.kind, self.place)
        if n_w and not seeds_too:
            emit(c[:n_w], p[:n_w], v[:n_w])
        elif seeds_too:
            emit(c, p, v)
        before = self._before(p)
        who = np.flatnonzero(((before > char) if left else (before < char)) & (p > 0))
        return self._push(r, queue, rest, who, before, p, v, left)

    def _push(self, r, queue, waiting, who, before, p, v, left):
        """Pushes the predecessors of ``who``; those of the range in hand go among ``waiting``."""
        if len(who):
            order, lcp = _once(v, who, before[who])
            child = before[who][order], p[who][order] - 1, lcp
            if not self.small:
                here = self.range_of(child[0]) == r
                if here.any():
                    waiting = self._merged(waiting, tuple(x[here] for x in child), left)
                    child = tuple(x[~here] for x in child)
            queue.split(*child, self.range_of)
        return waiting

    @staticmethod
    def _pushed(before, char, queued, left):
        if left:
            return before >= char if queued else before > char
        return before <= char if queued else before < char

    def _merged(self, a, b, left):
        both = tuple(np.concatenate(x) for x in zip(a, b, strict=True))
        order = np.argsort(both[0] if left else -both[0].astype(np.int64), kind="stable")
        return tuple(x[order] for x in both)

    def _many(self, r, queue, waiting, seeds, char, left, naming, emit, seeds_too):
        """Pops as many whole characters of this range as do not depend on each other; None if that is not even one."""
        sign = 1 if left else -1
        n_w, n_s = min(len(waiting[0]), BATCH), min(len(seeds[0]), BATCH)
        c = np.concatenate((waiting[0][:n_w], seeds[0][:n_s]))
        p = np.concatenate((waiting[1][:n_w], seeds[1][:n_s]))
        queued = np.arange(len(c)) < n_w
        before = self._before(p)
        ok = np.where(queued, (before >= c) if left else (before <= c), (before > c) if left else (before < c)) & (p > 0)
        key = sign * c.astype(np.int64)
        # Complete characters only, and none that something popped here pushes to.
        limit = np.iinfo(np.int64).max
        for held, n in ((waiting[0], n_w), (seeds[0], n_s)):
            if n < len(held):
                limit = min(limit, sign * int(held[n - 1]))
        if ok.any():
            limit = min(limit, int((sign * before[ok].astype(np.int64)).min()))
        if limit <= sign * char:
            return None
        take = np.flatnonzero(key < limit)
        take = take[np.lexsort((~queued[take], key[take]))]
        c, p, before, ok, queued = c[take], p[take], before[take], ok[take], queued[take]
        v = np.concatenate((waiting[2][:n_w], seeds[2][:n_s]))[take].copy()
        fresh = np.ones(len(c), bool)
        fresh[1:] = c[1:] != c[:-1]
        v[fresh] = 0
        border = np.flatnonzero(~fresh & ~queued & np.append(False, queued[:-1]))
        if len(border):
            v[border] = 0 if naming else _common(self.text, p[border - 1], p[border], np.ones(len(border), np.int64))
        kept = slice(None) if seeds_too else queued
        emit(c[kept], p[kept], v[kept])
        n_w, n_s = int(queued.sum()), int((~queued).sum())
        waiting, seeds = tuple(x[n_w:] for x in waiting), tuple(x[n_s:] for x in seeds)
        waiting = self._push(r, queue, waiting, np.flatnonzero(ok), before, p, v, left)
        return waiting, seeds


def _leading(chars: np.ndarray, char: int, ascending: bool) -> int:
    """How many of the sorted ``chars`` are the first one, ``char``."""
    if ascending:
        return int(np.searchsorted(chars, char, side="right"))
    return len(chars) - int(np.searchsorted(chars[::-1], char, side="left"))


def _longer(lcp: np.ndarray) -> np.ndarray:
    return np.where(lcp == SAME, SAME, np.minimum(lcp.astype(np.int16) + 1, CAP)).astype(np.uint8)


def _once(lcp, who, char):
    """Like ``_Pushes`` for parents of whole buckets, which no later sibling looks back to."""
    order = np.argsort(char, kind="stable")
    w, c = who[order], char[order]
    out = np.zeros(len(w), np.uint8)
    later = np.flatnonzero(c[1:] == c[:-1]) + 1
    if len(later):
        out[later] = _Minima(lcp)(w[later - 1] + 1, w[later])
    return order, _longer(out)


def _doubled(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a short text from the largest to the smallest, and common prefixes with the one before, by doubled names in memory."""
    n, rank, names, width = len(text), text.astype(np.int64), [], 1
    while True:
        if width <= CAP:
            names.append(rank.astype(np.int32))
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        both = rank * (n + 1) + after
        order = np.argsort(both, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(both[order[1:]] != both[order[:-1]])))
        width *= 2
        if rank[order[-1]] == n - 1:
            break
    order = order[::-1]
    same = np.zeros(max(0, n - 1), np.int64)
    for k in reversed(range(len(names))):
        equal = names[k][order[:-1] + same] == names[k][order[1:] + same]
        same[equal] += 1 << k
    return order, np.minimum(np.append(0, same), CAP).astype(np.uint8)


def sort_suffixes(text: np.ndarray, alphabet: int, emit: Callable[[np.ndarray, np.ndarray], None], budget: int = 64 << 20) -> None:
    """Emits all suffixes of ``text`` from the largest to the smallest.

    ``text``: whole numbers below ``alphabet``, the last a 0 that occurs
    nowhere else.  ``emit`` gets arrays of positions and of common prefixes
    (up to 254) with the suffix emitted before.  ``budget``: bytes that each
    queue keeps in memory.
    """
    n = len(text)
    if n == 1:
        emit(np.zeros(1, np.int64), np.zeros(1, np.uint8))
        return
    s = _types(text)
    lms = (np.flatnonzero(s[1:] & ~s[:-1]) + 1).astype(_place_type(n))
    del s
    level = _Level(text, alphabet, budget)
    # Naming: the LMS suffixes in order of their first character induce the order of their substrings.
    seeds = lms[np.argsort(text[lms], kind="stable")]
    shared = np.where(np.append(False, text[seeds[1:]] == text[seeds[:-1]]), SAME, 0).astype(np.uint8)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    found, differs = [], []
    least = SAME

    def name(pos, lcp):
        nonlocal least
        here = np.flatnonzero(is_lms[pos])
        # Equal to the LMS substring before if all between are.
        unequal = np.concatenate(([0], np.cumsum(lcp != SAME)))
        if not len(here):
            least = min(least, SAME if unequal[-1] == 0 else 0)
            return
        at = np.append(-1, here)
        new = unequal[here + 1] > unequal[at[:-1] + 1]
        new[0] |= least != SAME
        found.append(pos[here])
        differs.append(new)
        least = SAME if unequal[-1] == unequal[here[-1] + 1] else 0

    level.induce(seeds, shared, True, name)
    order, new = np.concatenate(found), np.concatenate(differs)
    del found, differs, is_lms
    new[0] = True
    # Descending, so the last class is the smallest name.
    names = int(new.sum()) - np.cumsum(new)
    count = int(new.sum())
    if count == len(lms):
        ranked, agreed = np.searchsorted(lms, order[::-1]), np.zeros(len(lms), np.int64)
    else:
        reduced = np.empty(len(lms), np.int32)
        reduced[np.searchsorted(lms, order)] = names
        pos_parts, lcp_parts = [], []

        def keep(pos, lcp):
            pos_parts.append(pos)
            lcp_parts.append(lcp)

        del order, names, new
        # Recursion ends where the names fit the memory that a queue may take.
        if len(reduced) * PER_NAME <= budget:
            keep(*_doubled(reduced))
        else:
            sort_suffixes(reduced, count, keep, budget)
        ranked = np.concatenate(pos_parts)[::-1]
        lcp = np.concatenate(lcp_parts)[::-1]
        # Descending common prefixes belong to the neighbour below.
        agreed = np.append(0, lcp[:-1]).astype(np.int32)
        del pos_parts, lcp_parts, lcp, reduced
    # Names agreed upon are whole substrings; from there on the characters tell.
    seeds = lms[ranked]
    known = np.zeros(len(seeds), lms.dtype)
    known[1:] = lms[np.minimum(ranked[:-1] + agreed[1:], len(lms) - 1)] - seeds[:-1]
    del ranked, agreed
    shared = np.zeros(len(seeds), np.uint8)
    shared[1:] = _common(text, seeds[:-1], seeds[1:], known[1:])
    level.induce(seeds, shared, False, emit)
