"""Token ids of whole texts, each distinct word of a task encoded once."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from tickerloom.llm.bytetext import SPACE, Texts, hash_runs


GATHERED = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


LETTER_OR_DIGIT = np.zeros(256, bool)
LETTER_OR_DIGIT[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
MARK = np.zeros(256, bool)
MARK[list(b'.,!?;:*#$%&()"')] = True
PLAIN_WORD = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


class Units:
    """Parts of texts that the tokenizer encodes each for itself: words, cut further where a letter or digit meets one of a few marks.

    The tokenizer splits there too, as its parts are letters, single digits or
    other signs; letters are told by ASCII and by the two-byte letters from
    U+00C0 to U+00FF, and elsewhere nothing is cut.  ``start``, ``end``,
    ``key`` and ``first`` are as in ``Words``.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, cut: bool):
        gap = SPACE[data]
        begins = ~gap
        begins[1:] &= gap[:-1]
        if cut and len(data) > 1:
            mark = MARK[data]
            wide = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            opens, closes = LETTER_OR_DIGIT[data], LETTER_OR_DIGIT[data]
            opens[:-1] |= wide
            closes[1:] |= wide
            begins[1:] |= (closes[:-1] & mark[1:]) | (mark[:-1] & opens[1:])
        inner = at[(at > 0) & (at < len(data))]
        begins[inner] = ~gap[inner]
        self.start = np.flatnonzero(begins)
        # A unit ends where the next one begins or at white space.
        stops = np.append(np.flatnonzero(begins | gap), len(data))
        self.end = stops[np.searchsorted(stops, self.start, side="right")]
        self.first = np.searchsorted(self.start, at)
        self.key = hash_runs(data, self.start, gap)


def gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches ``values[start[i] : start[i] + length[i]]`` end to end."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    out = np.empty(total, values.dtype)
    first = 0
    while first < len(ends):
        # About a million at a time, as the places take far more room than what lies there.
        done = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + GATHERED, side="right")))
        n, here = length[first:last], ends[first:last]
        upto = int(here[-1])
        out[done:upto] = values[np.arange(done, upto) + np.repeat(start[first:last] - (here - n), n)]
        first = last
    return out


class WordEncoder:
    """Ids of a text are those of its words in turn, for lower-casing tokenizers that drop white space and never look across it.

    Keeps the ids of up to about ``most`` distinct words in a table addressed
    by either end of a word's hash; the few whose two places are taken by
    others are looked up by bisection.
    """

    SLOTS = 20

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self):
        self.place = np.full(1 << self.SLOTS, -1, np.int32)
        self.known, self.used = 0, 0
        self.spare_keys, self.spare = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.keys, self.start, self.length, self.ids = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)

    def _ends(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (keys >> np.uint64(64 - self.SLOTS)).astype(np.int64), (keys & np.uint64((1 << self.SLOTS) - 1)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 for those not known."""
        high, low = self._ends(keys)
        entry = self.place[high]
        wrong = np.flatnonzero((entry < 0) | (self.keys[entry] != keys))
        other = self.place[low[wrong]]
        found = np.where((other >= 0) & (self.keys[other] == keys[wrong]), other, -1)
        if len(self.spare) and len(wrong):
            at = np.minimum(np.searchsorted(self.spare_keys, keys[wrong]), len(self.spare) - 1)
            found = np.where(self.spare_keys[at] == keys[wrong], self.spare[at], found)
        entry[wrong] = found
        return entry

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids; words of plain letters are encoded many at once and told apart by their last ids."""
        plain = np.array([PLAIN_WORD.fullmatch(w) is not None for w in words], bool)
        parts: list[list[int]] = [[]] * len(words)
        some = np.flatnonzero(plain)
        joined = [" ".join([words[k] for k in some[i : i + 200]]) for i in range(0, len(some), 200)]
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids], np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(some):
            plain[:], some, ids, last = False, some[:0], ids[:0], last[:0]
        others = np.flatnonzero(~plain)
        for k, e in zip(others.tolist(), self.tokenizer.encode_batch_fast([words[k] for k in others], add_special_tokens=False), strict=True):
            parts[k] = e.ids
        length = np.array([len(p) for p in parts], np.int64)
        length[some] = np.diff(np.append(-1, last))
        every = np.concatenate((ids, np.array([i for p in parts for i in p], np.uint32)))
        start = np.empty(len(words), np.int64)
        for which, base in ((some, 0), (others, len(ids))):
            start[which] = base + np.cumsum(length[which]) - length[which]
        return length, gather(every, start, length)

    def _learn(self, keys: np.ndarray, words: list[str]) -> np.ndarray:
        """Encodes new words; their entries."""
        length, ids = self._encoded(words)
        entry = np.arange(self.known, self.known + len(keys))
        for name, values, used in (("keys", keys, self.known), ("start", np.cumsum(length) - length + self.used, self.known), ("length", length, self.known), ("ids", ids, self.used)):
            held = getattr(self, name)
            if used + len(values) > len(held):
                held = np.resize(held, 2 * (used + len(values)))
                setattr(self, name, held)
            held[used : used + len(values)] = values
        self.known, self.used = self.known + len(keys), self.used + len(ids)
        high, low = self._ends(keys)
        for end in (high, low):
            left = np.flatnonzero(self._find(keys) < 0)
            free = left[self.place[end[left]] < 0]
            self.place[end[free]] = entry[free]
        left = np.flatnonzero(self._find(keys) < 0)
        if len(left):
            every, which = np.concatenate((self.spare_keys, keys[left])), np.concatenate((self.spare, entry[left].astype(np.int32)))
            order = np.argsort(every)
            self.spare_keys, self.spare = every[order], which[order]
        return entry

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin (one more entry than texts)."""
        # The tokenizer lower-cases all but its special tokens, so A-Z need not be told from a-z without those.
        plain = b"<|" not in texts.data.tobytes()
        data = LOWER[texts.data] if plain else texts.data
        words = Units(data, texts.at, cut=plain)
        if self.known > self.most:
            self._forget()
        entry = self._find(words.key)
        new = np.flatnonzero(entry < 0)
        if len(new):
            unique, first, back = np.unique(words.key[new], return_index=True, return_inverse=True)
            entry[new] = self._learn(unique, [data[words.start[i] : words.end[i]].tobytes().decode("utf-8", "replace") for i in new[first]])[back]
        length = self.length[entry]
        ids = gather(self.ids, self.start[entry], length)
        token_at = np.concatenate(([0], np.cumsum(length)))
        return ids, token_at[words.first]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and file."""
    return WordEncoder(path)
