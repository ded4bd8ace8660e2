"""Repeated windows of words against comparing all windows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tickerloom.llm import lempel

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(rows):
    texts = [WORD.findall(t or "") for _, t in rows]
    windows = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    out = []
    for (name, _), w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if windows[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((name, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def found(spark, documents, rows, **more):
    return sorted([tuple(x) for x in lempel.remove_repeated_words(documents(rows), keep_text=True, **more).collect()], key=str)


@pytest.fixture(scope="module")
def corpus():
    r = np.random.default_rng(3)

    def words(n, many=5000):
        return [f"w{x}" for x in r.integers(0, many, n)]

    line, passage = words(20), words(60)
    texts = [None, "", " \t\n", "one", "á  b\tc\nd", " ".join(words(34)), " ".join(words(35)), "same " * 34, "same " * 36, "ab " * 100]
    texts += [" ".join(words(30) + passage[k : k + n] + words(30)) for k, n in ((0, 60), (0, 60), (5, 34), (20, 36), (10, 50), (25, 35), (0, 35))]
    # A line that all share, in surroundings that differ or agree for a while.
    near = words(17)
    texts += [" ".join(words(40) + near[17 - k % 18 :] + line + near[: k % 18] + words(40)) for k in range(60)]
    copy = " ".join(words(300))
    texts += [copy, copy, copy + " and more", "more and " + copy, copy.upper()]
    twice = words(50)
    texts += [" ".join(twice + words(3) + twice), " ".join(words(20_000, 10**6)), " ".join(words(3000, 3))]
    rows = [(k * 7 % 501, t) for k, t in enumerate(texts)]
    return [*rows, rows[12], (rows[3][0], "an id that another row has"), (None, copy), (None, None)]


@pytest.mark.parametrize("hot", [lempel.HOT, 2])
def test_equals_comparing_all_windows(spark, documents, corpus, hot):
    assert found(spark, documents, corpus, hot=hot) == expected(corpus)


def test_no_rows(spark, documents):
    assert lempel.remove_repeated_words(documents([(1, "x")]).limit(0)).isEmpty()


def test_only_texts_too_short(spark, documents):
    rows = [(1, None), (2, "a b"), (3, "a b")]
    assert found(spark, documents, rows) == expected(rows)


@pytest.mark.parametrize("seed", range(5))
def test_factors_find_what_comparing_places_finds(seed):
    r = np.random.default_rng(seed)
    length = r.integers(35, 63, 40)
    base = r.integers(0, 3, 63)
    stretches = [np.where(r.random(n) < 0.01, 9 + r.integers(0, 3, n), base[:n]).astype(np.uint64) for n in length]
    block = lempel.Reference(np.concatenate(stretches), length)
    start = np.cumsum(length) - length
    windows = Counter(tuple(s[i : i + 35].tolist()) for s in stretches for i in range(len(s) - 34))
    want = [a + i for a, s in zip(start, stretches, strict=True) for i in range(len(s) - 34) if windows[tuple(s[i : i + 35].tolist())] > 1]
    assert np.flatnonzero(lempel.repeated_windows(block.match, start, start + length)).tolist() == want
    # Factors cover each stretch end to end, and none can be made longer.
    owner, first, last = lempel.factors(block.match, start, start + length)
    assert all((first[1:] == last[:-1]) | (owner[1:] != owner[:-1]))
    assert all((last - first >= block.match[first]) | (last == (start + length)[owner]))


def test_longest_match_elsewhere():
    words = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3], np.uint64)
    assert lempel.Reference(words, np.array([6, 3])).match.tolist() == [3, 2, 1, 2, 1, 0, 3, 2, 1]
