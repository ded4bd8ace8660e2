import numpy as np
import pytest

from tickerloom.llm import induced


def sorted_suffixes(text, alphabet, budget=1 << 26):
    pos, lcp = [], []
    induced.sort_suffixes(np.array(text), alphabet, lambda p, v: (pos.append(p), lcp.append(v)), budget)
    return np.concatenate(pos).tolist(), np.concatenate(lcp).tolist()


def brute(text):
    order = sorted(range(len(text)), key=lambda i: text[i:], reverse=True)

    def common(a, b):
        n = 0
        while a + n < len(text) and b + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        return min(n, induced.CAP)

    return order, [0] + [common(a, b) for a, b in zip(order, order[1:], strict=False)]


@pytest.mark.parametrize("seed", range(40))
def test_equals_plain_sorting(seed):
    r = np.random.default_rng(seed)
    alphabet = int(r.choice([1, 2, 3, 5, 600, 3000]))
    text = r.integers(1, alphabet + 1, r.integers(0, 400)).tolist()
    text = text * int(r.integers(1, 4)) + [0]
    assert sorted_suffixes(text, alphabet + 1) == brute(text)


def test_queues_on_disk_give_the_same():
    r = np.random.default_rng(5)
    text = [*np.tile(r.integers(1, 900, 700), 2).tolist(), 0]
    assert sorted_suffixes(text, 901, budget=500) == sorted_suffixes(text, 901)


def test_buckets_larger_than_a_batch(monkeypatch):
    monkeypatch.setattr(induced, "BATCH", 16)
    r = np.random.default_rng(6)
    for text in ([*r.integers(1, 3, 500).tolist(), 0], [*([1] * 300), 0], [*r.integers(1, 700, 600).tolist(), 0]):
        assert sorted_suffixes(text, 701) == brute(text)


def test_a_long_run_counts_up_to_the_cap():
    order, lcp = sorted_suffixes([*([1] * 600), 0], 2)
    assert order == list(range(601)) and max(lcp) == induced.CAP
