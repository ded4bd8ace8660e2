"""Each operator against a plain version on small tables: nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import gam, minhash, mixing, packing, pii, rules, simhash, suffixes, token_output, urls
from tickerloom.llm.bytetext import Texts
from tickerloom.llm.components import connected
from tickerloom.llm.sources import tokenizer_path
from tickerloom.llm.tokens import WordEncoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(r, n, words=4000):
    return " ".join(f"w{r.integers(0, words)}" for _ in range(n))


def edited(r, text, share):
    words = text.split(" ")
    for k in np.flatnonzero(r.random(len(words)) < share):
        words[k] = f"x{r.integers(0, 10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    """Families of near copies around a base, exact copies, shared passages, odd texts, repeated rows and null ids."""
    r = np.random.default_rng(11)
    texts = []
    for _ in range(6):
        base = sentence(r, 150)
        texts += [base, base, *[edited(r, base, s) for s in (0.005, 0.01, 0.02, 0.03, 0.05)]]
    texts += [None, "", " \t", "one", "One two", "one two", "a b c d", "a b c d e", "A B C D E", "x" * 49, "y" * 50, "y" * 50 + "é", sentence(r, 20_000)]
    passage = sentence(r, 60)
    texts += [sentence(r, 30) + " " + passage + " " + sentence(r, 30) for _ in range(8)]
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)]
    return [*rows, rows[5], (rows[8][0], "the same id with another text of its own, long enough to be looked at as well"), (None, texts[0]), (None, None)]


def collected(df):
    return [tuple(x) for x in df.collect()]


# ---------------------------------------------------------------- near duplicates
def shingles(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_all_pairs(spark, documents, corpus, percent):
    sets = [(i, shingles(t)) for i, t in corpus]
    reach = {i: i for i, _ in corpus if i is not None}

    def find(i):
        while reach[i] != i:
            i = reach[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                reach[hi] = lo
    expected = Counter((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets)
    assert Counter(collected(minhash.near_duplicates(documents(corpus), minhash.Settings(percent=percent)))) == expected
    assert len({find(i) for i in reach}) < len(reach)


def test_near_duplicates_of_nothing(documents):
    assert collected(minhash.near_duplicates(documents([]))) == []
    assert sorted(collected(minhash.near_duplicates(documents([(3, None), (1, "")]))), reverse=True) == [(3, 0, 3, True), (1, 0, 1, True)]


def test_a_large_family_is_one_group(spark, documents):
    """Hundreds of near copies of one text, some of which are linked only through others."""
    r = np.random.default_rng(3)
    base = sentence(r, 400)
    rows = [(1000 - k, edited(r, base, 0.004)) for k in range(300)]
    got = collected(minhash.near_duplicates(documents(rows)))
    assert {x[2] for x in got} == {701} and sum(x[3] for x in got) == 1


def test_sketches_estimate_the_difference():
    r = np.random.default_rng(4)
    s = minhash.Settings(percent=85)
    for n, j in ((100, 0.9), (3000, 0.85), (20000, 0.85)):
        common = int(2 * n * j / (1 + j))
        ids = r.integers(1, 2**48, 2 * n - common).astype(np.uint64)
        a, b = np.sort(ids[:n]), np.sort(np.append(ids[:common], ids[n:]))
        x = minhash.odd_sketches(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), s.bins)
        flips = int(np.bitwise_count(x[0] ^ x[1]).sum())
        filled = lambda k: s.bins * (1 - np.exp(-k / s.bins))
        differing = filled(len(a)) + filled(len(b)) - 2 * j * filled((len(a) + len(b)) / (1 + j))
        mean = s.bins / 2 * (1 - np.exp(-2 * differing / s.bins))
        assert abs(flips - mean) < 4.5 * np.sqrt(2 * mean) + 4


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 200 + k) for k in range(60)] + [(7, 7), (41, 40)]
    got = dict(collected(connected(spark.createDataFrame(links, "a bigint, b bigint"))))
    assert got == {k: 0 for k in range(42)} | {k: 100 for k in [100, *range(200, 260)]}


# ---------------------------------------------------------------- repeated passages
def without_repeats(corpus):
    owner = {}
    for i, t in corpus:
        b = (t or "").encode()
        for p in range(len(b) - 49) if i is not None else ():
            owner[b[p : p + 50]] = min(i, owner.get(b[p : p + 50], i))
    expected = Counter()
    for i, t in corpus:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49) if i is not None else ():
            if owner[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(b) else 0
        expected[(i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)] += 1
    return expected


def test_repeats_equal_a_table_of_all_strings(documents, corpus):
    got = suffixes.remove_repeats(documents(corpus).repartition(5), keep_text=True)
    assert Counter((*x[:5], bytes(x[5])) for x in collected(got)) == without_repeats(corpus)


def test_repeats_with_crowded_anchors(spark, documents, corpus, monkeypatch):
    """Lines that many texts have between other bytes, with equal bytes to the left, to the right, on both sides, or on none."""
    r = np.random.default_rng(11)
    rulers = ["-" * 28, "=" * 60, "licensed under the terms of this notice.", "x" * 45]

    def some(n):
        return "".join(r.choice(list("abcdefgh "), n))

    sides = [some(int(n)) for n in r.integers(1, 30, 12)]
    rows = []
    for i in range(300):
        parts = [x + ruler + y for ruler in rulers for x, y in [[sides[int(r.integers(12))] if r.random() < 0.6 else some(30) for _ in range(2)]]]
        rows.append((1000 + i, some(int(r.integers(5))).join(parts)))
    rows += [r_ for r_ in corpus if r_[0] is None or r_[0] < 200]
    small = suffixes.blocks_of
    monkeypatch.setattr(suffixes, "blocks_of", lambda docs: small(docs, 4000))
    levels = []
    whole = suffixes.shared
    monkeypatch.setattr(suffixes, "shared", lambda offers, level, most: (levels.append(level), whole(offers, level, most))[1])
    expected = without_repeats(rows)
    assert sum(n * x[2] for x, n in expected.items()) > 20_000
    for most, deepest in ((20, 3), (0, 5)):
        levels.clear()
        got = suffixes.remove_repeats(documents(rows).repartition(3), keep_text=True, most=most)
        assert Counter((*x[:5], bytes(x[5])) for x in collected(got)) == expected
        assert max(levels) >= deepest


def test_longer_anchors_split_surroundings_and_lose_no_string():
    """One anchor between other bytes: each string keeps to one longer anchor, equal strings to the same."""
    r = np.random.default_rng(12)
    texts = [bytes(r.integers(97, 101, 22, dtype=np.uint8)) + b"#" * 28 + bytes(r.integers(97, 101, 22, dtype=np.uint8)) for _ in range(400)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    low = np.arange(400) * 72
    runs = low, low + 23, np.full(400, 7, np.uint64), low + 22
    groups = []
    for level in range(5):
        runs = suffixes.lengthened(data, runs[0], runs[1], runs[3], level)
        at = np.concatenate([np.arange(a, b) for a, b in zip(*runs[:2], strict=True)])
        assert sorted(at.tolist()) == [72 * i + j for i in range(400) for j in range(23)]
        anchor_of = {}
        for a, b, k in zip(*map(np.ndarray.tolist, runs[:3]), strict=True):
            for p in range(a, b):
                assert anchor_of.setdefault(data[p : p + 50].tobytes(), k) == k
        groups.append(max(Counter(runs[2].tolist()).values()))
    assert groups == sorted(groups, reverse=True) and groups[0] <= 6 and all(b - a == 1 for a, b in zip(*runs[:2], strict=True))


def test_repeats_across_many_small_blocks(spark, documents, corpus, monkeypatch):
    usual = sorted(map(str, collected(suffixes.remove_repeats(documents(corpus)))))
    small = suffixes.blocks_of
    monkeypatch.setattr(suffixes, "blocks_of", lambda docs: small(docs, 2000))
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(suffixes, "SEGMENT", 300)
    assert sorted(map(str, collected(suffixes.remove_repeats(documents(corpus))))) == usual


def test_repeats_of_nothing(documents):
    nothing = hashlib.sha256(b"").hexdigest()
    assert collected(suffixes.remove_repeats(documents([]))) == []
    assert collected(suffixes.remove_repeats(documents([(1, None)]))) == [(1, 0, 0, 0, nothing)]


# ---------------------------------------------------------------- quality
def quality_rows(r, n):
    good = [(k, ". ".join(sentence(r, 12).capitalize() for _ in range(int(r.integers(3, 30)))) + ".") for k in range(n)]
    bad = [(n + k, " ".join(w + "!!" for w in sentence(r, 80).upper().split()) if k % 2 else " ".join([sentence(r, 1)] * 200)) for k in range(n)]
    return good + bad


def test_quality_holds_out_and_separates(spark, documents):
    r = np.random.default_rng(2)
    rows = quality_rows(r, 300)
    labels = spark.createDataFrame([(i, int(i < 300)) for i, _ in rows] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    odd = [(900, None), (901, ""), (902, "x" * 10_000), (None, rows[0][1])]
    got = {(x[0], x[1]): x for x in collected(gam.quality(documents(rows + odd + rows[:1]), labels))}
    for i, held, score, predicted in got.values():
        assert held == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= score <= 1 and predicted == int(score >= 0.7)
    unseen = [x for x in got.values() if x[1] and x[0] < 600]
    assert len(unseen) > 100 and all(x[3] == int(x[0] < 300) for x in unseen)
    assert {x[0] for x in got.values()} == {i for i, _ in rows + odd}


def test_quality_without_labels_is_undecided(spark, documents):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert collected(gam.quality(documents([(1, "a"), (2, None)]), none).select("score", "predicted")) == [(0.5, 0), (0.5, 0)]
    assert collected(gam.quality(documents([]), none)) == []
    assert gam.keep_good(documents([(1, "a"), (2, None)]), none).count() == 2


def test_pairs_learn_an_interaction():
    r = np.random.default_rng(1)
    x = r.random((3000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    alone, both = gam.fit(x, y, n_pairs=0), gam.fit(x, y, n_pairs=2)
    test = r.random((1000, 3))
    truth = (test[:, 0] > 0.5) != (test[:, 1] > 0.5)
    assert ((alone.score(test) > 0.5) == truth).mean() < 0.7 < 0.95 < ((both.score(test) > 0.5) == truth).mean()


# ---------------------------------------------------------------- packing
def test_best_fit_takes_the_fullest_bin():
    bins, offset, fill = packing.best_fit(np.array([3, 6, 5, 4, 2]), 10)
    assert bins.tolist() == [1, 0, 1, 0, 1] and offset.tolist() == [5, 0, 0, 6, 8] and fill.tolist() == [10, 10]


def test_packing_is_gapless_and_tight(spark):
    r = np.random.default_rng(8)
    sizes = r.integers(1, 101, 4000)
    items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "item int, length long").repartition(20)
    path_items = packing.pin(items)
    got = collected(packing.pack(path_items, 100, fan_in=3))
    assert sorted((x[0], x[1]) for x in got) == list(enumerate(sizes.tolist()))
    places = defaultdict(list)
    for _, length, sequence, offset in got:
        places[sequence].append((offset, length))
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(spans[-1]) <= 100
    assert len(places) <= 1.02 * sizes.sum() / 100 + 1


@pytest.mark.parametrize(("low", "high"), [(1, 101), (45, 101), (51, 101), (1, 4)])
def test_handing_on_few_bins_packs_as_well_as_handing_on_all(spark, low, high):
    r = np.random.default_rng(low)
    items = packing.pin(spark.createDataFrame([(i, int(s)) for i, s in enumerate(r.integers(low, high, 900))], "item int, length long").repartition(12))
    few = packing.pack(items, 100, fan_in=2).select("sequence_id").distinct().count()
    groups = defaultdict(list)
    for x in items.withColumn("g", F.spark_partition_id()).collect():
        groups[x["g"]].append(x["length"])
    level = [packing.best_fit(np.array(v), 100)[2] for _, v in sorted(groups.items())]
    while len(level) > 1:
        level = [packing.best_fit(np.concatenate(level[i : i + 2]), 100)[2] for i in range(0, len(level), 2)]
    assert few <= len(level[0])


def test_capacity_tree_finds_the_smallest_that_fits():
    r = np.random.default_rng(3)
    tree, held = token_output.CapacityTree(100), []
    for _ in range(500):
        if held and r.random() < 0.4:
            free = held.pop(int(r.integers(len(held))))
            tree.add(free, -1)
        else:
            held.append(int(r.integers(0, 101)))
            tree.add(held[-1], 1)
        size = int(r.integers(0, 101))
        assert tree.smallest(size) == min((f for f in held if f >= size), default=-1)


def test_id_matrices_give_every_document_back(spark, documents, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "BUFFER_TOKENS", 2000)
    path = tokenizer_path("word_bpe_49k.json")
    plain, r = Tokenizer.from_file(path), np.random.default_rng(21)
    rows = [(k, sentence(r, int(n))) for k, n in enumerate(r.integers(0, 120, 60))] + [(100, None), (101, ""), (None, "a b"), (3, "again"), (102, sentence(r, 900))]
    parts, fill = defaultdict(list), []
    for x in token_output.packed_ids(documents(rows).repartition(3), path, 64).collect():
        ids = np.frombuffer(bytes(x["ids"]), "<u2")
        assert len(ids) == 64 and not ids[x["n_tokens"] :].any() and x["cu_seqlens"][0] == 0 and x["cu_seqlens"][-1] == x["n_tokens"]
        assert x["position_resets"] == x["cu_seqlens"][:-1] and x["n_segments"] == len(x["doc_ids"]) and zlib.crc32(bytes(x["ids"])) == x["ids_crc32"]
        for k, name in enumerate(x["doc_ids"]):
            parts[(name, x["starts"][k])].append(ids[x["cu_seqlens"][k] : x["cu_seqlens"][k + 1]].tolist())
        fill.append(x["n_tokens"])
    expected = defaultdict(list)
    for name, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        for a in range(0, len(ids), 64):
            expected[(name, a)].append(ids[a : a + 64])
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in expected.items()}
    assert sum(fill) > 0.9 * 64 * len(fill)
    assert token_output.packed_ids(documents([]), path, 64).isEmpty()


def test_pieces_hold_the_tokenizers_ids(spark, documents):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = ["Hello, hello WORLD's 12", None, "", "İ ΣΑΣ don't", "<|endoftext|> X", "naïve\u00a0e\u0301 日本", sentence(np.random.default_rng(0), 3000)]
    rows = [*enumerate(texts), (0, texts[0]), (None, "a")]
    expected = Counter()
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        for piece, a in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[a : a + 64], "<u4")
            expected[(i, piece, a, len(part), zlib.crc32(part.tobytes()))] += 1
    got = collected(packing.pack_documents(documents(rows), path, 64))
    assert Counter(x[:5] for x in got) == expected
    assert sum(x[3] for x in got) == sum(k[3] * n for k, n in expected.items())
    assert collected(packing.pack_documents(documents([]), path, 64)) == []


def test_word_table_survives_crowding(monkeypatch):
    monkeypatch.setattr(WordEncoder, "SLOTS", 4)
    encoder = WordEncoder(tokenizer_path("word_bpe_49k.json"), most=150)
    r = np.random.default_rng(1)
    for _ in range(5):
        texts = [sentence(r, 40, 300) for _ in range(4)]
        ids, at = encoder.encode(Texts(pa.array(texts)))
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


# ---------------------------------------------------------------- urls
def test_host_path_and_longest_rule(spark):
    cases = {
        "HTTP://WWW.A.Example.NET/en/x?q#f": ("www.a.example.net", "/en/x", "example.net/en/", "allow"), "http://b.net/en": ("b.net", "/en", "net/", "block"),
        "http://b.net": ("b.net", "", None, None), "http://example.com/de/1": ("example.com", "/de/1", "example.com/de/", "block"),
        "x://notexample.com/de/1": ("notexample.com", "/de/1", None, None), "https://é.org/fr/?a": ("é.org", "/fr/", "org/fr/", "allow"),
        "http://h#a/b?c": ("h", "", None, None), "a://b://c/d": ("b:", "//c/d", None, None), "": ("", "", None, None), "nothing": ("", "", None, None),
        "http://user.net?x": ("user.net", "", None, None), "http://ÄB.net/": ("Äb.net", "/", "net/", "block"),
    }
    pages = spark.createDataFrame([(k, u, "p", 0.1) for k, u in enumerate([*cases, None, *cases])], "page_id bigint, url string, path string, score double")
    got = collected(urls.filter_urls(pages))
    wanted = [*cases.values(), ("", "", None, None), *cases.values()]
    for (_, *row), want in zip(sorted(got), wanted, strict=True):
        assert tuple(row[:3]) == want[:3] and row[3] == (want[3] or row[3]) and row[3] in ("allow", "block")
    assert collected(urls.filter_urls(pages.limit(0))) == []


def test_url_model_tells_unseen_hosts_apart(spark):
    bad = ["https://spam-farm.example.com/en/1", "http://www.cheap-pills.example.org/en/450?page=2", "https://casino-win.example.com/fr/2", "http://m.free-bets.example.com/en/3"]
    good = ["http://ththre.example.com/fr/825?page=2", "https://thther.example.org/en/685", "https://m.therou.example.com/en/474.html", "http://blog.orchard.example.com/en/9"]
    pages = spark.createDataFrame(list(enumerate(bad + good)), "page_id bigint, url string")
    got = [x[1] for x in sorted(collected(urls.filter_urls(pages, rules=()).select("page_id", "verdict")))]
    assert got == ["block"] * 4 + ["allow"] * 4


# ---------------------------------------------------------------- host rules
def test_base_counts_equal_plain_ones(documents, corpus):
    odd = [(500, "\n\n x\n x\nx\nx"), (501, "a b c a b c d"), (502, "#*$ |<> é日 &%"), (503, "a a a a a a"), (504, "l\r\nl\r\nl")]

    def plain(t):
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + d for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for d in range(3)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)

    rows = corpus + odd
    got = Counter(x[:7] for x in collected(rules.judge(documents(rows))))
    assert got == Counter((i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]) for i, c in ((i, plain(t)) for i, t in rows))
    assert collected(rules.judge(documents([]))) == []


def test_a_host_goes_only_when_most_of_it_fails(documents):
    r = np.random.default_rng(7)
    rows = [(100 * h + k, sentence(r, 60) if k >= bad else "short", None if h == 9 else f"h{h}") for h, bad in enumerate([0, 1, 2, 3, 2, 1, 0, 38, 1, 2]) for k in range(40)]
    rows.append((5000, sentence(r, 60), "alone"))
    kept = {(x[0], x[7]) for x in collected(rules.judge(documents(rows)))}
    assert kept == {(i, t != "short" and h != "h7") for i, t, h in rows}


def test_one_hot_host_says_little_about_many_small_ones(documents):
    """A third and more of all texts in a host that mostly fails; every other host has two clean texts."""
    r = np.random.default_rng(3)
    rows = [(k, "short" if k % 5 < 3 else sentence(r, 60), "hot") for k in range(500)]
    rows += [(1000 + k, sentence(r, 60), f"h{k // 2}") for k in range(600)]
    kept = {x[0]: x[7] for x in collected(rules.judge(documents(rows)))}
    assert all(kept[1000 + k] for k in range(600)) and not any(kept[k] for k in range(500))


def test_a_prior_of_one_text_where_no_spread_can_be_told(documents):
    r = np.random.default_rng(4)
    lone = [(k, sentence(r, 60) if k % 3 else "short", f"h{k}") for k in range(30)]
    assert {x[0]: x[7] for x in collected(rules.judge(documents(lone)))} == {k: t != "short" for k, t, _ in lone}


# ---------------------------------------------------------------- fingerprints
def test_edits_and_order_of_documents(documents, corpus):
    rows = [(i, t or "") for i, t in corpus]
    ordered = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1].encode()))
    expected = Counter()
    for (i, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        half = len(t) // 2
        expected[(i, len(t), hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest())] += 1
    got = collected(simhash.fingerprint_edits(documents(corpus).repartition(4)))
    assert Counter(x[:3] for x in got) == expected
    assert all(0 <= v <= 1 for x in got for v in x[5:])
    by_text = dict(collected(simhash.fingerprint_documents(documents([(k, t) for k, (_, t) in enumerate(corpus)]))))
    for k, (_, t) in enumerate(corpus):
        assert by_text[k] == by_text[[x for _, x in corpus].index(t)]
    assert collected(simhash.fingerprint_edits(documents([]))) == []
    assert len(collected(simhash.fingerprint_edits(documents([(None, "a b")])))) == 1


def test_half_edited_texts_stay_nearer_than_strangers(documents):
    r = np.random.default_rng(9)
    got = collected(simhash.fingerprint_edits(documents([(k, sentence(r, 150)) for k in range(60)])))
    assert min(x[5] for x in got) > 0.5 and np.mean([x[5] > x[6] for x in got]) > 0.95


def test_fingerprints_count_votes():
    text = "a b c d e f g a b c"
    keys, _, _ = simhash.windows(simhash.Words(Texts(pa.array([text]))), 3)
    got = simhash.fingerprints(Texts(pa.array(["", text, *["q r s " * 400] * 2, None])))
    for half, salted in enumerate((keys, simhash.mix(keys ^ np.uint64(0x6A09E667F3BCC909)))):
        votes = sum(1 if int(k) >> b & 1 else -1 for k in salted for b in [0])
        assert (int(got[1, half]) & 1) == (votes > 0)
    assert got[0].tolist() == got[4].tolist() == [0, 0] and got[2].tolist() == got[3].tolist()


def test_block_tables_find_everything_in_the_radius(spark):
    r = np.random.default_rng(12)
    base = [int.from_bytes(r.bytes(16)) for _ in range(30)]
    near = [b ^ sum(1 << int(k) for k in r.choice(128, d, replace=False)) for b in base for d in range(6)]
    index = spark.createDataFrame([(f"{x:032x}",) for x in near] + [(None,)], "fingerprint string")
    queries = spark.createDataFrame([(f"{x:032x}",) for x in base], "fingerprint string")
    got = set(collected(simhash.find_within(queries, index)))
    assert got == {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in base for b in near if (a ^ b).bit_count() <= 3}


# ---------------------------------------------------------------- mixing
def test_mix_equals_a_sorted_one(documents):
    r = np.random.default_rng(13)
    rows = [(k, sentence(r, int(r.integers(1, 60))), ["big", "tiny", "mid", None, "z"][int(r.choice(5, p=[0.6, 0.02, 0.2, 0.1, 0.08]))]) for k in range(1500)]
    rows += [(2000, None, "big"), (2001, "", "empty"), rows[0]]
    got = collected(mixing.mix(documents(rows)))
    size = lambda t: len(WORD.findall(t or ""))
    sources = sorted({s for _, _, s in rows if s is not None}) + [None]
    total = {s: sum(size(t) for _, t, q in rows if q == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    open_, target, left = set(sources), {}, 1.5 * sum(total.values())
    while True:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit >= 2 * total[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * total[s]
        left, open_ = left - sum(target[s] for s in full), open_ - full
    target |= {s: weight[s] * unit for s in open_}
    taken = defaultdict(int)
    of = {i: s for i, _, s in rows}
    for i, n, source_size, goal, words in got:
        s = of[i]
        assert source_size == total[s] and goal == pytest.approx(target[s]) and words in (0, n, 2 * n)
        taken[s] += words
    longest = {s: max(size(t) for _, t, q in rows if q == s) for s in sources}
    assert all(abs(target[s] - taken[s]) <= longest[s] / 2 + 1 for s in sources)
    assert sorted(got, key=str) == sorted(collected(mixing.mix(documents(rows).repartition(3))), key=str)
    assert Counter((x[0], x[4]) for x in got if x[1]) == Counter((i, size(t) * n) for i, t, n in _copies(mixing.resample(documents(rows)), rows) if size(t))
    assert collected(mixing.mix(documents([]))) == []


def _copies(sampled, rows):
    often = Counter((x["doc_id"], x["text"]) for x in sampled.collect())
    twice = Counter((i, t) for i, t, _ in rows)
    return [(i, t, often[(i, t)] // twice[(i, t)]) for i, t, _ in rows]


# ---------------------------------------------------------------- personal data
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_spans(t):
    digits = lambda m: re.sub(r"[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in EMAIL.finditer(t)], "ip": [m.span() for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15],
    }


def test_base_spans_equal_the_patterns():
    r = np.random.default_rng(14)
    for _ in range(4000):
        t = "".join(r.choice(list("aZ@@..1292+- ()%é"), int(r.integers(0, 30))))
        assert pii.base_spans(t) == plain_spans(t), t


def test_detect_keeps_base_spans_and_finds_more(documents):
    texts = [
        "mail bob.7@a1.example.com or call +1 (212) 555-0188 4111 1111 1111 1111", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" in é text', None, "", "no data, version 2.0.",
        "from 10.0.0.1 and 300.1.1.1", "é 4111111111111111 5500000000000004 x", "a" * 200_000 + " 1.2.3.4 " + "9" * 100_000,
    ]
    got = {x[0]: x for x in collected(pii.detect(documents([*enumerate(texts), (None, texts[0])])))}
    for i, t in [*enumerate(texts), (None, texts[0])]:
        base = plain_spans(t or "") if len(t or "") < 1000 else pii.base_spans(t)
        said = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k])
        assert got[i][1:6] == (*(len(base[k]) for k in pii.KINDS), hashlib.sha256(said.encode()).hexdigest())
        assert set(said.split(",")) - {""} <= set(got[i][6].split(","))
    assert "secret:9:49" in got[1][6] and got[4][6] == "" and {"card:2:18", "card:19:35"} <= set(got[6][6].split(","))
    assert collected(pii.detect(documents([]))) == []


def test_field_finds_unseen_spans():
    import random

    rng, weights, right = random.Random(123), pii.trained(), 0
    for _ in range(300):
        text, spans = pii._made(rng)
        tokens = [m.span() for m in pii.TOKEN.finditer(text)]
        right += [(tokens[i][0], tokens[j][1], k) for i, j, k in pii.decode(pii.segments(text, tokens), weights)] == spans
    assert right >= 290


def test_best_segmentation_equals_all_of_them():
    """The dynamic program against every way to cut a short text."""
    weights = pii.trained()
    text = "a 10.0.0.1 4111111111111111 +1 (212) 555-0188"
    tokens = [m.span() for m in pii.TOKEN.finditer(text)]
    lattice = pii.segments(text, tokens)
    score = lambda on: weights[:, on].sum(1).max()
    best = [0.0]
    for j in range(len(tokens)):
        best.append(max([best[j]] + [best[i] + score(on) for i, on in lattice[j]]))
    found = pii.decode(lattice, weights)
    assert sum(score(next(on for a, on in lattice[j] if a == i)) for i, j, _ in found) == pytest.approx(best[-1])
    assert [pii.ALL[k] for _, _, k in found] == ["ip", "card", "phone"]


def test_masking_replaces_spans_and_nothing_else(documents):
    rows = [(1, "call +1 (212) 555-0188 now"), (2, None), (3, "clean text"), (4, "x@y.org 1.2.3.4")]
    masked = pii.mask(documents(rows))
    assert masked.columns == documents(rows).columns
    assert {x["doc_id"]: x["text"] for x in masked.collect()} == {1: "call <phone> now", 2: None, 3: "clean text", 4: "<email> <ip>"}


def test_secrets_of_any_number_of_tokens():
    """A run of digits and letters in turn is found whole, however many tokens it is."""
    import random

    rng, weights = random.Random(5), pii.trained()
    secrets = ["f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda", "a1" * 20, "0f" * 64, *["".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (40, 64) * 50]]
    for secret in secrets:
        text = f'set token = "{secret}" here'
        found = pii.find(text, weights)[1]
        assert ("secret", 13, 13 + len(secret)) in found, secret
        assert [s for s in found if s[0] not in pii.KINDS] == [("secret", 13, 13 + len(secret))]
        assert secret[:8] not in pii.masked(text, weights) and secret[-8:] not in pii.masked(text, weights)


def test_keys_are_found_whole_at_any_length_and_with_marks():
    rng, weights = random.Random(6), pii.trained()
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    for lead, key in (
        ('key: "', hexes(140)), ('token = "', hexes(129)), ('key: "', "a1b2" * 2000), ('password: "', "QwErTyUiOp" * 40), ("api_key: ", "sk-AbC123xyz-889900aabbccdd"),
        ("secret=", "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo0NTY3ODk/abc+d=="), ('token = "', "4111111111111111abcdefabcdefabcdefabcdef"),
    ):
        text = f'{lead}{key}" and more'
        found = pii.find(text, weights)[1]
        assert [s for s in found if s[0] == "secret"] == [("secret", len(lead), len(lead) + len(key))]
        assert pii.masked(text, weights).endswith('>" and more') and key[-12:] not in pii.masked(text, weights)
    # Both the number and the key around it are reported.
    assert ("card", 9, 25) in pii.find('token = "4111111111111111abcdefabcdefabcdefabcdef"', weights)[1]
    for plain in ("see the-10-best-places-to-visit-in-2020 now", "in usr/local/lib/python3/dist-packages/x now", "at 2021-05-06T10-20-30 sharp", "a well-known-and-long-hyphenated-word here"):
        assert pii.find(plain, weights)[1] == []


def test_best_segmentation_equals_trying_all():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(1, 7)
        weights = np.array([[rng.uniform(-2, 2) for _ in range(5)] for _ in range(3)])
        lattice = [[(i, sorted(rng.sample(range(5), rng.randint(1, 3)))) for i in range(j + 1) if rng.random() < 0.5] for j in range(n)]

        def best(j):
            """Highest score of the first j tokens."""
            if not j:
                return 0.0
            return max([best(j - 1)] + [best(i) + weights[:, on].sum(1).max() for i, on in lattice[j - 1]])

        spans = pii.decode(lattice, weights)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        on_of = {(i, j): on for j, here in enumerate(lattice) for i, on in here}
        assert sum(weights[k, on_of[i, j]].sum() for i, j, k in spans) == pytest.approx(best(n))


def test_spans_without_a_digit(documents):
    """Spelt-out addresses and named secrets need neither digit nor at sign."""
    weights = pii.trained()
    rows = {
        "write to jane.doe [at] example [dot] com please": [("email", 9, 40)],
        "ask joe(at)example.org now": [("email", 4, 22)],
        "mail anna (AT) mail (dot) example (dot) net today": [("email", 5, 43)],
        'the password: "QwErTyUiOpAsDfGhJkLzXcVbNm" is old': [("secret", 15, 41)],
        "meet [at] noon, the key point is Donaudampfschifffahrtsgesellschaft": [],
    }
    for text, spans in rows.items():
        assert pii.find(text, weights)[1] == spans, text
    got = {x["doc_id"]: x["spans"] for x in pii.detect(documents([*enumerate(rows), (9, None)])).collect()}
    assert got == {**{i: pii._joined(s) for i, s in enumerate(rows.values())}, 9: ""}
    masked = {x["doc_id"]: x["text"] for x in pii.mask(documents([*enumerate(rows)])).collect()}
    assert masked[0] == "write to <email> please" and masked[3] == 'the password: "<secret>" is old'


def test_dense_stretches_have_no_borders():
    """Spans of a long stretch full of digits are those each line has alone, wherever they lie."""
    weights = pii.trained()
    line = 'Ann tel: (212) 555-0188; key = "0123456789abcdef0123456789abcdef01234567", DE89370400440532013000 and bob [at] mail7 [dot] com'
    alone = pii.find(line, weights)[1]
    assert [k for k, _, _ in alone] == ["email", "phone", "secret", "iban"]
    for lead in (0, 7, 61):
        for mark in ("\n", " ", ", "):
            text = "1" * lead + mark + mark.join([line] * 60)
            shifts = [lead + len(mark) + k * (len(line) + len(mark)) for k in range(60)]
            want = {(k, a + s, b + s) for s in shifts for k, a, b in alone}
            assert set(pii.added_spans(text, {}, weights)) == want, (lead, mark)
