import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tickerloom.llm.bytetext import Texts, Words, chunks, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.none() | st.text(st.sampled_from("aB é\n\t | 日"), max_size=30), min_size=1, max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    t = Texts(pa.array(texts, pa.string()))
    words = Words(t)
    expected = [WORD.findall(x or "") for x in texts]
    assert words.per_text.tolist() == [len(w) for w in expected]
    assert [t.data[a:b].tobytes().decode() for a, b in zip(words.start, words.end, strict=True)] == [w for one in expected for w in one]
    assert t.code_points().tolist() == [len(x or "") for x in texts]
    flat = [w for one in expected for w in one]
    assert len(set(words.key.tolist())) == len(set(flat))


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_windows_tell_sequences_apart(texts):
    words = Words(Texts(pa.array(texts, pa.string())), lower=True)
    keys, owner, _ = windows(words, 3, short_as_one=True)
    expected = []
    for i, x in enumerate(texts):
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in x or ""))
        expected += [(i, tuple(w[k : k + 3])) for k in range(len(w) - 2)] if len(w) >= 3 else [(i, tuple(w))] * bool(w)
    assert sorted(owner.tolist()) == sorted(i for i, _ in expected)
    assert len(set(keys.tolist())) == len({s for _, s in expected})


def test_chunks_hold_every_row_once():
    rows = ["x" * n for n in (5, 0, 100, 1, 1, 1)] + [None]
    batch = pa.RecordBatch.from_pydict({"t": rows})
    parts = [p.column("t").to_pylist() for p in chunks(batch, "t", 10, 2)]
    assert [x for p in parts for x in p] == rows
    assert all(len(p) <= 2 for p in parts)


def test_sliced_columns_start_at_their_own_offset():
    t = Texts(pa.array(["ab", None, "cd e"], pa.string()).slice(1))
    assert (t.data.tobytes(), t.at.tolist()) == (b"cd e", [0, 0, 4])
    assert np.array_equal(Words(t).per_text, [0, 2])
