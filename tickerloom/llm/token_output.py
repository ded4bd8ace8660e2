"""Packed token ids as binary rows for training.

Documents are cut into pieces no longer than a sequence, and the pieces of a
task's buffer are packed best-fit-decreasing: a segment tree over the free
capacities in use finds the fullest sequence that still takes a piece.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.bytetext import Texts, chunks
from tickerloom.llm.tokens import encoder

BUFFER_TOKENS = 4 << 20
ROWS = 128


class CapacityTree:
    """How many open sequences have each free capacity, summed up in a segment tree."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, free: int, n: int) -> None:
        at = self.leaves + free
        while at:
            self.count[at] += n
            at >>= 1

    def smallest(self, size: int) -> int:
        """Smallest free capacity in use that is at least ``size``, or -1."""
        at = self.leaves + size
        if self.count[at]:
            return size
        # Up until a right sibling has something, then down its leftmost branch.
        while at > 1 and (at & 1 or not self.count[at + 1]):
            at >>= 1
        if at <= 1:
            return -1
        at += 1
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Sequences of item indexes, longest items first, each item in the fullest sequence that takes it."""
    tree, holding, waiting = CapacityTree(capacity), [], [[] for _ in range(capacity + 1)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        free = tree.smallest(size)
        if free < 0:
            s, free = len(holding), capacity
            holding.append([])
        else:
            s = waiting[free].pop()
            tree.add(free, -1)
        holding[s].append(i)
        if free > size:
            waiting[free - size].append(s)
            tree.add(free - size, 1)
    return holding


def packed_ids(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, pad_id: int = 0, nearly: float = 0.99, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, n_segments, doc_ids, pieces, starts, cu_seqlens, position_resets, ids, ids_crc32.

    A document is its text's ids and ``end_id``; longer ones are cut every
    ``capacity`` ids.  ``ids`` is one row of the id matrix: ``capacity``
    little-endian unsigned integers (two bytes where the vocabulary allows,
    else four), padded with ``pad_id`` after ``n_tokens``.  ``cu_seqlens``
    runs from 0 to ``n_tokens``; positions start again from 0 at each of
    ``position_resets``.  ``doc_ids``, ``pieces`` and ``starts`` tell for each
    segment its document, the number of the piece and the ids before it, so
    every document can be put together again.

    A task packs what its buffer holds, hands on the sequences that are at
    least ``nearly`` full and packs the others' pieces again with what
    follows; texts never move between tasks.  Null and empty texts are
    ``end_id`` alone; repeated rows are packed each; an empty table gives no
    rows; other columns are not looked at.
    """
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode = encoder(tokenizer)
        width = np.dtype("<u2") if len(encode.ends) <= 1 << 16 else np.dtype("<u4")
        task, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []  # (id, piece, start, ids)
        tokens = 0

        def rows(groups):
            nonlocal number
            for i in range(0, len(groups), ROWS):
                made = []
                for group in groups[i : i + ROWS]:
                    matrix = np.full(capacity, pad_id, width)
                    ends = np.cumsum([0, *(len(p[3]) for p in group)])
                    matrix[: ends[-1]] = np.concatenate([p[3] for p in group])
                    raw = matrix.tobytes()
                    made.append(((task << 32) + number, int(ends[-1]), len(group), [p[0] for p in group], [p[1] for p in group], [p[2] for p in group], ends.tolist(), ends[:-1].tolist(), raw, zlib.crc32(raw)))
                    number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

        def pack(last):
            nonlocal held, tokens
            full, rest = [], []
            for group in best_fit_decreasing(np.array([len(p[3]) for p in held], np.int64), capacity):
                size = sum(len(held[k][3]) for k in group)
                (full if last or size >= nearly * capacity else rest).append([held[k] for k in group])
            if len(rest) * capacity > BUFFER_TOKENS // 2:
                # Pieces that do not go together would fill the buffer: those sequences are done as they are.
                full, rest = full + rest, []
            held = [p for group in rest for p in group]
            tokens = sum(len(p[3]) for p in held)
            yield from rows(full)

        schema = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("doc_ids", pa.list_(source_type)), ("pieces", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("ids", pa.binary()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, at = encode.encode(Texts(part.column("text")))
                ids = np.insert(ids.astype(width), at[1:], end_id)
                at = (at + np.arange(len(at))).tolist()
                for name, a, b in zip(part.column("doc_id").to_pylist(), at, at[1:], strict=False):
                    for piece, start in enumerate(range(0, b - a, capacity)):
                        held.append((name, piece, start, ids[a + start : min(b, a + start + capacity)]))
                    tokens += b - a
                if tokens >= BUFFER_TOKENS:
                    yield from pack(False)
        if held:
            yield from pack(True)

    from pyspark.sql.pandas.types import to_arrow_type

    source_type = to_arrow_type(source.schema["doc_id"].dataType)
    return source.mapInArrow(run, (
        f"sequence_id long, n_tokens int, n_segments int, doc_ids array<{kind}>, pieces array<int>, starts array<long>, "
        "cu_seqlens array<int>, position_resets array<int>, ids binary, ids_crc32 long"
    ))
