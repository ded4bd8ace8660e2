"""Hierarchical residual packing of token pieces into sequences.

Every task packs its own pieces best-fit; bins that are nearly full are done,
the others go up a tree of ever fewer groups as items of their own size and
are packed best-fit again.  Only the bins move, their pieces learn at the end
where they went.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.bytetext import Texts, chunks
from tickerloom.llm.tokens import encoder
from tickerloom.session import pin


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin; longest first, each into the fullest bin that still takes it.

    Bins wait in one stack per free space; a bitmap of the spaces in use gives
    the smallest that fits.
    """
    n = len(sizes)
    bin_of, offset, fill = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        above = used >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            b = waiting[free].pop()
            if not waiting[free]:
                used &= ~(1 << free)
        else:
            free, b = capacity, len(fill)
            fill.append(0)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += size
        left = free - size
        if left:
            waiting[left].append(b)
            used |= 1 << left
    return bin_of, offset, np.array(fill, np.int64)


def _settle(fill: np.ndarray, capacity: int, nearly: float, others: int) -> np.ndarray:
    """Which bins of a group are done while ``others`` more groups go on.

    No two bins that best-fit leaves go together, so all but one are more than
    half full, of this group as of any other.  What can still come to them is
    the one emptier bin of each other group, so the emptiest ``others`` serve
    as well as all; those, and the one at most half full, go on unless they
    are nearly full.
    """
    done = fill >= nearly * capacity
    rest = np.flatnonzero(~done & (2 * fill > capacity))
    if len(rest) > others:
        done[rest[np.argsort(fill[rest], kind="stable")[others:]]] = True
    return done


def _going_on(capacity: int, nearly: float, others: int):
    """Keeps the bins of a group that are not done; see ``_settle``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_bin")
        return rows[~_settle(rows["_fill"].to_numpy(), capacity, nearly, others)]

    return run


def pack(items: DataFrame, capacity: int, nearly: float = 0.995, fan_in: int = 8) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``items``, whose ``length`` is 1 to ``capacity``.

    Offsets within a sequence are gapless from 0.  Items stay where they are
    packed first; up the tree go bins alone (group, number, fill), as many as
    there are groups still, and each level notes which bin went where.
    ``items`` must be read from a table, so that a lost task packs the same
    rows again.  No items give no rows; equal items are packed each.
    """
    columns = items.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)

    def local(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        rows = pa.Table.from_batches(rows)
        group = TaskContext.get().partitionId()
        bin_of, offset, fill = best_fit(rows.column("length").to_numpy(), capacity)
        for name, values in zip(["_group", "_bin", "_fill", "_place"], [np.full(len(bin_of), group), bin_of, fill[bin_of], offset], strict=True):
            rows = rows.append_column(name, pa.array(values))
        yield from rows.to_batches()

    placed = pin(items.mapInArrow(local, f"{kinds}, _group long, _bin long, _fill long, _place long"))
    groups = (placed.agg(F.max("_group")).first()[0] or 0) + 1
    # Every bin begins where it holds its first item.
    bins = placed.filter("_place = 0").select("_group", "_bin", "_fill")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        # In one order whatever order the bins came in.
        rows = rows.sort_values(["_group", "_bin"])
        bin_of, base, fill = best_fit(rows["_fill"].to_numpy(), capacity)
        return rows.assign(_to=rows["_next"], _number=bin_of, _base=base, _full=fill[bin_of])[["_group", "_bin", "_to", "_number", "_base", "_full"]]

    moves, height = [], 0
    while groups > 1 or not height:
        height, before = height + 1, groups
        groups = -(-groups // fan_in)

        kept = bins.groupBy("_group").applyInPandas(_going_on(capacity, nearly, before - 1), "_group long, _bin long, _fill long")
        step = kept.withColumn("_next", F.floor(F.col("_group") / fan_in).cast("long"))
        moved = pin(step.groupBy("_next").applyInPandas(merge, "_group long, _bin long, _to long, _number long, _base long, _full long"))
        moves.append(moved)
        bins = moved.groupBy(F.col("_to").alias("_group"), F.col("_number").alias("_bin")).agg(F.first("_full").alias("_fill"))
    # Where each bin of the lowest level ends up, put together from the top.
    final = None
    for level, moved in reversed(list(enumerate(moves, 1))):
        here = moved.select("_group", "_bin", "_to", "_number", "_base", (F.lit(level << 58) + F.shiftleft("_to", 34) + F.col("_number")).alias("_id"))
        if final is not None:
            up = final.select(F.col("_group").alias("_to"), F.col("_bin").alias("_number"), F.col("_base").alias("_more"), F.col("_id").alias("_end"))
            here = here.join(up, ["_to", "_number"], "left").withColumns({"_base": F.col("_base") + F.coalesce("_more", F.lit(0)), "_id": F.coalesce("_end", "_id")})
        final = here.select("_group", "_bin", "_base", "_id")
    joined = placed.join(final, ["_group", "_bin"], "left")
    own = F.shiftleft("_group", 34) + F.col("_bin")
    return joined.select(*columns, F.coalesce("_id", own).alias("sequence_id"), (F.col("_place") + F.coalesce("_base", F.lit(0))).alias("offset"))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 1, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pieces of every text's ids followed by ``end_id``: ``keep``, piece, start, length, ids_crc32.

    A document longer than ``capacity`` is cut every ``capacity`` ids; a null
    or empty text is ``end_id`` alone.
    """
    source = docs.select(*keep, F.col(text).cast("string").alias("_body"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema.fields)

    def run(batches):
        encode = encoder(tokenizer).encode
        for batch in batches:
            for part in chunks(batch, "_body"):
                texts = Texts(part.column("_body"))
                ids, at = encode(texts)
                # Room for the end id after each text.
                places = at[:-1] + np.arange(texts.n)
                full = np.insert(ids.astype("<u4"), at[1:], end_id)
                size = np.diff(at) + 1
                pieces = -(-size // capacity)
                owner = np.repeat(np.arange(texts.n), pieces)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(capacity, size[owner] - start)
                begin = places[owner] + start
                view = memoryview(full).cast("B")
                crc = np.fromiter((zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)), np.int64, len(owner))
                kept = [part.column(c).take(pa.array(owner)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], names=[*keep, "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(run, f"{schema}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row of ``docs``.

    Repeated rows and rows with a null id are packed each; other columns are
    not looked at.
    """
    pieces = token_pieces(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), tokenizer, capacity)
    return pack(pin(pieces), capacity)
