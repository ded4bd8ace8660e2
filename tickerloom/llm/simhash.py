"""SimHash fingerprints of 128 bits, and block tables that find all within a Hamming radius."""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.bytetext import CHUNK_BYTES, CHUNK_ROWS, Texts, Words, mix, windows

BITS = 128
# Bit k of a byte becomes the lowest bit of byte k of a 64-bit value, so that up to 255 bytes can be added at once.
LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def fingerprints(texts: Texts, width: int = 3) -> np.ndarray:
    """Two 64-bit halves per text.

    Terms are the runs of ``width`` words (a shorter text is one term), each
    weighted by how often the text has it; a term's hash votes for its set
    bits and against the others.  A text without words gets all zero bits.
    """
    keys, owner, _ = windows(Words(texts), width, short_as_one=True)
    if (np.diff(owner) < 0).any():
        order = np.argsort(owner, kind="stable")
        keys, owner = keys[order], owner[order]
    out = np.zeros((texts.n, 2), np.uint64)
    if not len(keys):
        return out
    n = np.bincount(owner, minlength=texts.n)
    some = np.flatnonzero(n)
    first = (np.cumsum(n) - n)[some]
    # Stretches of at most 255 terms of one text.
    pieces = -(-n[some] // 255)
    text_piece = np.cumsum(pieces) - pieces
    cut = np.repeat(first, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(text_piece, pieces))
    for half, salt in enumerate((0, 0x6A09E667F3BCC909)):
        hashed = (mix(keys ^ np.uint64(salt)) if salt else keys).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            lanes = np.add.reduceat(LANES[hashed[:, byte]], cut).view(np.uint8).reshape(-1, 8)
            votes = np.add.reduceat(lanes, text_piece, axis=0, dtype=np.int64)
            bits = (2 * votes > n[some, None]).astype(np.uint64)
            out[some, half] |= (bits << np.arange(8, dtype=np.uint64)).sum(1, dtype=np.uint64) << np.uint64(8 * byte)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - np.bitwise_count(a ^ b).sum(1) / BITS


def as_hex(prints: np.ndarray) -> list[str]:
    return [f"{int(a):016x}{int(b):016x}" for a, b in prints]


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every whole text as 32 hex digits; a null text counts as empty."""
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(i, CHUNK_ROWS)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(as_hex(fingerprints(Texts(part.column("text")))), pa.string())], names=["doc_id", "fingerprint"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def find_within(queries: DataFrame, index: DataFrame, radius: int = 3, spare: int = 3) -> DataFrame:
    """(query, match, distance) for every query fingerprint and every indexed one within ``radius`` bits.

    Both sides are columns ``fingerprint`` of hex digits; equal ones count
    once.  The bits are cut into ``radius + spare`` blocks: two fingerprints
    within the radius agree on some ``spare`` of them, so one table per choice
    of ``spare`` blocks, moved to the front, finds every such pair by equality.
    A null fingerprint matches nothing.
    """
    blocks = radius + spare
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    high, low = (F.conv(F.substring("fingerprint", at, 16), 16, -10).cast("long") for at in (1, 17))

    def bits(first: int, last: int):
        parts = []
        for base, word in ((0, high), (64, low)):
            a, b = max(first, base) - base, min(last, base + 64) - base
            if a < b:
                parts.append(word.bitwiseAND(F.lit(((1 << b) - (1 << a)) - (1 << 64) if b == 64 else (1 << b) - (1 << a))))
        return parts

    def tables(side: DataFrame, name: str) -> DataFrame:
        rows = side.select("fingerprint").filter("fingerprint IS NOT NULL").distinct()
        keys = [F.xxhash64(F.lit(t), *[p for b in choice for p in bits(edges[b], edges[b + 1])]) for t, choice in enumerate(combinations(range(blocks), spare))]
        return rows.select(F.col("fingerprint").alias(name), high.alias(f"{name}_a"), low.alias(f"{name}_b"), F.explode(F.array(*keys)).alias("block"))

    distance = F.expr("bit_count(query_a ^ match_a) + bit_count(query_b ^ match_b)")
    found = tables(queries, "query").join(tables(index, "match"), "block").withColumn("distance", distance)
    return found.filter(F.col("distance") <= radius).select("query", "match", "distance").distinct()


def _borders(source: DataFrame) -> list:
    """Smallest id of each of about as many even runs as the session has shuffle partitions; only these come to the driver."""
    ids = source.select("doc_id").filter("doc_id IS NOT NULL")
    n = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ids.repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id().alias("_run")).agg(F.min("doc_id").alias("_low"))
    return sorted(r[0] for r in ranged.select("_low").collect())


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, whose second half is the start of the next document.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  The next document is the one after it by id, then
    by text for repeated ids; null ids come last; after the last comes the
    first again, so a single document follows itself.  Null texts count as
    empty; an empty table gives no rows; other columns are not looked at.

    Ids alone are looked at to cut the table into runs; the first document of
    a run also travels to the run before, and the texts move once.
    """
    source = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    borders = _borders(source)
    runs = max(1, len(borders))
    kind = source.schema["doc_id"].dataType.simpleString()

    def place(batches):
        lows = np.array(borders)
        for batch in batches:
            ids = batch.column("doc_id")
            absent = ids.is_null().to_numpy(zero_copy_only=False)
            if len(lows):
                values = np.array(ids.fill_null(borders[0]).to_pylist())
                run = np.maximum(np.searchsorted(lows, values, side="right") - 1, 0)
                run[absent] = runs - 1
                guest = np.flatnonzero((lows[run] == values) & ~absent)
            else:
                run, guest = np.zeros(batch.num_rows, np.int64), np.arange(batch.num_rows)
            to = np.concatenate((run, (run[guest] - 1) % runs)).astype(np.int32)
            rows = np.concatenate((np.arange(batch.num_rows), guest))
            is_guest = np.arange(len(rows)) >= batch.num_rows
            for i in range(0, len(rows), CHUNK_ROWS):
                part = pa.array(rows[i : i + CHUNK_ROWS])
                yield pa.RecordBatch.from_arrays([
                    pa.array(to[i : i + CHUNK_ROWS]), pa.array(is_guest[i : i + CHUNK_ROWS]), ids.take(part), batch.column("text").take(part)
                ], names=["_run", "_guest", "doc_id", "text"])

    placed = source.mapInArrow(place, f"_run int, _guest boolean, doc_id {kind}, text string")
    ordered = placed.repartitionById(runs, "_run").sortWithinPartitions("_guest", F.col("doc_id").asc_nulls_last(), "text")

    def compare(batches):
        waiting = None  # the last row so far: id, text, fingerprint
        for ids, texts, guests in _rows(batches):
            prints = fingerprints(Texts(pa.array(texts, pa.large_string())))
            if waiting is not None:
                ids, texts, guests = [waiting[0], *ids], [waiting[1], *texts], [False, *guests]
                prints = np.vstack((waiting[2], prints))
            yield from _pairs(ids, texts, prints)
            if guests[-1]:
                return
            waiting = ids[-1], texts[-1], prints[-1:]

    id_type = source.schema["doc_id"].dataType.simpleString()

    def _rows(batches):
        """Chunks of rows in order; the first guest ends them."""
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t, g in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("_guest").to_pylist(), strict=True):
                t = t.as_py()
                ids.append(i)
                texts.append(t)
                held += len(t)
                if g:
                    yield ids, texts, [False] * (len(ids) - 1) + [True]
                    return
                if held >= CHUNK_BYTES or len(ids) >= CHUNK_ROWS:
                    yield ids, texts, [False] * len(ids)
                    ids, texts, held = [], [], 0
        if ids:
            yield ids, texts, [False] * len(ids)

    def _pairs(ids, texts, prints):
        if len(ids) < 2:
            return
        chars = [len(t) for t in texts[:-1]]
        edited = [t[: n - n // 2] + u[: n // 2] for t, u, n in zip(texts, texts[1:], chars, strict=False)]
        other = fingerprints(Texts(pa.array(edited, pa.large_string())))
        own, nxt = prints[:-1], prints[1:]
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(ids[:-1], arrow_id), "n_chars": chars, "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            "fingerprint": as_hex(own), "edited_fingerprint": as_hex(other), "near_edited": likeness(own, other), "near_next": likeness(own, nxt),
        })

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(source.schema["doc_id"].dataType)
    return ordered.mapInArrow(compare, f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
