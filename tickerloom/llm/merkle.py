"""Merkle manifest of a table: per source a 16-ary hash tree over its rows, and one over the sources.

Trees are kept as a log in postorder: a node is appended as soon as its
subtree is complete, so the place of every node follows from the number of
leaves up to its end alone (``postorder``) and siblings are addressed without
links.  The log is built by aligned builders: each takes ``ARITY ** TIER``
consecutive nodes of one tree and writes that whole subtree; the subtrees'
roots are the nodes of the next tier, until each tree has one left.  A builder
never holds more than one aligned subtree, however many rows a source has.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.operators.ordered import running_total
from tickerloom.session import pin

ARITY, TIER = 16, 2
BLOCK = ARITY**TIER
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<left:string,right:string>>"


def postorder(level: np.ndarray | int, end: np.ndarray | int) -> np.ndarray:
    """Place in the log (from 0) of the node of ``level`` whose subtree ends after ``end`` leaves.

    The leaf that completes it also completes one node of each lower level, and
    nothing above it is appended earlier: lower levels and its own have
    ``ceil(end / 16 ** j)`` nodes by then, higher ones ``(end - 1) // 16 ** j``.
    """
    level, end = np.asarray(level, np.int64), np.asarray(end, np.int64)
    total = np.zeros(np.broadcast_shapes(level.shape, end.shape), np.int64) - 1
    for j in range(16):
        span = np.int64(ARITY) ** j if j < 15 else np.int64(1 << 62)
        total += np.where(j <= level, -(-end // span), (end - 1) // span)
    return total


def _height(block: int, nodes: int) -> int:
    """Levels of a builder's subtree: all of them, but in a tree that ends inside its first block."""
    if block or nodes == BLOCK:
        return TIER
    return next(h for h in range(TIER + 1) if ARITY**h >= nodes)


def _subtree(block: int, digests: list[bytes]) -> list[list[bytes]]:
    out = [digests]
    for _ in range(_height(block, len(digests))):
        nodes = out[-1]
        out.append([sha256(b"".join(nodes[i : i + ARITY])).hexdigest().encode() for i in range(0, len(nodes), ARITY)])
    return out


def _places(height: int, nodes: int):
    """(level, index, place) of every node of a subtree over ``nodes`` leaves."""
    for level in range(height + 1):
        count = -(-nodes // ARITY**level)
        index = np.arange(count)
        yield level, count, postorder(level, np.minimum((index + 1) * ARITY**level, nodes))


def _written(levels: list[list[bytes]]) -> bytes:
    """A subtree's digests in the order of the log, 32 bytes each."""
    log = [b""] * sum(map(len, levels))
    for level, _, place in _places(len(levels) - 1, len(levels[0])):
        for p, digest in zip(place.tolist(), levels[level], strict=True):
            log[p] = bytes.fromhex(digest.decode())
    return b"".join(log)


def _read(block: int, nodes: int, log: bytes) -> list[list[bytes]]:
    """The levels of a subtree, addressed in its part of the log."""
    return [[log[32 * p : 32 * p + 32].hex().encode() for p in place.tolist()] for _, _, place in _places(_height(block, nodes), nodes)]


def _tier(nodes: DataFrame, extra: list[str]) -> DataFrame:
    """(tree, block, nodes, log, root, extra...) of the builders over ``nodes`` (tree, index, digest, extra...).

    ``extra`` columns are handed on as arrays in the order of the nodes.
    """
    fields = [f for f in nodes.schema.fields if f.name in extra]
    schema = "tree string, block long, nodes long, log binary, root string" + "".join(f", {f.name} array<{f.dataType.simpleString()}>" for f in fields)

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("index")
        block = rows.column("_block")[0].as_py()
        levels = _subtree(block, [d.encode() for d in rows.column("digest").to_pylist()])
        made = {
            "tree": pa.array([rows.column("tree")[0].as_py()], pa.string()), "block": pa.array([block], pa.int64()), "nodes": pa.array([rows.num_rows], pa.int64()),
            "log": pa.array([_written(levels)], pa.binary()), "root": pa.array([levels[-1][0].decode()], pa.string()),
        }
        for f in fields:
            kind = rows.schema.field(f.name).type
            made[f.name] = pa.array([rows.column(f.name).to_pylist()], pa.list_(kind))
        return pa.table(made)

    block = F.floor(F.col("index") / BLOCK).cast("long")
    return nodes.withColumn("_block", block).groupBy("tree", "_block").applyInArrow(build, schema)


def grow(leaves: DataFrame, extra: list[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The log of all trees over ``leaves`` (tree, index, digest, extra...), tier by tier, and (tree, root).

    ``index`` counts a tree's leaves from 0 without gaps.  Every tier is a
    written table; ``last`` marks the one block a tree ends in.
    """
    tiers, roots, nodes = [], [], leaves
    while True:
        built = pin(_tier(nodes, list(extra) if not tiers else []))
        blocks = built.groupBy("tree").agg(F.max("block").alias("_blocks"))
        tier = pin(built.join(blocks.select(F.col("tree").alias("_t"), "_blocks"), F.col("tree") == F.col("_t")).withColumn("last", F.col("_blocks") == 0).drop("_t", "_blocks"))
        tiers.append(tier)
        roots.append(tier.filter("last").select("tree", "root"))
        nodes = tier.filter("NOT last").select("tree", F.col("block").alias("index"), F.col("root").alias("digest"))
        if nodes.isEmpty():
            return tiers, reduce(DataFrame.union, roots)


def entries(tiers: list[DataFrame]) -> DataFrame:
    """The whole log: (tree, position, level, digest), positions as in one postorder walk of each tree."""

    def listed(tier: int):
        def run(batches):
            for batch in batches:
                rows = []
                for tree, block, nodes, log in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "nodes", "log")), strict=True):
                    # Upper tiers repeat the roots of the blocks below, which stand in those blocks.
                    for level, digests in list(enumerate(_read(block, nodes, log)))[1 if tier else 0 :]:
                        for i, digest in enumerate(digests):
                            # A subtree's last node ends where its tree does; only the last leaf of all can be missing.
                            rows.append((tree, block * BLOCK + min((i + 1) * ARITY**level, nodes), tier * TIER + level, digest.decode()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.string()))], names=["tree", "end", "level", "digest"])

        return run

    parts = []
    for t, tier in enumerate(tiers):
        found = tier.select("tree", "block", "nodes", "log").mapInArrow(listed(t), "tree string, end long, level int, digest string")
        # Ends count nodes of this tier; in leaves they are multiples of a block's, and never beyond the last leaf.
        parts.append(found.withColumn("end", F.col("end") * (BLOCK**t)))
    leaves = tiers[0].groupBy(F.col("tree").alias("_t")).agg(F.sum("nodes").alias("_n"))
    rows = reduce(DataFrame.union, parts).join(leaves, F.col("tree") == F.col("_t")).withColumn("end", F.least("end", "_n"))
    place = F.lit(-1).cast("long")
    for j in range(15):
        span = F.lit(ARITY**j)
        place = place + F.when(F.lit(j) <= F.col("level"), F.ceil(F.col("end") / span)).otherwise(F.floor((F.col("end") - 1) / span))
    return rows.select("tree", place.alias("position"), "level", "digest")


def _siblings(levels: list[list[bytes]], i: int):
    """(left, right): the other nodes of the run of node ``i`` on each level up to the subtree's root."""
    for nodes in levels[:-1]:
        first = i - i % ARITY
        yield b"".join(nodes[first:i]), b"".join(nodes[i + 1 : first + ARITY])
        i //= ARITY


def _joined(tier: DataFrame, above: DataFrame) -> DataFrame:
    right = above.select(F.col("tree").alias("_t"), F.col("index").alias("_i"), *[c for c in above.columns if c not in ("tree", "index")])
    return tier.join(right, (F.col("tree") == F.col("_t")) & (F.col("block") == F.col("_i"))).drop("_t", "_i")


def paths(tier: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, index, path): the siblings on the way up from each node of ``tier``; ``above`` has those from its blocks on."""

    def run(rows: pa.Table) -> pa.Table:
        out = []
        for tree, block, nodes, log, path in zip(*(rows.column(c).to_pylist() for c in ("tree", "block", "nodes", "log", "path")), strict=True):
            levels = _read(block, nodes, log)
            for i in range(nodes):
                own = [{"left": a.decode(), "right": b.decode()} for a, b in _siblings(levels, i)]
                out.append((tree, block * BLOCK + i, own + path))
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate((("tree", pa.string()), ("index", pa.int64()), ("path", kind)))})

    return _joined(tier, above).select("tree", "block", "nodes", "log", "path").groupBy("tree", "block").applyInArrow(run, f"tree string, index long, path {STEP}")


def lifted(tiers: list[DataFrame], top: DataFrame) -> DataFrame:
    """(tree, index, path) of each block of the lowest tier; ``top`` (tree, path) is what follows each tree's root."""
    above = None
    for tier in reversed(tiers):
        ended = tier.filter("last").select("tree", F.col("block").alias("index")).join(top.select(F.col("tree").alias("_t"), "path"), F.col("tree") == F.col("_t")).drop("_t")
        here = ended if above is None else ended.union(above)
        above = pin(here) if tier is tiers[0] else pin(paths(tier, here))
    return above


# ---------------------------------------------------------------- rows of a table
def _hashed(parts: list[Column]) -> Column:
    one = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*one).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, other) of every row: its leaf, and the one after tampering where its id is chosen for that.

    ``tree`` is the source with a mark before it, empty for null, so that null
    comes first and every tree has a name.
    """
    values = [F.col(c).cast("string") for c in FIELDS]
    lower = F.translate(values[-1], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        _hashed(values).alias("digest"), F.when(chosen, _hashed([*values[:-1], lower])).alias("other"))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``index``, the place of each row in its tree; a tree of any size is cut into even stretches."""
    counted = rows.withColumns({"_one": F.lit(1).cast("long"), "_row": F.monotonically_increasing_id()})
    return running_total(counted, ["tree"], [*order, "_row"], "_one", "_upto").withColumn("index", F.col("_upto") - 1).drop("_one", "_row", "_upto")


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``.

    A row's leaf hashes its five columns, nulls included; a null id is the
    first of its source, a null source the first tree.  Rows that share an id
    are ordered by their leaves, and rows equal in all five columns have equal
    leaves, so any order of theirs gives the same digests.  Empty and long texts are
    values like any other; an empty table gives no rows; other columns are not
    looked at.
    """
    rows = _numbered(leaves(docs), ["doc_id", "digest"])
    tiers, subroots = grow(rows, ["doc_id", "other"])
    subroots = pin(subroots)
    named = _numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")), ["name"])
    upper, root = grow(pin(named), ["name"])
    none = F.array().cast(STEP)
    # Paths of the sources: from each tier of their tree up to the one root.
    path = lifted(upper, root.select("tree", none.alias("path")))
    sources = _leaf_paths(upper[0], path)
    tops = pin(subroots.join(sources.select(F.col("name").alias("_n"), "path"), F.col("tree") == F.col("_n")).select("tree", F.col("root").alias("subroot"), "path"))
    above = lifted(tiers, tops).join(tops.select(F.col("tree").alias("_t"), "subroot"), F.col("tree") == F.col("_t")).drop("_t").withColumn("root", root.select("root").scalar())
    return _proved(tiers[0], above)


def _leaf_paths(tier: DataFrame, above: DataFrame) -> DataFrame:
    """(name, path) of the leaves of the tree over the sources."""
    names = tier.select("tree", F.posexplode("name").alias("_at", "name"), "block").select(F.col("tree").alias("_t"), (F.col("block") * BLOCK + F.col("_at")).alias("_i"), "name")
    return paths(tier, above).join(names, (F.col("tree") == F.col("_t")) & (F.col("index") == F.col("_i"))).select("name", "path")


def _proved(tier: DataFrame, above: DataFrame) -> DataFrame:
    """The proof of every leaf, and what folding it with the tampered leaf gives."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]

    def run(rows: pa.Table) -> pa.Table:
        out = []
        for block, nodes, log, ids, others, path, subroot, root in zip(*(rows.column(c).to_pylist() for c in ("block", "nodes", "log", "doc_id", "other", "path", "subroot", "root")), strict=True):
            levels = _read(block, nodes, log)
            upper = [(s["left"].encode(), s["right"].encode()) for s in path]
            for i, (name, other) in enumerate(zip(ids, others, strict=True)):
                steps = [*_siblings(levels, i), *upper]
                proof, now = sha256(), other.encode() if other else levels[0][i]
                for left, right in steps:
                    proof.update(left + right)
                    now = sha256(left + now + right).hexdigest().encode()
                out.append((name, levels[0][i].decode(), subroot, root, proof.hexdigest(), now.decode(), now.decode() == root))
        return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))})

    joined = _joined(tier.drop("root"), above).select("tree", "block", "nodes", "log", "doc_id", "other", "path", "subroot", "root")
    return joined.groupBy("tree", "block").applyInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
