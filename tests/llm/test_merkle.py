"""The Merkle manifest against plain trees, and the log against a walk in postorder."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, path int, root string, _t string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    def one(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return H(*map(one, (doc_id, source, lang, n_chars, text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def steps(levels, i):
    for nodes in levels[:-1]:
        run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
        yield "".join(run[: i % 16]), "".join(run[i % 16 + 1 :])
        i //= 16


def expected(rows):
    """Sorted result rows by plain lists; ties by leaf, null first."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0], leaf(*r), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for name in names:
        trees[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        built[name] = levels_of([x[1] for x in trees[name]])
    upper = levels_of([built[n][-1][0] for n in names])
    root, out = upper[-1][0], []
    for j, name in enumerate(names):
        for i, (doc_id, own, r) in enumerate(trees[name]):
            path = [*steps(built[name], i), *steps(upper, j)]
            now = own
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and r[4] is not None:
                now = leaf(*r[:4], "".join(c.lower() if c.isascii() else c for c in r[4]))
            for a, b in path:
                now = H(a, now, b)
            out.append((doc_id, own, built[name][-1][0], root, H(*[a + b for a, b in path]), now, now == root))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "t", 3, "r", "x") for r in rows], SCHEMA)
    return sorted([tuple(x) for x in merkle.manifest(df).collect()], key=str)


def test_manifest_equals_plain_trees(spark):
    rows = [(i, "hot", "en", 5, f"Text {i}") for i in range(700)]
    rows += [(k, s, None, None, t) for s in (None, "", "a", "é", "ab") for k, t in ((-5, "X"), (0, None), (3, ""), (None, "null id"), (3, "same id"), (3, "same id"))]
    rows += [(i, f"one{i}", "en", 0, "A" * 3) for i in range(300)]
    rows += [(7, "long", "de", 1, "Ä long TEXT " * 50_000)]
    assert found(spark, rows) == expected(rows)


def test_heights_at_the_borders_of_blocks(spark):
    rows = [(i, f"s{n}", "en", 1, "T") for n in (1, 2, 16, 17, 255, 256, 257, 4096, 4097) for i in range(n)]
    assert found(spark, rows) == expected(rows)


def test_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("n", [1, 18, 5000])
def test_log_is_one_walk_in_postorder(spark, n):
    digests = [H(str(i)) for i in range(n)]
    leaves = spark.createDataFrame([("t", i, d) for i, d in enumerate(digests)], "tree string, index bigint, digest string")
    tiers, roots = merkle.grow(leaves)
    got = [(r.level, r.digest) for r in merkle.entries(tiers).orderBy("position").collect()]
    levels = levels_of(digests)
    walk = []

    def visit(level, i):
        if level:
            for c in range(16 * i, min(16 * i + 16, len(levels[level - 1]))):
                visit(level - 1, c)
        walk.append((level, levels[level][i]))

    visit(len(levels) - 1, 0)
    assert got == walk and roots.first().root == levels[-1][0]


def test_place_follows_from_level_and_end():
    # Of 17 leaves: 16, their parent, the last, its parent, the root.
    assert merkle.postorder(np.array([0, 1, 0, 1, 2]), np.array([16, 16, 17, 17, 17])).tolist() == [15, 16, 17, 18, 19]


def test_rows_of_one_hot_source_are_cut_into_blocks(spark):
    df = spark.range(3000).select(F.lit("s").alias("tree"), F.col("id").alias("index"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("digest"))
    tiers, _ = merkle.grow(df)
    assert [t.agg(F.max("nodes")).first()[0] for t in tiers] == [256, 12]
