"""Mixing sources to target weights by nested hash thresholds, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.session import pin

# A document's place in its source's order: 56 bits of a hash of its id, read as groups of STEP bits.
STEP, LEVELS = 8, 7


def _place(key: str):
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 14), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2) -> DataFrame:
    """(source, source_size, target) of each source.

    Sources in order of code points, null last, weigh ``weights`` in turn and
    share ``percent`` of all words; no target exceeds ``most`` times its
    source's size, what is over being shared again by weight among the others.
    Sources that reach their limit are those with the smallest limit per
    weight, so one pass over the sources in that order finds where it stops.
    There is one row per source, not per document.
    """
    by_source = pin(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (turn % len(weights) + 1).cast("int"))
    limit = most * F.col("source_size")
    rows = by_source.withColumn("weight", weight).withColumn("limit", limit)
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Words for each unit of weight if the sources before this one are at their limits and the rest are not.
    left = F.sum("source_size").over(everything) * percent - 100 * F.coalesce(F.sum("limit").over(before), F.lit(0))
    rows = rows.withColumn("_unit", left / 100.0 / F.sum("weight").over(after))
    open_ = F.col("_unit") * F.col("weight") < F.col("limit")
    unit = F.min(F.when(open_, F.struct((F.col("limit") / F.col("weight")).alias("o"), F.col("source").isNull().alias("n"), "source", "_unit"))).over(everything).getField("_unit")
    share = F.coalesce(unit * F.col("weight"), F.col("limit").cast("double"))
    return rows.select("source", "source_size", F.least(share, F.col("limit").cast("double")).alias("target"))


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, place) of every row, written once: narrow rows that all further steps read."""
    words = F.regexp_count(F.col(text).cast("string"), F.lit("[^\\x20\\x09-\\x0D]+"))
    return pin(docs.select(
        F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(words, F.lit(0)).cast("long").alias("size"), _place(key).alias("place")))


def limits(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150) -> DataFrame:
    """(source, source_size, target, whole, threshold) of each source.

    A source takes every document ``whole`` times and those with a place below
    ``threshold`` once more, the one in which the budget ends among them if
    that comes nearer to the budget than stopping before it.  The threshold is found by histograms: words by
    hash bucket, then by finer buckets inside the one bucket where the budget
    ends, so no rows are sorted and a source of any size moves as sums.
    """
    goal = targets(sizes, weights, percent)
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    # Budget of each source for one more copy, and the hash prefix reached so far.
    open_ = pin(goal.withColumn("whole", whole).select(
        "source", "source_size", "target", "whole", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long").alias("budget"), F.lit(0).cast("long").alias("prefix")))
    state = open_
    for level in range(1, LEVELS + 1):
        shift = STEP * (LEVELS - level)
        reached = state.select(F.col("source").alias("_s"), "prefix", "budget")
        # Only rows of the one open bucket of each source, from the second level on.
        inside = sizes.join(reached, sizes.source.eqNullSafe(F.col("_s")) & (F.shiftright("place", shift + STEP) == F.col("prefix")))
        counts = inside.groupBy("_s", "prefix", "budget", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("_s").orderBy("bucket"))
        filled = counts.withColumn("upto", upto)
        # The first bucket that does not fit whole stays open; if all fit, the end of the range does.
        full = F.coalesce(F.max(F.when(F.col("upto") <= F.col("budget"), F.col("upto"))), F.lit(0))
        next_ = F.coalesce(F.min(F.when(F.col("upto") > F.col("budget"), F.col("bucket"))), F.shiftleft(F.first("prefix") + 1, STEP))
        beyond = F.min(F.when(F.col("upto") > F.col("budget"), F.struct("bucket", "words")))["words"]
        found = filled.groupBy("_s").agg(full.alias("_used"), next_.alias("_next"), beyond.alias("_beyond"))
        keep = state.join(found, state.source.eqNullSafe(F.col("_s")), "left")
        # A prefix past the range (everything fits) or of an empty bucket stays where it is, in finer units.
        state = pin(keep.select(
            "source", "source_size", "target", "whole", (F.col("budget") - F.coalesce("_used", F.lit(0))).alias("budget"),
            F.coalesce("_next", F.shiftleft("prefix", STEP)).alias("prefix"), F.col("_beyond").alias("beyond")))
    # Documents that share the place where the budget ends go together: taken if most of them fits.
    closer = F.coalesce(F.col("beyond") < 2 * F.col("budget"), F.lit(False))
    return state.select("source", "source_size", "target", "whole", (F.col("prefix") + closer.cast("long")).alias("threshold"))


def _copies(place: Column) -> Column:
    return F.col("_whole") + (place < F.col("_threshold")).cast("long")


def _by_source(found: DataFrame) -> DataFrame:
    return found.select(F.col("source").alias("_s"), F.col("source_size").alias("_size"), F.col("target").alias("_target"), F.col("whole").alias("_whole"), F.col("threshold").alias("_threshold"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs``.

    Size is the number of words (null: 0).  Each source takes every document
    as often as its target holds its size whole; the words still missing are
    taken once more in order of a hash of the id, up to the document that
    comes nearest to them, so a source misses its target by half a document at most.  Rows that share an id share a hash and are taken or left together;
    an empty table gives no rows; other columns are not looked at.
    """
    sizes = measured(docs, key, text, source)
    rows = sizes.join(_by_source(limits(sizes, weights, percent)), sizes.source.eqNullSafe(F.col("_s")))
    taken = F.col("size") * _copies(F.col("place"))
    return rows.select("doc_id", "size", F.col("_size").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"))


def resample(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with every row as often as the mix takes it; texts do not move, only the sources' limits do."""
    found = _by_source(limits(measured(docs, key, text, source), weights, percent))
    rows = docs.join(found, docs[source].cast("string").eqNullSafe(F.col("_s")))
    often = F.sequence(F.lit(1).cast("long"), _copies(_place(key)))
    return rows.filter(_copies(_place(key)) > 0).withColumn("_copy", F.explode(often)).select(*docs.columns)
