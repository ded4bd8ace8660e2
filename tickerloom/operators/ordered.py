"""Ordered scans that survive a hot key.

A window keyed by session or by nothing at all sends a whole group to one task.
These operators range-partition on (keys, order) instead, so a group of any
size is cut into even chunks, work inside each chunk, and pass one small
summary row per chunk on to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.session import pin

CHUNK = "_chunk"


def ordered_chunks(df: DataFrame, keys: list[str], order: list[str], cheap: bool = False) -> DataFrame:
    """Cut ``df`` into evenly sized runs of (keys, order), numbered by ``_chunk``.

    The input is pinned first, unless it is ``cheap``, because sampling the range
    borders works it out a second time; the result is pinned because every later branch must see
    the same borders, also after an executor is lost.  Pass narrow rows.
    ``order`` should end in a unique column, else ties share a chunk.
    """
    ranged = (df if cheap else pin(df)).repartitionByRange(*keys, *order)
    return pin(ranged.withColumn(CHUNK, F.spark_partition_id()))


def _with_carry(chunks: DataFrame, keys: list[str], summary: Column, fold) -> DataFrame:
    """Attach ``_carry``: ``fold`` of the summaries of a key's earlier chunks.

    A carry row exists only where a key continues from an earlier chunk, which
    happens at most once per chunk, so the broadcast side never has more rows
    than there are partitions.
    """
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carries = (
        chunks.groupBy(*keys, CHUNK)
        .agg(summary.alias("_summary"))
        .select(*keys, CHUNK, fold("_summary").over(before).alias("_carry"))
        .filter(F.col("_carry").isNotNull())
    )
    return chunks.join(F.broadcast(carries), [*keys, CHUNK], "left")


def _in_chunk(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, cheap: bool = False) -> DataFrame:
    """Last non-null ``value`` up to and including each row, per key; ``cheap`` as in ``ordered_chunks``."""
    chunks = ordered_chunks(df, keys, order, cheap)
    position = F.struct(*order)
    tail = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), position))
    rows = _with_carry(chunks, keys, tail, lambda c: F.last(c, ignorenulls=True))
    running = _in_chunk(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(value, ignorenulls=True).over(running)
    return rows.withColumn(out, F.coalesce(seen, F.col("_carry"))).drop("_carry", CHUNK)


def previous_row(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """Add, for each ``{source: target}``, the value of the row before; ``keys`` may be empty."""
    chunks = ordered_chunks(df, keys, order)
    packed = F.struct(*columns)
    tail = F.max_by(packed, F.struct(*order))
    rows = _with_carry(chunks, keys, tail, lambda c: F.last(c, ignorenulls=True))
    lagged = F.coalesce(F.lag(packed).over(_in_chunk(keys, order)), F.col("_carry"))
    rows = rows.withColumn("_prev", lagged)
    for source, target in columns.items():
        rows = rows.withColumn(target, F.col("_prev").getField(source))
    return rows.drop("_prev", "_carry", CHUNK)


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Cumulative sum of ``value`` per key, current row included."""
    chunks = ordered_chunks(df, keys, order)
    rows = _with_carry(chunks, keys, F.sum(value), F.sum)
    running = _in_chunk(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(value).over(running) + F.coalesce(F.col("_carry"), F.lit(0))
    return rows.withColumn(out, total).drop("_carry", CHUNK)


def smoothed(df: DataFrame, keys: list[str], order: list[str], means: dict[str, tuple[str, float, float | None]], chunked: bool = True, block: int = 128) -> DataFrame:
    """Linear recurrences ``x = decay * before + (1 - decay) * input``, per key in order: ``means`` maps a new column to (input, decay, seed).

    A mean starts from its seed, or without one from its first input; inputs
    are not null.  A stretch of n rows maps the value before it to
    ``decay ** n * before + rest``, and such maps are put together block by
    block and chunk by chunk, so a series of any length is cut into even
    chunks.  Pass ``chunked=False`` only where a key's rows fit one task
    whatever the data size: then all steps share one shuffle.  ``order`` must
    be unique within a key.
    """
    columns = [c for c in df.columns if c != CHUNK]
    rows = df if CHUNK in df.columns else ordered_chunks(df, keys, order) if chunked else df.withColumn(CHUNK, F.lit(0))
    place = F.row_number().over(_in_chunk(keys, order)) - 1
    held = F.struct(*order, *[c for c in columns if c not in [*keys, *order]])
    blocks = rows.withColumn("_block", F.floor(place / block)).groupBy(*keys, CHUNK, "_block").agg(F.array_sort(F.collect_list(held)).alias("_rows"))

    def after(before: Column, value: Column, decay: float) -> Column:
        return before * decay + value * (1.0 - decay)

    def map_of(source: str, decay: float) -> Column:
        """What a block does to the value before it."""
        rest = F.aggregate("_rows", F.lit(0.0), lambda x, row: after(x, row[source], decay))
        return F.struct(F.pow(F.lit(decay), F.size("_rows")).alias("scale"), rest.alias("rest"))

    def value_after(many: Column, name: str, start: Column) -> Column:
        """Value of a mean after the maps ``many`` in turn."""
        return F.aggregate(many, start, lambda x, m: x * m[name]["scale"] + m[name]["rest"])

    def composed(many: Column, name: str) -> Column:
        """``many`` maps of a mean as one."""
        none = F.struct(F.lit(1.0).alias("scale"), F.lit(0.0).alias("rest"))
        return F.aggregate(many, none, lambda a, m: F.struct(
            (a["scale"] * m[name]["scale"]).alias("scale"), (a["rest"] * m[name]["scale"] + m[name]["rest"]).alias("rest")))

    blocks = blocks.withColumn("_maps", F.struct(*[map_of(source, decay).alias(n) for n, (source, decay, _) in means.items()]))

    inside = Window.partitionBy(*keys, CHUNK).orderBy("_block")
    earlier = F.collect_list("_maps").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    start = {n: F.lit(seed) if seed is not None else F.first(F.get("_rows", F.lit(0))[source]).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for n, (source, _, seed) in means.items()}
    blocks = blocks.select("*", earlier.alias("_earlier"), F.struct(*[x.cast("double").alias(n) for n, x in start.items()]).alias("_start"))
    if chunked or CHUNK in df.columns:
        chunks = blocks.groupBy(*keys, CHUNK).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("_block", "_maps"))), lambda b: b["_maps"]).alias("_all"), F.min_by("_start", "_block").alias("_begin"))
        chunks = chunks.select(*keys, CHUNK, F.struct(*[composed(F.col("_all"), n).alias(n) for n in means]).alias("_whole"), "_begin")
        order_of = Window.partitionBy(*keys).orderBy(CHUNK)
        before = F.collect_list("_whole").over(order_of.rowsBetween(Window.unboundedPreceding, -1))
        begin = F.first("_begin").over(order_of.rowsBetween(Window.unboundedPreceding, 0))
        carries = chunks.select(*keys, CHUNK, before.alias("_before"), begin.alias("_begin"))
        carries = carries.select(*keys, CHUNK, F.struct(*[value_after(F.col("_before"), n, F.col("_begin")[n]).alias(n) for n in means]).alias("_carry"))
        # One row per key and chunk.
        blocks = blocks.join(carries, [*keys, CHUNK]).withColumn("_start", F.col("_carry")).drop("_carry")
    blocks = blocks.withColumn("_x", F.struct(*[value_after(F.col("_earlier"), n, F.col("_start")[n]).alias(n) for n in means]))
    kind = "array<struct<" + ",".join(f"`{n}`:double" for n in means) + ">>"

    def step(acc: Column, row: Column) -> Column:
        now = {n: after(acc["x"][n], row[source], decay).alias(n) for n, (source, decay, _) in means.items()}
        x = F.struct(*now.values())
        return F.struct(x.alias("x"), F.concat(acc["all"], F.array(x)).alias("all"))

    values = F.aggregate("_rows", F.struct(F.col("_x").alias("x"), F.array().cast(kind).alias("all")), step, lambda acc: acc["all"])
    listed = blocks.select(*keys, CHUNK, F.inline(F.arrays_zip(F.col("_rows").alias("r"), values.alias("m"))))
    out = listed.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in columns], *[F.col(f"m.{n}").alias(n) for n in means], CHUNK)
    return out if CHUNK in df.columns or chunked else out.drop(CHUNK)


def percent_ranks(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """SQL ``percent_rank()`` over the whole frame for each ``{value: target}`` of doubles.

    Ranks are taken on the distinct values with their counts, so equal values
    collapse before anything moves and no task ever holds the whole column; all
    columns share one ordered scan.  Null values get a null rank and are not
    counted.
    """
    df = pin(df)
    pairs = F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns])
    values = df.select(F.inline(pairs)).filter(F.col("_v").isNotNull())
    counts = values.groupBy("_c", "_v").agg(F.count("*").alias("_n"))
    upto = running_total(counts, ["_c"], ["_v"], "_n", "_upto")
    sizes = upto.groupBy("_c").agg(F.sum("_n").alias("_size"))
    below = (F.col("_upto") - F.col("_n")).cast("double")
    rank = F.coalesce(F.try_divide(below, F.col("_size") - 1), F.lit(0.0))
    # One size row per ranked column, hence a side of fixed size.
    ranks = upto.join(F.broadcast(sizes), "_c").select("_c", "_v", rank.alias("_rank"))
    for value, target in columns.items():
        one = ranks.filter(F.col("_c") == value).select(F.col("_v"), F.col("_rank").alias(target))
        df = df.join(one, F.col(value).cast("double") == F.col("_v"), "left").drop("_v")
    return df
