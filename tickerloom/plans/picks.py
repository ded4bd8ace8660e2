"""Pick runs, their ranked entries, outcomes and the latest ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.nested import decoded
from tickerloom.functions.scalar import finite, iso_date, iso_time
from tickerloom.functions.text import literal_search
from tickerloom.operators.newest import newest_first, newest_row, page, top
from tickerloom.operators.ordered import running_total
from tickerloom.schemas import ANALYSIS_JSON

SCORES = ["close_price", "rule_composite_score", "llm_composite_score", "final_composite_score"]
LEVELS = ["predicted_buy_price", "predicted_target_price", "predicted_stop_loss"]
RUN_ORDER = ["created_at_utc", "id"]


def of_kind(runs: DataFrame, run_kind: str | None) -> DataFrame:
    return runs if run_kind is None else runs.filter(F.col("run_kind") == run_kind)


def run_total(runs: DataFrame, run_kind: str | None = None) -> DataFrame:
    """Number of runs of a kind, whatever the page."""
    return of_kind(runs, run_kind).agg(F.count("*").alias("total"))


def runs_page(runs: DataFrame, run_kind: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest runs first, each row also carrying the total number of matches."""
    rows = page(of_kind(runs, run_kind), newest_first(*RUN_ORDER), limit, offset)
    return rows.select(
        "id", "run_kind", iso_date("trade_date_as_of").alias("trade_date"), "rule_version", "llm_enabled", "llm_model",
        decoded("summary_json", "struct<customer:bigint>").alias("summary"), iso_time("created_at_utc").alias("created_at"),
        run_total(runs, run_kind).scalar().alias("total"),
    )


def entry_counts(runs: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries per run, 0 for a run without any."""
    counts = entries.groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("entry_count"))
    return runs.join(counts, "id", "left").withColumn("entry_count", F.coalesce("entry_count", F.lit(0).cast("bigint")))


def entry_view(entries: DataFrame, *extra: str) -> DataFrame:
    """Entry fields as served, with NaN and infinities as null."""
    return entries.select(
        "id", "ts_code", "name", F.col("rank_in_run").alias("rank"), *[finite(c).alias(c) for c in SCORES], "recommendation",
        "verdict", *[finite(c).alias(c) for c in LEVELS], F.col("markdown").alias("markdown_report"),
        decoded("report_json", "struct<qty:bigint>").alias("report"), decoded("analysis_process_json", ANALYSIS_JSON).alias("analysis"),
        *extra,
    )


def run_entries(runs: DataFrame, entries: DataFrame) -> DataFrame:
    """Runs with their entry count and entries; ``position`` counts a run's entries by rank, then id.

    A run ranks each instrument of the universe at most a few times, so its
    entries fit one group; count and position come from the groups of the join.
    """
    run = runs.select(F.col("id").alias("run_id"), "run_kind", iso_date("trade_date_as_of").alias("trade_date"))
    own = Window.partitionBy("run_id")
    rows = run.join(entry_view(entries, "run_id"), "run_id").withColumn("entry_count", F.count("*").over(own))
    return rows.withColumn("position", F.row_number().over(own.orderBy("rank", "id")).cast("bigint"))


def entry_outcomes(entries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Entries with their outcomes by horizon (one per entry and horizon), empty if none."""
    packed = outcomes.groupBy(F.col("entry_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("horizon_days", "return_pct", "hit_buy", "hit_target", "hit_stop"))).alias("backtest_outcomes")
    )
    kind = packed.schema["backtest_outcomes"].dataType.simpleString()
    return entries.join(packed, "id", "left").withColumn(
        "backtest_outcomes", F.coalesce("backtest_outcomes", F.array().cast(kind))
    )


def outcome_rows(entries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per entry and outcome, flat; an entry without outcomes has one row of nulls."""
    return entries.join(outcomes.withColumnRenamed("entry_id", "id"), "id", "left")


def newest_reports(entries: DataFrame) -> DataFrame:
    """The newest entry of every instrument code."""
    return newest_row(entries, ["ts_code"], ["created_at_utc", "id"])


def with_newest_report(instruments: DataFrame, entries: DataFrame) -> DataFrame:
    """Instruments with their newest entry, null if they never had one."""
    report = newest_reports(entries).select(
        "ts_code", F.col("id").alias("entry_id"), F.col("final_composite_score").alias("score"), "recommendation"
    )
    return instruments.join(report, "ts_code", "left")


def adequate_run(runs: DataFrame, entries: DataFrame, run_kind: str = "scan", top_n: int = 30, candidates: int = 20) -> DataFrame:
    """The newest of the last ``candidates`` runs with ``top_n`` entries, else the fullest one."""
    recent = top(of_kind(runs, run_kind), newest_first(*RUN_ORDER), candidates)
    counts = (
        entries.join(F.broadcast(recent.select(F.col("id").alias("run_id"))), "run_id")
        .groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("entry_count"))
    )
    enough = F.col("entry_count") >= top_n
    order = [enough.desc(), F.when(~enough, F.col("entry_count")).desc_nulls_last(), *newest_first(*RUN_ORDER)]
    return top(recent.join(counts, "id"), order, 1)


def latest_ranking(runs: DataFrame, entries: DataFrame, run_kind: str = "scan", top_n: int = 30) -> DataFrame:
    """Top entries by rank of the adequate run."""
    run = adequate_run(runs, entries, run_kind, top_n).select(
        F.col("id").alias("run_id"), iso_date("trade_date_as_of").alias("trade_date"), "rule_version"
    )
    listed = entries.join(F.broadcast(run), "run_id")
    return top(listed, [F.col("rank_in_run"), F.col("id")], top_n).select(
        "run_id", "trade_date", "rule_version", "id", "ts_code", "name", F.col("rank_in_run").alias("rank"), *SCORES,
        "recommendation", "verdict", "predicted_buy_price", "predicted_target_price",
    )


def filter_ranking(ranking: DataFrame, q: str) -> DataFrame:
    """Literal, case-blind search inside a loaded ranking; a blank query keeps all."""
    if not q.strip():
        return ranking
    return ranking.filter(literal_search("ts_code", q) | literal_search("name", q))


def by_score(entries: DataFrame) -> DataFrame:
    """Entries ascending by final score, null counting as 0, with the new ``position`` among all of them.

    Positions are running totals over even chunks, so no task holds the whole list.
    """
    scored = entries.withColumns({"_score": F.coalesce("final_composite_score", F.lit(0.0)), "_one": F.lit(1).cast("long")})
    return running_total(scored, [], ["_score", "id"], "_one", "position").drop("_score", "_one").orderBy("position")


def watch_flags(rows: DataFrame, watchlist: DataFrame, market: str = "a") -> DataFrame:
    """Whether each row's instrument is on the watchlist of its market."""
    listed = watchlist.filter(F.col("market") == market).select("ts_code").distinct().withColumn("watching", F.lit(True))
    return rows.join(listed, "ts_code", "left").withColumn("watching", F.coalesce("watching", F.lit(False)))
