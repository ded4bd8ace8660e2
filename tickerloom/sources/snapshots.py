"""Daily execution snapshots: one JSON file per day, named ``execution_<date>.json``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.functions.nested import snapshot_body
from tickerloom.functions.text import date_in_file_name
from tickerloom.schemas import PLAN_JSON

PATTERN = "execution_*.json"


def document_lines(plans: DataFrame, order: list[str], wrapped: Column | None = None) -> DataFrame:
    """(plan_date, place, line): each day's plans as the lines of one JSON document, in ``order``.

    The document is a list, or ``{"plans": [...]}`` on days where ``wrapped``
    holds.  A day has at most one plan per instrument.
    """
    body = F.to_json(F.struct(*[c for c in plans.columns if c != "plan_date"]))
    day = Window.partitionBy("plan_date").orderBy(*order)
    place, total = F.row_number().over(day), F.count("*").over(day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = plans.select("plan_date", place.alias("place"), total.alias("_n"), body.alias("_body"), (F.lit(False) if wrapped is None else wrapped).alias("_wrapped"))
    first, last = F.col("place") == 1, F.col("place") == F.col("_n")
    opening = F.when(first & F.col("_wrapped"), '{"plans":[').when(first, "[").otherwise("")
    closing = F.when(last & F.col("_wrapped"), "]}").when(last, "]").otherwise(",")
    return rows.select(F.date_format("plan_date", "yyyy-MM-dd").alias("plan_date"), "place", F.concat(opening, "_body", closing).alias("line"))


def write_snapshot_files(lines: DataFrame, path: str) -> None:
    """Write (plan_date, place, line) as one file per day below ``path``; a day that is there already is replaced.

    Days are written beside and then renamed one by one, so a reader sees a
    day's old or new file, and a repeated write ends in the same files.
    """
    spark = lines.sparkSession
    staged = f"{path}/.staged-{uuid.uuid4().hex}"
    # All lines of a day go to one file in order; they pass through the task, none are held.
    dealt = lines.repartition("plan_date").sortWithinPartitions("plan_date", "place").select("plan_date", "line")
    dealt.write.partitionBy("plan_date").text(staged)
    new = spark._jvm.org.apache.hadoop.fs.Path
    files = new(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.globStatus(new(f"{staged}/plan_date=*/part-*")):
        day = found.getPath().getParent().getName().removeprefix("plan_date=")
        target = new(f"{path}/execution_{day}.json")
        files.delete(target, False)
        files.rename(found.getPath(), target)
    files.delete(new(staged), True)


def snapshot_days(spark: SparkSession, path: str) -> DataFrame:
    """(plan_date) of every file, from the names alone: no file is opened."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", PATTERN).load(path)
    return listed.select(date_in_file_name("path").alias("plan_date"))


def read_snapshot_files(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """(plan_date, document): whole files with the date taken from the name; files outside the days asked for are not opened."""
    files = spark.read.option("pathGlobFilter", PATTERN).text(path, wholetext=True)
    name = F.col("_metadata.file_name")
    if since is not None:
        files = files.filter(name >= f"execution_{since}.json")
    if until is not None:
        files = files.filter(name <= f"execution_{until}.json")
    return files.select(date_in_file_name(name).alias("plan_date"), F.col("value").alias("document"))


def newest_snapshot_files(spark: SparkSession, path: str, days: int) -> DataFrame:
    """The newest ``days`` files by name; older ones are listed but not opened."""
    oldest = snapshot_days(spark, path).orderBy(F.desc("plan_date")).limit(days).agg(F.min("plan_date")).first()[0]
    return read_snapshot_files(spark, path, since=oldest)


def decode_snapshots(documents: DataFrame) -> DataFrame:
    """Parsed ``plans`` per document; an unreadable one gets an ``error`` instead and the run goes on."""
    parsed = documents.select("plan_date", snapshot_body("document", PLAN_JSON).alias("body"))
    broken = F.col("body").isNull() | F.col("body.broken").isNotNull()
    none = F.array().cast(f"array<{PLAN_JSON}>")
    return parsed.select(
        "plan_date",
        F.when(~broken, F.coalesce("body.plans", none)).alias("plans"),
        F.when(broken, F.lit("解析失败")).alias("error"),
    )


def plan_rows(decoded: DataFrame) -> DataFrame:
    """One row per plan; an unreadable document has none."""
    return decoded.select("plan_date", F.inline("plans"))
