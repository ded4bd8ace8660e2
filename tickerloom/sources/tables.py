"""Batch readers: parquet tables, query views, JSON lines, rule rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tickerloom.schemas import INPUT_SCHEMAS, RESEARCH_SCHEMAS


def input_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(INPUT_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def input_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table as a stream of arriving files.

    A pattern is given instead of the plain path because the file source takes
    a plain path for a folder, while the table may also be a single file.
    """
    return spark.readStream.schema(INPUT_SCHEMAS[name]).parquet(f"{folder}/{name}.[p]arquet")


def research_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored research table; an absent one reads as an empty table of its schema."""
    return parquet_or_empty(spark, f"{folder}/{name}", RESEARCH_SCHEMAS[name])


def parquet_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def bound_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame], **args) -> DataFrame:
    """Run SQL over named frames; values are bound as parameters, never formatted into the text."""
    return spark.sql(text, args=args, **tables)


def json_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(RESEARCH_SCHEMAS[name]).json(path)


RULES = "risk_type string, action string, lookback_days int, factor double"


def risk_rules(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    """Risk rules as rows (risk_type, action, lookback_days, factor)."""
    return spark.createDataFrame(rules, RULES)


def risk_rules_file(spark: SparkSession, path: str) -> DataFrame:
    """Risk rules from a file or folder of JSON lines; a field left out is null."""
    return spark.read.schema(RULES).json(path)
