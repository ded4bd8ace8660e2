"""Where the queries find their tables and tokenizers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file; the same path on all machines, as the package is installed on each."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
