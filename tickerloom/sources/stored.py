"""Stored keyed tables: rows dealt into hash buckets, one folder each, of which a change rewrites only the touched ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.session import pin
from tickerloom.sources.tables import parquet_or_empty

BUCKET = "bucket"


class KeyedTable:
    """A table of one row per key below ``path``.

    ``buckets`` is fixed for a table's life and sets how much one change
    rewrites (a bucket) and how many numbers the driver sees (one per bucket at
    most).  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        return parquet_or_empty(self.spark, self.path, f"{self.schema}, {BUCKET} int")

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys``; only their buckets are read."""
        asked = self._numbers(keys.select(self._bucket().alias(BUCKET)).distinct())
        return self._stored().filter(F.col(BUCKET).isin(asked)).drop(BUCKET).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    @staticmethod
    def _numbers(buckets: DataFrame) -> list[int]:
        return [r[0] for r in buckets.collect()]

    @staticmethod
    def _prints(rows: DataFrame) -> DataFrame:
        """Per bucket, the rows and a sum of their hashes, which tell whether anything changed."""
        columns = sorted(c for c in rows.columns if c != BUCKET)
        return rows.groupBy(BUCKET).agg(F.count("*").alias("_n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("_h"))

    def change(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the rows of the touched buckets by ``merge(stored rows, changes)``.

        ``merge`` sees the stored rows of those buckets alone and must keep
        what it does not change.  Buckets in which nothing changed are not
        written, so a repeated change set leaves every file as it is; one that
        broke off is repeated whole.
        """
        changes = pin(changes)
        touched = self._numbers(changes.select(self._bucket().alias(BUCKET)).distinct())
        if not touched:
            return
        before = self._stored().filter(F.col(BUCKET).isin(touched))
        # Written aside first: what is overwritten below is read here for the last time.
        after = pin(merge(before.drop(BUCKET), changes).withColumn(BUCKET, self._bucket()))
        was, now = self._prints(before), self._prints(after)
        both = was.join(now.select(F.col(BUCKET).alias("_b"), F.col("_n").alias("_n2"), F.col("_h").alias("_h2")), F.col(BUCKET) == F.col("_b"), "full_outer")
        differs = both.filter("NOT (_n <=> _n2 AND _h <=> _h2)").select(F.coalesce(BUCKET, "_b").alias(BUCKET), F.col("_b").isNull().alias("gone")).collect()
        fresh = [r[0] for r in differs if not r["gone"]]
        if fresh:
            rows = after.filter(F.col(BUCKET).isin(fresh)).repartition(BUCKET)
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        self._drop([r[0] for r in differs if r["gone"]])

    def _drop(self, buckets: list[int]) -> None:
        """Removes buckets that no row is left in."""
        new = self.spark._jvm.org.apache.hadoop.fs.Path
        files = new(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for b in buckets:
            files.delete(new(f"{self.path}/{BUCKET}={b}"), True)
