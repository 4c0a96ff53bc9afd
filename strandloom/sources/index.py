"""A reference index that is kept: minimizers bucketed by hash, so that later joins on the hash read them in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_index(minimizers: DataFrame, table: str, buckets: int) -> None:
    """Save as a table in buckets of hashes, sorted in each; buckets should be about the index's bytes by 256 MB."""
    minimizers.write.mode("overwrite").bucketBy(buckets, "hash").sortBy("hash").saveAsTable(table)


def read_index(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
