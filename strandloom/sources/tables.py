"""Text tables as collections of sequences: genome (STRING), contig (LONG, its order in the genome), name, seq."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequences import bases_of_text


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its scan has fewer partitions than there are (a small or single file); large scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of texts that a Python worker gets at a time, where Spark's default would be 10,000.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: language and source are the genome, the document is the contig."""
    small_batches(spark)
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    genome = F.concat_ws("/", "lang", "source")
    return docs.select(genome.alias("genome"), F.col("doc_id").alias("contig"), F.col("doc_id").cast("string").alias("name"), bases_of_text(F.col("text")).alias("seq"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items, each a genome of one contig."""
    small_batches(spark)
    items = spread(load(spark, sf_dir, "benchmark").select("item_id", "text"))
    return items.select(F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("genome"), F.col("item_id").alias("contig"), F.col("item_id").cast("string").alias("name"), bases_of_text(F.col("text")).alias("seq"))
