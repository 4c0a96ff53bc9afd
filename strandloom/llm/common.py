"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable: the cluster's spark.checkpoint.dir; where it is unset a folder of our own, in local mode (tests) only."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strandloom-"))


def unused(df: DataFrame, name: str) -> str:
    """name, or with further underscores the first that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialized(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a reliable checkpoint in the shared folder."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint()


#: Bytes up to which a table that has been counted is broadcast, and bytes that a partition of one should have.
SMALL_BYTES, PART_BYTES = 2_000_000, 8_000_000


def compact(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, which is materialized, in no more partitions than its rows need: few rows in many partitions make many tiny shuffle files."""
    return df.coalesce(max(1, -(-df.count() * row_bytes // PART_BYTES)))


def side(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, which is materialized, as a side of a join: broadcast if its rows, counted, are small, and else shuffled."""
    return F.broadcast(df) if df.count() * row_bytes <= SMALL_BYTES else df


#: Rows of whole texts that go to Python at a time, where the session leaves Spark's default.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Let Python workers get texts in smaller batches than Spark's default of 10,000 rows, so that an executor's memory holds for long texts."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def slices(batches, rows: int = 500):
    """The batches in smaller ones, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def one_text_an_id(rows: DataFrame) -> DataFrame:
    """id, y, text: of rows (id, y, text) that share an id and a label the one whose text has the least hash. Spark reduces a repeated id before it shuffles."""
    least = rows.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    return least.select("id", "y", F.col("least.text").alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ids_and_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under its own names, so that further columns can't clash; null texts are empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
