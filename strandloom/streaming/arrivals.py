"""Sequences that arrive, matched with a kept index: a join of a stream with a table, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandloom.operators import sketch

SCHEMA = "genome string, contig long, name string, seq string"


def arriving_sequences(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """A stream of the Parquet files of sequences that come into a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def arriving_hits(sequences: DataFrame, index: DataFrame, k: int, w: int, hash: str = "splitmix", mode: str = "window", seed: int = 42) -> DataFrame:
    """The stream's minimizers joined with index (hash, reference, pos); works on a batch too."""
    own = sketch.sketches(sequences, ["genome", "contig"], k, w, hash, mode, seed)
    return own.join(index, "hash")


def count_into(hits: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append, for each batch of arrivals, the shared hashes of each new genome and reference to a table. A batch that is run again after a failure
    replaces its own rows."""

    def save(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("genome", "reference").agg(F.countDistinct("hash").alias("shared"), F.max("sketch_size").alias("sketch_size"))
        counts.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return hits.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
