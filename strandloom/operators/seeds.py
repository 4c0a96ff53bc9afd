"""Shared hashes of queries and references: frequencies, hot keys, hits and their diagonals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequences import floor_div


def frequencies(minimizers: DataFrame) -> DataFrame:
    return minimizers.groupBy("hash").agg(F.count("*").alias("hits"))


def frequency_threshold(counts: DataFrame, top_percent: float) -> DataFrame:
    """One row, threshold: the hits of the last of the top_percent most frequent hashes; null if that is none.

    Ranks come from a histogram of hits, not from a sort of all hashes in one task.
    """
    histogram = counts.groupBy("hits").agg(F.count("*").alias("n"))
    up_to = F.sum("n").over(Window.orderBy(F.desc("hits")))
    n = F.sum("n").over(Window.partitionBy())
    rank = F.floor(n * (top_percent / 100.0))
    return histogram.select("hits", up_to.alias("up_to"), rank.alias("rank")).where("rank > 0 and up_to >= rank").agg(F.max("hits").alias("threshold"))


def without_hot(minimizers: DataFrame, top_percent: float) -> DataFrame:
    """Minimizers of hashes with fewer hits than the threshold; ties at it go too."""
    if top_percent <= 0:
        return minimizers
    counts = frequencies(minimizers)
    threshold = frequency_threshold(counts, top_percent).first()["threshold"]
    if threshold is None:
        return minimizers
    return minimizers.join(counts.where(F.col("hits") >= threshold).select("hash"), "hash", "left_anti")


def hits(sketches: DataFrame, minimizers: DataFrame) -> DataFrame:
    """Every sketch row with every reference minimizer of its hash."""
    return sketches.join(minimizers, "hash")


def diagonals(hits: DataFrame, keys: list[str], width: int) -> DataFrame:
    """hits and bin, of reference place less query place."""
    return hits.withColumn("bin", floor_div(F.col("pos") - F.col("qpos"), width))


def clusters(hits: DataFrame, keys: list[str], width: int, least: Column | int) -> DataFrame:
    """keys, bin, n_hits, n_places: diagonal bins with hits at `least` or more different query places, which a column may give for each row."""
    grouped = diagonals(hits.withColumn("__least", least if isinstance(least, Column) else F.lit(least)), keys, width).groupBy(*keys, "bin")
    return grouped.agg(F.count("*").alias("n_hits"), F.countDistinct("qpos").alias("n_places"), F.max("__least").alias("__least")).where("n_places >= __least").drop("__least")


def consecutive_regions(hits: DataFrame, keys: list[str], least: str, query_len: str) -> DataFrame:
    """keys, start, end: where `least` consecutive hits (by reference place) lie within a query's length; overlapping ones united.

    least and query_len are columns with one value for each key.
    """
    from strandloom.operators.intervals import merge

    order = Window.partitionBy(*keys).orderBy("pos")
    numbered = hits.select(*keys, "pos", least, query_len, F.row_number().over(order).alias("__n"))
    later = numbered.select(*keys, F.col("pos").alias("__last"), F.col("__n").alias("__m"))
    pairs = numbered.withColumn("__m", F.col("__n") + F.col(least) - 1).join(later, [*keys, "__m"]).where(F.col("__last") - F.col("pos") < F.col(query_len))
    found = pairs.select(*keys, F.greatest(F.col("__last") - (F.col(query_len) - 1), F.lit(0)).alias("start"), F.col("pos").alias("end"))
    return merge(found, keys, gap=0)
