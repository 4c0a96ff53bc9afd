"""Intervals of places, ends included: union, depth, coverage, and joins of ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: int = 1) -> DataFrame:
    """keys, start, end of the unions of intervals that overlap or are at most gap apart."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__new", (before.isNull() | (before + gap < F.col(start))).cast("int"))
    grouped = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("__island")


def coverage(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys and the places that at least one interval covers."""
    return merge(rows, keys, start, end).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start") + 1).alias("covered"))


def deep(rows: DataFrame, keys: list[str], least, start: str = "start", end: str = "end") -> DataFrame:
    """keys, start, end of the stretches that at least `least` (a number or a column name of rows) intervals cover.

    Only places where the depth changes are sorted.
    """
    depth_needed = F.lit(least) if isinstance(least, int) else F.col(least)
    carried = [] if isinstance(least, int) else [least]
    marks = rows.select(*keys, *carried, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct((F.col(end) + 1).alias("at"), F.lit(-1).alias("step")))).alias("m"))
    steps = marks.groupBy(*keys, *carried, F.col("m.at").alias("at")).agg(F.sum("m.step").alias("step"))
    order = Window.partitionBy(*keys).orderBy("at")
    depths = steps.select(*keys, *carried, F.col("at").alias("start"), F.sum("step").over(order).alias("depth"), (F.lead("at").over(order) - 1).alias("end"))
    return merge(depths.where((F.col("depth") >= depth_needed) & (F.col("depth") > 0) & F.col("end").isNotNull()), keys)


def points_within(ranges: DataFrame, points: DataFrame, keys: list[str], width: int, start: str = "start", end: str = "end", at: str = "pos") -> DataFrame:
    """ranges joined with the points of the same keys from start to end. Both are cut into buckets of width places, so the join has an equality to go by
    however long a sequence is."""
    cut = ranges.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    dealt = points.withColumn("__bucket", F.floor(F.col(at) / width))
    return cut.join(dealt, [*keys, "__bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("__bucket")


def overlapping(ranges: DataFrame, others: DataFrame, keys: list[str], width: int) -> DataFrame:
    """ranges (start, end) joined with others (other_start, other_end) that share a place; a pair meets in the first bucket they share."""
    cut = ranges.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    dealt = others.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("other_start") / width), F.floor(F.col("other_end") / width))))
    first = F.floor(F.greatest("start", "other_start") / width)
    return cut.join(dealt, [*keys, "__bucket"]).where((F.col("start") <= F.col("other_end")) & (F.col("other_start") <= F.col("end")) & (F.col("__bucket") == first)).drop("__bucket")
