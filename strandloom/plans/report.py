"""What the stages of a comparison did: rows counted on the way by observe(), counters of each query, seconds, and their long and short reports."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandloom.sources.sinks import long_metrics

SCHEMA = "section string, name string, metric string, value double"


class StageReport:
    """Counters of stages that ride on the jobs that run anyway, and the seconds of those jobs; stages that repeat add up (most: take the largest)."""

    def __init__(self) -> None:
        self._watched: list[tuple[str, Observation, dict[str, str]]] = []
        self._nanoseconds: dict[str, int] = {}
        self._tables: dict[str, list[DataFrame]] = {}

    def watch(self, stage: str, df: DataFrame, sums: dict[str, Column] | None = None, most: dict[str, Column] | None = None) -> DataFrame:
        """df, whose rows count for the stage when it is next run, with sums and maxima of further columns."""
        seen, sums, most = Observation(), sums or {}, most or {}
        self._watched.append((stage, seen, {**dict.fromkeys(("rows", *sums), "sum"), **dict.fromkeys(most, "max")}))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(n) for n, c in sums.items()], *[F.max(c).alias(n) for n, c in most.items()])

    def keep(self, stage: str, df: DataFrame) -> DataFrame:
        """df, of which rows are counted for each query later: keep a materialized table, which is read again."""
        self._tables.setdefault(stage, []).append(df)
        return df

    @contextmanager
    def timed(self, stage: str) -> Iterator[None]:
        began = time.perf_counter_ns()
        try:
            yield
        finally:
            self._nanoseconds[stage] = self._nanoseconds.get(stage, 0) + time.perf_counter_ns() - began

    def stages(self) -> dict[str, dict[str, float]]:
        """By stage its merged counters and seconds; to be called after the jobs."""
        found: dict[str, dict[str, float]] = {}
        for stage, seen, kinds in self._watched:
            own = found.setdefault(stage, {})
            for name, value in seen.get.items():
                if value is not None:
                    own[name] = max(own.get(name, value), value) if kinds[name] == "max" else own.get(name, 0) + value
        for stage, ns in self._nanoseconds.items():
            found.setdefault(stage, {})["seconds"] = ns / 1e9
        return found

    def queries(self) -> DataFrame | None:
        """A row for each query with the rows of each kept stage."""
        stages = {stage: fold(DataFrame.unionByName, [t.select("query") for t in tables]) for stage, tables in self._tables.items()}
        return counters(stages, "query") if stages else None

    def rows(self, spark: SparkSession) -> DataFrame:
        """section, name, metric, value: stages, then queries by name."""
        listed = [("stage", stage, metric, float(value)) for stage, own in self.stages().items() for metric, value in own.items()]
        found, each = spark.createDataFrame(listed, SCHEMA), self.queries()
        return found if each is None else found.unionByName(long_metrics(each.orderBy("query"), "query", "query"))

    def summary(self) -> str:
        """A line for each stage."""
        return "\n".join(f"{stage}: " + " ".join(f"{k}={v:.6f}" if k == "seconds" else f"{k}={v:g}" for k, v in own.items()) for stage, own in self.stages().items())


class Unreported(StageReport):
    """Leaves plans as they are."""

    def watch(self, stage: str, df: DataFrame, sums: dict[str, Column] | None = None, most: dict[str, Column] | None = None) -> DataFrame:
        return df

    def keep(self, stage: str, df: DataFrame) -> DataFrame:
        return df


def counters(stages: dict[str, DataFrame], key: str) -> DataFrame:
    """key and, for each stage, how many of its rows have it (0 where none has)."""
    counted = [df.groupBy(key).agg(F.count("*").alias("n")).select(key, *[F.when(F.lit(stage == name), F.col("n")).otherwise(0).cast("long").alias(name) for name in stages]) for stage, df in stages.items()]
    return merged(counted, key)


def merged(parts: list[DataFrame], key: str, most: tuple[str, ...] = ()) -> DataFrame:
    """Reports of parts of a run as one: numbers of a key add up, those named in most give their largest."""
    every = fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.groupBy(key).agg(*[(F.max if c in most else F.sum)(F.coalesce(c, F.lit(0))).alias(c) for c in every.columns if c != key])
