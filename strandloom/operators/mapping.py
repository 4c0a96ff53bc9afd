"""From clusters of seed hits to scored mappings of fragments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.config import Config
from strandloom.functions import kernels
from strandloom.functions import statistics as st
from strandloom.operators import intervals, seeds
from strandloom.operators.analytics import side

KEYS = ["query", "frag", "genome", "contig"]
#: Candidates whose windows are Python lists at a time.
WINDOW_ROWS = 128


def minimum_hits_table(sketches: DataFrame, config: Config) -> DataFrame:
    """sketch_size, least: no more rows than a fragment has bases."""
    spark = sketches.sparkSession
    sizes = [r[0] for r in sketches.select("sketch_size").distinct().collect()]
    rows = [(s, max(1, st.relaxed_minimum_hits(int(s), config.kmer, config.min_identity, config.model))) for s in sizes]
    return spark.createDataFrame(rows, "sketch_size long, least long")


def chained(hits: DataFrame, config: Config) -> DataFrame:
    """KEYS, frag_len, start, end: candidate ranges of starts, from chains within diagonal bins, in either orientation.

    hits: KEYS, frag_len, sketch_size, least, pos, qpos. A bin's hits come as one row, so tasks work on rows and not on groups; they are
    bounded by places, since a bin's places on a reference span its width and a fragment.
    """
    k = config.kmer
    dealt = seeds.diagonals(hits, KEYS, config.diagonal_bin).groupBy(*KEYS, "frag_len", "bin", "least")
    grouped = dealt.agg(F.collect_list("pos").alias("refs"), F.collect_list("qpos").alias("queries")).where(F.size(F.array_distinct("queries")) >= F.col("least"))

    def starts(refs: np.ndarray, queries: np.ndarray, length: int, least: int) -> set[int]:
        out: set[int] = set()
        for reverse in (False, True):
            places = np.maximum(np.maximum(length - queries, 0) - k, 0) if reverse else queries
            if config.optimal_chain:
                chain = kernels.optimal_chain(refs, places, k, length, least)
            else:
                chain = kernels.gap_chain(refs, places, least, max(config.max_gap, length + k), max(config.diagonal_tolerance, 8 * k), config.max_predecessors)
            if len(chain) and len(np.unique(chain[:, 1])) >= least:
                out |= set(np.maximum(chain[:, 0] - chain[:, 1], 0).tolist())
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            found = [sorted(starts(np.array(r, np.int64), np.array(q, np.int64), n, m)) for r, q, n, m in zip(rows["refs"], rows["queries"], rows["frag_len"], rows["least"])]
            yield batch.select([*KEYS, "frag_len"]).append_column("starts", pa.array(found, pa.list_(pa.int64())))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grouped.select(*KEYS, "frag_len").schema)
    found = grouped.select(*KEYS, "frag_len", "refs", "queries", "least").mapInArrow(run, schema + ", starts array<long>")
    each = found.select(*KEYS, "frag_len", F.explode("starts").alias("s"))
    return intervals.merge(each.select(*KEYS, "frag_len", F.greatest(F.col("s") - config.diagonal_band, F.lit(0)).alias("start"), (F.col("s") + config.diagonal_band).alias("end")), [*KEYS, "frag_len"])


def _slices(lists: pa.ListArray) -> list[list[int]]:
    """Each row's values, cut out of one list."""
    values, at = lists.flatten().to_numpy(zero_copy_only=False).tolist(), np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))).tolist()
    return [values[a:b] for a, b in zip(at, at[1:])]


def scored(candidates: DataFrame, sketches: DataFrame, minimizers: DataFrame, config: Config) -> DataFrame:
    """KEYS, frag_len, sketch_size, shared, start, end, identity, identity_upper: the best window of each candidate (cut from its lineage) that may reach the identity.

    In minmer mode minimizers are intervals (start, end), else places (pos).
    """
    k, w, minmer = config.kmer, config.resolved_window(), config.mode == "minmer"
    ranges = side(candidates, 150).withColumn("first", F.col("start")).withColumn("last", F.col("end")).drop("start", "end")
    if minmer:
        others = minimizers.select("genome", "contig", "hash", F.col("start").alias("other_start"), (F.col("end") - 1).alias("other_end"))
        near = intervals.overlapping(ranges.select("*", F.col("first").alias("start"), F.col("last").alias("end")), others, ["genome", "contig"], 4096)
        element, parts = F.struct("other_start", (F.col("other_end") + 1).alias("stop"), "hash"), ("hash", "other_start", "stop")
    else:
        near = intervals.points_within(ranges.select("*", F.col("first").alias("start"), (F.col("last") + F.col("frag_len") - 1).alias("end")), minimizers, ["genome", "contig"], 4096)
        element, parts = F.struct("pos", "hash"), ("hash", "pos")
    grouped = near.groupBy(*KEYS, "frag_len", "first", "last").agg(F.array_sort(F.collect_list(element)).alias("held"))
    whole = side(sketches, 100).groupBy(F.col("genome").alias("query"), "frag").agg(F.sort_array(F.collect_list("hash")).alias("sketch"))
    joined = grouped.join(whole, ["query", "frag"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, WINDOW_ROWS) for b in batches for at in range(0, b.num_rows, WINDOW_ROWS)):
            lengths, firsts, lasts = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("frag_len", "first", "last"))
            sketch, *held = (_slices(batch.column(batch.schema.names.index(c))) for c in ("sketch", *parts))
            if minmer:
                found = [kernels.best_interval_window(s, list(zip(h, a, b)), low, high) for s, h, a, b, low, high in zip(sketch, *held, firsts, lasts)]
            else:
                found = [kernels.best_window(s, h, p, n - (w - 1) - (k - 1), low, high, n) for s, h, p, n, low, high in zip(sketch, *held, lengths, firsts, lasts)]
            out = batch.select([*KEYS, "frag_len"]).append_column("sketch_size", pa.array([len(s) for s in sketch], pa.int64()))
            for name, at in (("shared", 0), ("start", 1)):
                out = out.append_column(name, pa.array([f[at] if f else None for f in found], pa.int64()))
            yield out.filter(pa.array([f is not None for f in found]))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.select(*KEYS, "frag_len").schema)
    windows = joined.select(*KEYS, "frag_len", "first", "last", "sketch", *[F.col(f"held.{c}").alias(c) for c in parts]).mapInArrow(run, schema + ", sketch_size long, shared long, start long")
    sizes = [int(r[0]) for r in sketches.select("sketch_size").distinct().collect()]
    table = st.distance_table(sketches.sparkSession, sizes, k, config.model)
    known = windows.join(table, (windows["sketch_size"] == table["sketch_size"]) & (windows["shared"] == table["shared"])).drop(table["sketch_size"]).drop(table["shared"])
    return known.where(F.col("identity_upper") >= config.min_identity).select(*KEYS, "frag_len", "sketch_size", "shared", "start", (F.col("start") + F.col("frag_len") - 1).alias("end"), "identity", "identity_upper")
