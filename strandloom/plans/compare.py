"""The comparison of collections of sequences, from sequences to identities of pairs."""

from __future__ import annotations

from functools import reduce as fold

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.config import Config
from strandloom.operators import mapping, reduce, seeds, sketch
from strandloom.operators import intervals
from strandloom.operators.analytics import cut, side, side_is_small
from strandloom.plans.report import StageReport, Unreported


def query_sketches(queries: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """The fragments, and their sketches."""
    tiles = sketch.fragments(queries, config.fragment)
    size = min(config.minmer_sketch(), config.fragment - config.kmer + 1) if config.mode == "minmer" else None
    return tiles, sketch.sketches(tiles, ["genome", "frag"], config.kmer, config.resolved_window(), config.hash, config.mode, config.seed, size)


def reference_index(references: DataFrame, config: Config, only: np.ndarray | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """The references' minimizers, or in minmer mode their intervals (of the hashes asked for, or within the places that two columns name)."""
    if config.mode == "minmer":
        window = config.fragment - config.kmer + 1
        return sketch.minmer_intervals(references, ["genome", "contig", *within], config.kmer, window, min(config.minmer_sketch(), window), config.hash, config.seed, only, within or None)
    return sketch.minimizers(references, ["genome", "contig"], config.kmer, config.resolved_window(), config.hash, config.mode, config.seed)


def map_fragments(queries: DataFrame, references: DataFrame, config: Config, report: StageReport | None = None) -> DataFrame:
    """Scored mappings of the queries' fragments on the references. report: gets rows and seconds of the stages that run, and the tables that it counts by query.

    Minimizers of the references are kept, as hits and window scores both read them. Minmer intervals are many times the references' size and are not:
    hits are found in one pass over the references, window scores in another over the contigs that have candidates.
    """
    config, minmer, counted, report = config.checked(), config.mode == "minmer", report is not None, report or Unreported()
    with report.timed("reference"):
        index = report.watch("reference", reference_index(references, config))
        if not minmer:
            index = cut(index)
        elif counted:
            index.write.format("noop").mode("overwrite").save()
            index = reference_index(references, config)
    with report.timed("query"):
        sketches = cut(report.watch("query", query_sketches(queries, config)[1], most={"largest_sketch": F.col("sketch_size")}))
        report.keep("minimizers", sketches.withColumnRenamed("genome", "query"))
    small = side_is_small(sketches, 100)
    if minmer and small and config.ignore_top_percent <= 0:
        asked = np.array(sorted(r[0] for r in sketches.select("hash").distinct().collect()), np.int64)
        index = reference_index(references, config, asked.astype(np.uint64))
    found = side(sketches, 100).join(F.broadcast(mapping.minimum_hits_table(sketches, config)), "sketch_size")
    own = found.select(F.col("genome").alias("query"), "frag", "hash", "qpos", "sketch_size", "least", F.lit(config.fragment).cast("long").alias("frag_len"))
    shared = report.watch("hits", seeds.hits(F.broadcast(own) if small else own, seeds.without_hot(index, config.ignore_top_percent)))
    keys = mapping.KEYS
    if minmer:
        candidates = intervals.deep(shared.select(*keys, "frag_len", "least", "start", (F.col("end") - 1).alias("end")), [*keys, "frag_len"], "least")
    elif config.mode == "exact":
        candidates = seeds.consecutive_regions(shared.select(*keys, "least", "frag_len", "pos"), keys, "least", "frag_len").withColumn("frag_len", F.lit(config.fragment).cast("long"))
    else:
        candidates = mapping.chained(shared, config)
    with report.timed("candidates"):
        held = report.keep("candidates", cut(report.watch("candidates", candidates, most={"longest": F.col("end") - F.col("start") + 1})))
    if minmer:
        spans = side(cut(held.groupBy("genome", "contig").agg(F.min("start").alias("first"), F.max("end").alias("last"))), 80)
        index = reference_index(references.join(spans, ["genome", "contig"]), config, within=("first", "last"))
    return report.watch("mappings", mapping.scored(held, sketches, index, config), most={"most_shared": F.col("shared")})


def compare(queries: DataFrame, references: DataFrame, config: Config, report: StageReport | None = None) -> DataFrame:
    """query, reference, ani, mapped, fragments: pairs with enough mapped fragments, by falling identity. With a report the mappings are kept, to be counted by query."""
    lengths = queries.unionByName(references).groupBy("genome", "contig").agg(F.max(F.length("seq")).alias("n")).groupBy("genome").agg(F.sum("n").alias("length"))
    mappings = map_fragments(queries, references, config, report)
    if report:
        with report.timed("mappings"):
            mappings = report.keep("mappings", cut(mappings))
    pairs = reduce.enough_mapped(reduce.genome_identities(mappings, config.fragment), lengths, config.fragment, config.min_fraction)
    fragments = queries.groupBy("genome").agg(F.sum(F.floor(F.length("seq") / config.fragment)).alias("fragments"))
    named = pairs.join(fragments.withColumnRenamed("genome", "query"), "query")
    return reduce.ordered(named).select("query", F.col("genome").alias("reference"), "ani", "mapped", F.col("fragments").cast("long").alias("fragments"))


def compare_split(queries: DataFrame, references: DataFrame, config: Config, parts: int, report: StageReport | None = None) -> DataFrame:
    """The same from parts of the references one by one, for a store of references that should not be shuffled at once."""
    genomes = sorted(r[0] for r in references.select("genome").distinct().collect())
    if parts < 2 or parts >= len(genomes):
        raise ValueError("parts must be 2 or more and fewer than the references")
    if config.ignore_top_percent > 0:
        raise ValueError("a frequency filter needs all references at once")
    size = -(-len(genomes) // parts)
    found = [compare(queries, references.where(F.col("genome").isin(genomes[at : at + size])), config, report) for at in range(0, len(genomes), size)]
    return fold(DataFrame.unionByName, found).orderBy(F.desc("ani"), "query", "reference")
