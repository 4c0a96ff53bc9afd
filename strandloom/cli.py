"""Command line: compare collections of sequence files, order contigs, compare two identity tables, and study methods against a truth."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandloom.config import Config
from strandloom.operators import analytics, base_level, order, studies
from strandloom.operators.reduce import best_both_ways
from strandloom.plans.compare import compare, compare_split, map_fragments, query_sketches
from strandloom.plans.report import StageReport
from strandloom.session import ship
from strandloom.sources import fastx, sinks


def _inputs(command: argparse.ArgumentParser) -> None:
    for short, long, listed in (("-q", "--query", "--ql"), ("-r", "--reference", "--rl")):
        which = command.add_mutually_exclusive_group(required=True)
        which.add_argument(short, long)
        which.add_argument(listed, listed + "ist" if listed == "--ql" else "--refList")
    command.add_argument("-o", "--output", required=True)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandloom")
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("compare", help="identities of query genomes against reference genomes")
    fixed = commands.add_parser("compare-exact", help="the same by exact minimizers (or minmers) of MurmurHash3 and the Poisson model, with one window for both sides")
    for command in (run, fixed):
        _inputs(command)
    plain = Config()
    for flag, field, kind in (("-k", "kmer", int), ("--fragLen", "fragment", int), ("--minIdentity", "min_identity", float), ("--minFraction", "min_fraction", float)):
        fixed.add_argument(flag, dest=field, type=kind, default=getattr(plain, field))
    fixed.add_argument("--minmer", dest="mode", action="store_const", const="minmer", default="exact")
    fixed.add_argument("--matrix", action="store_true")
    fixed.add_argument("--timing", metavar="FOLDER")
    fixed.set_defaults(hash="murmur3", visualize=False, split=None)
    hits = commands.add_parser("hits", help="the best hit of each query of a table of search results")
    hits.add_argument("table", help="tab-parted, with the columns of fastx.BLAST_SCHEMA")
    hits.add_argument("output")
    hits.add_argument("--coverage", type=float, default=0.0, help="least share of a query that a hit covers, in percent")
    for flag, field, kind in (
        ("-k", "kmer", int), ("--fragLen", "fragment", int), ("--minIdentity", "min_identity", float), ("--minFraction", "min_fraction", float), ("--pValue", "p_value", float), ("--referenceSize", "reference_size", int),
        ("--windowSize", "window", int), ("--ignoreTopPercent", "ignore_top_percent", float), ("--seed", "seed", int), ("--diagBin", "diagonal_bin", int), ("--diagBand", "diagonal_band", int),
        ("--chainMaxPredecessors", "max_predecessors", int), ("--chainMaxGap", "max_gap", int), ("--chainDiagTolerance", "diagonal_tolerance", int), ("--mode", "mode", str), ("--hash", "hash", str), ("--model", "model", str),
    ):
        run.add_argument(flag, dest=field, type=kind, default=getattr(plain, field))
    run.add_argument("--optimalChain", dest="optimal_chain", action="store_true")
    run.add_argument("--matrix", action="store_true")
    run.add_argument("--timing", metavar="FOLDER", help="rows and seconds of the stages, and counters of each query")
    run.add_argument("--visualize", action="store_true")
    run.add_argument("--split", type=int)
    contigs = commands.add_parser("order", help="order and turn contigs along a reference")
    contigs.add_argument("reference")
    contigs.add_argument("query")
    contigs.add_argument("prefix", nargs="?", default="reordered")
    tables = commands.add_parser("agree", help="statistics of two identity tables")
    tables.add_argument("one")
    tables.add_argument("other")
    tables.add_argument("--joined")
    tables.add_argument("--summary", required=True)
    tables.add_argument("--average-pairs", action="store_true")
    study = commands.add_parser("study", help="clusters and neighbours of methods against a table of true identities")
    study.add_argument("truth", help="tab-parted, with genome1, genome2, query_length, subject_length and the identities")
    study.add_argument("prefix")
    study.add_argument("--value", required=True, help="the truth's column of identities")
    study.add_argument("--method", nargs=3, action="append", required=True, metavar=("NAME", "TABLE", "SCALE"))
    study.add_argument("--thresholds", nargs="+", type=float, default=[95.0])
    study.add_argument("--ks", nargs="+", type=int, default=[1, 5, 10])
    study.add_argument("--repeats", type=int, default=10)
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("strandloom").getOrCreate()
    ship(spark)
    {"compare": _compare, "compare-exact": _compare, "hits": _hits, "order": _order, "agree": _agree, "study": _study}[a.command](spark, a)


def _compare(spark: SparkSession, a: argparse.Namespace) -> None:
    paths = [[one] if one else fastx.read_path_list(spark, listed) for one, listed in ((a.query, a.ql), (a.reference, a.rl))]
    queries, references = (fastx.read_sequences(spark, p) for p in paths)
    queries, references = queries.drop("seq_raw"), references.drop("seq_raw")
    config = Config(**{f: getattr(a, f) for f in Config.__dataclass_fields__ if hasattr(a, f)}).checked()
    report = StageReport() if a.timing else None
    found = analytics.cut(compare_split(queries, references, config, a.split, report) if a.split else compare(queries, references, config, report))
    sinks.write_lines(sinks.ani_lines(found), a.output)
    if report:
        print(report.summary())
        report.rows(spark).write.mode("overwrite").csv(a.timing, sep="\t", header=True)
    if a.matrix:
        names = {r[0] for side in (queries, references) for r in side.select("genome").distinct().collect()}  # no more than the paths that were given
        listed = spark.createDataFrame(list(enumerate(fastx.as_listed(names, paths[0] + paths[1]))), "row long, genome string")
        sinks.write_ordered(sinks.phylip_lines(found, listed), "row", a.output + ".matrix")
    if a.visualize:
        tiles, _ = query_sketches(queries, config)
        points = sinks.visualization_lines(best_both_ways(map_fragments(queries, references, config), config.fragment), sinks.offsets(references), tiles)
        points.write.mode("overwrite").csv(a.output + ".map", sep="\t", header=True)


def _hits(spark: SparkSession, a: argparse.Namespace) -> None:
    best = analytics.best_search_hits(fastx.read_blast(spark, a.table), "qseqid", a.coverage)
    best.orderBy("qseqid").write.mode("overwrite").csv(a.output, sep="\t", header=True)


def _order(spark: SparkSession, a: argparse.Namespace) -> None:
    references, contigs = fastx.read_sequences(spark, a.reference), fastx.read_sequences(spark, a.query)
    placed = analytics.cut(order.placements(contigs, order.alignments(contigs, references, Config())))
    placed.drop("seq", "contig").orderBy("order").write.mode("overwrite").csv(a.prefix + ".tsv", sep="\t", header=True)
    sinks.write_lines(sinks.fasta_lines(placed), a.prefix + ".fasta")
    sinks.write_ordered(sinks.pseudochromosome(placed), "line", a.prefix + ".pseudo.fasta")
    sinks.write_lines(sinks.paf_lines(placed, references, base_level.aligned(contigs, references, placed, Config())), a.prefix + ".paf")


def _agree(spark: SparkSession, a: argparse.Namespace) -> None:
    both = [fastx.read_ani_table(spark, path) for path in (a.one, a.other)]
    if a.average_pairs:
        both = [analytics.reciprocal_means(t).select(F.col("a").alias("query"), F.col("b").alias("reference"), "ani") for t in both]
    pairs = analytics.agreement_pairs(*both)
    summary = analytics.agreement(pairs).crossJoin(analytics.only_counts(*both).drop("shared"))  # one row each
    sinks.long_metrics(summary.withColumn("of", F.lit("tables")), "agreement", "of").write.mode("overwrite").csv(a.summary, sep="\t", header=True)
    if a.joined:
        pairs.orderBy("query", "reference").write.mode("overwrite").csv(a.joined, sep="\t", header=True)


def _study(spark: SparkSession, a: argparse.Namespace) -> None:
    if any(name == "truth" for name, _, _ in a.method):
        raise ValueError("truth is the name of the true table; a method needs another")
    rows = fastx.read_truth_table(spark, a.truth, a.value)
    nodes = studies.side_lengths(rows, [("genome1", "query_length"), ("genome2", "subject_length")])
    directed = [("truth", rows.select(F.col("genome1").alias("query"), F.col("genome2").alias("reference"), "ani"), 1.0)]
    directed += [(name, fastx.read_directed_identities(spark, table), float(scale)) for name, table, scale in a.method]
    pairs = None
    for name, table, scale in directed:
        averaged = studies.averaged_pairs(table, nodes, scale).select(F.lit(name).alias("method"), "a", "b", "ani")
        pairs = averaged if pairs is None else pairs.unionByName(averaged)
    pairs = analytics.cut(pairs)
    found = studies.split_recall(nodes.select("name"), pairs, "truth", a.ks, a.repeats)
    tables = {
        "clusters": studies.threshold_series(nodes, pairs, "truth", a.thresholds).orderBy("method", "threshold_ani"),
        "neighbours": found.orderBy("repeat", "query", "method", "k"),
        "recall": analytics.two_level(found, ["method", "k"], ["repeat"], "recall").orderBy("method", "k"),
    }
    for name, table in tables.items():
        table.write.mode("overwrite").csv(f"{a.prefix}.{name}.tsv", sep="\t", header=True)


if __name__ == "__main__":
    main()
