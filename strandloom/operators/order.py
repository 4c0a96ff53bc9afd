"""Order and orientation of contigs along references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import Config
from strandloom.functions.sequences import iupac_reverse_complement
from strandloom.operators import seeds, sketch
from strandloom.operators.analytics import cut


def diagonal_hits(contigs: DataFrame, references: DataFrame, config: Config) -> DataFrame:
    """on_diagonals() of the hashes that contigs and references share."""
    k, w = config.kmer, config.resolved_window()
    own = sketch.sketches(contigs.select("contig", "name", F.length("seq").cast("long").alias("length"), "seq"), ["contig", "name", "length"], k, w, config.hash, config.mode, config.seed)
    index = sketch.minimizers(references.select(F.col("name").alias("reference"), "seq"), ["reference"], k, w, config.hash, config.mode, config.seed)
    return on_diagonals(own.join(seeds.without_hot(index, config.ignore_top_percent), "hash"), config)


def on_diagonals(both: DataFrame, config: Config) -> DataFrame:
    """contig, name, length, reference, strand, pos, qpos, bin: shared hashes in the two bins of diagonals that overlap at theirs, on both strands."""
    strands = both.select("*", F.explode(F.array(F.struct(F.lit("+").alias("strand"), (F.col("pos") - F.col("qpos")).alias("d")), F.struct(F.lit("-").alias("strand"), (F.col("pos") + F.col("qpos")).alias("d")))).alias("s")).select("*", "s.strand", "s.d").drop("s")
    return strands.select("contig", "name", "length", "reference", "strand", "pos", "qpos", F.explode(F.array(F.floor(F.col("d") / config.diagonal_bin), F.floor(F.col("d") / config.diagonal_bin) + 1)).alias("bin"))


def best_bins(hits: DataFrame, k: int) -> DataFrame:
    """The bin with the most different places of each contig, reference and strand, three at least, and its extents (start, end, q0, q1)."""
    groups = hits.groupBy("contig", "name", "length", "reference", "strand", "bin").agg(F.countDistinct("qpos").alias("n"), F.min("pos").alias("start"), (F.max("pos") + k).alias("end"), F.min("qpos").alias("q0"), (F.max("qpos") + k).alias("q1"))
    best = Window.partitionBy("contig", "reference", "strand").orderBy(F.desc("n"), "bin")
    return groups.where("n >= 3").withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def alignments(contigs: DataFrame, references: DataFrame, config: Config) -> DataFrame:
    """name, length, reference, start, end, strand, matches, aligned, mapq: extents of the shared hashes on the best diagonal of each contig, reference and strand.

    It is a sketch of an alignment: matches are hashes times the k-mer's length, at most the extent. base_level.aligned() has the bases.
    """
    k = config.kmer
    chosen = best_bins(diagonal_hits(contigs, references, config), k)
    aligned = F.col("end") - F.col("start")
    return chosen.select("contig", "name", "length", "reference", "start", "end", "strand", F.least(F.col("n") * k, aligned).alias("matches"), aligned.alias("aligned"), F.least(F.lit(60), F.col("n").cast("int")).alias("mapq"))


def placements(contigs: DataFrame, found: DataFrame) -> DataFrame:
    """order (from 1), contig, name, length, reference, start, end, strand, aligned, matches, mapq, status, seq: each contig at its best place, then the unplaced ones.

    Sequences on the reverse strand are turned. Contigs are numbered within each reference, without their sequences, and from the number of contigs on the references before it.
    """
    best = Window.partitionBy("contig").orderBy(F.desc("aligned"), F.desc("matches"), F.desc("mapq"), "reference", "start", "strand")
    top = found.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n", "name", "length")
    placed = cut(contigs.select("contig", "name", F.length("seq").cast("long").alias("length")).join(top, "contig", "left"))
    before = F.sum("n").over(Window.orderBy(F.col("there").isNull(), "there").rowsBetween(Window.unboundedPreceding, -1))
    bases = placed.groupBy(F.col("reference").alias("there")).agg(F.count("*").alias("n")).select("there", F.coalesce(before, F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("reference").orderBy("start", "end", F.desc("length"), "name"))
    ranked = placed.withColumn("__place", place).join(bases, F.col("reference").eqNullSafe(F.col("there")))
    numbered = ranked.withColumn("order", (F.col("base") + F.col("__place")).cast("int")).withColumn("status", F.when(F.col("reference").isNull(), "unplaced").otherwise("placed"))
    seqs = contigs.select("contig", F.coalesce("seq_raw", "seq").alias("seq") if "seq_raw" in contigs.columns else "seq")
    whole = numbered.join(seqs, "contig").withColumn("seq", F.when(F.col("strand") == "-", iupac_reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    return whole.select("order", "contig", "name", "length", "reference", "start", "end", F.coalesce("strand", F.lit("+")).alias("strand"), F.coalesce("aligned", F.lit(0)).alias("aligned"), F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("mapq", F.lit(0)).alias("mapq"), "status", "seq")
