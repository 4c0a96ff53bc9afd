"""From mappings to identities of genome pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _first(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def best_per_fragment(mappings: DataFrame) -> DataFrame:
    """The mapping of the highest identity of each fragment and genome; of equal ones the last by contig, then start."""
    return _first(mappings, ["query", "genome", "frag"], F.desc("identity"), F.desc("contig"), F.desc("start"))


def best_per_bin(mappings: DataFrame, fragment: int) -> DataFrame:
    """Of those, the highest for each place bin of a reference; of equal ones the last fragment."""
    binned = mappings.withColumn("place_bin", F.floor(F.col("start") / max(1, fragment - 20)).cast("long"))
    return _first(binned, ["query", "genome", "contig", "place_bin"], F.desc("identity"), F.desc("frag"))


def best_both_ways(mappings: DataFrame, fragment: int) -> DataFrame:
    """The mappings that are best for their fragment and, of those, for their place bin."""
    return best_per_bin(best_per_fragment(mappings), fragment)


def genome_identities(mappings: DataFrame, fragment: int) -> DataFrame:
    """query, genome, ani, mapped of the mappings that are best both ways."""
    return best_both_ways(mappings, fragment).groupBy("query", "genome").agg(F.avg("identity").alias("ani"), F.count("*").alias("mapped"))


def enough_mapped(pairs: DataFrame, lengths: DataFrame, fragment: int, fraction: float) -> DataFrame:
    """Pairs of which the mapped fragments make up the fraction of the shorter genome; lengths: genome, length."""
    one = lengths.select(F.col("genome").alias("query"), F.col("length").alias("query_length"))
    both = pairs.join(one, "query").join(lengths.select("genome", "length"), "genome")
    return both.where(F.col("mapped") * fragment >= F.least("query_length", "length") * fraction).drop("query_length", "length")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(F.desc("ani"), "query", "genome")
