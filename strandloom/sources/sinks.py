"""Results as text files. Files are written by Spark, one folder for a result, except small matrices and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.analytics import running_sums


def ani_lines(ani: DataFrame) -> DataFrame:
    """value: five tab-parted columns, by falling identity, then query and reference."""
    ordered = ani.orderBy(F.desc("ani"), "query", "reference")
    return ordered.select(F.format_string("%s\t%s\t%.6f\t%d\t%d", "query", "reference", "ani", "mapped", "fragments").alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def phylip_lines(ani: DataFrame, genomes: DataFrame, digits: int = 6) -> DataFrame:
    """row, value: the lower triangle of mean identities of both directions, a line for each genome and one (row -1) with their number before them.

    genomes: genome, row (from 0). A pair without an identity above 0 is NA. Identities come to their row by joins, and a row is written from its few
    known cells and the gaps between them, so a task holds rows and never the matrix. Names that genomes lacks are left out.
    """
    names = genomes.select("genome", F.col("row").cast("long").alias("row"))
    one, other = names.toDF("query", "r1"), names.toDF("reference", "r2")
    cells = ani.join(one, "query").join(other, "reference").where("r1 <> r2").groupBy(F.greatest("r1", "r2").alias("row"), F.least("r1", "r2").alias("col")).agg(F.avg("ani").alias("ani"))
    known = cells.where("ani > 0").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", F.format_string(f"\t%.{digits}f", "ani").alias("text")))).alias("cells"))
    missing = lambda n: F.repeat(F.lit("\tNA"), n.cast("int"))
    at = lambda i: F.when(i > 0, F.get("cells", i - 1)["col"] + 1).otherwise(F.lit(0))  # noqa: E731  the column after the cell before
    held = F.array_join(F.transform("cells", lambda c, i: F.concat(missing(c["col"] - at(i)), c["text"])), "")
    line = F.concat("genome", F.coalesce(held, F.lit("")), missing(F.col("row") - F.coalesce(F.element_at("cells", -1)["col"] + 1, F.lit(0))))
    rows = names.join(known, "row", "left").select("row", line.alias("value"))
    return rows.unionByName(names.agg(F.lit(-1).cast("long").alias("row"), F.count("*").cast("string").alias("value")))


def write_ordered(lines: DataFrame, order: str, path: str) -> None:
    """Lines (order, value) as text files whose names follow the order; no task holds more than its range."""
    lines.repartitionByRange(order).sortWithinPartitions(order).select("value").write.mode("overwrite").text(path)


def visualization_lines(mappings: DataFrame, offsets: DataFrame, fragments: DataFrame) -> DataFrame:
    """A row for each mapping with places in whole genomes, for drawing a pair."""
    at = mappings.join(offsets.select("genome", "contig", "offset"), ["genome", "contig"]).join(fragments.select(F.col("genome").alias("query"), "frag", "global_start"), ["query", "frag"])
    return at.select(
        "query", F.col("genome").alias("reference"), F.col("frag").alias("query_fragment"), F.col("global_start").alias("query_start"), (F.col("global_start") + F.col("frag_len") - 1).alias("query_end"),
        F.col("contig").alias("reference_contig"), F.col("start").alias("reference_contig_start"), F.col("end").alias("reference_contig_end"), (F.col("offset") + F.col("start")).alias("reference_start"),
        (F.col("offset") + F.col("end")).alias("reference_end"), "identity", "identity_upper", F.col("shared").alias("conserved_sketches"), "sketch_size")


def fasta_lines(placed: DataFrame) -> DataFrame:
    """value: a record for each placed contig, its sequence in lines of 80."""
    head = F.format_string(">%04d_%s ref=%s:%d-%d strand=%s status=%s", "order", "name", F.coalesce("reference", F.lit("*")), F.coalesce("start", F.lit(0)), F.coalesce("end", F.lit(0)), F.coalesce("strand", F.lit("+")), "status")
    return placed.orderBy("order").select(F.concat(head, F.lit("\n"), F.regexp_replace("seq", "(.{80})(?=.)", "$1\n")).alias("value"))


def pseudochromosome(placed: DataFrame, gap: int = 1000, width: int = 80, name: str = "pseudochromosome_ordered_from_query_contigs") -> DataFrame:
    """line, value: all contigs in order as one FASTA record in lines of width, gap Ns between them; write it by write_ordered().

    Contigs get their place in the record from sums of lengths over ranges, and cut themselves into whole lines and what they share with neighbours; only such
    shared lines meet. So the record may be longer than any row: a row holds a contig's lines at most.
    """
    first = placed.agg(F.min("order")).first()[0]
    texts = placed.select("order", F.when(F.col("order") == first, F.col("seq")).otherwise(F.concat(F.repeat(F.lit("N"), F.lit(gap)), "seq")).alias("text"))
    starts = running_sums(texts.select("order", F.length("text").alias("n")).withColumn("one", F.lit(1)), ["one"], ["order"], {"start": F.col("n")}).select("order", "start")
    at = texts.join(starts, "order").withColumn("n", F.length("text"))
    head = F.least("n", F.pmod(-F.col("start"), F.lit(width))).cast("int")
    cut = at.withColumn("head", head).withColumn("whole", (F.floor((F.col("n") - F.col("head")) / width) * width).cast("int"))
    line = lambda place: F.floor(place / width).cast("long")
    rest = F.col("head") + F.col("whole")
    body = cut.where("whole > 0").select(line(F.col("start") + F.col("head")).alias("line"), F.regexp_replace(F.substring("text", F.col("head") + 1, F.col("whole")), f"(.{{{width}}})(?=.)", "$1\n").alias("value"))
    ends = F.array(F.struct(F.col("start").alias("place"), F.substring("text", F.lit(1), F.col("head")).alias("part")), F.struct((F.col("start") + rest).alias("place"), F.substring("text", rest + 1, F.col("n") - rest).alias("part")))
    parts = cut.select(F.inline(ends)).where("part <> ''").groupBy(line(F.col("place")).alias("line"))
    shared = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda p: p["part"]), "").alias("value"))  # a line's width at most
    title = placed.sparkSession.createDataFrame([(-1, f">{name}")], "line long, value string")
    return body.unionByName(shared).unionByName(title)


def paf_lines(placed: DataFrame, references: DataFrame, aligned: DataFrame | None = None) -> DataFrame:
    """value: a pairwise mapping line for each placed contig; with base_level.aligned() its extents, counts and alignment string (cg:Z:) are those of the bases."""
    lengths = references.select(F.col("name").alias("reference"), F.length("seq").alias("reference_length"))
    rows = placed.where("status = 'placed'").join(lengths, "reference")
    if aligned is None:
        return rows.select(F.concat_ws("\t", "name", "length", F.lit(0), "length", "strand", "reference", "reference_length", "start", "end", "matches", "aligned", "mapq").alias("value"))
    own = aligned.select("contig", "q_start", "q_end", F.col("start").alias("b0"), F.col("end").alias("b1"), F.col("matches").alias("equal"), "columns", "cigar")
    turned = F.col("strand") == "-"  # places on the contig as it was given
    q0, q1 = F.when(turned, F.col("length") - F.col("q_end")).otherwise(F.col("q_start")), F.when(turned, F.col("length") - F.col("q_start")).otherwise(F.col("q_end"))
    return rows.join(own, "contig").select(F.concat_ws("\t", "name", "length", q0, q1, "strand", "reference", "reference_length", "b0", "b1", "equal", "columns", "mapq", F.concat(F.lit("cg:Z:"), "cigar")).alias("value"))


def long_metrics(rows: DataFrame, section: str, name_col: str) -> DataFrame:
    """section, name, metric, value for each number of each row."""
    numbers = [f.name for f in rows.schema if f.name != name_col and f.dataType.typeName() in ("integer", "long", "double")]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in numbers])
    return rows.select(F.lit(section).alias("section"), F.col(name_col).cast("string").alias("name"), F.inline(pairs))


def offsets(seqs: DataFrame) -> DataFrame:
    """genome, contig, length and offset: the bases of the genome's contigs before it. Contigs are summed over ranges, so a genome may have any number of them."""
    sized = seqs.select("genome", "contig", F.length("seq").cast("long").alias("length"))
    return running_sums(sized, ["genome"], ["contig"], {"offset": F.col("length")})
