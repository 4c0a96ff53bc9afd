"""FASTA and FASTQ files, plain or gzipped, and the text tables that go with them."""

from __future__ import annotations

import gzip
import os
import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.sequences import display_name, normalized
from strandloom.operators.analytics import cut
from strandloom.sources.lines import SPLIT_BYTES, bgzf_lines, is_bgzf, lines_of


#: Bases of a piece of a long sequence; a record of more has several rows until it is stitched.
PIECE = 1 << 20
_FASTQ = re.compile(r"\.(fq|fastq)(\.gz|\.bgz)?$", re.IGNORECASE)
_FASTA = re.compile(r"\.(fa|fasta|fna|ffn|fas|faa|frn)(\.gz|\.bgz)?$", re.IGNORECASE)
_BASES = re.compile(rb"[A-Za-z*.\-]*$")
_PARTS = "path string, start long, rec long, head string, piece int, seq string, whole boolean"


class Broken(ValueError):
    """Lines that are no FASTQ records."""


def one_read(lines: list[bytes], at: int) -> tuple[tuple[bytes, bytes], int] | None:
    """(header, sequence) of the FASTQ record that begins at a line, sequence and quality over one or more lines each, and the line after it; None if lines are lacking."""
    if not lines[at].startswith(b"@"):
        raise Broken(f"no record begins with {lines[at][:40]!r}")
    seq, n = [], at + 1
    while n < len(lines) and not lines[n].startswith(b"+"):
        if not _BASES.match(lines[n].strip()):
            raise Broken(f"no bases: {lines[n][:40]!r}")
        seq.append(lines[n].strip())
        n += 1
    if n >= len(lines):
        return None
    bases, n, quality = b"".join(seq), n + 1, 0
    if not bases and n < len(lines) and not lines[n].strip():
        n += 1
    while quality < len(bases):
        if n >= len(lines):
            return None
        quality, n = quality + len(lines[n].strip()), n + 1
    if quality > len(bases):
        raise Broken(f"qualities of {lines[at][:40]!r} are longer than its sequence")
    return (lines[at][1:], bases), n


def _blank(lines: list[bytes], at: int) -> int:
    while at < len(lines) and not lines[at].strip():
        at += 1
    return at


def _synced(lines: list[bytes], ended: bool) -> int | None:
    """The first line at which a record surely begins: one that is whole and is followed by another's header, or by nothing. None if that needs more lines."""
    for at, line in enumerate(lines):
        if line.startswith(b"@"):
            try:
                found = one_read(lines, at)
                if found is None:
                    return None
                after = _blank(lines, found[1])
                if after == len(lines) and not ended:
                    return None
                if not found[0][1]:  # two lines of a quality may look like a record without bases
                    continue
                if after == len(lines) or lines[after].startswith(b"@"):
                    return at
            except Broken:
                pass
    return None


class _Parts:
    """Rows of the parts of a split, handed on in batches."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, path, start, rec, head, piece, seq: bytes, whole) -> None:
        self.rows.append((path, start, rec, None if head is None else head.decode("utf-8", "replace"), piece, seq.decode("utf-8", "replace"), whole))
        self.bytes += len(seq)

    def full(self) -> bool:
        return self.bytes >= PIECE or len(self.rows) >= 5_000

    def batch(self) -> pa.RecordBatch:
        names = ["path", "start", "rec", "head", "piece", "seq", "whole"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.bool_()]
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows), kinds)], names)
        self.rows, self.bytes = [], 0
        return made


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[bytes]]]:
    """((path, start), lines) of runs of lines of one split."""
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        values = batch.column(2).to_pylist()
        for key, run in groupby(range(len(keys)), keys.__getitem__):
            run = list(run)
            yield key, values[run[0] : run[-1] + 1]


def _fasta_parts(piece: int):
    """Records of splits of FASTA lines: rec 0 goes on with the record before the split; whole: all of the record is in this row."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at = _Parts(), None
        rec, head, number, parts, size = 0, None, 0, [], 0

        def close(whole: bool) -> None:
            if rec or parts or number:
                out.add(*at, rec, head, number, b"".join(parts), whole and rec > 0 and number == 0)

        for key, lines in _splits(batches):
            if key != at:
                if at is not None:
                    close(False)
                at, rec, head, number, parts, size = key, 0, None, 0, [], 0
            for line in lines:
                if line.startswith(b">"):
                    close(True)
                    rec, head, number, parts, size = rec + 1, line[1:], 0, [], 0
                else:
                    line = line.strip()
                    while size + len(line) > piece:
                        kept = piece - size
                        parts.append(line[:kept])
                        out.add(*at, rec, head, number, b"".join(parts), False)
                        line, number, parts, size = line[kept:], number + 1, [], 0
                    parts.append(line)
                    size += len(line)
                if out.full():
                    yield out.batch()
        if at is not None:
            close(False)
        if out.rows:
            yield out.batch()

    return parse


def _fastq_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads of splits of FASTQ lines. rec 0 holds the lines before the first sure record and rec -1 those of a last one that isn't whole; both are stitched later."""
    out, at, lines, rec, known = _Parts(), None, [], 0, False

    def take(ended: bool) -> None:
        nonlocal lines, rec, known
        if not known:
            found = 0 if at[1] == 0 else _synced(lines, ended)
            if found is None:
                if ended and lines:
                    out.add(*at, 0, None, 0, b"\n".join(lines), False)
                    lines = []
                return
            if found:
                out.add(*at, 0, None, 0, b"\n".join(lines[:found]), False)
            lines, known = lines[found:], True
        n = _blank(lines, 0)
        while n < len(lines):
            found = one_read(lines, n)
            if found is None:
                break
            rec, n = rec + 1, _blank(lines, found[1])
            out.add(*at, rec, found[0][0], 0, found[0][1], True)
        lines = lines[n:]
        if ended:
            out.add(*at, -1, None, 0, b"\n".join(lines), False)

    for key, run in _splits(batches):
        if key != at:
            if at is not None:
                take(True)
            at, lines, rec, known = key, [], 0, False
        lines += run
        take(False)
        if out.full():
            yield out.batch()
    if at is not None:
        take(True)
    if out.rows:
        yield out.batch()


def _small(df: DataFrame) -> DataFrame:
    """A table with few rows for each split, broadcast if it is small once counted, and else joined by a shuffle."""
    kept = cut(df)
    return F.broadcast(kept) if kept.count() * 200 <= 4_000_000 else kept


def _earlier():
    """The splits of a file before one."""
    return Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)


def fasta_pieces(lines: DataFrame, piece: int = PIECE) -> DataFrame:
    """genome, contig, head (in a record's first split), start, piece, seq_raw, whole: the records of FASTA lines, long ones and those across splits in several rows that (start, piece) order."""
    heads = lines.groupBy("path", "start").agg(F.count_if(F.substring("value", 1, 1) == F.lit(b">")).alias("n"))
    before = _small(heads.select("path", "start", F.coalesce(F.sum("n").over(_earlier()), F.lit(0)).alias("before")))
    parts = lines.mapInArrow(_fasta_parts(piece), _PARTS).join(before, ["path", "start"])
    contig = F.col("before") + F.col("rec") - 1
    return parts.select(F.col("path").alias("genome"), contig.alias("contig"), "head", "start", "piece", F.col("seq").alias("seq_raw"), "whole").where("contig >= 0")


def _fasta_records(lines: DataFrame, piece: int) -> DataFrame:
    parts = fasta_pieces(lines, piece)
    rows = F.array_sort(F.collect_list(F.struct("start", "piece", "seq_raw")))
    stitched = parts.where("not whole").groupBy("genome", "contig").agg(F.max("head").alias("name"), F.array_join(F.transform(rows, lambda r: r["seq_raw"]), "").alias("seq_raw"))
    return parts.where("whole").select("genome", "contig", F.col("head").alias("name"), "seq_raw").unionByName(stitched)


def _stitch(parts: pa.Table) -> pa.Table:
    """Lines that splits left over, between two sure records, as records."""
    rows = sorted(parts.to_pylist(), key=lambda r: (r["start"], -r["rec"]))
    lines = [x for r in rows if r["seq"] for x in r["seq"].encode().split(b"\n")]
    path, owner, found, n = rows[0]["path"], rows[0]["owner"], [], _blank(lines, 0)
    while n < len(lines):
        one = one_read(lines, n)
        if one is None:
            raise Broken(f"{path}: a record is cut off, or a split was read from a wrong line: read it with whole_files=True")
        found.append(one[0])
        n = _blank(lines, one[1])
    texts = [[x[k].decode("utf-8", "replace") for x in found] for k in (0, 1)]
    return pa.table({"path": pa.array([path] * len(found), pa.string()), "owner": pa.array([owner] * len(found), pa.int64()), "rec": pa.array(range(1, len(found) + 1), pa.int64()), "head": pa.array(texts[0], pa.string()), "seq": pa.array(texts[1], pa.string())})


def _fastq_records(lines: DataFrame) -> DataFrame:
    """Reads lie in splits, or between the last sure record of one and the first of a later one (their owner is the split in which they begin)."""
    parts = lines.mapInArrow(_fastq_parts, _PARTS)
    own = parts.groupBy("path", "start").agg(F.count_if(F.col("rec") > 0).alias("n"), F.max(F.col("rec") == -1).alias("sure"))
    last = F.last(F.when(F.col("sure"), F.col("start")), ignorenulls=True)
    splits = cut(own.withColumn("earlier", last.over(_earlier())))
    owner = F.when(F.col("rec") == -1, F.col("start")).otherwise(F.col("earlier"))
    left = parts.where("rec <= 0").join(splits.select("path", "start", "earlier"), ["path", "start"])
    between = cut(left.select("path", "start", "rec", "seq", owner.alias("owner")).groupBy("path", "owner").applyInArrow(_stitch, "path string, owner long, rec long, head string, seq string"))
    counts = between.groupBy("path", F.col("owner").alias("start")).agg(F.count("*").alias("m"))
    every = splits.join(counts, ["path", "start"], "left").select("path", "start", F.col("n"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("all"))
    before = _small(every.select("path", "start", "n", F.coalesce(F.sum("all").over(_earlier()), F.lit(0)).alias("before")))
    inner = parts.where("rec > 0").join(before, ["path", "start"]).select("path", (F.col("before") + F.col("rec") - 1).alias("contig"), "head", "seq")
    outer = between.withColumnRenamed("owner", "start").join(before, ["path", "start"]).select("path", (F.col("before") + F.col("n") + F.col("rec") - 1).alias("contig"), "head", "seq")
    return inner.unionByName(outer).select(F.col("path").alias("genome"), "contig", F.col("head").alias("name"), F.col("seq").alias("seq_raw"))


def records(content: bytes) -> Iterator[tuple[str, str]]:
    """(header, sequence as written without line ends) of a whole file's records."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    lines = content.splitlines()
    n = _blank(lines, 0)
    if n < len(lines) and lines[n].startswith(b"@"):
        while n < len(lines):
            one = one_read(lines, n)
            if one is None:
                raise Broken("the last record is cut off")
            yield one[0][0].decode("utf-8", "replace"), one[0][1].decode("utf-8", "replace")
            n = _blank(lines, one[1])
        return
    name, parts = None, []
    for line in content.decode("utf-8", "replace").splitlines():
        if line.startswith(">"):
            if name is not None:
                yield name, "".join(parts)
            name, parts = line[1:], []
        elif name is not None:
            parts.append(line.strip())
    if name is not None:
        yield name, "".join(parts)


def as_listed(genomes: Iterable[str], paths: list[str]) -> list[str]:
    """The genomes (paths as Spark gives them) in the order in which the paths first name them; those that none names follow by name."""

    def plain(path: str) -> str:
        found = urlparse(path)
        return unquote(found.path) if found.scheme else os.path.abspath(path)

    place: dict[str, int] = {}
    for path in paths:
        place.setdefault(plain(path), len(place))
    return sorted(genomes, key=lambda g: (place.get(plain(g), len(place)), g))


def read_sequences(spark: SparkSession, paths: str | list[str], whole_files: bool = False, split_bytes: int | None = None, piece: int = PIECE) -> DataFrame:
    """genome (the path), contig (from 0), name, seq (normalised), seq_raw: a row for each record of FASTA or FASTQ files, the same for any splits.

    Plain files are read in Spark's splits (spark.sql.files.maxPartitionBytes) and BGZF files in splits of split_bytes; a record that lies over several is stitched, and
    no file is held whole. Other gzipped files are one stream each. Sequences and qualities may be wrapped. A split of FASTQ lines begins at a
    line from which a record follows that is whole and is followed by another; what lies between must be whole records, or the query fails, and whole_files reads
    each file as one row instead. A file is FASTQ by its name (.fq, .fastq) or, where its name says neither, if it begins with @.
    """
    listed = [r["path"] for r in spark.read.format("binaryFile").load(paths).select("path").distinct().collect()]  # as Spark's own listing; no content is read
    shown = lambda found: found.select("genome", "contig", "name", normalized(F.col("seq_raw")).alias("seq"), "seq_raw")
    if whole_files or not listed:
        return shown(_whole(spark, paths))
    groups: dict[tuple[bool, bool], list[str]] = {}
    for path in listed:
        block = path.endswith((".gz", ".bgz")) and is_bgzf(path)
        first = None if _FASTQ.search(path) or _FASTA.search(path) else spark.read.text(path).where("trim(value) <> ''").head()
        groups.setdefault((bool(_FASTQ.search(path) or first and first[0].startswith("@")), block), []).append(path)
    found = None
    for (fastq, block), some in sorted(groups.items()):
        lines = bgzf_lines(spark, some, split_bytes or SPLIT_BYTES) if block else lines_of(spark, some)
        rows = _fastq_records(lines) if fastq else _fasta_records(lines, piece)
        found = rows if found is None else found.unionByName(rows)
    return shown(found)


def _whole(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of files of which each is one row."""
    files = spark.read.format("binaryFile").load(paths)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, at, name, seq) for path, content in zip(batch["path"], batch["content"]) for at, (name, seq) in enumerate(records(content))]
            yield pd.DataFrame(rows, columns=["genome", "contig", "name", "seq_raw"])

    return files.select("path", "content").mapInPandas(parse, "genome string, contig long, name string, seq_raw string")


def read_path_list(spark: SparkSession, path: str) -> list[str]:
    """A list of paths, one a line; blank lines and those that begin with # are left out. An error if nothing is left."""
    line = F.trim("value")
    found = [r[0] for r in spark.read.text(path).select(line.alias("p")).where((F.col("p") != "") & ~F.col("p").startswith("#")).collect()]
    if not found:
        raise ValueError(f"{path} lists no paths")
    return found


def read_ani_table(spark: SparkSession, path: str) -> DataFrame:
    """query, reference, ani from the first three of a table's white-space-parted columns; of a pair that repeats the last line holds."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))  # lines of a block keep their order
    cells = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select("value", place.alias("line")).where(F.trim("value") != "").select("line", cells[0].alias("query"), cells[1].alias("reference"), cells[2].cast("double").alias("ani"))
    last = Window.partitionBy("query", "reference").orderBy(F.desc("line"))
    return rows.withColumn("n", F.row_number().over(last)).where("n = 1").select("query", "reference", "ani")


def read_directed_identities(spark: SparkSession, path: str) -> DataFrame:
    """query, reference (file names without folders and .gz), ani from the first three of a table's white-space-parted columns; each line is a row."""
    cells = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(display_name(cells[0]).alias("query"), display_name(cells[1]).alias("reference"), cells[2].cast("double").alias("ani"))


def read_truth_table(spark: SparkSession, path: str, value_col: str) -> DataFrame:
    """genome1, genome2 (names as above), query_length, subject_length, ani (from value_col) of a tab-parted table with a header."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select(display_name(F.col("genome1")).alias("genome1"), display_name(F.col("genome2")).alias("genome2"), F.col("query_length").cast("long").alias("query_length"), F.col("subject_length").cast("long").alias("subject_length"), F.col(value_col).cast("double").alias("ani"))


BLAST_SCHEMA = "qseqid string, sseqid string, pident double, length long, mismatch long, gapopen long, qstart long, qend long, sstart long, send long, evalue double, bitscore double, qlen long, slen long, qcovhsp double"


def read_blast(spark: SparkSession, path: str) -> DataFrame:
    """Tabular search results, with the fragment's number and place out of its name."""
    rows = spark.read.csv(path, sep="\t", schema=BLAST_SCHEMA)
    return rows.select("*", *[F.regexp_extract("qseqid", rf"{tag}(\d+)", 1).cast("long").alias(name) for tag, name in (("frag_", "fragment"), ("qstart=", "fragment_start"), ("qend=", "fragment_end"))])
