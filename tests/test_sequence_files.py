"""Sequence files give the same records for any splits, wrapped or not, plain, gzipped or in BGZF blocks."""

import gzip
import random
import zlib

import pytest

from strandloom.sources import fastx

R = random.Random(11)


def bases(n):
    return "".join(R.choices("ACGTNacgt", k=n))


def wrapped(text, width):
    return [text[i : i + width] for i in range(0, len(text), width)] or [""]


def fasta(records, width):
    return "".join(f">{name}\n" + "".join(line + "\n" for line in wrapped(seq, width)) for name, seq in records)


def fastq(records, width):
    """Qualities hold @ and + at the starts of lines."""
    text = ""
    for name, seq in records:
        quality = "".join(R.choices("@+IF#ACGT", k=len(seq)))
        text += f"@{name}\n" + "\n".join(wrapped(seq, width)) + "\n+\n" + "\n".join(wrapped(quality, width)) + "\n"
    return text


def bgzf(content, block=200):
    """Blocks with a size field each, and the empty block that ends a file."""
    out = b""
    for part in [*(content[i : i + block] for i in range(0, len(content), block)), b""]:
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = packer.compress(part) + packer.flush()
        size = 18 + len(data) + 8
        out += b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff\x06\x00BC\x02\x00" + (size - 1).to_bytes(2, "little") + data + zlib.crc32(part).to_bytes(4, "little") + len(part).to_bytes(4, "little")
    return out


CONTIGS = [("first one", bases(5_000)), ("empty", ""), ("b|2 x", bases(61)), (">odd", bases(60)), ("long", bases(20_000)), ("", bases(10)), ("last", bases(1_234))]
READS = [(f"r{i}/1 @x", bases(R.choice([1, 30, 59, 60, 61, 150, 400]))) for i in range(120)]


def read(spark, path, split, **more):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = fastx.read_sequences(spark, path, split_bytes=split, **more).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    return sorted((r.genome.rsplit("/", 1)[-1], r.contig, r.name, r.seq_raw) for r in found), found


@pytest.mark.parametrize("split", [1_009, 7_000, 10**8])
@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_fasta(spark, tmp_path, split, ends):
    texts = {"a.fa": fasta(CONTIGS, 60), "b.fna": "; remark\n\n" + fasta(CONTIGS[::-1], 10**6), "c.fasta": fasta(CONTIGS[:1], 7)[:-1], "d.fa": "", "e.fa": "no header\nACGT\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.replace("\n", ends).encode())
    (tmp_path / "f.fa.gz").write_bytes(gzip.compress(texts["a.fa"].replace("\n", ends).encode()))
    (tmp_path / "g.fa.gz").write_bytes(bgzf(texts["a.fa"].replace("\n", ends).encode()))
    want = [(file, i, n, s) for file, rows in (("a.fa", CONTIGS), ("b.fna", CONTIGS[::-1]), ("c.fasta", CONTIGS[:1]), ("f.fa.gz", CONTIGS), ("g.fa.gz", CONTIGS)) for i, (n, s) in enumerate(rows)]
    got, rows = read(spark, str(tmp_path), split, piece=999)
    assert got == sorted(want)
    assert all(r.seq == r.seq_raw.upper() for r in rows)


@pytest.mark.parametrize("split", [313, 4_001, 10**8])
@pytest.mark.parametrize("width", [60, 10**6])
def test_fastq(spark, tmp_path, split, width):
    text = fastq(READS, width)
    (tmp_path / "a.fq").write_text(text)
    (tmp_path / "b.fastq").write_text("\n" + fastq(READS[:3], width) + "\n\n")
    (tmp_path / "c.fq.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "d.fq.gz").write_bytes(bgzf(text.encode(), 97))
    (tmp_path / "e.reads").write_text(text)
    want = [(file, i, n, s) for file, rows in (("a.fq", READS), ("b.fastq", READS[:3]), ("c.fq.gz", READS), ("d.fq.gz", READS), ("e.reads", READS)) for i, (n, s) in enumerate(rows)]
    assert read(spark, str(tmp_path), split)[0] == sorted(want)
    assert read(spark, str(tmp_path), split, whole_files=True)[0] == sorted(want)


def test_reads_that_are_cut_off(spark, tmp_path):
    (tmp_path / "a.fq").write_text(fastq(READS[:5], 60).rstrip("\n")[:-3])
    with pytest.raises(Exception, match="cut off"):
        read(spark, str(tmp_path / "a.fq"), 10**8)


def test_a_sync_is_never_inside_a_record():
    """A quality line that looks like a header is passed over."""
    lines = [b"@q", b"ACGT", b"+", b"@@@@", b"@r", b"AC", b"+", b"@I", b"@s", b"A", b"+", b"I"]
    for at in range(1, len(lines)):
        found = fastx._synced(lines[at:], True)
        assert found is None or at + found in (4, 8)


def test_a_sequence_over_many_splits_stays_in_pieces(spark, tmp_path):
    (tmp_path / "a.fa").write_text(fasta([("x", "ACGTTGCAAT" * 50_000)], 80))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = fastx.lines_of(spark, [str(tmp_path / "a.fa")])
        assert lines.rdd.getNumPartitions() > 20
        pieces = fastx.fasta_pieces(lines, piece=3_000).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert max(len(p.seq_raw) for p in pieces) <= 3_000 and {p.contig for p in pieces} == {0}
    assert "".join(p.seq_raw for p in sorted(pieces, key=lambda p: (p.start, p.piece))) == "ACGTTGCAAT" * 50_000
