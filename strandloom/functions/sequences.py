"""Column functions on sequences, names and pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC codes and their complements, both cases.
IUPAC, IUPAC_COMPLEMENT = "ACGTacgtRYMKBVDHrymkbvdh", "TGCAtgcaYRKMVBHDyrkmvbhd"
LETTERS, LETTER_BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def iupac_reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, IUPAC, IUPAC_COMPLEMENT))


def bases_of_text(text: Column) -> Column:
    """A text's ASCII letters as bases, so that text tables can stand for sequences."""
    return F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]", ""), LETTERS, LETTER_BASES)


def normalized(seq: Column) -> Column:
    """Upper case without white space, anything but ACGT as N."""
    return F.regexp_replace(F.regexp_replace(F.upper(seq), r"\s", ""), "[^ACGT]", "N")


def display_name(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.gz$", "")


def pair_key(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def floor_div(x: Column, width: int) -> Column:
    """Towards minus infinity, as bins of diagonals need."""
    return F.floor(x / float(width)).cast("long")


def md5_60(text: Column) -> Column:
    """A hash below 2**60 that other engines have too."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
