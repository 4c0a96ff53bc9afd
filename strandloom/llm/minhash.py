"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Word shingles are hashed once (XXH64). The top 8 bits of a hash name one of 256 bins, and a bin keeps its least hash. Empty bins
are filled by optimal densification: bin i looks at bins drawn by a hash of (i, attempt) until one is filled; after ATTEMPTS draws it takes the
filled bin j that is least by a hash of (i, j), which is a draw among the filled ones too. The fingerprint holds the low 4 bits of
each bin's hash, 16 bins to a long. Of unrelated bins one in 16 agrees by chance, which the likeness corrects for.

Texts without words (null, empty, white space) have the fingerprint of zeros: likeness 1 among each other. Texts with fewer words
than a shingle have one shingle of them all. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import ids_and_texts, shuffle_partitions

BINS, BITS, ATTEMPTS = 256, 4, 16
_LOW56 = (1 << 56) - 1
_SPACE = " \t\n\x0b\f\r"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.transform(F.array(value), body).getItem(0)


def _bin(h: Column) -> Column:
    return F.shiftright(h, 56)


def _empty(h: Column) -> Column:
    return h.bitwiseAND(F.lit(_LOW56)) == F.lit(_LOW56)


def shingle_hashes(text: Column, shingle: int) -> Column:
    """The hashes of a text's word shingles, repeats included; none without words."""
    words = F.split(F.btrim(F.lower(text), F.lit(_SPACE)), "[ \\t\\n\\x0B\\f\\r]+")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    shingles = _let(hashed, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (shingle - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, shingle))))
    return F.when(F.length(F.btrim(text, F.lit(_SPACE))) > 0, shingles).otherwise(F.array().cast("array<bigint>"))


def fingerprint(text: Column, shingle: int = 5) -> Column:
    """The fingerprint of a text as an array of 16 longs."""
    # A bin's largest hash stands in each bin, so that the first of each bin in the sorted hashes is its least, or says that it is empty.
    stand_ins = F.transform(F.sequence(F.lit(-128), F.lit(127)), lambda b: F.shiftleft(b.cast("bigint"), 56).bitwiseOR(F.lit(_LOW56)))
    least = _let(F.sort_array(F.concat(shingle_hashes(text, shingle), stand_ins)), lambda s: F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(s, F.greatest(i - 1, F.lit(0)))))))

    def filled(bins: Column, some: Column) -> Column:
        def draw(i: Column) -> Column:
            def attempt(found: Column, t: Column) -> Column:
                return F.when(found.isNotNull(), found).otherwise(_let(F.get(bins, F.pmod(F.xxhash64(i, t), F.lit(BINS)).cast("int")), lambda h: F.when(~_empty(h), h)))

            drawn = F.aggregate(F.sequence(F.lit(1), F.lit(ATTEMPTS)), F.lit(None).cast("bigint"), attempt)
            return F.coalesce(drawn, F.array_min(F.transform(some, lambda h: F.struct(F.xxhash64(i, _bin(h)).alias("rank"), h.alias("h")))).getField("h"))

        return F.transform(bins, lambda h, i: F.when(_empty(h), draw(i)).otherwise(h))

    def packed(bins: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.aggregate(F.slice(bins, k * 16 + 1, 16), F.lit(0).cast("bigint"), lambda a, h: F.shiftleft(a, BITS).bitwiseOR(h.bitwiseAND(F.lit(15)))))

    return _let(least, lambda bins: _let(F.filter(bins, lambda h: ~_empty(h)), lambda some: F.when(F.size(some) == 0, F.array_repeat(F.lit(0).cast("bigint"), 16)).otherwise(_let(filled(bins, some), packed))))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of the shingles behind two fingerprints."""

    def apart(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        some = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseOR(F.shiftrightunsigned(d, 3))
        return F.bit_count(some.bitwiseAND(F.lit(0x1111111111111111)))

    agree = (F.lit(BINS) - F.aggregate(F.zip_with(a, b, apart), F.lit(0), lambda s, n: s + n)) / F.lit(float(BINS))
    chance = 1.0 / (1 << BITS)
    return F.greatest(F.lit(0.0), (agree - chance) / (1.0 - chance))


def as_text(prints: Column) -> Column:
    """A fingerprint as 256 lowercase hexadecimal digits."""
    return F.array_join(F.transform(prints, lambda p: F.lower(F.lpad(F.hex(p), 16, "0"))), "")


def _bucket(bounds: list[int], key: Column) -> Column:
    """How many of the ascending bounds are not above key, found in two steps."""
    step = max(1, int(len(bounds) ** 0.5))
    array = F.lit(bounds) if bounds else F.array().cast("array<bigint>")
    coarse = F.lit(bounds[::step]) if bounds else array
    return _let(F.size(F.filter(coarse, lambda x: x <= key)), lambda i: F.when(i == 0, 0).otherwise((i - 1) * step + F.size(F.filter(F.slice(array, (i - 1) * step + 1, step), lambda x: x <= key))))


def _range(cuts: list[int], null_parts: int, key: Column, order: Column) -> Column:
    """Numbers that rise with (key, order), nulls first. A key that several of the ascending cuts name is parted by order into as many ranges."""
    bounds = sorted(set(cuts))
    parts = [cuts.count(b) for b in bounds]
    bases = [0]
    for n in parts:
        bases.append(bases[-1] + n + (n > 1))
    part = lambda n: F.least(F.floor((order / F.lit(2.0**64) + 0.5) * n), n - 1)

    def placed(at: Column) -> Column:
        bound, n, base = (F.get(F.lit(x), F.greatest(at - 1, F.lit(0))) for x in (bounds, parts, bases))
        return F.when(at == 0, F.lit(-1).cast("bigint")).otherwise(base + F.when(n == 1, F.lit(0)).when(key > bound, n).otherwise(part(n)))

    known = _let(_bucket(bounds, key), placed) if bounds else F.lit(0).cast("bigint")
    return F.when(key.isNull(), part(F.lit(null_parts)) - (null_parts + 1)).otherwise(known)


def with_next(rows: DataFrame, values: list[str], key: str = "doc_id", tie: str = "text", derive: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """rows with what derive adds, row by row, and, as next_<value>, the values of the row that follows by descending key; after the last comes the first.

    Rows are dealt into ranges of the key at approximate quantiles, several for each shuffle partition, and each range gets the first row of the
    range that follows, so that a window over each range is enough. Null keys come last. Equal keys follow by descending hash of tie, and
    many rows with one key, or without any, are dealt into several ranges by that hash.
    """
    spark = rows.sparkSession
    ranges = 8 * shuffle_partitions(spark)
    cuts, total, known = rows.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)]), F.count("*"), F.count(key)).first()
    hashed = rows.withColumn("__order", F.xxhash64(tie))
    null_parts = max(1, ranges * (total - known) // max(1, total))
    dealt = hashed.withColumn("__range", _range(cuts or [], null_parts, F.col(key), F.col("__order")))
    first = F.max(F.struct(F.col(key).alias("key"), "__order")).alias("first")
    firsts = sorted(dealt.groupBy("__range").agg(first).collect(), reverse=True, key=lambda r: r["__range"])  # one row for each range
    goes_to = [(*own["first"], before["__range"]) for before, own in zip(firsts, firsts[1:] + firsts[:1])]
    to = spark.createDataFrame(goes_to, "__key long, __hash long, __to long")
    copies = hashed.join(F.broadcast(to), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__order") == F.col("__hash"))).select(*hashed.columns, F.col("__to").alias("__range"), F.lit(True).alias("__copy"))
    order = Window.partitionBy("__range").orderBy("__copy", F.desc_nulls_last(key), F.desc("__order"), F.desc(tie))
    both = derive(dealt.withColumn("__copy", F.lit(False)).unionByName(copies.dropDuplicates(["__range"])))
    return both.select("*", *[F.lead(v).over(order).alias(f"next_{v}") for v in values]).where("not __copy").drop("__range", "__copy", "__order")


def compare_with_edited(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: its fingerprint, that of its edited text, and the likeness to that and to the next document's.

    The edited text ends with the next document's beginning (by descending id) instead of its own last third.
    """
    texts = ids_and_texts(docs, id_col, text_col)
    pairs = with_next(texts, ["text", "prints"], derive=lambda df: df.withColumn("prints", fingerprint(F.col("text"), shingle)))
    n, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - third), F.substr("next_text", F.lit(1), third))
    pairs = pairs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "prints", "next_prints")
    pairs = pairs.withColumn("edited_prints", fingerprint(F.col("edited"), shingle))
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("prints")).alias("fingerprint"), as_text(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"), likeness(F.col("prints"), F.col("next_prints")).alias("near_next"),
    )
