"""SimHash fingerprints and near-duplicate classes by anchor-point covering.

A fingerprint has 64 bits in two halves. If two differ in at most 2t+1 bits (t = 1 here, so 3 or fewer), they differ in at
most t in one half. 31 bits of a half are covered by the Hamming code of length 31: each of its 2**26 code words is an
anchor, and every point is within the covering radius 1 of exactly one, its home. A fingerprint is replicated to every anchor within
radius + t = 2: its home alone, or its home and 15 more. A pair that is close in a half thus meets at the home of either. A bucket
holds different fingerprints only (copies are folded before), and a fingerprint has a bounded number of others within 3 bits.

Null and empty texts have no words: fingerprint zero, linked like any other. Rows that repeat come out as often as they go in.
A null id never names a class; a class of null ids only has a null name. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import SMALL_BYTES, compact, ids_and_texts, materialized, side, slices, unused
from strandloom.llm.components import components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
HASHES_AT_ONCE = 65_536


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in over half the XXH64 hashes of the word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    join = b" ".join
    return _majority(np.array([xxh64_intdigest(join(s), seed) for s in zip(*[words[i:] for i in range(shingle)])], np.uint64)) % 2**64


def _majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have set, as a signed number."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        bits = np.unpackbits(hashes[at : at + HASHES_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, bits: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bits = np.array([fingerprint(text, shingle, seed) for text in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], ["doc_id", "bits"])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, bits long")


def _anchors(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each half of each fingerprint: its row, its anchors (half in bit 31), and which of them are homes."""
    place = np.arange(1, 32, dtype=np.int64)
    rows, keys, homes = [], [], []
    for half in (0, 1):
        x = (bits.view(np.uint64) >> np.uint64(32 * half)).astype(np.int64) & 0x7FFFFFFF
        syndrome = np.bitwise_xor.reduce(np.where((x[:, None] >> (place - 1)) & 1, place, 0), axis=1)
        home = np.where(syndrome > 0, x ^ (1 << np.maximum(syndrome - 1, 0)), x)
        rows.append(np.arange(len(x)))
        keys.append(home | half << 31)
        homes.append(np.ones(len(x), bool))
        off = np.flatnonzero(syndrome)  # a point at distance 1: flips of two places whose numbers' xor is the syndrome
        other = place[None, :] ^ syndrome[off, None]
        r, c = np.nonzero(place[None, :] < other)
        rows.append(off[r])
        keys.append(x[off[r]] ^ (1 << (place[c] - 1)) ^ (1 << (other[r, c] - 1)) | half << 31)
        homes.append(np.zeros(len(r), bool))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def links(different: DataFrame, threshold: int = 2) -> DataFrame:
    """Pairs (a, b) of the different fingerprints in the column bits that differ in at most threshold (3 or fewer) bits."""
    if not 0 <= threshold <= 3:
        raise ValueError("the anchors cover thresholds of 0 to 3 bits")

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(0).to_numpy()
            for at in range(0, len(bits), 20_000):
                part = bits[at : at + 20_000]
                rows, keys, homes = _anchors(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows]), pa.array(homes)], ["anchor", "bits", "home"])

    covered = different.select("bits").mapInArrow(cover, "anchor long, bits long, home boolean")
    homes = covered.where("home").select("anchor", F.col("bits").alias("a"))
    all_there = covered.select("anchor", F.col("bits").alias("b"))
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold) & (F.col("a") != F.col("b"))
    pairs = homes.join(all_there.hint("merge"), (homes["anchor"] == all_there["anchor"]) & near)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, threshold: int = 2, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, bits, component_id: the least doc_id reachable by links of at most threshold differing bits, itself included."""
    prints = materialized(fingerprints(docs, shingle, seed, id_col, text_col))
    groups = materialized(prints.groupBy("bits").agg(F.min("doc_id").alias("first")))
    roots = components(links(groups, threshold))
    linked = groups.join(roots, groups["bits"] == roots["node"]).select("bits", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    classes = groups.join(linked.select("bits", "root").join(least, "root").select("bits", "least"), "bits", "left")
    classes = materialized(classes.select("bits", F.least("first", "least").alias("component_id")))
    return prints.join(classes, "bits").select("doc_id", "bits", "component_id")


def hexadecimal(bits: str) -> Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


# Near copies by similarity: the anchors propose what differs in few bits, a complete prefix filter on word shingles the rest, the exact sets decide.

#: One text in SAMPLED tells which shingles are common: those that COMMON_FROM of them or more hold, MOST_COMMON at most. These go last in the order of
#: shingles. Any order finds all pairs; one that puts common shingles last proposes few others.
SAMPLED, COMMON_FROM, MOST_COMMON = 8, 3, 500_000
#: Bits in which fingerprints of five-word shingles differ at most where the anchors propose a pair.
ANCHOR_BITS = 3
#: Rounds in which a bucket is compared with a leader, before those that are not yet linked there are compared with each other.
LEADER_ROUNDS = 2
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _shingle_set(text: str, shingle: int) -> np.ndarray:
    """The different shingles' hashes in order; a text of fewer words is one shingle, a text without words has none."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.array([*map(xxh64_intdigest, words)], np.uint64)
    size = min(shingle, len(words))
    places = len(words) - size + 1
    total = np.full(places, size, np.uint64)
    for k in range(size):
        total = (total ^ (total >> np.uint64(29))) * _MIX[k % len(_MIX)] + hashes[k : k + places]
    total = (total ^ (total >> np.uint64(32))) * _MIX[0]
    return np.unique(total ^ (total >> np.uint64(29)))


def _set_hash(hashes: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


#: Words of 64 bits in a set's parity. A bit tells if an odd number of shingles falls to it, so sets differ in as many shingles at least as parities in bits.
PARITY = [f"p{i}" for i in range(8)]


def _parity(hashes: np.ndarray) -> np.ndarray:
    odd = np.bincount((hashes >> np.uint64(55)).astype(np.int64), minlength=64 * len(PARITY)) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _prefix(hashes: np.ndarray, common: np.ndarray, ranks: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles, rare ones first. Of two sets of this similarity, both prefixes hold the first shingle that the sets share."""
    if not len(hashes):
        return hashes
    rank = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, ranks[at], 0)
    return hashes[np.lexsort((hashes, rank))][: len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-6)) + 1]


def _shared(size: Column, other: Column, similarity: float) -> Column:
    """The least number of shingles that sets of these sizes share if they are similar."""
    return F.ceil(similarity / (1 + similarity) * (size + other) - 1e-6)


def _parities_allow(one: str, other: str, similarity: float) -> Column:
    """False for nodes that can't be similar by their sizes and parities, in columns that begin with one and other."""
    size, lead = F.col(f"{one}size"), F.col(f"{other}size")
    share = _shared(size, lead, similarity)
    differ = sum(F.bit_count(F.col(f"{one}{p}").bitwiseXOR(F.col(f"{other}{p}"))) for p in PARITY)
    return (F.least(size, lead) >= share) & (differ <= size + lead - 2 * share)


def _nodes(texts: DataFrame, shingle: int) -> DataFrame:
    """doc_id, node (the hash of the text's set of shingles), the set's size, its fingerprint's bits and its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes = [_shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            parity = np.array([*map(_parity, hashes)], np.int64).reshape(-1, len(PARITY))
            columns = [batch.column(0), pa.array([*map(_set_hash, hashes)], pa.int64()), pa.array([*map(len, hashes)], pa.int32()), pa.array([_majority(h) for h in hashes], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x.copy()) for x in parity.T]], ["doc_id", "node", "size", "bits", *PARITY])

    return texts.mapInArrow(run, "doc_id long, node long, size int, bits long, " + ", ".join(f"{p} long" for p in PARITY))


def _common_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The common shingles among a sample of different texts, in ascending order, and how common each is."""

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [_shingle_set(t, shingle).view(np.int64) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], ["shingle"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("text").distinct()
    counts = some.mapInArrow(sampled, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_FROM)
    known = counts.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).toArrow()
    common, ranks = known["shingle"].to_numpy().astype(np.int64).view(np.uint64), known["n"].to_numpy().astype(np.int64)
    order = np.argsort(common)
    return common[order], ranks[order]


def _members(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """bucket (a shingle), node, place, size: each text in the bucket of each shingle of its prefix; only buckets of several nodes, each node once."""
    shared = texts.sparkSession.sparkContext.broadcast(_common_shingles(texts, shingle))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            out = []
            for text in batch.column(0).to_pylist():
                hashes = _shingle_set(text, shingle)
                first = _prefix(hashes, *shared.value, similarity).view(np.int64)
                out.append((first, np.full(len(first), _set_hash(hashes)), np.arange(len(first)), np.full(len(first), len(hashes))))
            bucket, node, place, size = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(node), pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32))], ["bucket", "node", "place", "size"])

    members = texts.select("text").mapInArrow(prefixes, "bucket long, node long, place int, size int")
    several = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    return members.join(several, "bucket", "left_semi").dropDuplicates(["bucket", "node"])


def _unlinked(rows: DataFrame) -> DataFrame:
    """The rows of buckets whose members do not all have the same root yet."""
    apart = rows.groupBy("bucket").agg(F.min("root").alias("l"), F.max("root").alias("m")).where("l < m").select("bucket")
    return rows.join(apart, "bucket", "left_semi")


def _labels(links: DataFrame) -> DataFrame:
    """node, root, links (how many) of the nodes of links (a, b). Nodes with one root are linked by a chain; some that are linked may have different roots.

    Each node points to the least of its neighbours by hash if that is less than itself, and is led along up to four of these pointers.
    """
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    near = ends.groupBy("node").agg(F.count("*").alias("links"), F.min(F.struct(F.xxhash64("other").alias("h"), "other")).alias("n"))
    labels = compact(materialized(near.select("node", "links", F.when(F.col("n.h") < F.xxhash64("node"), F.col("n.other")).otherwise(F.col("node")).alias("root"))), 24)
    for _ in range(2):
        further = side(labels, 24).select(F.col("node").alias("root"), F.col("root").alias("further"))
        labels = compact(materialized(labels.join(further, "root").select("node", "links", F.col("further").alias("root"))), 24)
    return side(labels, 24)


def similar_pairs(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """copies (doc_id, node): the hash of the text's set of shingles; and pairs (a, b) of nodes whose shingles' Jaccard similarity is at least similarity.

    The pairs link all nodes that similar pairs link, directly or by a chain. Nodes whose SimHash fingerprints of the same shingles meet at an anchor within
    ANCHOR_BITS are compared first. For the others, texts meet in a bucket for each shingle of their prefixes. Each bucket that is not linked yet is
    compared with a leader, in a further round with the member that has most links by then; those that no chain of verified pairs links are
    compared with each other. A large group of near copies so gives about as many pairs as it has members.
    """
    if not 0 < similarity <= 1:
        raise ValueError("the similarity is above 0 and at most 1")
    texts = ids_and_texts(docs, id_col, text_col).where("doc_id is not null")
    copies = compact(materialized(_nodes(texts, shingle)), 100)
    nodes = compact(materialized(copies.groupBy("node", "size", "bits", *PARITY).agg(F.min("doc_id").alias("holder"))), 100)
    nodes_side = side(nodes, 100)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes = [_shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([*map(_set_hash, hashes)], pa.int64()), pa.array([h.tobytes() for h in hashes], pa.binary())], ["node", "hashes"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, one, other = batch.columns
            keep = []
            for x, y in zip(one.to_pylist(), other.to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verified(candidates: DataFrame) -> DataFrame:
        """Of the candidates (a, b) those that are similar."""
        one, other = (nodes_side.select(*[F.col(c).alias(side if c == "node" else f"{side}_{c}") for c in ["node", "size", *PARITY]]) for side in ("a", "b"))
        ordered = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        likely = compact(materialized(ordered.join(one, "a").join(other, "b").where(_parities_allow("a_", "b_", similarity)).select("a", "b")), 16)
        wanted = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
        holders = compact(materialized(nodes.join(wanted, "node", "left_semi").select(F.col("holder").alias("doc_id")).distinct()), 8)
        # A row of such an id may hold another text; what no candidate names falls out of the joins.
        hashed = materialized(texts.join(side(holders, 8), "doc_id", "left_semi").mapInArrow(sets, "node long, hashes binary").dropDuplicates(["node"]))
        if hashed.agg(F.coalesce(F.sum(F.length("hashes") + 16), F.lit(0))).first()[0] <= SMALL_BYTES:
            hashed = F.broadcast(hashed)
        a, b = hashed.select(F.col("node").alias("a"), F.col("hashes").alias("one")), hashed.select(F.col("node").alias("b"), F.col("hashes").alias("other"))
        return compact(materialized(likely.join(a, "a").join(b, "b").select("a", "b", "one", "other").mapInArrow(verify, "a long, b long")), 16)

    groups = compact(materialized(nodes.groupBy("bits").agg(F.min("node").alias("first"))), 16)
    same = nodes.join(side(groups, 16), "bits").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = links(groups, ANCHOR_BITS).join(groups.select(F.col("bits").alias("a"), F.col("first").alias("x")), "a").join(groups.select(F.col("bits").alias("b"), F.col("first").alias("y")), "b")
    found = [verified(same.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b"))))]

    left = _members(texts, shingle, similarity).join(_labels(found[0]), "node", "left").select("bucket", "node", "place", "size", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    left = compact(materialized(_unlinked(left)), 48)
    row, lead = ["root", "node", "place", "size"], [F.col(c).alias(f"lead_{c}") for c in ("root", "node", "place", "size")]
    share = _shared(F.col("size"), F.col("lead_size"), similarity)  # so many shingles at least are shared, this one and later ones
    fits = (F.col("root") != F.col("lead_root")) & (F.col("size") - F.col("place") >= share) & (F.col("lead_size") - F.col("lead_place") >= share)
    for _ in range(LEADER_ROUNDS):
        first = left.groupBy("bucket").agg(F.min(F.struct((-F.col("links")).alias("d"), F.xxhash64("node").alias("h"), *row)).alias("f")).select("bucket", "f.*")
        led = left.join(first.select("bucket", *lead), "bucket")
        found.append(verified(led.where(fits).select(F.col("node").alias("a"), F.col("lead_node").alias("b"))))
        rest = led.where("node <> lead_node").select("bucket", "node", "place", "size").join(_labels(reduce(DataFrame.unionByName, found)), "node", "left")
        left = compact(materialized(_unlinked(rest.select("bucket", "node", "place", "size", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))), 48)

    # Members whose sizes allow it meet: those of one size class, and those of a class with the next.
    known = left.join(nodes_side.select("node", *PARITY), "node").withColumn("class", F.floor(F.log(F.col("size")) / math.log(1 / similarity) + 1e-9) if similarity < 1 else F.col("size").cast("long"))
    others = known.select(F.col("bucket").alias("there"), F.explode(F.array(F.col("class"), F.col("class") - 1)).alias("met"), F.col("class").alias("own"), *lead, *[F.col(p).alias(f"lead_{p}") for p in PARITY])
    once = (F.col("met") < F.col("own")) | (F.col("node") < F.col("lead_node"))
    meet = (F.col("bucket") == F.col("there")) & (F.col("class") == F.col("met")) & once & fits & _parities_allow("", "lead_", similarity)
    found.append(verified(known.join(others.hint("merge"), meet).select(F.col("node").alias("a"), F.col("lead_node").alias("b"))))
    return copies.select("doc_id", "node"), reduce(DataFrame.unionByName, found)


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those that a row with a lesser id in their class of equal or similar texts makes redundant, with all columns.

    Of rows that share an id too, all stay or all go. Rows with a null id stay.
    """
    copies, pairs = similar_pairs(docs, shingle, similarity, id_col, text_col)
    classes = materialized(copies.join(components(pairs), "node", "left").select("doc_id", F.coalesce("root", "node").alias("root")))
    least, name = classes.groupBy("root").agg(F.min("doc_id").alias("least")), unused(docs, "__gone")
    gone = classes.join(least, "root").where("doc_id > least").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
