"""Merkle fixity audit of WARC replicas, in DataFrame functions only.

A replica's records lie in archives of archive_records slots, ordered by id: slot = id mod archive_records, archive = the rest. A record is hashed
whole (SHA-256). Leaves are slots; an inner node stands for FAN_OUT children in order and for the range of offsets that they
fill, and its hash is that of the children's numbers, lengths in bytes and hashes, so it covers the ordered ranges too. Two replicas are compared at the root, then only below nodes that differ, level by
level, each a join on the node's number, so nothing below an equal node is looked at.

Rows that share an id share a slot, whose hash covers how many they are and the sums of their hashes' quarters, in whatever order they come, so that no row is
gathered. Rows with a null id get slots by their hash in archives of their own, below NULL_ARCHIVES, as many as keep them apart. A null url or body is empty. Empty tables have no nodes: against another replica all its records are missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import materialized

FAN_OUT = 16
#: The archive below which rows with a null id have theirs, and how many these are.
NULL_ARCHIVES, NULL_SPREAD = -(1 << 40), 1 << 20


def warc_record(url: Column, body: Column) -> Column:
    """A response record as text."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def manifest(records: DataFrame, archive_records: int = 1000, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """A row for each slot: id, archive, slot, leaf, size, start (offset in the archive), hash."""
    record = warc_record(F.col(url_col), F.col(body_col))
    hashed = records.select(F.col(id_col).cast("long").alias("id"), F.sha2(record, 256).alias("hash"), F.octet_length(record).cast("long").alias("size"))
    archive = F.when(F.col("id").isNull(), NULL_ARCHIVES - F.pmod(F.xxhash64(F.lit("archive"), "hash"), F.lit(NULL_SPREAD))).otherwise(F.floor(F.col("id") / archive_records)).cast("long")
    slot = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("hash"), F.lit(archive_records))).otherwise(F.pmod(F.col("id"), F.lit(archive_records))).cast("long")
    quarters = [F.sum(F.conv(F.substring("hash", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")).alias(f"q{i}") for i in range(4)]
    slots = hashed.select("*", archive.alias("archive"), slot.alias("slot")).groupBy("archive", "slot").agg(
        F.min("id").alias("id"), F.sum("size").alias("size"), F.count("*").alias("n"), F.min("hash").alias("hash"), *quarters)
    start = F.coalesce(F.sum("size").over(Window.partitionBy("archive").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    width = FAN_OUT
    while width < archive_records:
        width *= FAN_OUT
    return slots.select("id", "archive", "slot", ((F.col("archive") + 1) * width + F.col("slot")).alias("leaf"), "size", start.alias("start"), F.when(F.col("n") == 1, F.col("hash")).otherwise(F.sha2(F.concat_ws(",", *[F.col(c).cast("string") for c in ("n", "q0", "q1", "q2", "q3")]), 256)).alias("hash"))


def tree(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """The levels from the leaves up: node, hash, size (its range's bytes), first and last archive and offset of its range."""
    end = F.struct("archive", (F.col("start") + F.col("size")).alias("offset"))
    out = [leaves.select(F.col("leaf").alias("node"), "hash", "size", F.struct("archive", F.col("start").alias("offset")).alias("first"), end.alias("last"))]
    for _ in range(levels):
        above = out[-1].groupBy(F.floor(F.col("node") / FAN_OUT).cast("long").alias("parent")).agg(
            F.array_sort(F.collect_list(F.struct("node", "size", "hash"))).alias("below"), F.sum("size").alias("size"), F.min("first").alias("first"), F.max("last").alias("last"))
        text = F.array_join(F.transform("below", lambda c: F.concat_ws(":", c["node"].cast("string"), c["size"].cast("string"), c["hash"])), ",")
        out.append(materialized(above.select(F.col("parent").alias("node"), F.sha2(text, 256).alias("hash"), "size", "first", "last")))
    return out


def audit(one: DataFrame, other: DataFrame) -> DataFrame:
    """Slots of two manifests that differ: id, archive, slot, status (changed, missing or extra in other), offsets, sizes and hashes of both."""
    one, other = materialized(one), materialized(other)
    last = max(m.agg(F.coalesce(F.max("leaf"), F.lit(0))).first()[0] for m in (one, other))
    levels = 0
    while FAN_OUT**levels <= last:
        levels += 1
    trees = [tree(m, levels) for m in (one, other)]
    suspects = None
    for a, b in zip(*[reversed(t) for t in trees]):
        a, b = (t.select("node", F.col("hash").alias(f"{side}_hash")) for t, side in ((a, "a"), (b, "b")))
        if suspects is not None:
            near = suspects.select(F.explode(F.sequence(F.col("node") * FAN_OUT, F.col("node") * FAN_OUT + (FAN_OUT - 1))).alias("node"))
            a, b = a.join(near, "node", "left_semi"), b.join(near, "node", "left_semi")
        suspects = materialized(a.join(b, "node", "full").where(~F.col("a_hash").eqNullSafe(F.col("b_hash"))).select("node"))
    sides = [m.join(suspects, m["leaf"] == suspects["node"], "left_semi").select("leaf", F.struct(*m.columns).alias(side)) for m, side in ((one, "a"), (other, "b"))]
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    either = lambda name: F.coalesce(f"a.{name}", f"b.{name}").alias(name)
    return sides[0].join(sides[1], "leaf", "full").select(
        either("id"), either("archive"), either("slot"), status.alias("status"), F.col("a.start").alias("start"), F.col("a.size").alias("size"), F.col("b.start").alias("other_start"),
        F.col("b.size").alias("other_size"), F.col("a.hash").alias("sha256"), F.col("b.hash").alias("other_sha256"))
