"""Collocations: phrases of two to four words whose words stand together more often than their parts do.

Counting is exact in two steps. Every chunk sends a sorted stream of short codes of its phrases, with counts, to one of many shards,
which lie by ranges of codes. A shard merges its streams and sends back a bit for each code, whether it is frequent anywhere. Chunks then
count the phrases with frequent codes by their words (codes that fall together cost only work), and Spark sums these counts.

The counts are kept as two streams, ordered by the words from the first on (prefix order) and from the last on (suffix order). In each a
phrase stands right after the phrase it extends, so one pass over a stream, holding the open phrases in a stack of four, meets the count of
every part and the largest extension of every phrase: a merge of the streams of all orders in lockstep, without hash tables. Streams
are cut into ranges anywhere, also within one first word; what is open at a cut is handed on, at most three phrases for each range.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.chunks import CHUNK_CHARS, chunked, numbers, words_of
from strandloom.llm.common import materialized

#: Where pieces end.
BREAKS = b".,;:!?\n\x0b\x0c\r"
LONGEST = 4
#: Words whose codes a shard gets, about, before chunks count their own repeats; and rows of a range of a stream.
SHARD_WORDS, RANGE_ROWS = 2_000_000, 250_000
#: Odd numbers that mix codes.
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _codes(ids: np.ndarray, words: pa.Array, part: str, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1 to LONGEST words: where phrases start, and their codes of 32 + bits bits. The upper bits tell the shard."""
    seed = xxhash.xxh64_intdigest(part.encode())
    hashes = np.array([0, *(xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist())], np.uint64)
    own, whole = hashes[ids], ids != 0
    code, ok, found = np.zeros(len(ids), np.uint64), np.ones(len(ids), bool), []
    for n in range(1, LONGEST + 1):
        end = len(ids) - n + 1
        if end <= 0:
            break
        code, ok = code[:end] * STEP + own[n - 1 :], ok[:end] & whole[n - 1 :]
        at = np.flatnonzero(ok)
        mixed = code[at]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX
        found.append((at, mixed >> np.uint64(32 - bits)))
    return found


def _streams(bits: int, cap: int):
    """For each chunk a row for each shard: its different codes, sorted, without the shard's bits, and their counts up to cap."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                every = [c for _, c in _codes(numbers(row["ids"]), words_of(row["words"]), row["part"], bits)]
                codes, counts = np.unique(np.concatenate(every), return_counts=True) if every else (np.zeros(0, np.uint64), np.zeros(0, int))
                at = np.searchsorted(codes, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
                low, capped = codes.astype(np.uint32), np.minimum(counts, cap).astype(np.uint8)
                shards = np.flatnonzero(at[1:] > at[:-1])
                columns = [pa.array([row["chunk"]] * len(shards), pa.int64()), pa.array(shards, pa.int32()), *(pa.array([x[at[s] : at[s + 1]].tobytes() for s in shards], pa.binary()) for x in (low, capped))]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "shard", "codes", "counts"])

    return stream


def _frequent(least: int):
    """A shard's streams merged: for each chunk a bit for each of its codes, in their order, whether all chunks together have it least times."""

    def merge(shard: pa.Table) -> pa.Table:
        codes = [np.frombuffer(x, np.uint32) for x in shard["codes"].to_pylist()]
        counts = [np.frombuffer(x, np.uint8) for x in shard["counts"].to_pylist()]
        both = np.sort((np.concatenate(codes).astype(np.uint64) << np.uint64(8)) | np.concatenate(counts))
        starts = np.flatnonzero(np.append(True, both[1:] >> np.uint64(8) != both[:-1] >> np.uint64(8)))
        sums = np.add.reduceat(both & np.uint64(255), starts)
        often = (both[starts[sums >= least]] >> np.uint64(8)).astype(np.uint32)
        bits = [np.packbits(_within(c, often)).tobytes() for c in codes]
        return pa.table({"chunk": shard["chunk"], "shard": shard["shard"], "bits": pa.array(bits, pa.binary()), "codes": pa.array([len(c) for c in codes], pa.int32())})

    return merge


def _within(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def _counted(bits: int):
    """A chunk's phrases that may be frequent, with their exact counts in it; the empty phrase counts all its words."""

    def count(chunk: pa.Table, marks: pa.Table) -> pa.Table:
        rows = []
        flags = {s: np.unpackbits(np.frombuffer(b, np.uint8))[:n].astype(bool) for s, b, n in zip(*(marks[c].to_pylist() for c in ("shard", "bits", "codes")))}
        for row in chunk.to_pylist():
            ids, words = numbers(row["ids"]), words_of(row["words"])
            found = _codes(ids, words, row["part"], bits)
            rows.append((row["part"], pa.array([""], pa.string()), pa.array([int(np.count_nonzero(ids))], pa.int64())))
            if not flags or not found:
                continue
            every = np.unique(np.concatenate([c for _, c in found]))
            often = every[np.concatenate([flags[s] for s in sorted(flags)])]
            known = np.full(len(ids) + 1, -1, np.int64)  # the number of the phrase, one word shorter, that starts at a place
            for n, (at, codes) in enumerate(found, 1):
                at = at[_within(codes, often)]
                if n > 1:  # parts of a frequent phrase are frequent
                    at = at[(known[at] >= 0) & (known[at + 1] >= 0)]
                if not len(at):
                    break
                last = ids[at + n - 1].astype(np.int64)
                _, first, number, counts = np.unique(last if n == 1 else known[at] << 32 | last, return_index=True, return_inverse=True, return_counts=True)
                known = np.full(len(ids) + 1, -1, np.int64)
                known[at] = number
                each = [words.take(pa.array(ids[at[first] + j] - 1)) for j in range(n)]
                rows.append((row["part"], each[0] if n == 1 else pc.binary_join_element_wise(*each, " "), pa.array(counts, pa.int64())))
        parts = [pa.array([part] * len(c), pa.string()) for part, _, c in rows]
        return pa.table({"lang": pa.chunked_array(parts, pa.string()), "phrase": pa.chunked_array([p for _, p, _ in rows], pa.string()), "f": pa.chunked_array([c for *_, c in rows], pa.int64())})

    return count


def phrase_counts(docs: DataFrame, least: int = 30, lang_col: str = "lang", text_col: str = "text", chars: int = CHUNK_CHARS) -> DataFrame:
    """lang, phrase (words joined by spaces), f: exact counts of all phrases of 1 to 4 words that a language has at least least times, and of the empty phrase, which stands for any word."""
    named = docs.select(F.lit(0).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    chunks = chunked(named, BREAKS, "lang", chars=chars).select("chunk", "part", "ids", "words")
    n_words = chunks.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0] // 4
    bits, cap = max(4, min(16, (n_words // SHARD_WORDS).bit_length())), min(255, least)
    streams = chunks.mapInArrow(_streams(bits, cap), "chunk long, shard int, codes binary, counts binary")
    marks = streams.groupBy("shard").applyInArrow(_frequent(cap), "chunk long, shard int, bits binary, codes int")
    counted = chunks.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(_counted(bits), "lang string, phrase string, f long")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == ""))


def in_order(counts: DataFrame, key, rows: int) -> DataFrame:
    """counts with its key (an array of words), in ranges of about RANGE_ROWS rows that lie in order and are sorted; cut from its lineage."""
    return materialized(counts.withColumn("key", key).repartitionByRange(max(1, -(-rows // RANGE_ROWS)), "lang", "key").sortWithinPartitions("lang", "key"))


class _Open:
    """The phrases that the last row extends, itself included: a stack of (words, f, largest extension)."""

    def __init__(self, lang: str | None = None, opened: list | None = None):
        self.lang, self.stack = lang, [list(x) for x in opened or []]

    def close_for(self, lang: str, key: list) -> list:
        """Take off what the row (lang, key) doesn't extend."""
        n = len(self.stack)
        while n and not (lang == self.lang and self.stack[n - 1][0] == key[: len(self.stack[n - 1][0])]):
            n -= 1
        closed, self.stack, self.lang = self.stack[n:], self.stack[:n], lang
        return closed


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a range: which phrases are open at its end, which of an earlier range may go on in it, and those one's largest extensions here."""
    opened, first, before = _Open(), None, {}
    for batch in batches:
        for lang, key, f in zip(*(batch.column(c).to_pylist() for c in ("lang", "key", "f"))):
            if first is None:
                first = (lang, key)
            opened.close_for(lang, key)
            if len(key) > 1 and lang == first[0] and key[:-1] == first[1][: len(key) - 1] and not (opened.stack and opened.stack[-1][0] == key[:-1]):
                before[len(key) - 1] = max(before.get(len(key) - 1, 0), f)
            opened.stack.append([key, f, 0])
    if first is not None:
        told = {"first": first, "lang": opened.lang, "open": [x[:2] for x in opened.stack], "before": sorted(before.items())}
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([json.dumps(told)], pa.string())], ["range", "told"])


def lockstep(stream: DataFrame, counts: str, extension: str) -> DataFrame:
    """The rows of an ordered stream with the counts of the parts that they begin with, in order of length, and with the largest count of what extends them by one word at the key's end."""
    carried, later, opened, lang = {}, {}, [], None
    for at, told in sorted((r["range"], json.loads(r["told"])) for r in stream.select("lang", "key", "f").mapInArrow(_ends, "range int, told string").collect()):
        going = _Open(lang, [[k, f, 0] for k, f in opened])
        going.close_for(told["first"][0], told["first"][1])
        going = [x[:2] for x in going.stack]
        carried[at] = (told["first"][0], going)
        for length, f in told["before"]:
            key = (told["first"][0], tuple(told["first"][1][:length]))
            later[key] = max(later.get(key, 0), f)
        same = told["lang"] == told["first"][0]
        last = told["open"][-1][0]
        lang, opened = told["lang"], [x for x in going if same and x[0] == last[: len(x[0])] and len(x[0]) < len(last)] + told["open"]
    names = [c for c in stream.columns if c != "key"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_at = _Open(*carried.get(TaskContext.get().partitionId(), (None, [])))
        for x in open_at.stack:
            x.extend([0, None])
        waiting: list[dict] = []

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist(waiting, schema=schema)
            waiting.clear()
            return made

        def done(closed: list) -> None:
            for key, _, most, row in closed:
                if row is not None:
                    waiting.append(row | {extension: max(most, later.get((row["lang"], tuple(key)), 0))})

        schema = None
        for batch in batches:
            if schema is None:
                kinds = [batch.schema.field(c) for c in names]
                schema = pa.schema([*kinds, pa.field(counts, pa.list_(pa.int64())), pa.field(extension, pa.int64())])
            for row in batch.to_pylist():
                key = row.pop("key")
                done(open_at.close_for(row["lang"], key))
                if open_at.stack and len(open_at.stack[-1][0]) == len(key) - 1:
                    open_at.stack[-1][2] = max(open_at.stack[-1][2], row["f"])
                open_at.stack.append([key, row["f"], 0, row | {counts: [x[1] for x in open_at.stack]}])
            if waiting:
                yield batch_of()
        done(open_at.stack)
        if waiting:
            yield batch_of()

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema if f.name != "key")
    return stream.select(*names, "key").mapInArrow(scan, f"{shape}, `{counts}` array<long>, `{extension}` long")


def collocations(docs: DataFrame, least: int = 30, top: int = 2_000, lang_col: str = "lang", text_col: str = "text", chars: int = CHUNK_CHARS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first top phrases of 2 to 4 words by score.

    a, l and r count the phrase, the part before and the part from its lowest-scoring cut on; score is floor(2000000 a / (l + r)). Phrases whose
    words lie inside a longer phrase with at least 0.8 of their count are dropped; one that is one word longer shows it, since what lies
    inside four words with that count lies inside the three words between with it too. A null text is empty, a null language is `und`;
    repeated rows count as often as they come; ids and further columns are not looked at. No words, or none frequent, give no rows.
    """
    counts = materialized(phrase_counts(docs, least, lang_col, text_col, chars).withColumn("words", F.split("phrase", " ")))
    phrases, rows = counts.where("phrase <> ''").select("lang", "words", "f"), counts.count()
    by_suffix = lockstep(in_order(phrases, F.reverse("words"), rows), "rests", "left_most")
    by_prefix = lockstep(in_order(by_suffix, F.col("words"), rows), "firsts", "right_most")
    most = F.greatest("left_most", "right_most").cast("decimal(38,0)")
    candidates = by_prefix.where((F.size("words") > 1) & (100 * most < 80 * F.col("f").cast("decimal(38,0)")))
    cuts = """array_min(transform(sequence(1, size(words) - 1), k -> struct(
        (cast(2000000 as decimal(38,0)) * cast(f as decimal(38,0))) div (cast(firsts[k - 1] as decimal(38,0)) + cast(rests[size(words) - k - 1] as decimal(38,0))) as score,
        k as k, firsts[k - 1] as l, rests[size(words) - k - 1] as r)))"""
    scored = candidates.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), F.expr(cuts).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
