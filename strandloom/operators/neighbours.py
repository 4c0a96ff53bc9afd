"""Exact nearest neighbours by cosine: all queries against all vectors, in blocks of numpy products."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.analytics import cut

#: Queries and vectors of a group, at most on average; queries and vectors whose products are made at a time.
QUERIES, VECTORS, TILE = 8_192, 32_768, 1_024
#: Pairs that wait until the best are sorted out of them, for each query on average.
WAITING = 8
#: Scores are rounded to so many digits; products by another order of sums differ by far less than SLACK.
DIGITS, SLACK = 6, 1e-9


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)


def _rounded(scores: np.ndarray) -> np.ndarray:
    """Scores in units of the last digit, halves of the shortest decimal going away from 0."""
    size = np.abs(scores) * 10.0**DIGITS
    units = np.floor(size + 0.5).astype(np.int64)
    for i in np.flatnonzero(np.abs(size - np.floor(size) - 0.5) < 1e-4).tolist():
        units[i] = int(Decimal(repr(abs(float(scores[i])))).scaleb(DIGITS).to_integral_value(ROUND_HALF_UP))
    return np.where(scores < 0, -units, units)


class _Best:
    """The k best of each query by the score rounded to some digits, then by name, while vectors come in order of their names."""

    def __init__(self, n: int, k: int, digits: int):
        self.n, self.k, self.unit = n, k, 10 ** (DIGITS - digits)
        self.row = np.zeros(0, np.int64)
        self.at, self.key, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.bound = np.full(n, -np.inf)  # products below it change nothing
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, row: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        self.waiting.append((row, at, score))
        if np.isinf(self.bound[0]) or sum(len(w[0]) for w in self.waiting) > WAITING * self.n:
            self.sort()

    def sort(self) -> None:
        if not self.waiting:
            return
        row, at, score = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting = []
        units = _rounded(score)
        key = np.sign(units) * ((np.abs(units) + self.unit // 2) // self.unit)
        row, at, key, score = (np.concatenate(x) for x in ((self.row, row), (self.at, at), (self.key, key), (self.score, score)))
        order = np.lexsort((at, -key, row))
        first = np.searchsorted(row[order], np.arange(self.n))
        nth = np.arange(len(order)) - first[row[order]]
        kept = order[nth < self.k]
        self.row, self.at, self.key, self.score = row[kept], at[kept], key[kept], score[kept]
        last = order[nth == self.k - 1]
        better = key[last] + 1  # vectors to come have later names, so an equal key is none
        least = self.unit * better - self.unit // 2 + ((better <= 0) & (self.unit > 1))
        self.bound[row[last]] = (least - 0.5) / 10.0**DIGITS - SLACK


def _group(k: int, digits: tuple[int, ...]):
    """Of a group's queries and vectors the k best for each query, for each number of digits."""

    def run(asked: pa.Table, others: pa.Table) -> pa.Table:
        ids, vectors, norms, out = [], [], [], []
        for table in (asked, others):
            if not table.num_rows:
                return pa.table({"query": pa.array([], pa.int64()), "candidate": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "digits": pa.array([], pa.int32())})
            name = table["name"].to_numpy()
            order = np.argsort(name, kind="stable")
            ids.append(name[order])
            vectors.append(np.frombuffer(b"".join(table["vector"].to_pylist()), np.float64).reshape(len(name), -1)[order])
            norms.append(table["norm"].to_numpy()[order])
        (qi, ci), (qn, cn), (q, c) = ids, norms, vectors
        unit, columns = (c / cn[:, None]).T.copy(), c.T.copy()
        for low in range(0, len(qi), TILE):
            names, sides, length = qi[low : low + TILE], q[low : low + TILE], qn[low : low + TILE]
            direction, own = sides / length[:, None], sides.T.copy()
            best = {d: _Best(len(names), k, d) for d in digits}
            at, size = 0, min(TILE, max(64, 2 * k))
            while at < len(ci):
                near = direction @ unit[:, at : at + size]
                for b in best.values():
                    row, column = np.divmod(np.flatnonzero((near >= b.bound[:, None]).ravel()), near.shape[1])
                    column += at
                    kept = names[row] != ci[column]
                    row, column = row[kept], column[kept]
                    if len(row):
                        score = np.zeros(len(row))
                        for x, y in zip(own, columns):  # in the order of the vectors, as sums in SQL
                            score += y[column] * x[row]
                        b.add(row, column, score / (cn[column] * length[row]))
                at, size = at + size, min(TILE, size if not at else size * 2)
            for b in best.values():
                b.sort()
            out += [(names[b.row], ci[b.at], b.score, np.full(len(b.row), d)) for d, b in best.items()]
        query, candidate, score, kind = (np.concatenate(x) for x in zip(*out))
        return pa.table({"query": query, "candidate": candidate, "score": score, "digits": kind.astype(np.int32)})

    return run


def cosine_neighbours(rows: DataFrame, asks: Column, k: int, digits: tuple[int, ...] = (DIGITS,)) -> DataFrame:
    """query, candidate, score, digits: for each number of digits pairs that hold the k best candidates of each query, by the score rounded to that many, then by name.

    rows: name (LONG), x (ARRAY<DOUBLE>); asks: whether a row is a query. Scores are rounded to DIGITS. Every query meets every other name in a group of some queries and
    some vectors, which hands on its k best; so the work goes by pairs, memory by groups. Rows without a length above 0, or of another size than most, are compared pair by pair:
    their scores are null or NaN, where they have none.
    """
    named = rows.where("name is not null").select("name", "x", F.sqrt(_dot(F.col("x"), F.col("x"))).alias("norm"), F.size("x").alias("size"), F.coalesce(asks, F.lit(False)).alias("asks"))
    able = (F.col("norm") > 0) & (F.col("norm") < float("inf"))
    pack = F.udf(lambda x: np.asarray(x, np.float64).tobytes(), "binary", useArrow=False)
    named = cut(named)
    sizes = named.where(able).groupBy("size").agg(F.count("*").alias("n"), F.count_if("asks").alias("asking")).orderBy(F.desc("n"), "size").first()
    size, n, asking = (sizes["size"], sizes["n"], sizes["asking"]) if sizes else (0, 0, 0)
    plain = F.coalesce(able & (F.col("size") == size), F.lit(False))
    whole, odd = named.where(plain), named.where(~plain)
    ways = rows.sparkSession.sparkContext.defaultParallelism
    blocks, parts = max(1, -(-asking // QUERIES)), max(1, -(-n // VECTORS), min(2 * ways, n // TILE))
    packed = whole.select("name", pack("x").alias("vector"), "norm", "asks")
    dealt = lambda of: F.pmod(F.xxhash64("name"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    columns = lambda: [F.col(c).alias(c) for c in ("name", "vector", "norm")]  # noqa: E731  # of each side's own, or a cogroup of one table with itself mixes them up
    asked = packed.where("asks").select(*columns(), dealt(blocks).alias("block"), every(parts).alias("part"))
    others = packed.select(*columns(), every(blocks).alias("block"), dealt(parts).alias("part"))
    found = asked.groupBy("block", "part").cogroup(others.groupBy("block", "part")).applyInArrow(_group(k, digits), "query long, candidate long, score double, digits int")
    if not odd.isEmpty():
        pairs = lambda a, b: a.where("asks").select(F.col("name").alias("query"), F.col("x").alias("qx"), F.col("norm").alias("qn")).join(b.select(F.col("name").alias("candidate"), "x", "norm"), F.col("query") != F.col("candidate"))
        length = F.col("norm") * F.col("qn")
        score = F.when(length == 0, F.when(_dot(F.col("x"), F.col("qx")).isNotNull(), float("nan"))).otherwise(F.try_divide(_dot(F.col("x"), F.col("qx")), length))
        others = pairs(odd, named).unionByName(pairs(whole, odd)).select("query", "candidate", score.alias("score"))
        found = found.unionByName(others.select("*", F.explode(F.array(*[F.lit(d) for d in digits])).alias("digits")))
    return found.withColumn("score", F.round("score", DIGITS))
