"""Neighbours in blocks against plain Python."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.operators import analytics, neighbours
from strandloom.plans import registry


def cosine(a, b):
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    if a is None or b is None or None in a or None in b or len(a) != len(b):
        return None
    length = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
    return round(dot(a, b) / length, 6) if length else math.nan


def best(rows, digits, k):
    out = {}
    for q, a in rows:
        if q is not None and q % 3 == 0:
            found = [(c, cosine(a, b)) for c, b in rows if c is not None and c != q]
            rank = lambda s: (2, 0) if s is None else (0, 0) if s != s else (1, -round(s, digits))
            out[q] = [c for c, s in sorted(found, key=lambda x: (rank(x[1]), x[0]))[:k]]
    return out


@pytest.mark.parametrize("odd", [False, True])
def test_against_all_pairs(spark, monkeypatch, odd):
    monkeypatch.setattr(neighbours, "QUERIES", 20)
    monkeypatch.setattr(neighbours, "VECTORS", 30)
    r = random.Random(8)
    rows = [(i, [float(r.randrange(-2, 3)) + (i % 4 > 1) * r.random() for _ in range(4)]) for i in r.sample(range(1000), 150)]
    rows = [(i, x if any(x) else [1.0] * 4) for i, x in rows]
    if odd:
        rows += [(1001, None), (1002, [0.0] * 4), (1005, [1.0, None, 2.0, 3.0]), (1008, [1.0, 2.0]), (None, [1.0] * 4), (1011, None)]
    table = spark.createDataFrame(rows, "name long, x array<double>")
    found = analytics.cut(neighbours.cosine_neighbours(table, F.col("name") % 3 == 0, 5, (6, 1)))
    for digits in (6, 1):
        got = {}
        own = found.where(f"digits = {digits}").drop("digits").withColumn("score", F.round("score", digits))
        for x in analytics.nearest(own, 5).orderBy("query", "rank").collect():
            got.setdefault(x.query, []).append(x.candidate)
        assert got == best(rows, digits, 5)


def test_tiles_and_rounding(monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 16)
    r = np.random.default_rng(2)
    x = r.integers(-2, 3, (200, 3)).astype(float) + 0.125
    names = r.permutation(200)
    table = lambda at: pa.table({"name": names[at], "vector": [v.tobytes() for v in x[at]], "norm": np.sqrt((x[at] ** 2).sum(axis=1))})
    got = neighbours._group(4, (6, 1))(table(slice(0, 60)), table(slice(0, 200))).to_pydict()
    whole = {int(n): v.tolist() for n, v in zip(names, x)}
    for digits in (6, 1):
        mine = {}
        for q, c, d in zip(got["query"], got["candidate"], got["digits"]):
            if d == digits:
                mine.setdefault(q, set()).add(c)
        want = {int(q): {c for _, c in sorted((-round(cosine(whole[int(q)], v), digits), c) for c, v in whole.items() if c != q)[:4]} for q in names[:60]}
        assert mine == want
    assert neighbours._rounded(np.array([0.0000005, -0.0000015, 0.1234565, 0.9999994, -0.0])).tolist() == [1, -2, 123457, 999999, 0]


def test_no_join_of_all_pairs(spark, tmp_path):
    r = random.Random(9)
    spark.createDataFrame([(i, [r.random() for _ in range(8)]) for i in range(100)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = registry.nearest_neighbours(spark, str(tmp_path))
    plan = found._jdf.queryExecution().toString()
    assert found.count() == 50 and "NestedLoop" not in plan and "Cartesian" not in plan
