"""Exact ranks and quantiles of values that lie in many ranges, against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import analytics


def plain_ranks(values):
    return [sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2 for v in values]


R = random.Random(3)
CASES = {
    "ties": [R.choice([0.0, -0.0, 1.5, 100.0, 100.0, 100.0, R.random()]) for _ in range(700)],
    "scales": [10.0 ** R.randint(-300, 300) * R.choice([-1, 1]) for _ in range(400)],
    "one": [7.25],
    "equal": [3.0] * 500,
    "two": [1.0, 2.0],
}


@pytest.fixture
def ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield 13
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("case", sorted(CASES))
def test_quantiles_and_ranks(spark, ranges, case):
    values = CASES[case]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "i long, v double").repartition(5)
    points = (0.0, 0.01, 0.05, 0.25, 0.333, 0.5, 0.75, 0.99, 1.0)
    row = analytics.quantiles(rows, "v", points).first()
    assert (row["n"], row["min"], row["max"]) == (len(values), min(values), max(values))
    assert [row[f"p{round(100 * p):02d}"] for p in points] == pytest.approx([float(np.quantile(values, p)) for p in points], rel=1e-12)
    got = {r.i: r.rank for r in analytics.mean_ranks(rows, "v", "rank").collect()}
    assert got == dict(enumerate(plain_ranks(values)))


def test_ranges_share_the_work(spark, ranges):
    """Several ranges hold values, and no window or exchange gathers all of them in one task."""
    rows = spark.range(20_000).select(F.rand(5).alias("v"), (F.col("id") % 7).cast("double").alias("w"))
    found = analytics.ranked_values(rows, {"v": F.col("v"), "w": F.col("w")})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" in plan
    sizes = [r["count"] for r in found.where("kind = 'v'").groupBy(F.floor(F.col("below") / 20_000 * 13)).count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) == 13
    assert sorted((r.value, r.n, r.below) for r in found.where("kind = 'w'").collect())[0] == (0.0, 2858, 0)


def test_agreement(spark, ranges):
    draw = np.random.default_rng(1)
    one = np.round(draw.normal(90, 5, 300), 1)
    other = np.round(one + draw.normal(0, 2, 300), 1)
    pairs = spark.createDataFrame([(f"q{i}", "r", float(a), float(b), float(b - a)) for i, (a, b) in enumerate(zip(one, other))], "query string, reference string, one double, other double, delta double")
    row = analytics.agreement(pairs).first()
    d = other - one
    ranks = np.corrcoef(plain_ranks(one.tolist()), plain_ranks(other.tolist()))[0, 1]
    want = [300, np.corrcoef(one, other)[0, 1], ranks, d.mean(), np.median(d), np.abs(d).mean(), np.median(np.abs(d)), math.sqrt((d * d).mean()), np.abs(d).max(), np.abs(d).min()]
    assert list(row) == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_no_values(spark):
    rows = spark.createDataFrame([(None,)], "v double")
    assert analytics.quantiles(rows, "v", (0.5,)).first().asDict() == {"n": 0, "mean": None, "min": None, "max": None, "p50": None}
    empty = spark.createDataFrame([], "query string, reference string, one double, other double, delta double")
    assert analytics.agreement(empty).first()["n"] == 0
