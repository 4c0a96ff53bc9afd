"""Distances, bounds and sizes under the Poisson and the binomial mutation model: plain numbers that plans use as small tables."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def jaccard_to_distance(j: float, k: int, model: str = "poisson") -> float:
    if j <= 0:
        return 1.0
    if j >= 1:
        return 0.0
    shared = 2 * j / (1 + j)
    return -math.log(shared) / k if model == "poisson" else 1 - shared ** (1 / k)


def distance_to_jaccard(d: float, k: int, model: str = "poisson") -> float:
    d = min(max(d, 0.0), 1.0)
    shared = math.exp(-k * d) if model == "poisson" else (1 - d) ** k
    return shared / (2 - shared)


def jaccard_to_distance_column(j: Column, k: int, model: str = "poisson") -> Column:
    shared = 2 * j / (1 + j)
    between = -F.log(shared) / k if model == "poisson" else 1 - F.pow(shared, F.lit(1 / k))
    return F.when(j <= 0, 1.0).when(j >= 1, 0.0).otherwise(between)


def distance_to_jaccard_column(d: Column, k: int, model: str = "poisson") -> Column:
    d = F.greatest(F.lit(0.0), F.least(F.lit(1.0), d))
    shared = F.exp(-k * d) if model == "poisson" else F.pow(1 - d, F.lit(float(k)))
    return shared / (2 - shared)


@lru_cache(maxsize=None)
def _log_factorials(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])


def binomial_tails(n: int, p: float) -> np.ndarray:
    """P(X >= x) for x = 0 to n + 1."""
    if p <= 0 or p >= 1:
        tails = np.full(n + 2, 1.0 if p >= 1 else 0.0)
        tails[0], tails[n + 1] = 1.0, 0.0
        return tails
    x = np.arange(n + 1)
    f = _log_factorials(n)
    terms = f[n] - f[x] - f[n - x] + x * math.log(p) + (n - x) * math.log1p(-p)
    sums = np.logaddexp.accumulate(terms[::-1])[::-1]
    tails = np.append(np.clip(np.exp(sums), 0, 1), 0.0)
    tails[0] = 1.0
    return tails


def distance_lower_bound(d: float, s: int, k: int, confidence: float = 0.9, model: str = "poisson") -> float:
    """The distance at the upper confidence bound of shared sketch elements."""
    if s == 0:
        return 1.0
    p = min(max(distance_to_jaccard(d, k, model), 0.0), 1.0)
    tails, x = binomial_tails(s, p), max(math.ceil(s * p), 1)
    rare = np.flatnonzero(tails[x : s + 1] < (1 - confidence) / 2)
    x = x + int(rare[0]) - 1 if len(rare) else s
    return jaccard_to_distance(min(max(x, 1), s) / s, k, model)


@lru_cache(maxsize=4096)
def distance_rows(s: int, k: int, model: str = "poisson") -> tuple[tuple[int, float, float], ...]:
    """(shared, identity, its upper bound) for 0 to s shared of s sketch elements."""
    out = []
    for shared in range(s + 1):
        d = jaccard_to_distance(shared / s, k, model) if s else 1.0
        out.append((shared, 100 * (1 - d), 100 * (1 - distance_lower_bound(d, s, k, 0.9, model))))
    return tuple(out)


def distance_table(spark: SparkSession, sizes: list[int], k: int, model: str = "poisson") -> DataFrame:
    rows = [(s, *row) for s in sorted(set(sizes)) for row in distance_rows(s, k, model)]
    return spark.createDataFrame(rows, "sketch_size int, shared int, identity double, identity_upper double")


def minimum_hits(s: int, k: int, identity: float, model: str = "poisson") -> int:
    return math.ceil(s * distance_to_jaccard(1 - identity / 100, k, model))


@lru_cache(maxsize=65536)
def relaxed_minimum_hits(s: int, k: int, identity: float, model: str = "poisson", confidence: float = 0.9) -> int:
    """The least number of shared elements, going down from the strict one, whose upper bound still reaches the identity."""
    least = minimum_hits(s, k, identity, model) if s else 0
    for shared in range(least, -1, -1) if s else ():
        d = jaccard_to_distance(shared / s, k, model)
        if 100 * (1 - distance_lower_bound(d, s, k, confidence, model)) < identity:
            break
        least = shared
    return least


def random_hit_p_value(s: int, k: int, identity: float, query: int, reference: int, model: str = "poisson", confidence: float = 0.9) -> float:
    p = 1 / (1 + 4.0**k / query)
    x = relaxed_minimum_hits(s, k, identity, model, confidence)
    return reference * (float(binomial_tails(s, p * p / (2 * p - p * p))[x]) if x <= s else 0.0)


def recommended_window(p_value: float, k: int, identity: float, query: int, reference: int, model: str = "poisson") -> int:
    fitting = (s for s in (1, 2, 5, *range(10, query, 10)) if random_hit_p_value(s, k, identity, query, reference, model) <= p_value)
    return min(max(2 * query // next(fitting, query), 1), query)


def recommended_minmer_sketch(p_value: float, k: int, identity: float, segment: int, reference: int, model: str = "poisson") -> int:
    n = max(1, segment - k)
    return next((s for s in range(10, n, 10) if random_hit_p_value(s, k, identity, n, reference, model, 0.95) <= p_value), n)


def odd_span_window(k: int, w: int) -> int:
    """The window nearest below (2 for 1) with an odd span k + w - 1, which canonical window minimizers need."""
    return w if (k + w - 1) % 2 else (w - 1 if w > 1 else w + 1)
