"""A quality classifier as a sparse rule ensemble over text statistics.

Statistics of a document are numbers that need one pass over its text. Small boosted regression trees are grown on a bounded sample
of labelled rows; each path from a root to a node is a rule, a conjunction of bounds on statistics. A logistic model with a lasso penalty
over the rules (and no other terms) keeps a few of them, which are compiled into one Spark column expression over the statistics.

Null and empty texts have statistics of zero. An empty table gives no rows; without labelled rows of both kinds every score is the share of
label 1 (0 without rows). Repeated rows are scored each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import one_text_an_id, slices, small_batches

STATISTICS = ("chars", "words", "word_chars", "lines", "line_chars", "upper", "digits", "stops", "symbols", "spaces", "different_words", "most_common_word", "repeated_lines", "capital_words", "marked_words", "long_words", "runs")
#: Labelled rows that the fit takes at most, drawn by hash; trees, their depth, and the lasso's strength for each row.
SAMPLE, TREES, DEPTH, LASSO = 8_000, 24, 3, 0.002
Rule = tuple[tuple[int, bool, float], ...]

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_STOPS = b".,;:?'\""
_SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _STOPS)
_SPACES = b" \t\n\v\f\r"
_MARKS = tuple(bytes([b]) for b in _SYMBOLS)


def statistics(text: str) -> tuple[float, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words, lines = raw.split(), raw.split(b"\n")
    n, w, k = max(1, len(raw)), max(1, len(words)), len(lines)
    counts = Counter(words)
    part = lambda some: (len(raw) - len(raw.translate(None, some))) / n
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return (
        float(len(text)), float(len(words)), sum(map(len, words)) / w, float(k), len(raw) / k, part(_UPPER), part(_DIGITS), part(_STOPS), part(_SYMBOLS), part(_SPACES),
        len(counts) / w, max(counts.values(), default=0) / w, 1 - len(set(lines)) / k, sum(x.isupper() for x in words) / w, sum(x.endswith(_MARKS) for x in words) / w, sum(len(x) > 20 for x in words) / w, repeats / w,
    )


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without its text, and the statistics as columns __<name>."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.names.index(text_col)
            rows = np.array([statistics(t or "") for t in batch.column(at).to_pylist()], float).reshape(-1, len(STATISTICS))
            kept = [(n, c) for i, (n, c) in enumerate(zip(batch.schema.names, batch.columns)) if i != at]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(x) for x in rows.T], [n for n, _ in kept] + [f"__{s}" for s in STATISTICS])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col]
    return docs.mapInArrow(run, ", ".join(fields + [f"__{s} double" for s in STATISTICS]))


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """The paths of boosted trees, each rule once. Thresholds are halfway between quantiles."""
    cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 49))) for c in x.T]
    below = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]  # x <= cut k if the place is at most k
    odds = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rules: dict[Rule, None] = {}

    def grow(rows: np.ndarray, residual: np.ndarray, path: Rule, left: int) -> None:
        if path:
            rules.setdefault(tuple(sorted(path)))
        best = None
        if left and len(rows) >= 20:
            total, n = residual[rows].sum(), len(rows)
            for j, c in enumerate(cuts):
                sums = np.cumsum(np.bincount(below[j][rows], residual[rows], len(c) + 1))[:-1]
                sizes = np.cumsum(np.bincount(below[j][rows], minlength=len(c) + 1))[:-1]
                fine = (sizes >= 10) & (n - sizes >= 10)
                if fine.any():
                    gain = np.where(fine, sums**2 / np.maximum(sizes, 1) + (total - sums) ** 2 / np.maximum(n - sizes, 1), -np.inf)
                    k = int(gain.argmax())
                    if best is None or gain[k] > best[0]:
                        best = gain[k], j, k
            if best and best[0] <= total**2 / n * (1 + 1e-9) + 1e-9:
                best = None
        if best is None:
            p = 1 / (1 + np.exp(-odds[rows]))
            odds[rows] += 0.3 * np.clip(residual[rows].sum() / ((p * (1 - p)).sum() + 1), -4, 4)
            return
        _, j, k = best
        side = below[j][rows] <= k
        for low in (True, False):
            grow(rows[side == low], residual, (*path, (j, low, float(cuts[j][k]))), left - 1)

    for _ in range(trees):
        grow(np.arange(len(y)), y - 1 / (1 + np.exp(-odds)), (), depth)
    return list(rules)


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, j] <= cut) == low for j, low, cut in rule])


def fit_lasso(r: np.ndarray, y: np.ndarray, strength: float = LASSO, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and an intercept that is not penalised, by accelerated proximal gradient steps."""
    n = len(y)
    rate = 4 * n / (np.linalg.norm(np.column_stack([r, np.ones(n)]), 2) ** 2)
    w, b = np.zeros(r.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        off = (1 / (1 + np.exp(-(r @ vw + vb))) - y) / n
        nw, nb = vw - rate * (r.T @ off), vb - rate * off.sum()
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * strength, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


class RuleEnsemble:
    def __init__(self, rules: list[tuple[Rule, float]], intercept: float):
        self.rules, self.intercept = rules, intercept

    def column(self) -> Column:
        """The score as a column expression over the statistics."""
        terms = [F.when(reduce(lambda a, b: a & b, [(F.col(f"__{STATISTICS[j]}") <= cut) if low else (F.col(f"__{STATISTICS[j]}") > cut) for j, low, cut in rule]), weight).otherwise(0.0) for rule, weight in self.rules]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.intercept))))


def fit(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return RuleEnsemble([], 40.0 * (2 * share - 1))
    rules = grow_rules(x, y)
    if not rules:
        return RuleEnsemble([], float(np.log(share / (1 - share))))
    weights, intercept = fit_lasso(np.column_stack([holds(x, rule) for rule in rules]).astype(float), y)
    return RuleEnsemble([(rule, float(w)) for rule, w in zip(rules, weights) if abs(w) > 1e-6], float(intercept))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> RuleEnsemble:
    """Fit on at most sample labelled rows, the least by a hash of their id; labels must hold training rows only.

    An id with several labels has the greatest, and of documents that share an id the text with the least hash is taken, so that ids bound the rows.
    Rows with a null id or label are left out.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    rows = rows.groupBy("id").agg(F.max("y").alias("y"))
    chosen = F.broadcast(rows.orderBy(F.xxhash64("id"), "id").limit(sample))
    got = with_statistics(one_text_an_id(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(chosen, "id"))).toPandas().sort_values("id")
    return fit(got[[f"__{s}" for s in STATISTICS]].to_numpy(float), got["y"].to_numpy(float))


def score(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, and the statistics as columns __<name>."""
    rows = with_statistics(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return rows.select("doc_id", model.column().alias("score"), *[f"__{s}" for s in STATISTICS])
