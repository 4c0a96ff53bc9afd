"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Tokens are runs of letters; a sequence is at most SEQUENCE consecutive tokens of a document. There are two states, and a token's
features are its word and the word's first 3 to 8 letters. Where labels are given for documents only, tokens are labelled first:
in documents labelled toxic, those with a feature that is much more frequent among such documents than among the others.
Weights and transitions maximise the likelihood of the labelled sequences. Forward-backward marginals of a document's tokens give its score (a
logistic function of their largest value and of how many are expected) and its offending offsets.

The model is fitted in one task from a bounded sample of labelled rows, so that the driver holds no texts, only the model; each executor scores whole documents.
Null and empty texts, and texts without letters, score as no toxic token does. An empty table gives no rows; without any labelled rows
of both kinds every score is the share of toxic ones (0 without rows). Repeated rows are scored each.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import one_text_an_id, slices, small_batches

TOKEN = re.compile(r"[^\W\d_]+")
SEQUENCE = 64
#: Labelled rows of each kind that the fit takes at most; documents and sequences are drawn by hash.
SAMPLE_A_KIND, MARKED_SEQUENCES, PLAIN_SEQUENCES = 1_200, 5_000, 5_000
STEPS = 50
MEMO = 100_000


def features(word: str) -> list[str]:
    return [word + "$", *[word[:n] for n in range(3, 9) if len(word) >= n]]


def _marginals(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of padded sequences of state-1 log potentials: P(state 1) at each place, and the expected numbers of moves between states.

    Potentials of state 0 are 1. trans holds log potentials of from, to.
    """
    n, width = scores.shape
    order = np.argsort(-lengths, kind="stable")  # so that those that go on at a step come first
    active = [int(k) for k in n - np.searchsorted(np.sort(lengths), np.arange(width), side="right")]
    emit = np.exp(np.clip(scores[order].T, -40, 40))
    (m00, m01), (m10, m11) = np.exp(trans)
    one = np.zeros((width, n))  # P(state 1) given the tokens so far
    for t in range(width):
        k = active[t]
        if t:
            f1 = one[t - 1, :k]
            f0 = 1 - f1
            up = (f0 * m01 + f1 * m11) * emit[t, :k]
            one[t, :k] = up / (up + f0 * m00 + f1 * m10)
        else:
            one[0, :k] = emit[0, :k] / (1 + emit[0, :k])
    marginal, moves = np.zeros((width, n)), np.zeros((2, 2))
    back = np.full(n, 0.5)  # the share of state 1 in what follows
    for t in range(width - 1, -1, -1):
        k = active[t]
        f1, b1 = one[t, :k], back[:k]
        marginal[t, :k] = f1 * b1 / (f1 * b1 + (1 - f1) * (1 - b1))
        if t:
            f1 = one[t - 1, :k]
            f0, r1, r0 = 1 - f1, b1 * emit[t, :k], 1 - b1
            parts = (f0 * m00 * r0, f0 * m01 * r1, f1 * m10 * r0, f1 * m11 * r1)
            total = parts[0] + parts[1] + parts[2] + parts[3]
            moves += np.array([(x / total).sum() for x in parts]).reshape(2, 2)
            up, down = m10 * r0 + m11 * r1, m00 * r0 + m01 * r1
            back[:k] = up / (up + down)
    out = np.zeros((n, width))
    out[order] = marginal.T
    return out, moves


def _padded(values: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' tokens one after the other as sequences: the places of tokens in them, and the sequences' lengths."""
    lengths = [min(SEQUENCE, n - at) for n in sizes for at in range(0, n, SEQUENCE)]
    lengths = np.array(lengths, np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    col = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((len(lengths), SEQUENCE))
    out[row, col] = values
    return out, row * SEQUENCE + col, lengths


class Tagger:
    """A fitted field and the document score over its marginals."""

    def __init__(self, weights: dict[str, float], bias: float, trans: np.ndarray, scale: np.ndarray, share: float):
        self.weights, self.bias, self.trans, self.scale, self.share = weights, bias, trans, scale, share
        self.memo: dict[str, float] = {}

    def token_marginals(self, docs: list[list[str]]) -> list[np.ndarray]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, get = self.memo, self.weights.get
        for word in {w for words in docs for w in words}.difference(memo):
            memo[word] = self.bias + sum(get(f, 0.0) for f in features(word.lower()))
        sizes = [len(words) for words in docs]
        scores = np.fromiter((memo[w] for words in docs for w in words), float, sum(sizes))
        if not len(scores):
            return [np.zeros(0) for _ in docs]
        padded, place, lengths = _padded(scores, sizes)
        flat = np.zeros(len(scores))
        for at in range(0, len(lengths), 4096):
            marginal = _marginals(padded[at : at + 4096], lengths[at : at + 4096], self.trans)[0].ravel()
            own = (place >= at * SEQUENCE) & (place < (at + 4096) * SEQUENCE) if len(lengths) > 4096 else slice(None)
            flat[own] = marginal[place[own] - at * SEQUENCE]
        return np.split(flat, np.cumsum(sizes)[:-1])

    def score(self, marginals: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-self.scale @ aggregates(marginals)))) if len(self.scale) else self.share


def aggregates(marginals: np.ndarray) -> np.ndarray:
    """What a document's score is made of: one, the largest marginal, and the log of the expected number of toxic tokens and one."""
    return np.array([1.0, marginals.max(initial=0), np.log1p(marginals.sum())])


def _unlike_before(docs: list[list[str]]) -> list[bool]:
    """Whether each document shares none of three minimum hashes of five-word shingles with one before: copies must not speak twice."""
    seen: tuple[set, set, set] = (set(), set(), set())
    out = []
    for words in docs:
        raw = [zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))]
        least = [min((h * odd) & 0xFFFFFFFF for h in raw) for odd in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
        out.append(not any(h in s for h, s in zip(least, seen)))
        for h, s in zip(least, seen):
            s.add(h)
    return out


def label_tokens(docs: list[list[str]], toxic: list[int]) -> list[np.ndarray]:
    """Token labels from document labels: 1 in toxic documents for tokens with a feature that speaks for toxicity."""
    counts, sizes = (Counter(), Counter()), [1, 1]
    for words, label, new in zip(docs, toxic, _unlike_before(docs)):
        if new:
            counts[bool(label)].update({f for w in {w.lower() for w in words} for f in features(w)})
            sizes[bool(label)] += 1
    share = sizes[1] / sum(sizes)

    def tells(n: int, other: int) -> bool:
        """Much more frequent in toxic documents, and by a likelihood ratio not by chance."""
        both = n + other
        ratio = 2 * (n * np.log(n / (both * share)) + (other * np.log(other / (both * (1 - share))) if other else 0))
        return ratio >= 18 and n / sizes[1] >= 12 * (other + 0.5) / sizes[0]

    telling = {f for f, n in counts[True].items() if n >= 3 and tells(n, counts[False][f])}
    told = {w: any(f in telling for f in features(w.lower())) for words in docs for w in set(words)}
    return [np.array([bool(label) and told[w] for w in words], bool) for words, label in zip(docs, toxic)]


def fit(texts: list[str | None], toxic: list[int]) -> Tagger:
    """A tagger from documents' labels."""
    share = float(np.mean(toxic)) if toxic else 0.0
    if not 0 < share < 1:
        return Tagger({}, 0.0, np.zeros((2, 2)), np.zeros(0), share)
    once: dict[str, str] = {}  # a word is one object, however often it stands
    docs = [[once.setdefault(w, w) for w in TOKEN.findall(t or "")] for t in texts]
    labels = label_tokens(docs, toxic)
    cut = [(words[i : i + SEQUENCE], own[i : i + SEQUENCE]) for words, own in zip(docs, labels) for i in range(0, len(words), SEQUENCE)]
    marked = [s for s in cut if s[1].any()]
    plain = [s for s in cut if not s[1].any()]
    step = max(1, len(plain) // PLAIN_SEQUENCES)
    weights, bias, trans = _fit_field(marked[:: max(1, len(marked) // MARKED_SEQUENCES)] + plain[::step])
    tagger = Tagger(weights, bias, trans, np.zeros(0), share)
    x = np.stack([aggregates(m) for m in tagger.token_marginals(docs)])
    y = np.array(toxic, float)
    scale = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps of a slightly regularised logistic regression
        p = 1 / (1 + np.exp(-x @ scale))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(len(scale))
        scale -= np.linalg.solve(hessian, x.T @ (p - y) + 0.1 * scale)
    tagger.scale, tagger.memo = scale, {}
    return tagger


def _fit_field(sequences: list[tuple[list[str], np.ndarray]]) -> tuple[dict[str, float], float, np.ndarray]:
    """Weights that maximise the sequences' likelihood less a penalty, by Adam steps over all of them."""
    vocabulary: dict[str, int] = {}
    tokens = np.array([vocabulary.setdefault(w.lower(), len(vocabulary)) for words, _ in sequences for w in words], np.int64)
    truth = np.concatenate([own for _, own in sequences]).astype(float)
    names: dict[str, int] = {}
    pairs = ((i, names.setdefault(f, len(names))) for w, i in vocabulary.items() for f in features(w))
    of_word, of_feature = np.fromiter(chain.from_iterable(pairs), np.int64).reshape(-1, 2).T
    seen = np.bincount(of_feature, np.bincount(tokens, minlength=len(vocabulary))[of_word], len(names)) >= 2
    keep = seen[of_feature]
    of_word, of_feature = of_word[keep], of_feature[keep]
    _, place, lengths = _padded(np.zeros(len(tokens)), [len(w) for w, _ in sequences])
    grid = np.zeros(len(lengths) * SEQUENCE)
    grid[place] = truth
    grid = grid.reshape(-1, SEQUENCE).astype(int)
    after = np.arange(1, SEQUENCE)[None, :] < lengths[:, None]
    observed = np.bincount((grid[:, :-1] * 2 + grid[:, 1:])[after], minlength=4).reshape(2, 2)
    theta = np.zeros(len(names) + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    theta[-5] = np.log((truth.sum() + 1) / (len(truth) - truth.sum() + 1))
    for step in range(1, STEPS + 1):
        word_scores = np.bincount(of_word, theta[of_feature], len(vocabulary)) + theta[-5]
        scores = np.zeros(len(lengths) * SEQUENCE)
        scores[place] = word_scores[tokens]
        marginal, pair = _marginals(scores.reshape(-1, SEQUENCE), lengths, theta[-4:].reshape(2, 2))
        off = marginal.ravel()[place] - truth
        by_word = np.bincount(tokens, off, len(vocabulary))
        gradient = np.concatenate([np.bincount(of_feature, by_word[of_word], len(names)), [off.sum()], (pair - observed).ravel()]) + 0.05 * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = {f: float(theta[i]) for f, i in names.items() if abs(theta[i]) > 1e-4 and seen[i]}
    return weights, float(theta[-5]), theta[-4:].reshape(2, 2)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_A_KIND) -> Tagger:
    """Fit, in one task, on at most sample labelled rows of each kind, the least by a hash of their id; labels must hold training rows only.

    An id with several labels has the greatest, and of documents that share an id the text with the least hash is taken, so that ids bound the rows.
    Rows with a null id or label are left out.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    rows = rows.groupBy("id").agg(F.max("y").alias("y"))
    kinds = [rows.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(kinds[0].unionByName(kinds[1]))  # 2 * sample rows at most
    got = one_text_an_id(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(chosen, "id")).select("id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, pa.schema([("id", pa.int64()), ("y", pa.int32()), ("text", pa.string())])).sort_by("id")
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows["text"].to_pylist(), rows["y"].to_pylist()))], pa.binary())], ["tagger"])

    found = got.repartition(1).mapInArrow(run, "tagger binary").first()
    return pickle.loads(found["tagger"]) if found else fit([], [])


def score(docs: DataFrame, tagger: Tagger, text_col: str = "text", spans_from: float = 0.5, score_col: str = "__score", spans_col: str = "__spans") -> DataFrame:
    """docs and a score (0 to 1) and spans, the offsets of runs of tokens with marginals of at least spans_from: array of (start, end).

    Null and empty texts have no tokens and get the score of none. Rows that repeat get equal scores; other columns stay, and must not have the two names.
    """
    if {score_col.lower(), spans_col.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {score_col} or {spans_col}; name others")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(batch.schema.names.index(text_col)).to_pylist()]
            marginals = own.token_marginals([TOKEN.findall(t) for t in texts])
            spans = [_spans(t, m >= spans_from) for t, m in zip(texts, marginals)]
            batch = batch.append_column(score_col, pa.array([own.score(m) for m in marginals], pa.float64()))
            yield batch.append_column(spans_col, pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}{', ' if fields else ''}`{score_col}` double, `{spans_col}` array<struct<start: int, end: int>>")


def _spans(text: str, marked: np.ndarray) -> list[dict]:
    out: list[dict] = []
    if marked.any():
        before = False
        for found, mark in zip(TOKEN.finditer(text), marked):
            if mark and before:
                out[-1]["end"] = found.end()
            elif mark:
                out.append({"start": found.start(), "end": found.end()})
            before = mark
    return out
