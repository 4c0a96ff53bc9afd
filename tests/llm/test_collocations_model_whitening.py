"""op11 to op13 against plain Python."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import collocations, language_model, whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_collocations(rows, least, top):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts[lang][tuple(words[i : i + n])] += 1
    found = []
    for lang, c in counts.items():
        scored = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            inside = any(len(q) > len(p) and f >= least and 100 * f >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, f in c.items() if f >= least)
            if not inside:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -s))
    return sorted(found)


def random_rows(seed, n=120):
    draw = np.random.default_rng(seed)
    words = ["a", "b", "B", "c", "é", "dd", "x\x01", "x", "日本", "a\x00"]
    marks = [" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\x0b", "! "]
    rows = []
    for _ in range(n):
        text = "".join(w for pair in zip(draw.choice(words, 40, p=[0.3, 0.2, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05]), draw.choice(marks, 40)) for w in pair)
        rows.append((draw.choice(["en", "de", None]), text))
    return rows + [("en", None), ("en", ""), (None, "..."), ("fr", "only here"), *[("en", "the same text again")] * 9]


@pytest.mark.parametrize("chars, range_rows, shard_words", [(8_000_000, 250_000, 2_000_000), (300, 7, 50), (300, 1, 2_000_000)])
def test_collocations_equal_plain_python(spark, monkeypatch, chars, range_rows, shard_words):
    monkeypatch.setattr(collocations, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard_words)
    rows = random_rows(5)
    docs = spark.createDataFrame([(i, t, lang, "en", i) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, part string, words long").repartition(3)
    for least, top in ((3, 2_000), (8, 4)):
        found = collocations.collocations(docs, least, top, chars=chars)
        assert sorted(map(tuple, found.collect())) == plain_collocations(rows, least, top)


def test_collocations_of_counts_beyond_codes(spark):
    """Counts over 255 and a least count over what a code's count can hold."""
    rows = [("en", "p q r")] * 300 + [("en", "p q")] * 40
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(docs, 290, 10).collect())) == plain_collocations(rows, 290, 10)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("x", " . ")], "lang string, text string"), 1).collect() == []


def plain_unigrams(rows, of, without):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % of == without for i, _ in words]
    counts = collections.Counter(w for (_, ws), h in zip(words, held) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    return sorted((str(i), h, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for (i, ws), h in zip(words, held))


@pytest.mark.parametrize("chars", [8_000_000, 500])
def test_language_model_counts_equal_plain_python(spark, monkeypatch, chars):
    monkeypatch.setattr(language_model, "PASSES", 1)
    texts = [t for _, t in random_rows(9)]
    rows = [*enumerate(texts), (None, "a b c"), (None, None), (3, "the same id"), (7, "the\x1csame \x85 id\r\n")]
    docs = spark.createDataFrame([(i, t, 1, 0.5) for i, t in rows], "doc_id long, text string, training int, score double").repartition(3)
    found = language_model.score_documents(docs, chars=chars).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == plain_unigrams(rows, 7, 2)
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_language_model_is_normalised(spark):
    """After any outputs the probabilities of all outputs sum to one, and so do the shares of a class; a text's score is the sum of its tokens'."""
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(random_rows(2))], "doc_id long, text string")
    coded, vocabulary = language_model.encode(docs, 7, 2)
    model = language_model.train(coded, vocabulary, rounds=2, enough=1)
    before = np.random.default_rng(0).integers(0, vocabulary.outputs, (20, language_model.CONTEXT)).astype(np.int16)
    every = np.arange(vocabulary.outputs, dtype=np.int16)
    for h in before:
        assert np.exp(model.log_probabilities(np.tile(h, (len(every), 1)), every)).sum() == pytest.approx(1, abs=1e-4)
    row = coded.where("doc_id = 4").first()
    outputs, share = np.frombuffer(row.outputs, np.int16), row.share
    padded, total = [0] * language_model.CONTEXT + outputs.tolist(), 0.0
    for i, w in enumerate(outputs):
        q = sum(model.context[padded[i + language_model.CONTEXT - j]] * model.places[j - 1] for j in range(1, language_model.CONTEXT + 1))
        s = (model.target @ q + model.bias).astype(float)
        total += s[w] - math.log(np.exp(s).sum())
    found = language_model.score(coded, vocabulary, model).where("doc_id = 4").first()
    assert found.score == pytest.approx(total / math.log(10) + share, rel=1e-4)


def test_class_shares_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(language_model, "OWN_WORDS", 1)
    docs = spark.createDataFrame([(i, "zz zz zz xa ya xa q. r. 1 é") for i in range(30)], "doc_id long, text string")
    coded, vocabulary = language_model.encode(docs, 7, 2)
    n = sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in range(30))
    assert (vocabulary.tokens, vocabulary.distinct, list(vocabulary.own)) == (11 * n, 8, ["zz"])
    a = language_model.ENDINGS.index("a")
    assert (vocabulary.class_tokens[a], vocabulary.class_words[a]) == (3 * n, 2)
    share = coded.where("doc_id = 1").first().share
    one = [(2 * n + 1, 3 * n + 3)] * 2 + [(n + 1, 3 * n + 3)] + [(n + 1, 2 * n + 3)] * 2 + [(n + 1, n + 2)] * 2
    assert share == pytest.approx(sum(math.log10(x / y) for x, y in one))


def test_language_model_step_is_the_gradient():
    """A small step changes the objective as its gradient says."""
    draw, outputs = np.random.default_rng(1), 7
    model = language_model.Model(outputs, draw.normal(size=outputs * 49 + language_model.CONTEXT * 24))
    before, w, noise = draw.integers(0, outputs, (16, language_model.CONTEXT)).astype(np.int16), draw.integers(0, outputs, 16).astype(np.int16), np.array([0, 2, 2, 5])
    log_noise = np.log(np.full(outputs, 4 / outputs))

    def objective(flat):
        m = language_model.Model(outputs, flat)
        q = sum(m.context[before[:, i]].astype(float) * m.places[i] for i in range(language_model.CONTEXT))
        s = q @ m.target.T + m.bias - log_noise
        return (-np.log1p(np.exp(-s[np.arange(16), w])) - np.log1p(np.exp(s[:, noise])).sum(axis=1)).mean()

    squares = language_model.Model(outputs, np.zeros(len(model.flat)))
    start = model.flat.copy()
    model.step(before, w, noise, log_noise.astype(np.float32), squares)
    gradient = np.sqrt(squares.flat) * np.sign(model.flat - start)  # the first step adds a gradient's square
    for i in draw.integers(0, len(start), 40):
        off = np.zeros(len(start))
        off[i] = 1e-2
        assert gradient[i] == pytest.approx((objective(start + off) - objective(start - off)) / 2e-2, abs=2e-3)


def test_language_model_learns(spark):
    """Words that follow each other are likelier than their frequency says, on documents held out too."""
    draw = np.random.default_rng(3)
    texts = [" ".join(f"{'uvw'[k]}{draw.integers(0, 9)} x{k}" for k in draw.integers(0, 3, 60)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = language_model.score_documents(docs).where("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert held[0] > held[1] + 0.1


def test_language_model_of_nothing(spark):
    assert language_model.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2]
    found = language_model.score_documents(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found] == [(True, 3, 0, 0, 0.0)] * len(held)


def plain_whitening(vectors, k=16):
    x = np.floor(64 * np.array(vectors)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    values, q = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    values, q = values[::-1], q[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), ((x - s / n) @ q[:, :k]) / np.sqrt(values[:k]), values / values.sum()


@pytest.mark.parametrize("size, rows, parts", [(5, 40, 1), (24, 300, 6), (24, 300, 40)])
def test_whitening_equals_plain_numpy(spark, size, rows, parts):
    draw = np.random.default_rng(size)
    vectors = (draw.normal(size=(rows, size)) * np.linspace(0.3, 2, size)).tolist()
    vectors[7] = vectors[3]
    junk = [None, [], [None] * size, [float("nan")] * size, [*vectors[0][:-1], float("inf")], vectors[0][:-1]]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)] + [(1000 + i, v, 2) for i, v in enumerate(junk)] + [(None, vectors[3], 3)] * 5, "vec_id long, embedding array<double>, component int").repartition(parts)
    n, deviation, whitened, explained = plain_whitening(vectors, 16)
    found = sorted((r for r in whitening.whiten(df).collect() if r.vec_id is not None), key=lambda r: (r.vec_id, r.component))
    k = min(16, size)
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in found] == [(i, c, n, int(deviation[i])) for i in range(rows) for c in range(1, k + 1)]
    got = np.array([r.whitened for r in found]).reshape(rows, k)
    assert np.abs(got * np.sign((got * whitened).sum(axis=0)) - whitened).max() < 1e-9
    assert np.abs(np.array([r.explained for r in found[:k]]) - explained[:k]).max() < 1e-12
    assert found[0].identity_error < 1e-9
    assert whitening.whiten(df).where("vec_id is null").count() == 5 * k


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [float("nan")])], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0])], schema)).collect()
    assert [(r.component, r.n, r.explained) for r in line] == [(1, 2, pytest.approx(1.0))] * 2


def test_deviation_is_exact_where_it_is_large(spark):
    rows = [(1, [2.0**33, 0.0]), (2, [-(2.0**33), 1.0]), (3, [1e9, 0.5]), (4, [1.0, 2.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()
    x = [[int(math.floor(64 * e)) for e in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    exact = {i: sum((4 * e - t) ** 2 for e, t in zip(v, s)) for (i, _), v in zip(rows, x)}
    assert {r.vec_id: r.deviation for r in found} == {i: d if d < 1 << 63 else None for i, d in exact.items()}


@pytest.mark.parametrize("kind", ["few", "equal", "spread", "tiny"])
def test_rank_one_updates(kind):
    """Values and vectors of every update, also with equal eigenvalues and entries that take no part."""
    draw = np.random.default_rng(4)
    x = {"few": draw.integers(-2, 3, (60, 12)), "equal": np.repeat(np.eye(8), 4, axis=0), "spread": draw.normal(size=(50, 9)) * 10.0 ** np.arange(-4, 5), "tiny": draw.normal(size=(30, 6)) * [1, 1, 1, 0, 1e-9, 1]}[kind].astype(float)
    found, half, other = (whitening.Spectrum(x.shape[1]) for _ in range(3))
    for i, row in enumerate(x, 1):
        found.add(row)
        (half if i % 3 else other).add(row)
        scatter = np.cov(x[:i].T, bias=True) * i if i > 1 else np.zeros((x.shape[1],) * 2)
        scale = max(1.0, np.abs(scatter).max())
        assert np.abs((found.vectors * found.values) @ found.vectors.T - scatter).max() < 1e-11 * scale
        assert np.abs(found.vectors.T @ found.vectors - np.eye(x.shape[1])).max() < 1e-11
    half.combine(other)
    assert half.n == len(x) and np.abs(half.mean - x.mean(axis=0)).max() < 1e-9 * max(1, np.abs(x).max())
    assert np.abs((half.vectors * half.values) @ half.vectors.T - scatter).max() < 1e-11 * scale


def test_runs_hold_every_output_once_with_those_before_it():
    draw = np.random.default_rng(6)
    docs = [np.append(draw.integers(1, 287, n), 0).astype(np.int16) for n in (0, 1, 31, 32, 33, 0, 200, 4)]
    runs, counted = language_model.runs_of([d.tobytes() for d in docs])
    outputs, before, _ = language_model.contexts([d.tobytes() for d in docs])
    c, length = language_model.CONTEXT, language_model.RUN
    assert runs.shape == (len(counted), c + length) and runs[:, c:][counted].tolist() == outputs.tolist()
    assert np.stack([runs[:, c - i : c - i + length][counted] for i in range(1, c + 1)], axis=1).tolist() == before.tolist()


def test_a_step_on_runs_is_the_step_on_their_outputs():
    draw, n = np.random.default_rng(7), 287
    runs, counted = language_model.runs_of([np.append(draw.integers(1, n, k), 0).astype(np.int16).tobytes() for k in (3, 70, 0, 40)])
    noise, log_noise = draw.integers(0, n, 48), np.log(np.full(n, 48 / n)).astype(np.float32)
    one, other = (language_model.Model(n, np.random.default_rng(8).normal(size=n * 49 + 120) / 3) for _ in range(2))
    squares = [language_model.Model(n, np.full(len(one.flat), 1e-4)) for _ in range(2)]
    c = language_model.CONTEXT
    before = np.stack([runs[:, c - i : c - i + language_model.RUN][counted] for i in range(1, c + 1)], axis=1)
    one.step_on_runs(runs, counted, noise, log_noise, squares[0])
    other.step(before, runs[:, c:][counted], noise, log_noise, squares[1])
    assert np.abs(one.flat - other.flat).max() < 1e-4 and np.abs(squares[0].flat - squares[1].flat).max() < 1e-6


@pytest.mark.parametrize("scale", [0.1, 3, 30])
def test_probabilities_of_any_size_of_scores(scale):
    """Also where odds, and the factors they are made of, pass single precision."""
    draw, n = np.random.default_rng(9), 40
    model = language_model.Model(n, draw.normal(size=n * 49 + 120) * scale)
    before, w = draw.integers(0, n, (1100, language_model.CONTEXT)).astype(np.int16), draw.integers(0, n, 1100).astype(np.int16)
    q = sum(model.context[before[:, i]].astype(float) * model.places[i] for i in range(language_model.CONTEXT))
    s = q @ model.target.T.astype(float) + model.bias
    want = s[np.arange(1100), w] - s.max(axis=1) - np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1))
    assert model.log_probabilities(before, w) == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_words_beyond_the_own_outputs_keep_an_exact_share_each(spark):
    """Every word is predicted, however many there are: own outputs, words of classes by their shares, and a share for unseen words sum to one."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i * 40 + j}{'abc'[j % 3]}" for j in range(40)) + " common") for i in range(60)], "doc_id long, text string")
    coded, vocabulary = language_model.encode(docs, 7, 2)
    assert vocabulary.distinct > 3 * vocabulary.outputs
    rows = coded.where("training").collect()
    first_class = 1 + len(vocabulary.own)
    shares = [vocabulary.class_words[k] * 2 / (n + vocabulary.class_words[k] + 1) + 1 / (n + vocabulary.class_words[k] + 1) for k, n in enumerate(vocabulary.class_tokens)]
    assert shares == pytest.approx([1] * len(shares))  # each word of a class came once here
    for r in rows[:5]:
        outputs = np.frombuffer(r.outputs, np.int16)
        in_class = outputs[outputs >= first_class] - first_class
        assert len(outputs) == 42 and r.share == pytest.approx(sum(math.log10(2 / (vocabulary.class_tokens[k] + vocabulary.class_words[k] + 1)) for k in in_class))
