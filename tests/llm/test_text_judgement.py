import itertools
import os
import re

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm import decontamination, fixity, licenses, lines, quality, queries, simhash, toxicity
from strandloom.llm.common import one_text_an_id


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_decontamination_against_all_windows(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(30))
    items = [(11, passage), (2, "Short Item"), (3, None), (4, ""), (None, "lost item"), (5, "solo"), (2, "second text of two")]
    docs = [(1, passage), (2, "x " * 500 + passage[:60]), (3, "a short-item b"), (4, None), (5, ""), (6, "solo"), (6, "solo"), (None, passage), (7, " ".join(f"w{i}" for i in range(12))), (8, ("y " * 100 + passage + " ") * 40)]
    table = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, __row int, items string")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 12) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = []
    for i, t in docs:
        w, hit, own = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= {*range(k, k + n)}
                    own |= found
        want.append((str(i), len(w), len(hit), sorted(own), 0 < len(hit) and 20 * len(hit) >= len(w)))
    for size, piece in ((decontamination.BLOCK_BYTES, decontamination.PIECE_WORDS), (40, decontamination.PIECE_WORDS), (decontamination.BLOCK_BYTES, 4), (200, 1)):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        monkeypatch.setattr(decontamination, "PIECE_WORDS", piece)
        got = decontamination.scan(table, bench).collect()
        kept = decontamination.clean(table, bench)
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in got) == sorted(want)
        assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in decontamination.clean(table, bench).collect()) == sorted(w[0] for w in want if not w[4])
    assert decontamination.scan(table, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.scan(table.limit(0), bench).count() == 0


def test_clean_judges_each_row_by_its_own_text_in_any_number_of_blocks(spark, monkeypatch):
    passage, other = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    docs = [(None, passage), (None, "clean without id"), (None, None), (4, other), (4, "clean with the id of another"), (5, passage), (6, ""), (7, "clean"), (7, "clean")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage), (2, other), (3, "x y z")], "item_id long, text string")
    want = sorted(str(d) for d in docs if d[1] not in (passage, other))
    for size in (decontamination.BLOCK_BYTES, 40):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        assert sorted(str(tuple(r)) for r in decontamination.clean(table, bench).collect()) == want


def test_columns_that_clash_with_our_own_stay(spark):
    names = ["__words", "__hits", "__items", "__bad", "__gone", "__id", "__text", "__told", "__lines", "__dropped"]
    docs = spark.createDataFrame([(1, "one line that repeats\nalone", *names), (2, "One line that repeats \nother", *names)], ["doc_id", "text", *names])
    bench = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    for kept in (decontamination.clean(docs, bench), lines.dedup_lines(docs, keep_columns=True), simhash.drop_near_copies(docs)):
        assert kept.columns == docs.columns and all(r[2:] == tuple(names) for r in kept.collect()) and kept.count() == 2


def test_repeated_items_are_one_and_fill_no_block(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(30))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 1_000)
    texts = spark.createDataFrame([(1, passage), (2, "x" * 50)], "doc_id long, text string")
    repeated = spark.range(10_000).select(F.lit(4).cast("long").alias("item_id"), F.lit(passage).alias("text"))
    assert len(decontamination._probes(texts, repeated, 13, "item_id", "text")) == 1
    assert [(r.doc_id, r.n_hit) for r in decontamination.scan(texts, repeated).orderBy("doc_id").collect()] == [(1, 30), (2, 0)]
    several = spark.range(100).select(F.lit(4).cast("long").alias("item_id"), F.concat(F.lit(passage), F.lit(" z"), "id").alias("text"))
    probes = decontamination._probes(texts, several, 13, "item_id", "text")
    size = several.agg(F.sum(F.octet_length("text"))).first()[0]
    assert len(probes) == -(-size // 1_000) and max(len(p.value.shingles.vocabulary) for p in probes) <= 30 + 1_000 // len(passage) + 3
    assert decontamination.scan(texts, several).where("contaminated").count() == 1


def test_a_repeated_id_is_one_training_row(spark):
    many = spark.range(10_000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 5_000).alias("text"), F.lit("c").alias("y"))
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, label int")
    got = one_text_an_id(many.selectExpr("doc_id AS id", "text").join(labels.selectExpr("doc_id AS id", "label AS y"), "id")).collect()
    assert sorted((r.id, r.y) for r in got) == [(0, 0), (1, 1)]
    for module in (toxicity, quality):
        scores = module.score(many, module.train(many, labels, "label"))
        assert scores.count() == 10_000
    assert [r.held_out for r in spark.createDataFrame([(None,)], "doc_id long").select(queries._held_out(3, 1)).collect()] == [False]
    nulls = spark.createDataFrame([(1, 1, None), (1, 1, None), (2, 0, "")], "id long, y int, text string")
    assert sorted(map(tuple, one_text_an_id(nulls).collect())) == [(1, 1, None), (2, 0, "")]


def test_training_tables_with_nulls_and_repeated_ids(spark):
    docs = spark.createDataFrame([(i, "bad awful words" if i % 2 else "good plain words", "x") for i in range(40)] + [(3, None, "x"), (None, "text", "x")], "doc_id long, text string, id string")
    labels = [(i, i % 2, i % 2, 0) for i in range(40)] + [(3, 1, 1, 0), (3, 0, 0, 0), (None, 1, 1, 0), (5, None, None, 0), (99, 1, 1, 0)]
    for part in (labels, labels[:1], []):
        table = spark.createDataFrame(part, "doc_id long, toxic int, quality int, y int")
        for module, column in ((toxicity, "toxic"), (quality, "quality")):
            model = module.train(docs, table, column)
            got = [r["__score" if module is toxicity else "score"] for r in module.score(docs, model).collect()]
            assert len(got) == 42 and all(0 <= x <= 1 for x in got)


def test_license_scan(spark):
    notice = dict(licenses.TEMPLATES[::-1])["MIT"]
    docs = [(1, "some text before it\n" + notice.upper() + "\nand more text after it"), (2, notice), (3, None), (4, ""), (5, "Released under the"), (6, "word " * 5000), (2, notice), (None, notice)]
    got = licenses.scan(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, line string")).collect()
    assert sorted((str(r.doc_id), r.line, r.license, r.dice) for r in got) == [("1", 1, "MIT", 1.0), ("2", 0, "MIT", 1.0), ("2", 0, "MIT", 1.0), ("None", 0, "MIT", 1.0)]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    header = dict(licenses.TEMPLATES)["Apache-2.0"].split(" ")
    wrapped = "# " + " ".join(header[:9]) + "\n#   " + " ".join(header[9:])
    long = {1: wrapped, 2: "A file\n \t\n" + wrapped + "\n\ncode follows\nhere", 3: "code\n" + wrapped + "\ncode", 4: "\n\n" + wrapped + "\n\n", 5: " ".join(header) + " word" * 100}
    got = licenses.scan(spark.createDataFrame([*long.items()], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.line, r.n_lines) for r in got if r.dice == 1) == [(1, -1, 2), (2, 2, 2), (4, -1, 6), (4, 2, 2)]
    sets = lambda t: (lambda w: {*zip(w, w[1:])})(re.sub(r"[\W_]+", " ", t.lower()).strip().split(" "))
    texts = ["licensed under the apache license version two", "Licensed under CC BY-NC 4.0", "this work is licensed under the gnu general public license, version 3 or 2"]
    got = {(r.doc_id, r.template): r.dice for r in licenses.scan(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), threshold=0.6).collect()}
    want = {(i, k): round(2 * len(sets(t) & sets(n)) / (len(sets(t)) + len(sets(n))), 9) for i, t in enumerate(texts) for k, (_, n) in enumerate(licenses.TEMPLATES)}
    assert got == {k: v for k, v in want.items() if v >= 0.6}


def test_whole_license_texts(spark):
    import textwrap

    whole = {name: text for name, text in licenses.TEMPLATES if len(text.split()) > 100}
    files = {i: f"Copyright (c) 2020 Some One\n\n{textwrap.fill(text, 76)}\n" for i, text in enumerate(whole.values())}
    head = "\n".join(f"// {x}" for x in textwrap.wrap(dict(licenses.TEMPLATES[::-1])["Apache-2.0"], 60))
    files |= {90: textwrap.fill(whole["MIT"], 70) + "\n\n" + "def f(x):\n    return x\n\n" * 400, 91: "x = 1\n\n" + head + "\n\nimport y\n" * 300}
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame([*files.items()], "doc_id long, text string")).where("n_lines > 1").collect()}
    assert {*enumerate(whole)} | {(90, "MIT")} <= got


def test_fixity_finds_what_differs(spark):
    rows = [(i, f"http://x/{i}", "é" * (i % 7) + "<p>") for i in range(0, 3000, 3)] + [(None, "http://n", None), (6, "http://x/6", "twice")]
    one = spark.createDataFrame(rows, "page_id long, url string, html string")
    changed = spark.createDataFrame([(i, u, "!" if i in (30, 2400) else h) for i, u, h in rows if i != 900] + [(50_000, "u", "h")], one.schema)
    got = {(r.id, r.status) for r in fixity.audit(fixity.manifest(one), fixity.manifest(changed)).collect()}
    assert got == {(30, "changed"), (2400, "changed"), (900, "missing"), (50_000, "extra")}
    assert fixity.audit(fixity.manifest(one), fixity.manifest(one)).count() == 0
    assert fixity.audit(fixity.manifest(one), fixity.manifest(one.limit(0))).count() == len(rows) - 1
    assert fixity.audit(fixity.manifest(one.limit(0)), fixity.manifest(one.limit(0))).count() == 0


def test_fixity_of_null_negative_and_repeated_ids(spark):
    rows = [(None, f"u{i % 40}", "body", "x") for i in range(200)] + [(-i, "u", f"b{i}", "x") for i in range(1, 1500)] + [(7, "same", f"v{i % 3}", "x") for i in range(30)] + [(8, "long", "z" * 300_000, "x")]
    schema = "page_id long, url string, html string, hash string"
    one = spark.createDataFrame(rows, schema)
    other = spark.createDataFrame([*rows[1:200], *rows[201:-2], rows[-1]][::-1], schema)  # one of five equal null rows, id -1 and one of ten equal rows of id 7 go
    got = sorted((str(r.id), r.status) for r in fixity.audit(fixity.manifest(one), fixity.manifest(other)).collect())
    assert got == [("-1", "missing"), ("7", "changed"), ("None", "changed")]
    assert fixity.audit(fixity.manifest(one), fixity.manifest(spark.createDataFrame(rows[::-1], schema))).count() == 0


def test_marginals_against_all_paths():
    r = np.random.default_rng(0)
    scores, lengths, trans = r.normal(size=(5, 4)), np.array([4, 2, 1, 3, 4]), r.normal(size=(2, 2))
    got, moves = toxicity._marginals(scores, lengths, trans)
    want = np.zeros((2, 2))
    for i, n in enumerate(lengths):
        total, states, steps = 0.0, np.zeros(4), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=n):
            weight = np.exp(sum(scores[i, t] * path[t] for t in range(n)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            total += weight
            states[:n] += weight * np.array(path)
            for a, b in zip(path, path[1:]):
                steps[a, b] += weight
        assert np.allclose(got[i], states / total)
        want += steps / total
    assert np.allclose(moves, want)


def synthetic(n, seed):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = ["".join(r.choice(list("abcdefgh"), r.integers(2, 7))) for _ in range(r.integers(20, 80))]
        bad = int(r.random() < 0.3)
        for at in r.integers(0, len(words), 3 if bad else 0):
            words[at] = "zork" + words[at]
        out.append((i, " ".join(words), bad))
    return out


def test_tagger_learns_and_points(spark):
    train, held = synthetic(300, 1), synthetic(120, 2)
    tagger = toxicity.fit([t for _, t, _ in train], [y for *_, y in train])
    rows = [(i, t, "c") for i, t, _ in held] + [(900, None, "c"), (901, "", "c"), (902, "1234 !", "c"), (902, "zorkabc", "c")]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score string"), tagger).collect()
    right = [(r["__score"] >= 0.7) == bool(y) for r, (_, _, y) in zip(sorted(got, key=lambda r: r.doc_id), held)]
    assert np.mean(right) > 0.95 and all(0 <= r["__score"] <= 1 for r in got)
    for r in got:
        for s in r["__spans"]:
            assert "zork" in r.text[s["start"] : s["end"]]
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), tagger).count() == 0
    assert toxicity.fit([], []).score(np.zeros(0)) == 0.0 and toxicity.fit(["a"], [1]).score(np.zeros(1)) == 1.0


def test_tagger_is_fitted_in_a_task_and_is_the_same(spark, monkeypatch):
    rows = synthetic(200, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (None, "zorkabc")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(900, 0), (901, 1)], "doc_id long, toxic int")
    got, want = toxicity.train(docs, labels), toxicity.fit([*[t for _, t, _ in rows], None], [*[y for *_, y in rows], 0])
    assert got.weights and got.weights == want.weights and got.bias == want.bias and (got.scale == want.scale).all() and (got.trans == want.trans).all()
    none = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.train(none, labels).share == toxicity.train(docs, labels.where("false")).share == 0
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: toxicity.Tagger({}, 0.0, np.zeros((2, 2)), np.zeros(0), os.getpid()))
    assert toxicity.train(docs, labels).share not in (0, os.getpid())  # the driver's process fits nothing


def test_copies_of_a_toxic_text_do_not_make_its_words_toxic():
    r = np.random.default_rng(5)
    word = lambda: "".join(r.choice(list("abcdefgh"), 6))
    copy = [word() for _ in range(40)]
    docs, toxic = [], []
    for k in range(200):
        bad = k % 2
        docs.append([*copy, "zorkabc"] if bad and k < 100 else [word() for _ in range(40)] + (["zork" + word()] if bad else []))
        toxic.append(bad)
    told = [w for words, own in zip(docs, toxicity.label_tokens(docs, toxic)) for w, x in zip(words, own) if x]
    assert told and all(w.startswith("zork") for w in told)


def test_rules_and_their_column_agree(spark):
    good = [(i, " ".join(f"word{j % 17}x{i}" for j in range(40)) + ".", 1) for i in range(120)]
    bad = [(200 + i, " ".join(f"W{j}$$$" for j in range(40)), 0) for i in range(60)]
    x = np.array([quality.statistics(t) for _, t, _ in good + bad])
    y = np.array([q for *_, q in good + bad], float)
    model = quality.fit(x, y)
    rows = [(i, t, 1.0) for i, t, _ in good[:20] + bad[:20]] + [(900, None, 1.0), (901, "", 1.0), (901, "\n\n", 1.0)]
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string, score double"), model).collect()
    assert len(got) == len(rows)
    for r in got:
        stats = np.array([[r[f"__{s}"] for s in quality.STATISTICS]])
        z = model.intercept + sum(w * quality.holds(stats, rule)[0] for rule, w in model.rules)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 and (r.doc_id >= 900 or (r.score > 0.7) == (r.doc_id < 200))
    assert 0 < len(model.rules) and quality.fit(x[:0], y[:0]).rules == []


def test_lasso_drops_what_does_not_help():
    r = np.random.default_rng(3)
    x = (r.random((400, 6)) < 0.5).astype(float)
    y = (x[:, 0] + 0.2 * r.random(400) > 0.6).astype(float)
    w, _ = quality.fit_lasso(x, y, strength=0.05)
    assert abs(w[0]) > 0.5 and (abs(w[1:]) < 1e-3).all()
