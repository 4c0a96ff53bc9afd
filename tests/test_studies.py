"""Studies of methods against plain Python."""

import itertools
import random

import pytest

from strandloom import cli
from strandloom.operators import studies


def greedy(nodes, pairs, threshold):
    reps, out = [], {}
    for name, _ in sorted(nodes, key=lambda n: (-n[1], n[0])):
        out[name] = next((r for r in reps if pairs.get((min(r, name), max(r, name)), -1) >= threshold), name)
        if out[name] == name:
            reps.append(name)
    return out


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(11)
    nodes = [(f"g{i}" + " x" * (i % 3), r.randrange(4)) for i in range(24)]
    held = {m: {tuple(sorted(p)): float(r.randrange(80, 100)) for p in itertools.combinations([n for n, _ in nodes], 2) if r.random() < 0.4} for m in ("truth", "one", "two")}
    rows = [(m, a, b, x) for m, pairs in held.items() for (a, b), x in pairs.items()] + [(m, n, n, 100.0) for m in held for n, _ in nodes]
    return nodes, held, spark.createDataFrame(nodes, "name string, length long"), spark.createDataFrame(rows, "method string, a string, b string, ani double")


def test_averaged_pairs(spark):
    rows = [("a", "b", 0.9), ("b", "a", 0.8), ("a", "c", -1.0), ("c", "b", None), ("a", "a", 0.5), ("c", "a", 0.7), ("c", "a", 0.7)]
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    got = {(r.a, r.b): (round(r.ani, 6), r.directions) for r in studies.averaged_pairs(spark.createDataFrame(rows, "query string, reference string, ani double"), names, 100).collect()}
    assert got == {("a", "b"): (85.0, 2), ("a", "c"): (70.0, 2), ("a", "a"): (100.0, 0), ("b", "b"): (100.0, 0), ("c", "c"): (100.0, 0)}


def test_threshold_series(tables):
    nodes, held, names, pairs = tables
    want = {(m, t): greedy(nodes, p, t) for m, p in held.items() for t in (90.0, 96.0)}
    got = {}
    for r in studies.threshold_clusters(names, pairs, [90.0, 96.0]).collect():
        got.setdefault((r.method, r.threshold), {})[r.name] = r.representative
    assert got == want
    rows = {(r.method, r.threshold_ani): r for r in studies.threshold_series(names, pairs, "truth", [90.0, 96.0]).collect()}
    assert set(rows) == {(m, t) for m in ("one", "two") for t in (90.0, 96.0)}
    for (m, t), r in rows.items():
        mine, true = want[m, t], want["truth", t]
        together = [(mine[a] == mine[b], true[a] == true[b]) for a, b in itertools.combinations(sorted(mine), 2)]
        assert (r.pair_tp, r.pair_fp, r.pair_fn) == tuple(together.count(x) for x in ((True, True), (True, False), (False, True)))
        members = lambda c: {rep: {n for n in c if c[n] == rep} for rep in c.values()}
        x, y = members(mine), members(true)
        assert (r.n_clusters, r.truth_n_clusters, r.largest_cluster_size) == (len(x), len(y), max(map(len, x.values())))
        assert r.representative_overlap == len(set(x) & set(y)) and r.exact_truth_clusters_recovered == sum(x.get(rep) == y[rep] for rep in y)
        assert r.same_representative_genomes == sum(mine[n] == true[n] for n in mine)
        assert r.missing_averaged_pairs_with_self == 24 * 25 // 2 - len(held[m]) - 24 and r.n_edges_ge_threshold == sum(v >= t for v in held[m].values())


def test_split_recall(tables):
    _, held, names, pairs = tables
    rows = studies.split_recall(names.select("name"), pairs, "truth", [1, 3], 4, 3).collect()
    asked = {}
    for r in rows:
        asked.setdefault(r.repeat, set()).add(r.query)
    assert len(rows) == sum(map(len, asked.values())) * 2 * 2
    everyone = {n for n, _ in tables[0]}
    for r in rows:
        def top(method):
            near = [(-held[method][p], c) for c in everyone - asked[r.repeat] if (p := tuple(sorted((r.query, c)))) in held[method]]
            return {c for _, c in sorted(near)[: r.k]}

        assert (r.truth_size, r.method_size, r.recovered) == (len(top("truth")), len(top(r.method)), len(top("truth") & top(r.method)))
        assert r.recall == r.recovered / r.k and (r.truth_best is None) == (not top("truth"))


def test_empty_tables(tables):
    _, _, names, pairs = tables
    assert studies.threshold_series(names.limit(0), pairs.limit(0), "truth", [90.0]).collect() == []
    assert studies.split_recall(names.select("name"), pairs.limit(0), "truth", [1]).collect() == []


def test_study_command(spark, tmp_path):
    (tmp_path / "truth").write_text("genome1\tgenome2\tquery_length\tsubject_length\tident\nd/a.fa\tb.fa\t90\t80\t96\na.fa\tc.fa.gz\t95\t70\t80\nb.fa\tc.fa\t80\t70\t82\n")
    (tmp_path / "m").write_text("x/a.fa b.fa 0.97 1 2\nb.fa\ta.fa 0.95\n\nc.fa a.fa -1\n")
    cli.main(["study", f"{tmp_path}/truth", f"{tmp_path}/out", "--value", "ident", "--method", "m", f"{tmp_path}/m", "100", "--thresholds", "95", "--ks", "1", "--repeats", "6"], spark)
    row = spark.read.csv(f"{tmp_path}/out.clusters.tsv", sep="\t", header=True, inferSchema=True).collect()
    assert [(r.method, r.n_clusters, r.truth_n_clusters, r.pair_f1, r.missing_averaged_pairs_with_self) for r in row] == [("m", 2, 2, 1.0, 2)]
    assert spark.read.csv(f"{tmp_path}/out.recall.tsv", sep="\t", header=True).columns[:3] == ["method", "k", "n"]
