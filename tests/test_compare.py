import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandloom.config import Config
from strandloom.operators import analytics, intervals, order, reduce, seeds, sketch
from strandloom.plans.compare import compare, compare_split, map_fragments, query_sketches, reference_index
from strandloom.plans.report import StageReport, merged
from strandloom.sources import fastx, sinks

SEQS = "genome string, contig long, name string, seq string"
SMALL = {"kmer": 12, "fragment": 1000, "min_identity": 70, "min_fraction": 0, "window": 10}


def dna(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def genomes(spark):
    g, r = dna(6000, 1), random.Random(2)
    near = "".join(c if r.random() > 0.03 else r.choice("ACGT") for c in g)
    q = spark.createDataFrame([("q", 0, "q", g), ("q", 1, "short", g[:300])], SEQS)
    return q, spark.createDataFrame([("same", 0, "a", g), ("near", 0, "b", near), ("turned", 0, "c", turned(near)), ("other", 0, "d", dna(6000, 3))], SEQS)


@pytest.mark.parametrize("more", [{}, {"optimal_chain": True, "model": "binomial"}, {"mode": "exact", "hash": "murmur3"}, {"mode": "minmer"}])
def test_identity_of_known_genomes(genomes, more):
    found = {r.reference: r for r in compare(*genomes, Config(**SMALL, **more)).collect()}
    assert {"same", "near", "turned"} <= set(found)
    assert "other" not in found or found["other"].ani < 85
    assert found["same"].ani > 99.9 and found["same"].mapped == found["same"].fragments == 6
    assert 96 < found["near"].ani < 98 and 96 < found["turned"].ani < 98


def test_split_gives_the_same(genomes):
    config = Config(**SMALL)
    assert compare_split(*genomes, config, 2).collect() == compare(*genomes, config).collect()
    for parts, more in ((1, {}), (9, {}), (2, {"ignore_top_percent": 1})):
        with pytest.raises(ValueError):
            compare_split(*genomes, Config(**SMALL, **more), parts)


def test_fraction_of_the_shorter_genome(spark):
    pairs = spark.createDataFrame([("q", "a", 90.0, 2), ("q", "b", 90.0, 1)], "query string, genome string, ani double, mapped long")
    lengths = spark.createDataFrame([("q", 5000), ("a", 9000), ("b", 9000)], "genome string, length long")
    assert [r.genome for r in reduce.enough_mapped(pairs, lengths, 1000, 0.4).collect()] == ["a"]


def test_ties_of_best_mappings(spark):
    rows = [("q", 0, "g", 1, 10, 90.0), ("q", 0, "g", 2, 5, 90.0), ("q", 0, "g", 2, 7, 90.0), ("q", 1, "g", 2, 8, 90.0)]
    found = reduce.best_per_fragment(spark.createDataFrame(rows, "query string, frag long, genome string, contig long, start long, identity double"))
    assert sorted((r.frag, r.contig, r.start) for r in found.collect()) == [(0, 2, 7), (1, 2, 8)]
    assert [r.frag for r in reduce.best_per_bin(found, 1000).collect()] == [1]


def test_threshold_takes_ties_along(spark):
    rows = spark.createDataFrame([(h, p) for h, n in enumerate([5, 5, 3, 1]) for p in range(n)], "hash long, pos long")
    assert seeds.frequency_threshold(seeds.frequencies(rows), 25).first()[0] == 5
    assert {r.hash for r in seeds.without_hot(rows, 25).collect()} == {2, 3}
    assert seeds.without_hot(rows, 0) is rows and seeds.without_hot(rows, 10).count() == 14


def test_intervals(spark):
    rows = spark.createDataFrame([("a", 1, 3), ("a", 4, 6), ("a", 8, 9), ("a", 2, 2), ("b", 1, 1)], "k string, start long, end long")
    assert sorted(map(tuple, intervals.merge(rows, ["k"]).collect())) == [("a", 1, 6), ("a", 8, 9), ("b", 1, 1)]
    assert dict(map(tuple, intervals.coverage(rows, ["k"]).collect())) == {"a": 8, "b": 1}
    assert sorted(map(tuple, intervals.deep(rows, ["k"], 2).collect())) == [("a", 2, 2)]
    assert intervals.merge(rows.limit(0), ["k"]).collect() == []


def test_range_joins_against_all_pairs(spark):
    r = random.Random(4)
    a = [(i, s, s + r.randrange(60)) for i in range(30) for s in [r.randrange(300)]]
    p = [(i, r.randrange(400)) for i in range(60)]
    left = spark.createDataFrame([("k", *x) for x in a], "k string, i int, start long, end long")
    points = spark.createDataFrame([("k", *x) for x in p], "k string, j int, pos long")
    got = sorted((x.i, x.j) for x in intervals.points_within(left, points, ["k"], 32).collect())
    assert got == sorted((i, j) for i, s, e in a for j, at in p if s <= at <= e)
    right = left.select("k", left.i.alias("j"), left.start.alias("other_start"), left.end.alias("other_end"))
    got = sorted((x.i, x.j) for x in intervals.overlapping(left, right, ["k"], 32).collect())
    assert got == sorted((i, j) for i, s, e in a for j, t, f in a if s <= f and t <= e)


def test_fragments(spark):
    seqs = spark.createDataFrame([("g", 0, "a", "A" * 25), ("g", 1, "b", "C" * 9), ("g", 2, "c", "G" * 10)], SEQS)
    assert sorted((r.contig, r.frag, r.global_start, r.seq[0]) for r in sketch.fragments(seqs, 10).collect()) == [(0, 0, 0, "A"), (0, 1, 10, "A"), (2, 2, 34, "G")]


def test_fastx(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nacgt\nRN\n>two\n\nGG\n")
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(b"@r1\nACGT\n+\nIIII\n"))
    got = sorted((r.name, r.seq, r.seq_raw) for r in fastx.read_sequences(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fq.gz")]).collect())
    assert got == [("one x", "ACGTNN", "acgtRN"), ("r1", "ACGT", "ACGT"), ("two", "GG", "GG")]
    (tmp_path / "list").write_text("# c\n\n a.fa \nb.fa\n")
    assert fastx.read_path_list(spark, str(tmp_path / "list")) == ["a.fa", "b.fa"]
    (tmp_path / "none").write_text("#\n")
    with pytest.raises(ValueError):
        fastx.read_path_list(spark, str(tmp_path / "none"))
    (tmp_path / "ani").write_text("a b 90 1 2\n\na\tb\t91\nc d 80\n")
    assert sorted(map(tuple, fastx.read_ani_table(spark, str(tmp_path / "ani")).collect())) == [("a", "b", 91.0), ("c", "d", 80.0)]


@pytest.mark.parametrize("parts", [1, 5])
def test_phylip_lines(spark, tmp_path, parts):
    """Lines against cells looked up one by one, in the files' order; names that aren't listed are left out."""
    r = random.Random(7)
    names = [f"g{i:02d}/x" for i in range(23)]
    r.shuffle(names)
    ani = {(a, b): r.uniform(70, 100) for a in [*names, "other"] for b in [*names, "other"] if r.random() < 0.3} | {(names[2], names[5]): 0.0}
    rows = spark.createDataFrame([(a, b, v) for (a, b), v in ani.items()], "query string, reference string, ani double").repartition(parts)
    lines = sinks.phylip_lines(rows, spark.createDataFrame(list(enumerate(names)), "row long, genome string"), 3)
    want = [str(len(names))]
    for i, name in enumerate(names):
        both = [[ani[p] for p in ((name, other), (other, name)) if p in ani] for other in names[:i]]
        want.append("\t".join([name, *(f"{sum(v) / len(v):.3f}" if v and sum(v) > 0 else "NA" for v in both)]))
    sinks.write_ordered(lines, "row", str(tmp_path / "m"))
    assert [line for f in sorted((tmp_path / "m").glob("part-*")) for line in f.read_text().splitlines()] == want


@pytest.mark.parametrize("gap, width", [(0, 7), (3, 7), (20, 7), (1, 80)])
def test_pseudochromosome_equals_the_naive_text(spark, tmp_path, gap, width):
    """Contigs shorter than a line, empty ones, and ones that end where a line does."""
    r = random.Random(gap)
    seqs = [dna(r.choice([0, 1, 2, 7, 14, 50, 333]), i) for i in range(60)]
    placed = spark.createDataFrame([(i + 1, s) for i, s in enumerate(seqs)], "order int, seq string").repartition(4)
    sinks.write_ordered(sinks.pseudochromosome(placed, gap, width, "x"), "line", str(tmp_path / "p"))
    whole = ("N" * gap).join(seqs)
    assert "".join(f.read_text() for f in sorted((tmp_path / "p").glob("part-*"))) == "".join(line + "\n" for line in [">x", *(whole[i : i + width] for i in range(0, len(whole), width))])


def test_running_sums(spark):
    """Sums over the rows before, of keys in many ranges and of keys that share one."""
    r = random.Random(8)
    rows = [("hot", i, r.randrange(100)) for i in range(500)] + [(f"k{i % 40}", i, r.randrange(100)) for i in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        df = spark.createDataFrame(rows, "k string, i long, v long").repartition(3)
        got = sorted(map(tuple, analytics.running_sums(df, ["k"], ["i"], {"sum": F.col("v"), "n": F.lit(1)}).collect()))
        numbers = {x.i: x.n for x in analytics.numbered(df.where("k = 'hot'"), "i", "n").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted((k, i, v, sum(x for a, j, x in rows if a == k and j < i), sum(a == k and j < i for a, j, x in rows)) for k, i, v in rows)
    assert numbers == {i: i for i in range(500)}


def test_stage_report(spark):
    """Counters equal recounts of the tables; stages and queries of parts add up."""
    r = random.Random(4)
    dna = "".join(r.choices("ACGT", k=3_000))
    seqs = lambda rows: spark.createDataFrame(rows, "genome string, contig long, name string, seq string")
    queries = seqs([("q1", 0, "a", dna[:1_200]), ("q2", 0, "b", "".join(r.choices("ACGT", k=600)))])
    references = seqs([("r1", 0, "c", dna), ("r2", 0, "d", dna[500:2_000]), ("r3", 0, "e", "".join(r.choices("ACGT", k=900)))])
    config = Config(kmer=12, fragment=300, window=8, min_fraction=0.0, reference_size=10_000)
    report = StageReport()
    found = compare(queries, references, config, report).collect()
    assert found == compare(queries, references, config).collect()
    stages = report.stages()
    index, sketches = reference_index(references, config.checked()).count(), query_sketches(queries, config.checked())[1]
    mappings = map_fragments(queries, references, config).collect()
    assert (stages["reference"]["rows"], stages["query"]["rows"], stages["mappings"]["rows"]) == (index, sketches.count(), len(mappings))
    assert stages["mappings"]["most_shared"] == max(m.shared for m in mappings) and stages["candidates"]["rows"] >= len(mappings) > 0
    assert all(s["seconds"] > 0 for name, s in stages.items() if name != "hits") and report.summary().count("\n") == len(stages) - 1
    each = {x.query: x for x in report.queries().collect()}
    assert {q: x.mappings for q, x in each.items()} == {q: sum(m["query"] == q for m in mappings) for q in ("q1", "q2")}
    assert sum(x.minimizers for x in each.values()) == sketches.count() and each["q2"].mappings == 0
    rows = {(x.section, x.name, x.metric): x.value for x in report.rows(spark).collect()}
    assert rows["query", "q1", "mappings"] == each["q1"].mappings and rows["stage", "hits", "rows"] == stages["hits"]["rows"]
    parts = StageReport()
    compare_split(queries, references, config, 2, parts).collect()
    assert parts.stages()["reference"]["rows"] == index and {x.query: x.mappings for x in parts.queries().collect()} == {q: x.mappings for q, x in each.items()}
    one, other = (spark.createDataFrame(rows, "path string, n long, top long") for rows in ([("a", 1, 5), ("b", 2, 1)], [("a", 10, 3), ("c", 4, 4)]))
    assert sorted(map(tuple, merged([one, other], "path", ("top",)).collect())) == [("a", 11, 5), ("b", 2, 1), ("c", 4, 4)]


def test_greedy_clusters_against_the_definition(spark):
    r = random.Random(5)
    nodes = [(f"n{i}", r.randrange(5)) for i in range(40)]
    edges = [(a[0], b[0]) for a in nodes for b in nodes if a < b and r.random() < 0.08]
    links = {frozenset(e) for e in edges}
    reps, want = [], {}
    for name, _ in sorted(nodes, key=lambda n: (-n[1], n[0])):
        first = next((x for x in reps if frozenset((x, name)) in links), None)
        want[name] = first or name
        if not first:
            reps.append(name)
    got = analytics.greedy_clusters(spark.createDataFrame(nodes, "name string, length long"), spark.createDataFrame(edges, "a string, b string"))
    assert dict(map(tuple, got.collect())) == want


def test_order(spark):
    ref = dna(20_000, 6)
    rows = [("c", 0, "mid", ref[9000:12000]), ("c", 1, "left", ref[2000:4500]), ("c", 2, "back", turned(ref[15000:18000])), ("c", 3, "none", dna(1500, 9))]
    contigs, refs = spark.createDataFrame(rows, SEQS), spark.createDataFrame([("r", 0, "refA", ref)], SEQS)
    placed = order.placements(contigs, order.alignments(contigs, refs, Config(window=10)))
    got = placed.orderBy("order").collect()
    assert [(r.name, r.strand, r.status) for r in got] == [("left", "+", "placed"), ("mid", "+", "placed"), ("back", "-", "placed"), ("none", "+", "unplaced")]
    assert got[2].seq == ref[15000:18000] and abs(got[1].start - 9000) < 30
    whole = ("N" * 10).join(r.seq for r in got)
    lines = sinks.pseudochromosome(placed, 10).orderBy("line").collect()
    assert lines[0].value == ">pseudochromosome_ordered_from_query_contigs" and "\n".join(r.value for r in lines[1:]) == "\n".join(whole[i : i + 80] for i in range(0, len(whole), 80))
    assert sinks.fasta_lines(placed).first()[0].startswith(">0001_left ref=refA:")
    assert sinks.paf_lines(placed, refs).count() == 3


def test_order_over_several_references(spark):
    r = random.Random(3)
    contigs = [("c", i, f"n{i}", "A" * r.randrange(1, 5)) for i in range(60)]
    found = [(i, f"n{i}", len(s), f"r{r.randrange(5)}", at := r.randrange(8), at + 3, "+", 3, 3, 60) for _, i, _, s in contigs if i % 4]
    table = spark.createDataFrame(found, "contig int, name string, length int, reference string, start int, end int, strand string, matches int, aligned int, mapq int")
    got = order.placements(spark.createDataFrame(contigs, "genome string, contig int, name string, seq string"), table).collect()
    place = {f[1]: f for f in found}
    key = lambda c: (place[c[2]][3:6] if c[2] in place else ("~", 0, 0), -len(c[3]), c[2])
    assert [x.name for x in sorted(got, key=lambda x: x.order)] == [c[2] for c in sorted(contigs, key=key)] and sorted(x.order for x in got) == [*range(1, 61)]
