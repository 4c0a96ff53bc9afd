import random

from strandloom import cli
from strandloom.operators import sketch
from strandloom.sources import fastx, index
from strandloom.streaming import arrivals


def dna(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def lines(folder):
    return [line for part in sorted(folder.glob("part-*")) for line in part.read_text().splitlines()]


def test_compare_files(spark, tmp_path):
    one = dna(6000, 1)
    for name, seq in (("a.fa", one), ("b.fa", one[:3000] + dna(3000, 2))):
        (tmp_path / name).write_text(f">{name}\n{seq}\n")
    (tmp_path / "list").write_text(f"{tmp_path}/a.fa\n{tmp_path}/b.fa\n")
    small = ["--fragLen", "1000", "--minFraction", "0", "-k", "14", "--windowSize", "9"]
    cli.main(["compare", "-q", f"{tmp_path}/a.fa", "--rl", f"{tmp_path}/list", "-o", f"{tmp_path}/out", "--matrix", "--visualize", *small], spark)
    got = [line.split("\t") for line in lines(tmp_path / "out")]
    assert sorted((q[-4:], r[-4:], m, n) for q, r, _, m, n in got) == [("a.fa", "a.fa", "6", "6"), ("a.fa", "b.fa", "3", "6")] and float(got[1][2]) > 99.9
    matrix = lines(tmp_path / "out.matrix")
    assert matrix[0] == "2" and float(matrix[2].split("\t")[1]) > 99
    assert sum(line.split("\t")[1].endswith("a.fa") for line in lines(tmp_path / "out.map")) == 6


def test_compare_exact_and_timing(spark, tmp_path):
    one = dna(6000, 1)
    (tmp_path / "a.fa").write_text(f">a\n{one}\n")
    (tmp_path / "b.fq").write_text(f"@b\n{one[:4000]}\n+\n{'I' * 4000}\n")
    for more in ([], ["--minmer"]):
        cli.main(["compare-exact", "-q", f"{tmp_path}/a.fa", "-r", f"{tmp_path}/b.fq", "-o", f"{tmp_path}/out", "--fragLen", "1000", "--timing", f"{tmp_path}/t", *more], spark)
        (ani, *counts), = [line.split("\t")[2:] for line in lines(tmp_path / "out")]
        assert float(ani) > 99.9 and counts == ["4", "6"]
        told = {tuple(line.split("\t")[:3]): float(line.split("\t")[3]) for line in lines(tmp_path / "t") if not line.startswith("section")}
        assert told["stage", "mappings", "rows"] >= 4 and told["stage", "query", "seconds"] > 0
        assert [v for (section, name, metric), v in told.items() if section == "query" and metric == "mappings"] == [told["stage", "mappings", "rows"]]


def test_best_hits_of_a_table(spark, tmp_path):
    row = lambda q, s, score, covers: f"{q}\t{s}\t99.5\t100\t0\t0\t1\t100\t5\t104\t0.0\t{score}\t100\t900\t{covers}\n"
    (tmp_path / "b.tsv").write_text(row("frag_3|qstart=7|qend=9", "s1", 50, 80) + row("frag_3|qstart=7|qend=9", "s2", 70, 95) + row("frag_4|qstart=1|qend=2", "s3", 90, 10))
    cli.main(["hits", f"{tmp_path}/b.tsv", f"{tmp_path}/best", "--coverage", "50"], spark)
    head, *got = [line.split("\t") for line in lines(tmp_path / "best")]
    assert [dict(zip(head, x))["sseqid"] for x in got] == ["s2"] and dict(zip(head, got[0]))["fragment"] == "3"


def test_order_and_agree(spark, tmp_path):
    ref = dna(12_000, 3)
    (tmp_path / "ref.fa").write_text(f">chr\n{ref}\n")
    (tmp_path / "q.fa").write_text(f">two\n{ref[7000:11000]}\n>one\n{ref[500:5000]}\n")
    cli.main(["order", f"{tmp_path}/ref.fa", f"{tmp_path}/q.fa", f"{tmp_path}/o"], spark)
    assert [line.split("\t")[1] for line in lines(tmp_path / "o.tsv") if line[0] in "12"] == ["one", "two"]
    assert lines(tmp_path / "o.fasta")[0].startswith(">0001_one") 
    assert sorted(line.split("\t")[0] + " " + line.split("\t")[-1][:5] for line in lines(tmp_path / "o.paf")) == ["one cg:Z:", "two cg:Z:"]
    (tmp_path / "x").write_text("a b 90\nb a 92\nc d 80\n")
    (tmp_path / "y").write_text("a b 91\nc d 79\ne f 70\n")
    cli.main(["agree", f"{tmp_path}/x", f"{tmp_path}/y", "--summary", f"{tmp_path}/s", "--joined", f"{tmp_path}/j", "--average-pairs"], spark)
    found = {line.split("\t")[2]: line.split("\t")[3] for line in lines(tmp_path / "s")}
    assert (float(found["n"]), float(found["max_abs"]), float(found["other_only"])) == (2, 1, 1) and len([x for x in lines(tmp_path / "j") if x[0] != "q"]) == 2


def test_arrivals_against_a_kept_index(spark, tmp_path):
    refs = spark.createDataFrame([(f"r{i}", 0, "x", dna(2000, i)) for i in range(3)], arrivals.SCHEMA)
    table = "index_of_tests"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    index.write_index(sketch.minimizers(refs.withColumnRenamed("genome", "reference"), ["reference"], 14, 8), table, 4)
    held = index.read_index(spark, table)
    spark.createDataFrame([("q", 0, "q", dna(2000, 1)[500:1500])], arrivals.SCHEMA).write.parquet(f"{tmp_path}/in")
    hits = arrivals.arriving_hits(arrivals.arriving_sequences(spark, f"{tmp_path}/in"), held, 14, 8)
    arrivals.count_into(hits, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    spark.sql(f"DROP TABLE {table}")
    assert [(r.genome, r.reference) for r in got] == [("q", "r1")] and got[0].shared > 0.9 * got[0].sketch_size


def test_genomes_keep_the_order_of_the_lists(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    genomes = {f"file:{tmp_path}/{n}.fa" for n in "abcd"}
    got = fastx.as_listed(genomes, [f"{tmp_path}/c.fa", "b.fa", f"file://{tmp_path}/c.fa"])
    assert got == [f"file:{tmp_path}/{n}.fa" for n in "cbad"]
    assert fastx.as_listed({"s3://one/x.fa"}, ["s3://one/x.fa"]) == ["s3://one/x.fa"] and fastx.as_listed([], ["a"]) == []
