"""The pipeline's stages on a small corpus with known cases, each judged on what the stage before kept."""

import random

import pytest

import corpus_pipeline as pipeline
from strandloom.llm import packing

WORDS = ["".join(random.Random(i).choices("abcdefghij", k=3 + i % 6)) for i in range(900)]


def prose(n, seed, per_line=12):
    r = random.Random(seed)
    words = r.choices(WORDS, k=n)
    return "\n".join(" ".join(words[i : i + per_line]) for i in range(0, n, per_line))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("tables"))
    docs, labels = [], []
    for i in range(120):
        text = prose(120, i).split(" ")
        bad = i % 4 == 0
        for at in range(3 if bad else 0):
            text[10 + 20 * at] = f"zork{text[10 + 20 * at]}"
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    toxic = {i for i, _, y in labels if y}
    passage = prose(40, 999, 40)
    near = docs[1][1].replace("\n", " ").split(" ")
    near[50] = "changed"
    docs += [(200, docs[2][1]), (201, " ".join(near)), (202, passage + "\n" + prose(30, 500)), (203, prose(3000, 501) + "\n" + passage.split(" ")[0]), (204, None), (205, ""), (206, docs[3][1].split("\n")[0] + "\n" + prose(100, 502))]
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "kept") for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, piece string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, {i: t for i, t in docs}, toxic


def test_stages(spark, corpus):
    sf, texts, toxic = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert texts.keys() - kept["toxicity"].keys() == toxic
    lines = kept["line dedup"]
    assert lines.keys() == kept["toxicity"].keys() and lines[200].text == "" and lines[200].n_chars == 0
    assert lines[206].text == texts[206].split("\n", 1)[1] and lines[2].text == texts[2] and lines[204].text is None
    near = kept["near dedup"]
    assert lines.keys() - near.keys() == {201, 204, 205}  # 200, which is empty now, stands for the empty ones
    assert near.keys() - kept["decontamination"].keys() == {202}
    pieces = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {p.doc_id for p in pieces} == kept["decontamination"].keys()
    whole = sorted((p.doc_id, p.piece, p.length) for p in pipeline.run(spark, sf).collect())
    assert whole == sorted((p.doc_id, p.piece, p.length) for p in pieces)
    assert sum(p.length for p in pieces) == sum(r.length for r in packing.pieces(docs, pipeline.public_tokenizers.path("word_bpe_49k.json")).collect())
