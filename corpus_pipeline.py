"""From raw documents to packed training sequences, in stages over all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import decontamination, lines, packing, simhash, toxicity
from strandloom.llm.common import materialized, table, unused
from strandloom.session import ship

TOXIC_FROM = 0.7
#: SQL can't express the tagger, the tokenizer and the packing: tests hold the stages against plain Python.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger, fitted on the labelled rows among them, does not reject."""
    tagger = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic")
    names = unused(docs, "__score"), unused(docs, "__spans")
    return toxicity.score(docs, tagger, score_col=names[0], spans_col=names[1]).where(F.col(names[0]) < TOXIC_FROM).drop(*names)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten characters or more stay in the first document that holds them; a document that loses all of its text stays, empty."""
    kept = lines.dedup_lines(docs, min_chars=10, keep_columns=True)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the least id, of each class of equal or similar texts."""
    return simhash.drop_near_copies(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in 20 lies in a passage of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), window=13, share=20)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a training sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
