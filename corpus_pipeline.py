"""The corpus pipeline: documents judged, freed of shared lines, deduplicated, mixed and encoded.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before has kept. All
stages but the last return the columns of documents; ``run`` writes each result and reads it again.
A document that line dedup leaves empty stays a row until near-dedup finds it a copy of the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railloom.llm import bpe, line_dedup, mixing, order_minhash, quality
from railloom.llm.registry import vocabulary
from railloom.workspace import Workspace, close_opened, importable, opened


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity their language's trusted text allows.

    Null and empty texts stay; repeated rows are judged alike; no columns but the documents' own come out.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels, Workspace(spark, "stage1"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that others share; n_chars follows the text.

    A null text becomes empty. Rows that share an id are one document; of equal lines those in the
    largest id stay, all of them. Other columns are left alone.
    """
    made = line_dedup.without_shared_lines(docs, Workspace(spark, "stage2"))
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return made


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id.

    Of repeated rows and of rows that share the smallest id one stays; texts without words are one
    group. All columns are left alone.
    """
    return order_minhash.keep_one_of_each(docs, Workspace(spark, "stage3"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it: not at all, once or twice.

    Repeated rows count each for itself; a null source is one. All columns are left alone.
    """
    return mixing.repeated(docs, Workspace(spark, "stage4"), lambda i: (5, 2, 1)[i % 3], share=1.5, most_epochs=2.0)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix encoded and decoded again: doc_id, lengths and digests of each of its rows."""
    importable(spark)
    codec = bpe.BytePairCodec.from_file(vocabulary("byte_bpe_multi_50k.tiktoken"))
    return bpe.round_trip_digests(docs, codec)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup),
    ("mix sources", mix_sources),
    ("bpe round trip", bpe_round_trip),
]

#: SQL cannot state a language model's judgement; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    workspace = Workspace(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        before = opened()
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = workspace.table(docs, f"after_{i}")
            close_opened(before)  # what the stage has written on its way
            if i:
                workspace.drop(f"after_{i - 1}")
    return docs
