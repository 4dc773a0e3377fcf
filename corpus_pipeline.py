"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, which is what the stage before it kept; its
result is written as Parquet and read again. All but the last return the columns of ``documents``. Nulls, empty texts,
repeated rows, empty tables and extra columns are handled as the stage's operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomstone.llm import common, decontamination, near_dedup, packing, quality, substring_dedup, tokens


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts; it is trained on the labelled ones among them."""
    s = common.Scratch(spark)
    model, _ = quality.train(docs, common.read(spark, sf_dir, "labels"), s)
    s.drop()
    return quality.accept(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least doc_id."""
    return near_dedup.keep(docs, common.Scratch(spark))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that another document keeps are cut out; documents without a word left go."""
    return substring_dedup.remove(docs, common.Scratch(spark))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows are cut out; documents that consist of them for the most part go."""
    common.prepare(spark)
    return decontamination.clean(docs, common.read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of 4096."""
    return packing.pack(docs, tokens.public("word_bpe_49k.json"), common.Scratch(spark))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("packing", pack),
]
#: Automata, chains, sampling and tokenizers are beyond SQL; tests/llm tests the operators of the stages, and the rows that the stages pass on.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    scratch = common.Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.result(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
