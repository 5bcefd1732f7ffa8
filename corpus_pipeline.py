"""A corpus pipeline of five stages over ``documents``; each reads what the one before it has written.

Quality classifier, language identification, near-duplicate removal, benchmark decontamination, packing.
Every stage but the last returns the columns of ``documents``. A stage handles nulls, empty texts, ties
and repeated rows as its operator does; an empty table goes through all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from windrow.llm import attention_mil, occurrence_join, open_windows, positional_index, subword_language
from windrow.llm.frames import stored
from windrow.llm.registry import table
from windrow.llm.tokens import known_path


#: Bytes of one batch of rows on its way to a Python worker, here and back; whole texts make large rows.
BATCH = str(4 << 20)


def bounded_batches(spark: SparkSession) -> None:
    """Batches by bytes, not by rows, so that what tasks hold at once does not depend on the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality is 1."""
    bounded_batches(spark)
    return attention_mil.accepted(docs, table(spark, sf_dir, "labels"))


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected."""
    bounded_batches(spark)
    return subword_language.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle overlap."""
    bounded_batches(spark)
    return occurrence_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    bounded_batches(spark)
    return positional_index.clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    bounded_batches(spark)
    return open_windows.packed(docs, open_windows.Settings(known_path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", quality_classifier),
    ("language identification", language_identification),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: The trained stages and the tokenizer have no SQL form; the pipeline is tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one's result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
