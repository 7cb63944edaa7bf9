"""A corpus from raw documents to packed training sequences.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keystrata.llm import decontamination, language_id, near_dedup, packing, pii
from keystrata.llm.common import materialize, release
from keystrata.llm.queries import PII_KEY, tokenizer_path


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any language go."""
    return language_id.language_stage(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the first stays."""
    return near_dedup.near_dedup_stage(docs, near_dedup.Threshold(words=5, percent=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontamination_stage(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets pseudonyms; every document stays."""
    return pii.pii_stage(docs, PII_KEY)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized documents, with their sequence and offset."""
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", pseudonymize),
    ("packing", pack_sequences),
]

#: Tokenization, language models and Feistel networks are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. Each stage's table goes as soon as the next one is stored."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialize(docs)
        if before is not None:
            release(before)
        before = docs  # the last stage's result is stored, too
    return docs
