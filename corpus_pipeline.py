"""Corpus pipeline: quality, near-duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's documents. All stages but the last
return the columns of the documents.

Defined cases are those of the operators. A document stays only with a non-null
id; of a group of near-duplicates the one with the smallest id stays, once.
The classifier and decontamination judge each row by its own text, also where
rows share an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import decontamination, mixing, near_dedup, quality, token_store
from holdfast.llm.queries import tokenizer_path
from holdfast.scratch import written


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.kept_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("doc_id is not null")


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more), in one row."""
    gone = near_dedup.near_duplicates(docs, shingle_words=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    # Those ids are few beside the rest, so they are what is moved.
    left = docs.join(written(gone, "pipeline-gone"), "doc_id", "left_anti").select(*docs.columns)
    return near_dedup.one_row(left, shingle_words=5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontamination.clean_rows(docs.where("doc_id is not null"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document stands as often as its source's passes say."""
    return mixing.mix(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document in the content-addressed store, read back."""
    # Fewer kept words than the operator alone: the workers have run the stages before, and the executor's memory is shared.
    return token_store.token_store(docs, tokenizer_path(), end_id=1, split_words=True, encoded_words=500_000)


STAGES = [
    ("quality classifier", classified),
    ("MinHash near-dedup", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", tokenised),
]

#: The stages' models, hashes and tokenizer have no SQL form. tests/llm/test_run.py holds run()'s rows to plain versions of the stages after the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{i}")
    return docs
