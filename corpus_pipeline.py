"""A corpus pipeline over documents: language ID, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again for the next. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import decontaminate, language_id, minhash, mixing, token_files
from tidewright.llm.common import saved, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; text without a letter goes. The model learns from this stage's labelled rows."""
    return language_id.identified(docs, language_id.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked at five-word shingles and a similarity of 0.8."""
    return minhash.distinct_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources up to one and a half times."""
    return mixing.mix(docs, repeat=1.5).select("row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files, read back: (doc_id, start, n_tokens, ids_crc32)."""
    return token_files.token_files(docs)


STAGES = [
    ("language_id", language),
    ("minhash", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("token_files", token_output),
]

#: Near-duplicates, edit-bounded search and byte-pair ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, on the documents in sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
