"""A corpus pipeline of five stages, each an operator of scriptorium.llm over all that the stage before it kept.

All stages: an empty table stays empty; documents without an id go through like others; columns that docs has besides are kept as they are, by any
name (the last stage returns its own columns only).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, common, decontam, langid, queries, simhash, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model rejects (score 0.5 or more).

    Null and empty texts stay (they score lowest), repeated rows go or stay together, a score of exactly 0.5 goes. Without labels of both
    classes all stay.
    """
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language can't be told: no letter, or no language with half of the score.

    Null and empty texts go, repeated rows go or stay together, a score of exactly 0.5 stays. Where no document has a language, all go.
    """
    return langid.determined_documents(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group whose fingerprints are linked.

    By op5's contract: fingerprints of 3-word shingles, linked at 2 differing bits. Near copies 3 or more bits apart stay, also
    those that a rule of 5-word shingles at similarity 0.8 would drop. Null and empty texts are one group. Of equal ids in a group the text with
    the least hash stays; of rows with this id and text the first by all other columns. A group without any id keeps one row likewise.
    """
    return simhash.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a window of a benchmark item occurs.

    Null and empty texts stay, repeated rows go or stay together; without items all stay.
    """
    return decontam.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the token ids of each document.

    Null and empty texts have no tokens; repeated rows are encoded alike and stay.
    """
    return bpe.encode_texts(docs, queries.vocabulary_path(), keep=[F.col("doc_id")], schema="doc_id long", with_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("language_id", with_language),
    ("simhash_near_dedup", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Learned stages have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None
