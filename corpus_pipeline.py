"""From documents to packed training sequences: five stages, each over all that its predecessor kept.

Defined cases, for all stages: an empty table gives an empty table, and columns of any name travel along unread. Null or
empty texts have no language and go with the first stage; very long ones are worked on whole. Rows that repeat as they are leave
one of them with the second stage; unlike texts of one id are judged each for itself; rows without an id stay. A null source
is a source of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartlake.llm import language_id, mixing, near_dedup, packing, pii
from cartlake.llm.queries import vocabulary_path
from cartlake.llm.staging import staged


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier does not reject; none, where no labelled text is there to learn from."""
    return language_id.accepted(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates, of a similarity of 0.8 or more."""
    return near_dedup.without_duplicates(docs, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with identifiers replaced by their kinds and the lengths adjusted."""
    return pii.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents, each copy of its own, as pieces of sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained and random stages are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows stored and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
