"""Training-text pipeline: language ID, line dedup, near dedup, decontamination, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, linededup, minhash
from tidemark.llm.queries import crc_fold, encoded_digests
from tidemark.plans.shared import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that the language decoder rejects: null texts, texts without a letter, and texts near no language. Each row is decided by its
    own text; repeated rows and null ids don't matter. All rows stay as they are if no labelled row is left to learn from."""
    return langid.with_language(docs, langid.train(docs.where(crc_fold(3) != 1)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that have a similar line earlier in the corpus; n_chars follows. Rows all stay, null and empty texts as they are."""
    cut = linededup.dedup_lines(docs, count_as=None)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, the one with the smallest id. Documents without words all stay;
    of rows equal in doc_id and text one stays, and different texts that share a doc_id, or have none, are documents of their own."""
    return minhash.one_of_each(docs, width=5, percent=80)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a benchmark item, each by its own text; null texts stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, a row for each; null texts count as empty."""
    return encoded_digests(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("leaks", leaks), ("encoding", encoding)]

#: SQL can't express the classifier, the sketches or the tokenizer; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what the stages leave of ``documents``; no rows for an empty table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
