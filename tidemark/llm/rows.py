"""Rows told apart by a number, for stages that decide on whole rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.shared import bounded, packed, stored


def keyed(docs: DataFrame) -> DataFrame:
    """row (all columns as a struct), doc_id, text of every row of ``docs``, where doc_id tells different texts apart.

    A doc_id that one row has stays. Rows whose doc_id is null or shared get a number over 2 ** 62 made from doc_id and
    text, so rows equal in both still have one number, and a row with an id of its own comes before them.
    """
    ids = F.col("doc_id").cast("long")
    shared = stored(docs.groupBy(ids.alias("shared_id")).agg(F.count("*").alias("n")).where("n > 1 or shared_id is null").select("shared_id"))
    if not shared.limit(1).count():
        return packed(docs, doc_id=ids, text=F.col("text"))
    made = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(ids, "text"), 2)
    rows = packed(docs, id=ids, made=made, text=F.col("text")).join(bounded(shared.withColumn("several", F.lit(True))), F.col("id").eqNullSafe(F.col("shared_id")), "left")
    return rows.select("row", F.when(F.col("several"), F.col("made")).otherwise(F.col("id")).alias("doc_id"), "text")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``keyed`` rows whose doc_id isn't in the column doc_id of ``gone`` (stored, without nulls)."""
    return docs.join(bounded(gone.select("doc_id")), "doc_id", "left_anti")


def opened(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The caller's columns of ``keyed`` rows."""
    return docs.select(*[F.col("row")[c].alias(c) for c in columns])
