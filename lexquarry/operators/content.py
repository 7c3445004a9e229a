"""Content by hash: duplicates, and what was processed before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry import config


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def hashed(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", content_hash(F.coalesce("text", F.lit(""))).alias("content_sha256"))


def distinct_documents(documents: DataFrame) -> DataFrame:
    """content_sha256, doc_id (the smallest) and copies."""
    return hashed(documents).groupBy("content_sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def unseen(documents: DataFrame, processed: DataFrame) -> DataFrame:
    """Documents whose content (with the options used) isn't in processed; both have content_sha256 and options."""
    return documents.join(processed.select("content_sha256", "options").distinct(), ["content_sha256", "options"], "left_anti")


def retained(processed: DataFrame, most: int = config.CACHE_DOCUMENTS) -> DataFrame:
    """The entries used last; processed: content_sha256, last_used. Ties go to the smaller hash."""
    return processed.orderBy(F.desc("last_used"), "content_sha256").limit(most)


def first_of_each(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of rows alike in key the first by order."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_nth = 1").drop("_nth")
