"""From files to pages and words: reading, recognition, correction, and all words with their places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.operators import ocr, vocabulary
from lexquarry.sources import binary
from lexquarry.sources.shared import stored


def items(read: DataFrame) -> DataFrame:
    """What is to be recognised: doc_id, page, item_id, kind, bytes, rect, width, height."""
    scanned = binary.as_pages(read).select(F.col("doc_id").alias("d"), F.col("page").alias("p"), "is_scanned")
    whole = read.join(scanned, (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p"))).drop("d", "p")
    routed = ocr.routed(whole.select("doc_id", "page", "is_scanned", "placements")).withColumnsRenamed({"doc_id": "d", "page": "p"})
    met = whole.join(routed, (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p"))).withColumn("of", F.get(F.filter("placements", lambda x: x["id"] == F.col("item_id")), 0))
    scan = F.col("kind") == "scan"
    return met.select("doc_id", "page", "item_id", "kind", F.when(scan, F.col("render")).otherwise(F.col("of.bytes")).alias("bytes"), "of.rect", "of.width", "of.height")


def ingested(read: DataFrame, reader: ocr.Recogniser, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages with all their texts, and words with places and corrections: what index and search take.

    read: as binary.pages() gives it; files with errors are left out here (binary.valid() has them). What was
    recognised, and what it became, are written to the shared folder, as both are used several times.
    """
    good, _ = binary.valid(read)
    wanted = items(good)
    told = stored(ocr.results(stored(ocr.recognised(wanted.filter("bytes IS NOT NULL"), reader, partitions), "recognised")), "results")
    pages = ocr.merged(binary.as_pages(good), told.select("doc_id", "item_id", "text"))
    words = binary.text_words(good).unionByName(ocr.box_words(told, wanted.drop("bytes")))
    return stored(pages, "pages"), stored(vocabulary.corrected_words(words), "words")
