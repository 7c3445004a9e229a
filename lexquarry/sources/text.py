"""Tables of text as pages, and pages as searchable sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry import config
from lexquarry.functions import text as tx

#: An image found on a page: bytes are left out wherever they aren't needed.
IMAGES = "array<struct<id: string, page: int, width: int, height: int, format: string, ocr_text: string, bytes: binary>>"


def classified(pages: DataFrame) -> DataFrame:
    """doc_id, page, text -> the columns of a page; one with hardly any text counts as scanned."""
    text = tx.stripped(F.coalesce("text", F.lit("")))
    return pages.select(
        "doc_id", F.col("page").cast("int").alias("page"), text.alias("text"), (F.length(text) < config.SCANNED_BELOW).alias("is_scanned"),
        F.lit("").alias("ocr_text"), F.lit(False).alias("has_images"), F.array().cast(IMAGES).alias("images"),
    )


def lines(documents: DataFrame) -> DataFrame:
    """A document's lines as its pages, counted from 1; blank ones keep their number."""
    return documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("page"), "text")


def turns(conversations: DataFrame) -> DataFrame:
    """A conversation's turns as the pages of a document."""
    return conversations.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), "text")


def web(pages: DataFrame) -> DataFrame:
    """Web pages as documents of one page: scripts, styles and tags taken out."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return pages.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), F.regexp_replace(bare, r"\s+", " ").alias("text"))


def as_recognised(pages: DataFrame) -> DataFrame:
    """Pages counted as scanned with their text as what recognition gave (where a table has no images)."""
    return pages.withColumns({"ocr_text": F.when(F.col("is_scanned"), F.col("text")).otherwise(F.col("ocr_text")), "text": F.when(F.col("is_scanned"), "").otherwise(F.col("text"))})


def label(src: Column, image_id: Column) -> Column:
    return F.when(src == "text", config.LABELS["text"]).when(src == "ocr", config.LABELS["ocr"]).otherwise(F.format_string(config.LABELS["image_ocr"], F.coalesce(image_id, F.lit("None"))))


def sources(pages: DataFrame) -> DataFrame:
    """doc_id, page, src, image_id, label, text: a row for each text that a page has."""
    kind = "src string, image_id string, text string"
    one = lambda src, text: F.struct(F.lit(src).alias("src"), F.lit(None).cast("string").alias("image_id"), text.alias("text"))
    images = F.transform("images", lambda i: F.struct(F.lit("image_ocr").alias("src"), i["id"].alias("image_id"), i["ocr_text"].alias("text")))
    every = F.filter(F.concat(F.array(one("text", F.col("text")), one("ocr", F.col("ocr_text"))).cast(f"array<struct<{kind}>>"), images.cast(f"array<struct<{kind}>>")), lambda s: F.coalesce(s["text"], F.lit("")) != "")
    return pages.select("doc_id", "page", F.explode(every).alias("s")).select("doc_id", "page", "s.src", "s.image_id", label(F.col("s.src"), F.col("s.image_id")).alias("label"), "s.text")


def with_normal_forms(pages: DataFrame) -> DataFrame:
    images = F.transform("images", lambda i: F.struct(i["id"].alias("id"), tx.normal(i["ocr_text"]).alias("text")))
    return pages.withColumns({"text_normal": tx.normal(F.col("text")), "ocr_normal": tx.normal(F.col("ocr_text")), "images_normal": images})


def words(pages: DataFrame) -> DataFrame:
    """doc_id, page, src, image_id, word, box, seq: each word on a grid of characters and lines.

    A window over a page's words adds up where each begins; white space of any length counts.
    """
    from pyspark.sql import Window

    piece = sources(pages).select("doc_id", "page", "src", "image_id", F.posexplode(F.split("text", r"\s")).alias("seq", "word"))
    before = Window.partitionBy("doc_id", "page", "src", "image_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0))
    placed = piece.withColumn("x0", start.cast("double")).filter("word <> ''")
    return placed.select("doc_id", "page", "src", "image_id", "word", "x0", F.col("page").cast("double").alias("y0"), (F.col("x0") + F.length("word")).alias("x1"), (F.col("page") + 1).cast("double").alias("y1"), F.col("seq").cast("long").alias("seq"))


def bare_words(pages: DataFrame) -> DataFrame:
    """words() without places, and so without a shuffle."""
    none = F.lit(None).cast("double")
    return sources(pages).select("doc_id", "page", "src", "image_id", F.posexplode(F.split("text", r"\s")).alias("seq", "word")).filter("word <> ''").select("doc_id", "page", "src", "image_id", "word", none.alias("x0"), none.alias("y0"), none.alias("x1"), none.alias("y1"), F.col("seq").cast("long").alias("seq"))
