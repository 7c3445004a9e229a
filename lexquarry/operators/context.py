"""Which pages and snippets a model gets to see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry import config
from lexquarry.functions import text as tx


def _images(joiner: str) -> Column:
    return F.array_join(F.transform(F.filter("images", lambda i: F.coalesce(i["ocr_text"], F.lit("")) != ""), lambda i: i["ocr_text"]), joiner)


def content(pages: DataFrame) -> Column:
    """A page's text, else what was recognised, else what its images hold."""
    first = tx.stripped(F.when(F.coalesce("text", F.lit("")) != "", F.col("text")).otherwise(F.coalesce("ocr_text", F.lit(""))))
    return F.when(first != "", first).otherwise(tx.stripped(_images("\n")))


def combined(pages: DataFrame) -> Column:
    """All that a page holds, for scoring."""
    images = F.array_join(F.transform("images", lambda i: F.concat(F.lit("\n"), F.coalesce(i["ocr_text"], F.lit("")))), "")
    return F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.coalesce("ocr_text", F.lit("")), images)


def page_scores(pages: DataFrame, fields: list[str]) -> DataFrame:
    """doc_id, page, score: 5 for each field that the page holds, 1 for each of its words of more than three letters."""
    asked = [tx.plain_form(f) for f in fields if f.strip()]
    text = tx.normal(combined(pages))
    terms = [F.when(F.contains(F.col("_n"), F.lit(f)), config.FIELD_SCORE).otherwise(0) for f in asked]
    terms += [F.when(F.contains(F.col("_n"), F.lit(w)), config.WORD_SCORE).otherwise(0) for f in asked for w in f.split() if len(w) > config.LONG_WORD]
    total = sum(terms, F.lit(0))
    return pages.withColumn("_n", text).select("doc_id", "page", total.cast("int").alias("score"))


def small_contexts(pages: DataFrame, most: int = config.CONTEXT) -> DataFrame:
    """doc_id, context, pages_used of documents of at most three pages: every page that isn't empty."""
    small = pages.groupBy("doc_id").agg(F.count("*").alias("_pages")).filter(F.col("_pages") <= config.SMALL_DOCUMENT).select(F.col("doc_id").alias("_d"))
    rows = pages.withColumn("_content", content(pages)).join(small, F.col("doc_id") == F.col("_d"))
    part = F.struct("page", F.concat(F.format_string(config.PAGE_HEADER, F.col("page")), F.lit("\n"), F.col("_content")).alias("chunk"))
    parts = F.array_sort(F.collect_list(F.when(F.col("_content") != "", part)))  # three at most
    chosen = rows.groupBy("doc_id").agg(parts.alias("parts"))
    return chosen.select("doc_id", F.substring(F.array_join(F.transform("parts", lambda p: p["chunk"]), "\n\n"), 1, most).alias("context"), F.transform("parts", lambda p: p["page"]).alias("pages_used"))


def chosen_pages(pages: DataFrame, fields: list[str]) -> DataFrame:
    """doc_id, page, score, chunk of longer documents: the four best pages, and the first one in any case."""
    own = F.struct("doc_id", "page")
    scored = page_scores(pages, fields).withColumnsRenamed({"doc_id": "_sd", "page": "_sp"})
    many = Window.partitionBy("_sd")
    best = Window.partitionBy("_sd").orderBy(F.desc("score"), "_sp")
    picked = scored.withColumns({"_nth": F.row_number().over(best), "_all": F.count("*").over(many)}).filter((F.col("_all") > config.SMALL_DOCUMENT) & ((F.col("_nth") <= config.TOP_PAGES) | (F.col("_sp") == 1)))
    rows = pages.withColumns({"_content": content(pages), "_combined": tx.stripped(combined(pages))})
    met = rows.join(picked, own == F.struct(F.col("_sd").alias("doc_id"), F.col("_sp").alias("page")))
    body = F.when(F.col("_nth") <= config.TOP_PAGES, F.col("_combined")).otherwise(F.col("_content"))
    score = F.when(F.col("_nth") <= config.TOP_PAGES, F.col("score")).otherwise(0)
    chunk = F.concat(F.format_string(config.PAGE_HEADER, F.col("page")), F.lit("\n"), F.col("_body"), F.lit("\n"))
    return met.withColumns({"_body": body, "_score": score}).filter("_body <> ''").select("doc_id", "page", F.col("_score").alias("score"), chunk.alias("chunk"))


def pruned_contexts(pages: DataFrame, fields: list[str], most: int = config.CONTEXT) -> DataFrame:
    """doc_id, context, pages_used of longer documents: chosen pages in order, until the budget is used up."""
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    rows = chosen_pages(pages, fields).withColumn("_before", F.coalesce(F.sum(F.length("chunk")).over(before), F.lit(0))).filter(F.col("_before") < most)
    cut = F.expr(f"substring(chunk, 1, CAST({most} - _before AS INT))")
    parts = F.array_sort(F.collect_list(F.struct("page", cut.alias("chunk"))))  # five at most
    return rows.groupBy("doc_id").agg(parts.alias("parts")).select("doc_id", F.substring(F.array_join(F.transform("parts", lambda p: p["chunk"]), "\n"), 1, most).alias("context"), F.transform("parts", lambda p: p["page"]).alias("pages_used"))


def contexts(pages: DataFrame, fields: list[str], most: int = config.CONTEXT) -> DataFrame:
    return small_contexts(pages, most).unionByName(pruned_contexts(pages, fields, most))


def evidence(hits: DataFrame, most: int = config.EVIDENCE_CHARACTERS) -> DataFrame:
    """query_id, doc_id, evidence, pages_used: up to five snippets; once three pages are seen, only of new ones.

    Hits of a query in a document are taken in their order. The first five of each page and the first of
    every page are all that can count, so no more than that is gathered: pages beyond the fifth new one
    never matter.
    """
    by_page = Window.partitionBy("query_id", "doc_id", "page").orderBy("position")
    first = hits.withColumn("_of_page", F.row_number().over(by_page)).filter(F.col("_of_page") <= config.EVIDENCE_PARTS)
    in_order = Window.partitionBy("query_id", "doc_id").orderBy("position")
    new = first.withColumn("_new", F.sum(F.when(F.col("_of_page") == 1, 1).otherwise(0)).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    # a known page counts only while fewer than three are seen
    taken = new.filter((F.col("_of_page") == 1) | (F.col("_new") < config.EVIDENCE_PAGES)).withColumn("_nth", F.row_number().over(in_order)).filter(F.col("_nth") <= config.EVIDENCE_PARTS)
    part = F.struct("_nth", "page", F.format_string(config.EVIDENCE_HEADER, F.col("page"), F.col("source_label"), F.col("snippet")).alias("text"))
    rows = taken.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))  # five at most
    return rows.select("query_id", "doc_id", F.substring(F.array_join(F.transform("parts", lambda p: p["text"]), "\n"), 1, most).alias("evidence"), F.transform("parts", lambda p: p["page"]).alias("pages_used"))
