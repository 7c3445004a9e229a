"""What leaves the engine: light payloads, images, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import json as js


def light(pages: DataFrame) -> DataFrame:
    """Pages whose images come without their bytes."""
    fields = ("id", "page", "width", "height", "format", "ocr_text")
    return pages.withColumn("images", F.transform("images", lambda i: F.struct(*(i[f].alias(f) for f in fields)))).select("doc_id", "page", "text", "is_scanned", "ocr_text", "has_images", "images")


def payload(pages: DataFrame) -> DataFrame:
    """doc_id and a JSON document for each: counts and light pages."""
    rows = light(pages).groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.count_if(~F.col("is_scanned")).alias("digital_pages"), F.count_if(F.col("is_scanned")).alias("ocr_pages"), F.array_sort(F.collect_list(F.struct("page", "text", "is_scanned", "ocr_text", "has_images", "images"))).alias("pages"))
    return rows.select("doc_id", F.to_json(F.struct(F.lit(True).alias("success"), "total_pages", "digital_pages", "ocr_pages", "pages")).alias("payload"))


def gallery(pages: DataFrame) -> DataFrame:
    """doc_id, page_number and the images of all pages."""
    return pages.select("doc_id", F.col("page").alias("page_number"), F.explode("images").alias("i")).select("doc_id", "page_number", "i.*")


def image(pages: DataFrame, doc_id, image_id: str) -> DataFrame:
    """media_type and bytes of one image."""
    return gallery(pages).filter((F.col("doc_id") == doc_id) & (F.col("id") == image_id)).select(F.concat(F.lit("image/"), F.when(F.lower("format") == "jpg", "jpeg").otherwise(F.lower("format"))).alias("media_type"), "bytes")


def value_rows(values: DataFrame) -> DataFrame:
    """doc_id, field, value, found of a map column ``values``."""
    return values.select("doc_id", F.explode("values").alias("field", "value")).withColumn("found", js.found(F.col("value")))


def csv_lines(values: DataFrame) -> DataFrame:
    """doc_id, line: the export's rows, header not included; fields in quotation marks, those of values doubled."""
    return value_rows(values).select("doc_id", F.concat(F.lit('"'), "field", F.lit('","'), F.replace("value", F.lit('"'), F.lit('""')), F.lit('"')).alias("line"))


def write_csv(values: DataFrame, path: str) -> None:
    value_rows(values).select(F.col("field").alias("Campo"), F.col("value").alias("Valor Extraido")).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(values: DataFrame, path: str) -> None:
    values.select("doc_id", "values").write.json(path)


def filtered_pages(pages: DataFrame, mode: str, hits: DataFrame | None = None) -> DataFrame:
    """All pages, those with hits ("matches") or those that are scanned."""
    if mode == "matches":
        return pages.join(hits.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
    return pages.filter("is_scanned") if mode == "scanned" else pages


def edited_fields(fields: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """A list of fields (at, field) with some added at its end where absent, then some removed; at tells the order."""
    both = fields.select(F.lit(0).alias("part"), "at", "field").unionByName(added.select(F.lit(1).alias("part"), "at", "field"))
    first = both.groupBy("field").agg(F.min(F.struct("part", "at")).alias("place")).join(removed.select("field"), "field", "left_anti")
    return first.select("field", F.row_number().over(Window.orderBy("place")).alias("at"))  # a list of a form's fields
