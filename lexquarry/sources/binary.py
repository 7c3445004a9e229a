"""Files: listing and hashing, validation, and page extraction by whichever backend is installed."""

from __future__ import annotations

from collections.abc import Iterator
from importlib.util import find_spec
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry import config
from lexquarry.functions import text as tx
from lexquarry.sources.text import IMAGES

PAGES = f"doc_id string, page int, text string, words array<struct<word: string, x0: double, y0: double, x1: double, y1: double>>, placements array<struct<id: string, width: int, height: int, format: string, bytes: binary, rect: array<double>, cover: double>>, render binary, error string"


class PageReader(Protocol):
    """Gives a file's pages; a module of this shape serves each file type."""

    def pages(self, content: bytes) -> Iterator[dict]: ...


class PdfReader:
    """Pages of a PDF by PyMuPDF, where it is installed."""

    def __init__(self, dpi: int = config.RENDER_DPI):
        self.dpi = dpi

    @staticmethod
    def available() -> bool:
        return find_spec("fitz") is not None

    def pages(self, content: bytes) -> Iterator[dict]:
        import fitz

        with fitz.open(stream=content, filetype="pdf") as document:
            if len(document) > config.UPLOAD_PAGES:
                raise ValueError(f"more than {config.UPLOAD_PAGES} pages")
            for number, page in enumerate(document, 1):
                area = page.rect.width * page.rect.height
                placed = []
                for i, image in enumerate(page.get_images(full=True), 1):
                    try:
                        raw = document.extract_image(image[0])
                        rect = next(iter(page.get_image_rects(image[0])), None)
                    except (RuntimeError, ValueError):
                        continue
                    if min(raw["width"], raw["height"]) >= config.LEAST_IMAGE:
                        share = rect.width * rect.height / area if rect is not None and area > 0 else 0.0
                        placed.append({"id": f"p{number}_img{i}", "width": raw["width"], "height": raw["height"], "format": raw["ext"], "bytes": raw["image"], "rect": rect and list(map(float, rect)), "cover": share})
                text = page.get_text("text").strip()
                boxes = [{"word": w[4], "x0": round(w[0], 2), "y0": round(w[1], 2), "x1": round(w[2], 2), "y1": round(w[3], 2)} for w in page.get_text("words", sort=True)]
                bare = len(text) < config.SCANNED_BELOW and not any(p["cover"] >= config.DOMINANT_COVER for p in placed)
                render = page.get_pixmap(matrix=fitz.Matrix(self.dpi / 72, self.dpi / 72), alpha=False).tobytes("png") if bare else None
                yield {"page": number, "text": text, "words": boxes, "placements": placed, "render": render}


def listed(spark: SparkSession, path: str, pattern: str = "*.pdf", most: int = config.UPLOAD_BYTES) -> DataFrame:
    """Files under path: doc_id (SHA-256 of the content), path, filename, content, error.

    A larger file than ``most`` bytes is listed by its path as doc_id, with an error and without its content, which isn't read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name, none = tx.basename(F.col("path")).alias("filename"), F.lit(None).cast("string").alias("error")
    small = files.filter(F.col("length") <= most).select(F.sha2("content", 256).alias("doc_id"), "path", name, "content", none)
    large = files.filter(F.col("length") > most).select(F.col("path").alias("doc_id"), "path", name, F.lit(None).cast("binary").alias("content"), F.format_string("%d bytes, more than %d", "length", F.lit(most)).alias("error"))
    return small.unionByName(large)


def pages(files: DataFrame, reader: PageReader) -> DataFrame:
    """Pages of all files. A file that can't be read, or was listed with an error, gives one row with page 0 and the error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(":")[0].strip() for c in ("page", "text", "words", "placements", "render")]
        for b in batches:
            for doc_id, content, error in zip(b["doc_id"], b["content"], b["error"]):
                try:
                    if error:
                        raise ValueError(error)
                    rows = [{"doc_id": doc_id, **{n: p.get(n) for n in names}, "error": None} for p in reader.pages(bytes(content))]
                except Exception as e:  # noqa: BLE001  what is wrong with a file is data, not a failure of the job
                    rows = [{"doc_id": doc_id, "page": 0, "text": None, "words": [], "placements": [], "render": None, "error": str(e) or type(e).__name__}]
                yield pd.DataFrame(rows, columns=["doc_id", *names, "error"])

    listed_error = F.col("error") if "error" in files.columns else F.lit(None).cast("string").alias("error")
    return files.select("doc_id", "content", listed_error).mapInPandas(read, PAGES)


def valid(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of readable files, and doc_id with error of the others."""
    return read.filter("error IS NULL").drop("error"), read.filter("error IS NOT NULL").select("doc_id", "error")


def as_pages(read: DataFrame) -> DataFrame:
    """The columns of classified pages, images without text so far."""
    images = F.transform("placements", lambda p: F.struct(p["id"].alias("id"), F.col("page").alias("page"), p["width"].alias("width"), p["height"].alias("height"), p["format"].alias("format"), F.lit("").alias("ocr_text"), p["bytes"].alias("bytes"))).cast(IMAGES)
    return read.select("doc_id", "page", tx.stripped(F.col("text")).alias("text"), (F.length(tx.stripped(F.col("text"))) < config.SCANNED_BELOW).alias("is_scanned"), F.lit("").alias("ocr_text"), (F.size("placements") > 0).alias("has_images"), images.alias("images"))


def text_words(read: DataFrame) -> DataFrame:
    """Words of digital pages with their true places, as text.words() gives them: doc_id, page, src, image_id, word, box, seq."""
    placed = read.select("doc_id", "page", F.posexplode("words").alias("seq", "w"))
    return placed.select("doc_id", "page", F.lit("text").alias("src"), F.lit(None).cast("string").alias("image_id"), "w.word", "w.x0", "w.y0", "w.x1", "w.y1", F.col("seq").cast("long").alias("seq"))


def sample(spark: SparkSession) -> DataFrame:
    """A made-up document of 20 pages, as pages() gives them: twelve with text, four with text and an image, four scanned."""

    def words(text: str) -> list[dict]:
        out, x = [], 50.0
        for w in text.split():
            out.append({"word": w, "x0": x, "y0": 90.0, "x1": x + 6.0 * len(w), "y1": 102.0})
            x += 6.0 * (len(w) + 1)
        return out

    rows = []
    for n in range(1, 21):
        kind = "text" if n <= 12 else "image" if n <= 16 else "scan"
        text = "" if kind == "scan" else f"Factura FE-{1000 + n} del paciente numero {n} con un valor total de {n * 1250} pesos"
        image = [] if kind == "text" else [{"id": f"p{n}_img1", "width": 900, "height": 700, "format": "png", "bytes": f"{kind} {n}".encode(), "rect": [50.0, 200.0, 500.0, 550.0], "cover": 0.31 if kind == "image" else 0.2}]
        rows.append(("sample", n, text, words(text), image, f"render {n}".encode() if kind == "scan" else None, None))
    return spark.createDataFrame(rows, PAGES)
