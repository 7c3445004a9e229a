"""Recognition: which images are read, what becomes of the words, how results join pages."""

from __future__ import annotations

from collections.abc import Iterator
from importlib.util import find_spec
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry import config
from lexquarry.functions import numbers as nm
from lexquarry.functions import text as tx
from lexquarry.operators import vocabulary

BOX = "struct<text: string, conf: double, x0: int, y0: int, x1: int, y1: int>"
RESULT = f"doc_id string, item_id string, text string, boxes array<{BOX}>, success boolean, error string"


class Recogniser(Protocol):
    """Reads one image: its words as struct<text, conf, left, top, width, height, block, par, line>.

    header(), where there is one, reads the strip at the top again; its words are placed in the whole image.
    """

    def words(self, image: bytes) -> list[dict]: ...


def faint_marks(gray: np.ndarray, blurred: np.ndarray) -> np.ndarray:
    """Dark on white: what is darker than its surroundings, three and a half times as strongly."""
    return np.clip(255 - 3.5 * (blurred.astype("float64") - gray), 0, 255).astype("uint8")


class Tesseract:
    """By pytesseract and Pillow, where they are installed."""

    def __init__(self, languages: str = "spa+eng"):
        self.languages = languages

    @staticmethod
    def available() -> bool:
        return all(find_spec(m) for m in ("pytesseract", "PIL"))

    def words(self, image: bytes) -> list[dict]:
        import io

        import pytesseract
        from PIL import Image, ImageDraw, ImageFilter, ImageOps

        picture = ImageOps.grayscale(Image.open(io.BytesIO(image)))
        longest = max(picture.size)
        scale = 1800 / longest if longest > 2000 and picture.width >= 1000 else 1000 / longest if longest < 600 and min(picture.size) > 50 else 1.0
        if scale != 1.0:
            picture = picture.resize((int(picture.width * scale), int(picture.height * scale)))
        wide, high = picture.size
        side, top = (max(2, int(n * 0.008)) for n in picture.size)
        frame = ImageDraw.Draw(picture)  # shadows at the border
        for box in ((0, 0, wide, top), (0, high - top, wide, high), (0, 0, side, high), (wide - side, 0, wide, high)):
            frame.rectangle(box, fill=255)
        picture = ImageOps.autocontrast(picture).filter(ImageFilter.UnsharpMask(radius=1.0, percent=80, threshold=2))
        return self._read(pytesseract, picture, 3, scale, 0)

    def header(self, image: bytes) -> list[dict]:
        import io

        import pytesseract
        from PIL import Image, ImageFilter, ImageOps

        picture = ImageOps.grayscale(Image.open(io.BytesIO(image)))
        low, offset = min(int(picture.height * 0.16), 380), int(picture.height * 0.012)
        if low < 60:
            return []
        strip = picture.crop((0, offset, picture.width, low))
        marks = faint_marks(np.asarray(strip), np.asarray(strip.filter(ImageFilter.GaussianBlur(8))))
        return self._read(pytesseract, Image.fromarray(marks), 11, 1.0, offset)

    def _read(self, pytesseract, picture, mode: int, scale: float, offset: int) -> list[dict]:
        d = pytesseract.image_to_data(picture, config=f"--oem 1 --psm {mode} -l {self.languages}", output_type=pytesseract.Output.DICT)
        names = {"left": "left", "top": "top", "width": "width", "height": "height", "block": "block_num", "par": "par_num", "line": "line_num"}
        rows = [{"text": t, "conf": c, "scale": scale, **{k: int(d[v][i]) for k, v in names.items()}} for i, (t, c) in enumerate(zip(d["text"], d["conf"]))]
        return [r | {"top": r["top"] + offset} for r in rows]


def image_ids(images: Column, page: Column) -> Column:
    """Names by place among all images of a page, whether or not they are kept."""
    return F.transform(images, lambda i, at: F.struct(F.format_string("p%d_img%d", page, at + 1).alias("id"), i.alias("image")))


def large_enough(images: Column) -> Column:
    return F.filter(images, lambda i: (i["width"] >= config.LEAST_IMAGE) & (i["height"] >= config.LEAST_IMAGE))


def dominant(placements: Column) -> Column:
    """The image that covers most of a page (of equals the first), if it covers half of it."""
    best = F.aggregate(placements, F.element_at(placements, 1), lambda a, p: F.when(p["cover"] > a["cover"], p).otherwise(a))
    return F.when((F.size(placements) > 0) & (best["cover"] >= config.DOMINANT_COVER), best)


def routed(pages: DataFrame, read_images: bool = True) -> DataFrame:
    """doc_id, page, item_id, kind: what is read. pages: is_scanned, placements (id, cover).

    A scanned page whose image dominates it is read by that image; other scanned pages are
    rendered, even where images aren't read; images of digital pages are read one by one.
    """
    # element_at fails on an empty array, so an empty one is made null first
    placed = pages.withColumn("_p", F.when(F.size("placements") > 0, F.col("placements"))).withColumn("_best", F.when(F.col("_p").isNotNull() & F.col("is_scanned"), dominant(F.col("_p"))))
    item = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("item_id"))
    none = F.array().cast("array<struct<kind:string,item_id:string>>")
    image = F.array(item("image", F.col("_best")["id"])) if read_images else none
    every = F.transform(F.col("_p"), lambda p: item("image", p["id"])) if read_images else none
    scan = F.array(item("scan", F.format_string("p%d_full_scan", F.col("page"))))
    items = F.when(F.col("_best").isNotNull(), image).when(F.col("is_scanned"), scan).otherwise(F.coalesce(every, none))
    return placed.select("doc_id", "page", F.explode(items).alias("i")).select("doc_id", "page", "i.item_id", "i.kind")


def recognised(items: DataFrame, reader: Recogniser, partitions: int | None = None) -> DataFrame:
    """doc_id, item_id, words, header, error of items (doc_id, item_id, bytes); a failure is a row, not the end of the job."""
    word = "struct<text: string, conf: double, left: int, top: int, width: int, height: int, block: int, par: int, line: int, scale: double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, item_id, image in zip(b["doc_id"], b["item_id"], b["bytes"]):
                try:
                    both = (reader.words(bytes(image)), reader.header(bytes(image)) if hasattr(reader, "header") else [])
                    rows.append((doc_id, item_id, *([{"scale": 1.0, **w, "conf": _number(w.get("conf"))} for w in some] for some in both), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((doc_id, item_id, [], [], str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words", "header", "error"])

    spread = items.repartition(partitions, "doc_id", "item_id") if partitions else items
    return spread.select("doc_id", "item_id", "bytes").mapInPandas(run, f"doc_id string, item_id string, words array<{word}>, header array<{word}>, error string")


def _number(conf) -> float:
    try:
        return float(conf)
    except (TypeError, ValueError):
        return -1.0


def boxes(words: Column) -> Column:
    """Boxes of words of two characters or more with an extent, in pixels of the image as it came."""
    own = F.filter(words, lambda w: (F.length(tx.stripped(w["text"])) >= config.LEAST_OCR_WORD) & (w["width"] > 0) & (w["height"] > 0))
    scaled = lambda p, s: nm.rescaled(p, s)
    return F.transform(own, lambda w: F.struct(tx.stripped(w["text"]).alias("text"), F.coalesce(w["conf"], F.lit(-1.0)).alias("conf"), scaled(w["left"], w["scale"]).alias("x0"), scaled(w["top"], w["scale"]).alias("y0"), scaled(w["left"] + w["width"], w["scale"]).alias("x1"), scaled(w["top"] + w["height"], w["scale"]).alias("y1")))


def lines(words: DataFrame) -> DataFrame:
    """doc_id, item_id, text of words (text, block, par, line, at): lines in order, words of a line in theirs."""
    kept = words.withColumn("text", tx.stripped(F.coalesce("text", F.lit("")))).filter("text <> ''")
    per = kept.groupBy("doc_id", "item_id", "block", "par", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda w: w["text"]), " ").alias("line_text"))
    return per.groupBy("doc_id", "item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "par", "line", "line_text"))), lambda x: x["line_text"]), "\n").alias("text"))


def header_words(words: Column, text: Column) -> Column:
    """Words of a header that count: three characters, a letter or digit among them, not in the text yet."""
    return F.filter(words, lambda w: (F.length(tx.stripped(w)) >= config.LEAST_HEADER_WORD) & w.rlike(r"[\p{L}\p{N}]") & ~F.contains(F.lower(text), F.lower(tx.stripped(w))))


def with_header(text: Column, boxes: Column, header: Column, header_boxes: Column) -> Column:
    """struct(text, boxes): a header's words before the text, its boxes in reverse before the others."""
    line = F.array_join(header, " ")
    return F.struct(F.when(F.size(header) > 0, F.concat(line, F.lit("\n"), text)).otherwise(text).alias("text"), F.concat(F.reverse(header_boxes), boxes).alias("boxes"))


def results(read: DataFrame) -> DataFrame:
    """doc_id, item_id, text, boxes, success, error of what recognised() read: lines put together, the header before them, words corrected."""
    keys = [F.col(c) for c in ("doc_id", "item_id")]
    told = read.select(*keys, F.posexplode("words").alias("at", "w")).select("doc_id", "item_id", "at", "w.text", "w.block", "w.par", "w.line")
    body = lines(told).withColumnsRenamed({"doc_id": "bd", "item_id": "bi", "text": "body"})
    met = read.join(body, (F.col("doc_id") == F.col("bd")) & (F.col("item_id") == F.col("bi")), "left").drop("bd", "bi").withColumn("body", F.coalesce("body", F.lit("")))
    met = met.withColumn("head", F.filter("header", lambda w: F.size(header_words(F.array(tx.stripped(w["text"])), F.col("body"))) > 0))
    # a header's words are corrected one by one; they are few
    fixed = vocabulary.corrections(met.select(F.explode("head").alias("w")).select(tx.stripped(F.col("w.text")).alias("token"))).filter("step > 0").select("token", "corrected")
    each = met.select(*keys, F.posexplode("head").alias("at", "w")).withColumn("token", tx.stripped(F.col("w.text"))).join(fixed, "token", "left")
    each = each.withColumn("w", F.col("w").withField("text", F.coalesce("corrected", "token")))
    heads = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]).alias("told")).withColumnsRenamed({"doc_id": "hd", "item_id": "hi"})
    met = met.join(heads, (F.col("doc_id") == F.col("hd")) & (F.col("item_id") == F.col("hi")), "left").drop("hd", "hi")
    plain = lambda w: F.struct(w["text"].alias("text"), F.coalesce(w["conf"], F.lit(-1.0)).alias("conf"), w["left"].alias("x0"), w["top"].alias("y0"), (w["left"] + w["width"]).alias("x1"), (w["top"] + w["height"]).alias("y1"))
    told_head = F.coalesce("told", F.slice("head", 1, 0))
    whole = met.withColumn("all", with_header(F.col("body"), boxes(F.col("words")), F.transform(told_head, lambda w: w["text"]), F.transform(told_head, plain)))
    clean = vocabulary.cleaned(whole.select(F.struct("doc_id", "item_id").alias("id"), F.col("all.text").alias("text"))).select(F.col("id.doc_id").alias("cd"), F.col("id.item_id").alias("ci"), F.col("text").alias("clean"))
    out = whole.join(clean, (F.col("doc_id") == F.col("cd")) & (F.col("item_id") == F.col("ci")), "left")
    return out.select("doc_id", "item_id", F.coalesce("clean", F.lit("")).alias("text"), F.when(F.col("error").isNull(), F.col("all.boxes")).otherwise(F.slice("all.boxes", 1, 0)).alias("boxes"), F.col("error").isNull().alias("success"), "error")


def box_words(results: DataFrame, items: DataFrame) -> DataFrame:
    """Recognised words with their places on the page, as text.words() gives them, for the index.

    items: doc_id, page, item_id, kind (scan or image), rect, width, height of what was read. Pixels
    of a rendered page become points by its resolution, those of an image by its place on the page;
    an image without a place has words without one. Items without text give none.
    """
    of = items.withColumnsRenamed({"doc_id": "d_", "item_id": "i_"})
    met = results.filter(F.coalesce("text", F.lit("")) != "").join(of, (F.col("doc_id") == F.col("d_")) & (F.col("item_id") == F.col("i_")))
    each = met.select("doc_id", "page", "item_id", "kind", "rect", "width", "height", F.posexplode("boxes").alias("seq", "b"))
    zoom, scan = F.lit(config.RENDER_DPI / 72.0), F.col("kind") == "scan"
    place = lambda c, low, high, size: F.when(scan, nm.scan_to_points(F.col(f"b.{c}"), zoom)).otherwise(nm.image_to_points(F.get("rect", low), F.get("rect", high), F.col(f"b.{c}"), F.col(size)))
    flat = (F.get("rect", 0) == F.get("rect", 2)) | (F.get("rect", 1) == F.get("rect", 3))
    x0, y0, x1, y1 = place("x0", 0, 2, "width"), place("y0", 1, 3, "height"), place("x1", 0, 2, "width"), place("y1", 1, 3, "height")
    told = lambda c: F.when(scan | ~F.coalesce(flat, F.lit(True)), c)
    return each.select("doc_id", "page", F.when(scan, "ocr").otherwise("image_ocr").alias("src"), F.when(~scan, F.col("item_id")).alias("image_id"), F.col("b.text").alias("word"), told(x0).alias("x0"), told(y0).alias("y0"), told(x1).alias("x1"), told(y1).alias("y1"), F.col("seq").cast("long").alias("seq"))


def tuning(runs: DataFrame) -> DataFrame:
    """Of measured runs (workers, dpi, seconds, items): the fastest, how many there were, and the mean of their seconds and items."""
    best = F.min_by(F.struct("workers", "dpi", "seconds"), F.struct("seconds", "workers", "dpi"))
    return runs.agg(best.alias("best"), F.count("*").alias("runs"), F.avg("seconds").alias("mean_seconds"), F.sum("items").alias("items")).select("best.*", "runs", "mean_seconds", "items")


def workers(cores: int | None) -> int:
    """How many readers one machine runs; on a cluster that is what partitions are for."""
    return min(10, max(1, (cores or 4) - 1))


def merged(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Pages (with images) with what was recognised (doc_id, item_id, text): renders by page, images by id."""
    told = results.filter(F.coalesce("text", F.lit("")) != "")
    scans = told.select(F.col("doc_id").alias("_d"), F.col("item_id").alias("_i"), F.col("text").alias("_scan"))
    # of one document: its items by name
    images = told.groupBy(F.col("doc_id").alias("_e")).agg(F.map_from_entries(F.collect_list(F.struct("item_id", "text"))).alias("_of"))
    met = pages.join(scans, (F.col("doc_id") == F.col("_d")) & (F.format_string("p%d_full_scan", F.col("page")) == F.col("_i")), "left").join(images, F.col("doc_id") == F.col("_e"), "left")
    filled = F.transform("images", lambda i: i.withField("ocr_text", F.coalesce(F.try_element_at("_of", i["id"]), i["ocr_text"])))
    met = met.withColumns({"images": filled, "ocr_text": F.coalesce("_scan", "ocr_text")})
    joined = F.array_join(F.transform(F.filter("images", lambda i: F.coalesce(i["ocr_text"], F.lit("")) != ""), lambda i: i["ocr_text"]), "\n\n")
    return met.withColumn("ocr_text", F.when(F.col("is_scanned") & (F.coalesce("ocr_text", F.lit("")) == ""), joined).otherwise(F.col("ocr_text"))).drop("_d", "_i", "_e", "_scan", "_of")
