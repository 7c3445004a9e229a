"""From bytes to hits: a reader and a recogniser of our own stand in for PyMuPDF and Tesseract."""

import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from lexquarry.operators import extract, index, ocr, search
from lexquarry.plans import ingest
from lexquarry.sources import binary
from lexquarry.sources.shared import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this file


class Reader:
    """Reads JSON: a list of pages, each with its text, words, placements and render."""

    def pages(self, content):
        for n, p in enumerate(json.loads(content), 1):
            words = [{"word": w, "x0": 10.0 * i, "y0": 5.0, "x1": 10.0 * i + 8, "y1": 9.0} for i, w in enumerate(p["text"].split())]
            placed = [{"id": i, "width": 100, "height": 200, "format": "png", "bytes": i.encode(), "rect": r, "cover": c} for i, r, c in p.get("images", [])]
            yield {"page": n, "text": p["text"], "words": words, "placements": placed, "render": p["render"].encode() if "render" in p else None}


class Reads:
    """An image's bytes are its words; a header word is marked by an exclamation mark."""

    def words(self, image):
        if image == b"broken":
            raise OSError("no image")
        return [{"text": t, "conf": 91, "left": 20 * i, "top": 40, "width": 15, "height": 10, "block": 1, "par": 1, "line": 1} for i, t in enumerate(image.decode().split()) if not t.endswith("!")]

    def header(self, image):
        return [{"text": t[:-1], "conf": 50, "left": 0, "top": 3, "width": 30, "height": 8, "block": 0, "par": 0, "line": 0} for t in image.decode().split() if t.endswith("!")]


LONG = "una factura electronica con texto digital suficiente"
FILE = [{"text": LONG, "images": [("p1_img1", [50.0, 100.0, 150.0, 300.0], 0.2)]}, {"text": "", "render": "facha paclente Semedica! ID-900.123"}, {"text": "x", "images": [("p3_img1", None, 0.9)]}, {"text": "", "render": "broken"}]


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    (folder / "a.json").write_text(json.dumps(FILE))
    (folder / "bad.json").write_text("{")
    (folder / "large.json").write_text(" " * 5000)
    read = stored(binary.pages(binary.listed(spark, str(folder), "*.json", 4000), Reader()), "read")
    return read, *ingest.ingested(read, Reads())


def test_files_that_cannot_be_read_are_told(whole):
    _, bad = binary.valid(whole[0])
    errors = {r.doc_id.rsplit("/", 1)[-1]: r.error for r in bad.collect()}
    assert len(errors) == 2 and errors["large.json"] == "5000 bytes, more than 4000"


def test_words_have_their_places(spark, whole):
    _, pages, words = whole
    got = {(r.page, r.word): r for r in words.collect()}
    assert got[1, "factura"].x0 == 10.0 and got[1, "factura"].src == "text"
    # pixels of a rendered page in points, of an image by its place on the page
    scan = got[2, "paclente"]
    assert scan.src == "ocr" and scan.image_id is None and scan.x0 == pytest.approx(20 * 72 / 150) and scan.y0 == pytest.approx(40 * 72 / 150) and scan.corrected == ["paciente"]
    image = got[1, "p1_img1"]
    assert image.src == "image_ocr" and image.image_id == "p1_img1" and (image.x0, image.y0, image.x1, image.y1) == (50.0, 140.0, 65.0, 150.0)
    assert got[3, "p3_img1"].x0 is None
    assert got[2, "Semedical"].y0 == pytest.approx(3 * 72 / 150)  # of the header, corrected
    texts = {r.page: r.ocr_text for r in pages.collect()}
    assert texts[2] == "Semedical\nFecha Paciente ID-900.123".replace("Fecha Paciente", "fecha paciente") and texts[4] == ""


def test_hits_from_bytes(spark, whole):
    _, pages, words = whole
    hits = search.search(pages, index.postings(words), spark.createDataFrame([(1, "paciente"), (2, "factura"), (3, "900123")], "query_id int, query string"), with_fuzzy=False).collect()
    assert {(h.query_id, h.page, h.match_type, h.token_searched) for h in hits} == {(1, 2, "exacto", "paclente"), (2, 1, "exacto", "factura")}
    assert next(h for h in hits if h.query_id == 1).x0 == pytest.approx(9.6)


def test_sample_document(spark):
    read = binary.sample(spark)
    pages, words = binary.as_pages(read), binary.text_words(read)
    assert pages.count() == 20 and pages.filter("is_scanned").count() == 4 and ingest.items(read).count() == 8
    assert index.postings(words).filter("term = 'fe-1003'").first().page == 3


def test_faint_marks_and_workers():
    gray, blurred = np.array([[100, 200], [250, 0]], "uint8"), np.array([[110, 190], [250, 255]], "uint8")
    assert ocr.faint_marks(gray, blurred).tolist() == [[220, 255], [255, 0]]
    assert [ocr.workers(n) for n in (None, 1, 2, 8, 64)] == [3, 1, 1, 7, 10]


def test_chosen_models(spark):
    names = lambda *x: spark.createDataFrame(list(enumerate(x)), "at int, name string")
    told = lambda *x: [r.name for r in extract.chosen_models(names(*x)).orderBy("at").collect()]
    assert told("a", "Qwen2:1b", "qwen3") == ["Qwen2:1b", "qwen3"] and told("b", "a") == ["b"] and told() == ["qwen2.5:1.5b"]
