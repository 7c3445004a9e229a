"""Correction, recognition, extraction, content, exports, streams."""

import json
import random
import sys
import unicodedata

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lexquarry.functions import json as js
from lexquarry.operators import content, extract, index, ocr, vocabulary
from lexquarry.sources import binary, sinks
from lexquarry.sources import text as source

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module

def test_corrections(spark):
    want = {"facha": ("fecha", 1), "Gestlon": ("Gestión", 1), "PACLENTE": ("PACIENTE", 1), "fehca": ("fecha", 4), "pacente": ("pacente", 0), "hola": ("hora", 3), "losartan": ("losartán", 2), "abc": ("abc", 0), "CC10": ("CC10", 0), "total": ("total", 0), "jumio": ("junio", 3)}
    got = {r.token: (r.corrected, r.step) for r in vocabulary.corrections(spark.createDataFrame([(t,) for t in want] + [(None,), ("facha",)], "token string")).collect()}
    assert got == want


def test_clean_block(spark):
    df = spark.createDataFrame([(1, "FACHA:  12/03\n=====\n\nel paclente (X) llegó\n-|"), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.text for r in vocabulary.cleaned(df).collect()}
    assert got == {1: "FECHA: 12/03\nel paciente (X) llegó", 2: "", 3: ""}


def test_recognised_words_get_corrected_keys(spark):
    words = spark.createDataFrame([(1, 1, "ocr", None, "Paclente", 0.0, 0.0, 0.0, 0.0, 0), (1, 1, "text", None, "Paclente", 0.0, 0.0, 0.0, 0.0, 1)], "doc_id long, page int, src string, image_id string, word string, x0 double, y0 double, x1 double, y1 double, seq long")
    rows = index.postings(vocabulary.corrected_words(words)).collect()
    assert sorted((r.src, r.term) for r in rows) == [("ocr", "paciente"), ("ocr", "paclente"), ("text", "paclente")]


class Reader:
    def words(self, image):
        if image == b"bad":
            raise ValueError("garbage")
        return [{"text": w, "conf": c, "left": 10 * i, "top": 0, "width": 8 if w != "zero" else 0, "height": 5, "block": 1, "par": 1, "line": 1 + i // 2} for i, (w, c) in enumerate([("Hola", 90), ("x", 80), ("zero", 70), ("mundo", "n/a")])]


def test_recognition_rows_and_errors(spark):
    items = spark.createDataFrame([("d", "p1_full_scan", bytearray(b"ok")), ("d", "p2_full_scan", bytearray(b"bad"))], "doc_id string, item_id string, bytes binary")
    rows = {r.item_id: r for r in ocr.recognised(items, Reader()).withColumn("boxes", ocr.boxes(F.col("words"))).collect()}
    assert [b.text for b in rows["p1_full_scan"].boxes] == ["Hola", "mundo"] and rows["p1_full_scan"].boxes[1].conf == -1.0
    assert rows["p2_full_scan"].error == "garbage" and rows["p2_full_scan"].words == []


def test_merge_of_results(spark):
    pages = source.classified(spark.createDataFrame([("d", 1, ""), ("d", 2, "x" * 40)], "doc_id string, page int, text string"))
    results = spark.createDataFrame([("d", "p1_full_scan", "hallado"), ("d", "nope", "")], "doc_id string, item_id string, text string")
    assert {r.page: r.ocr_text for r in ocr.merged(pages, results).collect()} == {1: "hallado", 2: ""}


class Pages:
    def pages(self, content):
        if content == b"broken":
            raise ValueError("corrupt")
        for i, t in enumerate(content.decode().split("\f"), 1):
            yield {"page": i, "text": t, "words": [], "placements": [], "render": None}


def test_ingest_and_quarantine(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"uno dos tres cuatro cinco seis siete\fdos")
    (tmp_path / "b.pdf").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"no")
    files = binary.listed(spark, str(tmp_path))
    good, bad = binary.valid(binary.pages(files, Pages()))
    assert sorted((r.page, r.is_scanned) for r in binary.as_pages(good).collect()) == [(1, False), (2, True)]
    assert [r.error for r in bad.collect()] == ["corrupt"]


@pytest.mark.skipif(not binary.PdfReader.available(), reason="PyMuPDF isn't installed")
def test_pdf_backend(spark):
    import fitz

    doc = fitz.open()
    doc.new_page().insert_text((72, 72), "hola")
    assert next(binary.PdfReader().pages(doc.tobytes()))["page"] == 1


def test_extraction(spark):
    pages = source.classified(spark.createDataFrame([(1, 1, "total 42"), (2, 1, "nada")], "doc_id long, page int, text string"))
    ok = extract.extract_values(pages, ["total"], extract.EchoModel('```json\n{"total": "42"}\n```')).collect()
    assert all(r["values"] == {"total": "42"} and r.error is None and r.pages_consulted == [1] for r in ok)
    bad = extract.extract_values(pages, ["total"], extract.EchoModel("nope")).collect()
    assert all(r["values"] == {"total": "No encontrado"} and r.error for r in bad)
    assert extract.extract_values(pages, [], extract.EchoModel()).first()["values"] == {}


class Failing:
    name = "down"

    def generate(self, prompt):
        raise ConnectionError("no server")


def test_questions(spark):
    pages = source.classified(spark.createDataFrame([(1, 1, "El monto total es 42 pesos en la factura")], "doc_id long, page int, text string"))
    postings = index.postings(source.words(pages))
    questions = spark.createDataFrame([(1, "¿Cuál es el monto?"), (2, "zzzz"), (3, " ")], "query_id int, query string")
    model = extract.EchoModel(json.dumps({"answer": "42", "unit": "pesos", "page": 1, "evidence": "monto", "confidence": 0.91234}))
    got = {r.query_id: r for r in extract.ask(pages, postings, questions, model).collect()}
    assert got[1].answer == "42" and got[1].confidence == 0.912 and got[1].pages_consulted == [1] * len(got[1].pages_consulted)
    assert got[2].answer is None and got[2].reason and got[3].error == "Pregunta vacía."
    down = {r.query_id: r for r in extract.ask(pages, postings, questions, Failing()).collect()}
    assert "no server" in down[1].error and down[1].confidence == 0


def test_json_salvage(spark):
    raws = ['{"a": 1}', '```json\n{"a": 1}\n```', 'so: {"a": 1} end', "[1]", "x", None, "```{"]
    df = spark.createDataFrame([(r,) for r in raws], "r string")
    assert [r[0] is not None for r in df.select(js.salvaged(F.col("r"))).collect()] == [True, True, True, False, False, False, False]


def test_exports_and_gallery(spark, tmp_path):
    values = spark.createDataFrame([(1, {"Total": '1"2', "Fecha": "x"})], "doc_id int, values map<string,string>")
    assert sorted(r.line for r in sinks.csv_lines(values).collect()) == ['"Fecha","x"', '"Total","1""2"']
    sinks.write_csv(values, str(tmp_path / "c"))
    sinks.write_json(values, str(tmp_path / "j"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).count() == 2
    pages = source.classified(spark.createDataFrame([(1, 1, "t")], "doc_id long, page int, text string"))
    assert sinks.gallery(pages).count() == 0 and json.loads(sinks.payload(pages).first().payload)["ocr_pages"] == 1


def test_content_store(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.copies) for r in content.distinct_documents(docs).collect()) == [(1, 2), (3, 1)]
    used = spark.createDataFrame([(c, i) for i, c in enumerate("abcde")], "content_sha256 string, last_used int")
    assert [r[0] for r in content.retained(used).collect()] == ["e", "d", "c"]


def test_stream_passes_over_what_was_seen(spark, tmp_path):
    from lexquarry.streaming import incremental

    where = [str(tmp_path / x) for x in ("in", "index", "checkpoint")]
    for rows in ([(1, "uno dos"), (2, "uno dos")], [(3, "uno dos"), (4, "tres")]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(where[0])
        incremental.watch(spark, *where).awaitTermination()
    got = spark.read.parquet(f"{where[1]}/postings")
    assert sorted(r.term for r in got.collect()) == ["dos", "tres", "uno"]


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and callable(e.entry)


def corrected_by_hand(token):
    clean = "".join(c for c in unicodedata.normalize("NFKD", token) if not unicodedata.combining(c)).lower()
    confused = dict(map(str.split, vocabulary.CONFUSIONS))
    one = [w for w in vocabulary.WORDS if len(w) == len(clean) and sum(a != b for a, b in zip(w, clean)) == 1]
    short = {}
    for w in vocabulary.WORDS:
        for i in range(len(w)):
            short.setdefault(w[:i] + w[i + 1 :], w)
    less = [short[g] for g in (clean[:i] + clean[i + 1 :] for i in range(len(clean))) if g in short and abs(len(short[g]) - len(clean)) <= 1]
    if len(token) < 4:
        return token, 0
    if clean in confused:
        word, step = confused[clean], 1
    elif clean in vocabulary.WORDS:
        word, step = clean, 2 if clean in vocabulary._forms() else 0
    else:
        word, step = (one[0], 3) if one else (less[0], 4) if less else (None, 0)
    if not step:
        return token, 0
    form = vocabulary.form_of(word)
    return (form.upper() if token == token.upper() else form if token[0] == token[0].upper() else form.lower()), step


def test_corrections_of_all_words_of_the_documents(spark, tmp_path):
    from lexquarry.plans import catalogue

    r, words = random.Random(3), ["electrocardiografico", "identificacíon", "Diagnóstico", "diagnóstlco", "HIPERTENSIONES", "niño", "straßenbahn"]
    for w in vocabulary.WORDS:
        at = r.randrange(len(w))
        words += [w, w[:at] + r.choice("aeionrst") + w[at + 1 :], w[:at] + w[at + 1 :], w[:at] + "é" + w[at + 1 :], w.upper()]
    spark.createDataFrame([(1, " ".join(words)), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.token: (x.corrected, x.step) for x in catalogue.queries()["vocab_corrections_all"](spark, str(tmp_path)).collect()}
    assert got == {w: corrected_by_hand(w) for w in words}
    assert sum(len(w) > 9 and step > 0 for w, (_, step) in got.items()) > 20
