"""Search: what the surveyed engine's tests assert, and a plain model of the stages."""

import difflib
import random
import re

from pyspark.sql import functions as F

from lexquarry.functions.text import plain_form
from lexquarry.operators import context, index, search
from lexquarry.sources import text as source


def digital(spark, n=3, doc=1):
    rows = [(doc, i, f"Página {i}\nNIT 900.123.456-7 FACTURA REMITENTE\nReporte financiero trimestral NIT de auditoría {i - 1}.") for i in range(1, n + 1)]
    return source.classified(spark.createDataFrame(rows, "doc_id long, page int, text string"))


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries, 1)), "query_id int, query string")


def run(spark, pages, *queries, fuzzy=True):
    return search.search(pages, index.postings(source.words(pages)), asked(spark, *queries), fuzzy).collect()


def test_exact_with_places(spark):
    hits = [h for h in run(spark, digital(spark), "FACTURA") if h.match_type == "exacto"]
    assert sorted(h.page for h in hits) == [1, 2, 3] and all(h.x0 is not None for h in hits)
    assert all("FACTURA" in h.snippet and h.source_label == "Texto Digital" for h in hits)


def test_case_accents_prefix_substring(spark):
    pages = digital(spark)
    assert {h.matched_term for h in run(spark, pages, "auditoria")} == {"auditoría"}
    assert {h.match_type for h in run(spark, pages, "finan")} == {"prefijo"}
    assert {h.match_type for h in run(spark, pages, "mestr")} == {"subcadena"}
    assert run(spark, pages, "", "   ", "x") == []
    assert run(spark, pages, "zzzqqq") == []


def test_phrase_and_order(spark):
    hits = run(spark, digital(spark), "reporte trimestral")
    assert {"frase", "exacto"} == {h.match_type for h in hits}
    first = sorted((h for h in hits), key=lambda h: h.position)
    assert [h.page for h in first] == sorted(h.page for h in hits) and first[0].match_type == "exacto"
    assert all(h.x0 is None for h in hits if h.match_type == "frase")


def test_fuzzy_only_for_unknown_terms(spark):
    hits = run(spark, digital(spark), "facturra")
    assert hits and all(h.match_type == "difuso (93%)" and h.matched_term == "FACTURA" for h in hits)
    assert not any(h.match_type.startswith("difuso") for h in run(spark, digital(spark), "factura"))


def test_index_keys(spark):
    words = spark.createDataFrame([(1, 1, "text", None, w, 0.0, 0.0, 0.0, 0.0, i) for i, w in enumerate(["CO9CA0101-LOSARTÁN", "1.043.589.150", "900.123.456-7", "CC-1043448102", "foo-foo", "(ab)", "x"])], "doc_id long, page int, src string, image_id string, word string, x0 double, y0 double, x1 double, y1 double, seq long")
    got = {}
    for r in index.postings(words).collect():
        got.setdefault(r.word, []).append(r.term)
    assert sorted(got["CO9CA0101-LOSARTÁN"]) == ["co9ca0101", "co9ca0101-losartan", "losartan"]
    assert "1043589150" in got["1.043.589.150"] and "589" in got["1.043.589.150"]
    assert "900123456" not in got["900.123.456-7"] and "123" in got["900.123.456-7"]
    assert got["CC-1043448102"].count("1043448102") == 2
    assert got["foo-foo"].count("foo") == 2 and got["(ab)"] == ["(ab)", "ab"] and "x" not in got


def model(pages, query):
    """Hits (page, kind, matched) of one document, by nested loops."""
    words: dict[str, list] = {}
    for page, text in pages:
        for w in text.split():
            n = plain_form(w)
            if len(n) < 2:
                continue
            clean = re.sub(r"^[^\w]+|[^\w]+$", "", n)
            terms = [n] + [clean] * (clean != n and len(clean) > 1) + [t for t in re.split(r"[-/_.:]+", clean) if len(t) > 1 and t != clean]
            for t in terms:
                words.setdefault(t, []).append((page, w))
    tokens = [plain_form(t) for t in re.split(r"[\s,\-_:.;/]+", query.strip()) if len(t) > 1]
    out, seen = set(), []
    for stage, test in (("exacto", lambda k, b, t: k == t), ("prefijo", lambda k, b, t: b != t and b.startswith(t)), ("subcadena", lambda k, b, t: len(t) > 2 and t in b and not b.startswith(t))):
        for t in tokens:
            for k, places in words.items():
                if test(k, re.sub(r"^[^\w]+|[^\w]+$", "", k), t):
                    seen += [w for _, w in places]
                    out |= {(p, w, k) for p, w in places}
    fuzzy = set()
    for t in tokens:
        if t in words or len(t) < 4 or any(w.lower().startswith(t) for w in seen):
            continue
        near = sorted(((-difflib.SequenceMatcher(None, t, k).ratio(), k) for k in words if k[0] == t[0] and k != t), key=lambda x: x)
        for r, k in [x for x in near if -x[0] >= 0.82][:5]:
            fuzzy |= {(p, w) for p, w in words[k][:10]}
            seen += [w for _, w in words[k][:10]]
    return {(p, w) for p, w, _ in out}, fuzzy


def test_stages_against_the_model(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choice(["ta", "re", "mi", "ló", "nex"]) for _ in range(r.randint(1, 3))) for _ in range(40)]
    docs = {d: [(p, " ".join(r.choice(vocabulary) + r.choice(["", ".", ","]) for _ in range(12))) for p in range(1, 4)] for d in range(1, 5)}
    pages = source.classified(spark.createDataFrame([(d, p, t) for d, ps in docs.items() for p, t in ps], "doc_id long, page int, text string"))
    queries = ["tare", "mi lo", "nexta remi", "talonexe", "rexmi"]
    hits = run(spark, pages, *queries)
    for q, query in enumerate(queries, 1):
        for d, ps in docs.items():
            plain, fuzzy = model(ps, query)
            own = [h for h in hits if h.query_id == q and h.doc_id == d]
            assert {(h.page, h.token_searched) for h in own if h.match_type in ("exacto", "prefijo", "subcadena")} == plain
            assert {h.page for h in own if h.match_type.startswith("difuso")} == {p for p, _ in fuzzy}


def test_many_queries_take_the_other_way(spark, monkeypatch):
    from lexquarry import config

    pages = digital(spark)
    want = {(h.query_id, h.page) for h in run(spark, pages, "reporte trimestral", "nit de") if h.match_type == "frase"}
    monkeypatch.setattr(config, "LIMITS", config.Limits(broadcast_queries=0))
    got = {(h.query_id, h.page) for h in run(spark, pages, "reporte trimestral", "nit de") if h.match_type == "frase"}
    assert got == want and len(got) == 6


def test_context_budget_and_pages(spark):
    rows = [(1, i, "palabra " * 100 + ("factura total" if i == 15 else "")) for i in range(1, 21)]
    pages = source.classified(spark.createDataFrame(rows, "doc_id long, page int, text string"))
    r = context.contexts(pages, ["factura", " "], 2000).first()
    assert len(r.context) <= 2000 and r.pages_used == sorted(r.pages_used) and r.pages_used[0] == 1 and 15 not in r.pages_used[3:]
    small = source.classified(spark.createDataFrame([(2, 1, "uno"), (2, 2, " "), (2, 3, "tres")], "doc_id long, page int, text string"))
    s = context.contexts(small, ["x"]).first()
    assert s.pages_used == [1, 3] and s.context == "--- PÁGINA 1 ---\nuno\n\n--- PÁGINA 3 ---\ntres"


def test_evidence_keeps_to_three_pages(spark):
    rows = [(1, 1, p, i, "Texto Digital", f"s{i}") for i, p in enumerate([1, 1, 2, 3, 1, 2, 4, 5, 6], 1)]
    hits = spark.createDataFrame(rows, "query_id int, doc_id long, page int, position int, source_label string, snippet string")
    assert context.evidence(hits).first().pages_used == [1, 1, 2, 3, 4]


def test_fallback_index_and_images(spark):
    pages = digital(spark)
    terms = {r.term for r in index.plain_postings(pages).select("term").distinct().collect()}
    assert {"factura", "nit", "auditoria"} <= terms
    with_image = pages.withColumn("images", F.array(F.struct(F.lit("p1_img1").alias("id"), F.col("page").alias("page"), F.lit(50).alias("width"), F.lit(50).alias("height"), F.lit("png").alias("format"), F.lit("sello rojo").alias("ocr_text"), F.lit(None).cast("binary").alias("bytes"))))
    hits = run(spark, with_image, "sello")
    assert {h.source_label for h in hits} == {"Imagen p1_img1 (OCR)"} and len(hits) == 3
