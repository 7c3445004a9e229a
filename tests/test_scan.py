"""Search without an index gives what search over the index gives."""

import random

import pytest
from pyspark.sql import functions as F

from lexquarry import config
from lexquarry.operators import index, scan, search
from lexquarry.plans import catalogue
from lexquarry.sources import text as source


def pages(spark):
    r = random.Random(11)
    syllables = ["ta", "re", "mi", "ló", "nex", "ﬁn", "ÁR", "Straße"]
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(60)]
    words += ["CO9CA0101-LOSARTÁN", "1.043.589.150", "CC-1043448102", "foo-foo", "(ab)", "x", "_a_", "ref123456", "½", "ΟΔΟΣ", "12,34", "…"]
    rows = [(d, p, r.choice(["", " "]) + "".join(r.choice(words) + r.choice(["", ".", ","]) + r.choice([" ", "  ", "\t", " "]) for _ in range(r.choice([0, 2, 15, 40])))) for d in range(1, 9) for p in range(1, 5)]
    plain = source.as_recognised(source.classified(spark.createDataFrame(rows, "doc_id long, page int, text string")))
    image = F.struct(F.lit("i1").alias("id"), F.col("page").alias("page"), F.lit(50).alias("width"), F.lit(50).alias("height"), F.lit("png").alias("format"), F.lit("tare sello remi").alias("ocr_text"), F.lit(None).cast("binary").alias("bytes"))
    both = F.array(image, image.withField("id", F.lit("i2")))
    return plain.withColumn("images", F.when(F.col("doc_id") == 2, both).otherwise(F.col("images")))


QUERIES = ["tare", "mi lo", "nexta remi", "talonexe", "rexmi", "tareta tarelo", "", "x", "finar", "strase", "1043589150", "043 losartan", "foo", "ab", "123456", "retaremi taremi", "οδος", "12", "sello tare"]


@pytest.mark.parametrize("fuzzy", [True, False])
def test_scan_is_search(spark, fuzzy, monkeypatch):
    rows, asked = pages(spark), spark.createDataFrame(list(enumerate(QUERIES, 1)), "query_id int, query string")
    want = search.search(rows, index.postings(source.words(rows)), asked, fuzzy).cache()
    assert {h.match_type.split(" ")[0] for h in want.collect()} == {"exacto", "prefijo", "subcadena", "frase"} | ({"difuso"} if fuzzy else set())
    got = scan.search(rows, asked, fuzzy)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    summary = sorted(search.summary(asked, want).collect())
    assert sorted(search.summed(asked, scan.counts(rows, asked, fuzzy)).collect()) == summary
    few = asked.filter("query_id <= 6")
    assert sorted(map(str, scan.search(rows, few, fuzzy).drop("position").collect())) == sorted(map(str, want.filter("query_id <= 6").drop("position").collect()))
    monkeypatch.setattr(config, "LIMITS", config.Limits(broadcast_queries=4))
    monkeypatch.setattr(scan, "WORDS_KEPT", 5)
    assert sorted(search.summed(asked, scan.counts(rows, asked, fuzzy)).collect()) == summary


def test_export_is_that_of_the_index(spark):
    rows = pages(spark)
    want = index.exported(index.postings(source.words(rows))).select("doc_id", "term", F.size("places").alias("n"), F.element_at("places", 1)["page"].alias("first_page"))
    got = scan.exported(rows)
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("name", ["search_batch", "search_ranked", "search_summary", "postings_export", "highlight_rects"])
def test_batches_asked_once_build_no_index(spark, name, monkeypatch):
    monkeypatch.setattr(catalogue.store, "opened", lambda *a: pytest.fail("an index of the whole corpus"))
    assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_places_are_those_of_hits(spark):
    rows = pages(spark)
    rows, asked = rows.unionByName(rows.filter("doc_id < 3")), spark.createDataFrame(list(enumerate(QUERIES, 1)), "query_id int, query string")
    want = search.highlight_rects(scan.search(rows, asked, False)).drop("y0", "y1")
    got = scan.places(rows, asked).distinct().select(want.columns[:3] + ["x0", "x1"])
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 100
    assert got.dtypes == want.dtypes


def test_rects_shuffle_no_text(spark):
    plan = catalogue.queries()["highlight_rects"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert "RepartitionByExpression" not in below and "Sort" not in below
