"""Column functions against plain Python."""

import difflib
import random

import unicodedata

from pyspark.sql import functions as F

from lexquarry.functions import text as tx


def test_normal_form_of_the_basic_plane(spark):
    rows = [(i, chr(i)) for i in range(1, 0xFFFF) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame(rows, "i int, c string")
    got = df.select("i", tx.normal(F.col("c")).alias("n"), F.col("c").rlike(tx.several()).alias("rare")).collect()
    for r in got:
        want = "".join(x for x in unicodedata.normalize("NFKD", chr(r.i)) if not unicodedata.combining(x)).lower()
        # characters newer than the Java runtime's tables keep their case
        if r.n != want and not r.rare:
            assert len(want) == 1 and r.n.lower() == want or r.n == want.upper() or unicodedata.category(chr(r.i)) in ("Lu", "Ll", "Lt", "Cn"), (hex(r.i), r.n, want)


def test_exact_normal_form(spark):
    rows = [(t,) for t in ("ﬁn", "Ünïcödé", "한글", None, "½", "ÇA")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(tx.normal_exact(F.col("t"))).collect()]
    assert got == [tx.plain_form(t) for (t,) in rows]


def test_tokens_edges_parts(spark):
    df = spark.createDataFrame([("¿Cuál es el monto?",), ("1.043.589.150",), (None,), ("  a, bc ",)], "q string")
    assert [r[0] for r in df.select(tx.query_tokens(F.col("q"))).collect()] == [["¿Cuál", "es", "el", "monto?"], ["043", "589", "150"], [], ["bc"]]
    words = spark.createDataFrame([("¡ñandú,",), ("(x_1)",), ("--",)], "w string")
    assert [r[0] for r in words.select(tx.trimmed_word(F.col("w"))).collect()] == ["ñandú", "x_1", ""]


def test_snippet_and_location(spark):
    text = "a" * 100 + " Señor\n\n  PÉREZ " + "b" * 100
    df = spark.createDataFrame([(text, "pérez"), (text, "PEREZ"), (text, "none"), ("", "x"), (None, "x")], "t string, w string")
    got = [tuple(r[0]) for r in df.select(tx.located(F.col("t"), F.col("w"))).collect()]
    assert got[0][0] == "PÉREZ" and got[0][1].startswith("...aaa") and got[0][1].endswith("bbb...") and "Señor PÉREZ" in got[0][1]
    assert got[1][0] == "PEREZ" and "Señor PÉREZ" in got[1][1]
    assert got[2] == ("none", "") and got[3] == ("x", "") and got[4] == ("x", "")


def test_similarity_bound_loses_nothing(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcde") for _ in range(r.randint(4, 9))) for _ in range(120)]
    pairs = [(a, b) for a in base for b in base[:60]] + [(a, a[:2] + "x" + a[3:]) for a in base] + [(a, a + "s") for a in base]
    df = spark.createDataFrame(pairs, "a string, b string")
    kept = {(x.a, x.b) for x in df.filter(tx.may_be_similar(F.col("a"), F.col("b"))).collect()}
    assert {(a, b) for a, b in pairs if difflib.SequenceMatcher(None, a, b).ratio() >= 0.82} <= kept


def test_lines_highlight_and_files(spark):
    df = spark.createDataFrame([("ok line\n\n==== | >>\nx\n-\n  y==z  ",)], "t string")
    assert df.select(tx.kept_lines(F.col("t"))).first()[0] == ["ok line", "|", "x", "-", "y z"]
    h = spark.createDataFrame([("a.b A.B axb", "a.b"), ("x", "")], "t string, w string")
    assert [r[0] for r in h.select(tx.highlighted(F.col("t"), F.col("w"))).collect()] == ["<mark>a.b</mark> <mark>A.B</mark> axb", "x"]
    f = spark.createDataFrame([("/x/Doc.PDF",), ("noext",), (".hidden",)], "p string")
    assert [tuple(r) for r in f.select(tx.basename(F.col("p")), tx.extension(F.col("p"))).collect()] == [("Doc.PDF", ".pdf"), ("noext", ""), (".hidden", "")]
    s = spark.createDataFrame([("foo, (bar)-baz",)], "t string").select(tx.with_separators(F.col("t"))).first()[0]
    assert "".join(s) == "foo, (bar)-baz" and "bar" in s
