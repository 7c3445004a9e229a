"""The positional index: words to postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry import config
from lexquarry.functions import text as tx
from lexquarry.sources.text import sources

KINDS = ("base", "clean", "part", "number", "run", "corrected")


def forms(words: DataFrame) -> DataFrame:
    """words with what their keys are made of; in steps, so that none is computed twice."""
    rows = words.withColumn("_base", tx.normal(F.col("word"))).filter(F.length("_base") >= config.LEAST_TERM)
    return rows.withColumn("_clean", tx.trimmed_word(F.col("_base"))).withColumn("_number", tx.digits_only(F.col("_clean")))


def keys(corrected: Column | None = None, kinds: tuple[str, ...] = KINDS) -> Column:
    """All index terms of a word (by its forms) as an array of structs (kind, term), in the order they are made.

    corrected: for recognised words, an array of corrections of the cleaned word and its parts. kinds: which are made.
    A term that several rules give comes several times, as many postings as it makes.
    """
    base, clean, number = F.col("_base"), F.col("_clean"), F.col("_number")
    long = lambda t: F.length(t) >= config.LEAST_TERM
    none = F.array().cast("array<struct<kind:string,term:string>>")
    one = lambda kind, term: F.array(F.struct(F.lit(kind).alias("kind"), term.alias("term")))
    many = lambda kind, terms: F.transform(terms, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))
    groups = {
        "base": one("base", base),
        "clean": F.when((clean != base) & long(clean), one("clean", clean)).otherwise(none),
        "part": F.when(clean.rlike(tx.PART_BREAK), many("part", F.filter(tx.word_parts(clean), lambda t: (t != clean) & long(t)))).otherwise(none),
        "number": F.when((number != clean) & tx.is_numeric(number) & (F.length(number) >= config.LEAST_NUMBER), one("number", number)).otherwise(none),
        "run": F.when(clean.rlike("[0-9]{6}"), many("run", F.filter(tx.digit_runs(clean), lambda t: (t != clean) & (t != number)))).otherwise(none),
    }
    if corrected is not None:
        groups["corrected"] = many("corrected", F.filter(corrected, long))
    chosen = [g for kind, g in groups.items() if kind in kinds]
    return F.concat(*chosen) if chosen else none


def postings(words: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """A row for each term of each word; no shuffle. words: as words() gives them, with corrected if recognised."""
    own = keys(F.col("corrected") if "corrected" in words.columns else None, kinds)
    rows = forms(words).select("doc_id", "page", "src", "image_id", "word", "x0", "y0", "x1", "y1", "seq", F.posexplode(own).alias("nth", "key"))
    return rows.select("doc_id", "key.term", "key.kind", "page", "src", "image_id", "x0", "y0", "x1", "y1", "word", (F.col("seq") * 64 + F.col("nth")).alias("seq"))


def plain_postings(pages: DataFrame) -> DataFrame:
    """The fallback index: plain words of every source, without places."""
    rows = sources(pages).select("doc_id", "page", "src", F.posexplode(tx.plain_words(F.col("text"))).alias("seq", "word"))
    none = F.lit(None).cast("double")
    return rows.select("doc_id", tx.normal(F.col("word")).alias("term"), F.lit("plain").alias("kind"), "page", "src", F.lit(None).cast("string").alias("image_id"), none.alias("x0"), none.alias("y0"), none.alias("x1"), none.alias("y1"), "word", F.col("seq").cast("long").alias("seq")).filter(F.length("term") >= config.LEAST_TERM)


def stats(postings: DataFrame) -> DataFrame:
    return postings.agg(F.count_distinct("term").alias("terms"), F.count("*").alias("postings"))


def vocabulary(postings: DataFrame) -> DataFrame:
    """term, documents, postings."""
    return postings.groupBy("term").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("postings"))


def by_first(postings: DataFrame) -> DataFrame:
    """Distinct terms by their first character."""
    return postings.select("term").distinct().groupBy(F.substring("term", 1, 1).alias("first")).agg(F.count("*").alias("terms"))


def exported(postings: DataFrame) -> DataFrame:
    """term and its postings as one array, in order: for exports of small corpora."""
    return postings.groupBy("doc_id", "term").agg(F.array_sort(F.collect_list(F.struct("page", "seq", "src", "word"))).alias("places"))
