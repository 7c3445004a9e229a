"""Batch search: a table of queries against a table of postings, in five stages.

Terms are matched with the vocabulary (distinct terms), and only what matches is joined with
postings. Prefixes join on the first two characters, substrings on one trigram of the term, similar
words on the first character within length bounds. Stages 1 to 3 are written once, as the fuzzy
stage asks which terms had no hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry import config
from lexquarry.functions import text as tx
from lexquarry.operators import store
from lexquarry.sources.shared import stored
from lexquarry.sources.text import label, sources

HIT = ("query_id", "doc_id", "page", "source", "source_label", "token_searched", "match_type", "snippet", "matched_term", "image_id", "x0", "y0", "x1", "y1")


def parsed(queries: DataFrame) -> DataFrame:
    """query_id, raw, tokens, terms: blank queries and those without tokens drop out."""
    rows = queries.select("query_id", tx.stripped(F.coalesce("query", F.lit(""))).alias("raw"), tx.query_tokens(F.col("query")).alias("tokens"))
    return rows.filter(F.size("tokens") > 0).withColumn("terms", F.transform("tokens", tx.normal))


def terms(queries: DataFrame) -> DataFrame:
    """query_id, raw, at, term: a row for each token."""
    return parsed(queries).select("query_id", "raw", F.posexplode("terms").alias("at", "term"))


def exact(asked: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Terms as they are; whether the index has them is for the postings to say."""
    return asked.select(*asked.columns, F.col("term").alias("key"), F.lit(0).alias("stage"))


def prefix(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    wanted = asked.filter(F.length("term") >= config.LEAST_TERM)
    same = (F.substring("term", 1, 2) == F.substring("bare", 1, 2)) & F.startswith("bare", "term") & (F.col("bare") != F.col("term"))
    return wanted.join(vocabulary, same).select(*asked.columns, "key", F.lit(1).alias("stage"))


def trigrams(x: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 2, F.lit(1))), lambda i: F.substring(x, i, F.lit(3))))


def substring(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Words that hold the term but don't begin with it; a term's middle trigram leads to them."""
    wanted = asked.filter(F.length("term") >= config.LEAST_SUBSTRING).withColumn("gram", F.substring("term", (F.length("term") / 2).cast("int"), F.lit(3)))
    wanted = wanted.withColumn("gram", F.when(F.length("gram") == 3, F.col("gram")).otherwise(F.substring("term", 1, 3)))
    pieces = vocabulary.filter(F.length("bare") >= config.LEAST_SUBSTRING).select("key", "bare", F.explode(trigrams(F.col("bare"))).alias("piece"))
    within = (F.col("gram") == F.col("piece")) & F.contains("bare", "term") & ~F.startswith("bare", "term")
    return wanted.join(pieces, within).select(*asked.columns, "key", F.lit(2).alias("stage"))


def similar(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Terms and vocabulary words of the same first character and a similarity of 0.82 or more: with ratio."""
    wanted = asked.filter(F.length("term") >= config.FUZZY_LENGTH).select("term").distinct()
    near = wanted.join(vocabulary.select("key"), (F.substring("term", 1, 1) == F.substring("key", 1, 1)) & (F.col("term") != F.col("key")) & tx.may_be_similar(F.col("term"), F.col("key")))
    return near.withColumn("ratio", tx.similarity(F.col("term"), F.col("key"))).filter(F.col("ratio") >= config.FUZZY_RATIO)


def _told(matched: DataFrame, texts: DataFrame) -> DataFrame:
    """Hits with the text they stand in, and what was found there."""
    place = texts.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), F.col("src").alias("s"), F.col("image_id").alias("i"), "text")
    joined = matched.join(place, (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")) & (F.col("src") == F.col("s")) & F.col("image_id").eqNullSafe(F.col("i")), "left")
    there = tx.located(F.coalesce("text", F.lit("")), F.col("word"))
    out = joined.withColumn("there", there).withColumns({"matched_term": F.when(F.col("there.matched") != "", F.col("there.matched")).otherwise(F.col("word")), "snippet": F.col("there.snippet"), "source_label": label(F.col("src"), F.col("image_id")), "source": F.col("src")})
    return out.drop("there", "text", "d", "p", "s", "i")


def hits_of(matched: DataFrame, postings: DataFrame, texts: DataFrame) -> DataFrame:
    """Vocabulary matches (key) to hits, with the columns of stages 1 to 3."""
    places = store.looked_up(postings, matched).withColumnRenamed("term", "posted").drop("kind")
    found = _told(matched.join(places, F.col("key") == F.col("posted")), texts)
    kind = F.when(F.col("stage") == 0, "exacto").when(F.col("stage") == 1, "prefijo").otherwise("subcadena")
    return found.withColumns({"token_searched": F.col("word"), "match_type": kind})


def fuzzy(asked: DataFrame, hits: DataFrame, postings: DataFrame, vocabulary: DataFrame, texts: DataFrame) -> DataFrame:
    """Per document, for terms it doesn't know and that no hit in it begins with: its most similar words."""
    near = similar(asked, vocabulary)
    wanted = asked.filter(F.length("term") >= config.FUZZY_LENGTH)
    # of the index only the terms asked for and what is like them
    needed = near.select("key").unionByName(wanted.select(F.col("term").alias("key"))).distinct()
    held = store.looked_up(postings, needed).join(needed.withColumnRenamed("key", "needed"), F.col("term") == F.col("needed"), "left_semi")
    own = held.select("doc_id", F.col("term").alias("key")).distinct()
    met = wanted.join(near, "term").join(own, "key")
    # a term that its document knows isn't looked for
    known = own.withColumnsRenamed({"doc_id": "kd", "key": "kk"})
    met = met.join(known, (F.col("doc_id") == F.col("kd")) & (F.col("term") == F.col("kk")), "left_anti")
    # nor is one that some hit of the query begins with, as it stands in the text
    begun = hits.select(F.col("query_id").alias("hq"), F.col("doc_id").alias("hd"), F.lower("matched_term").alias("hm")).distinct()
    met = met.join(begun, (F.col("query_id") == F.col("hq")) & (F.col("doc_id") == F.col("hd")) & F.startswith("hm", "term"), "left_anti")
    best = Window.partitionBy("query_id", "doc_id", "at").orderBy(F.desc("ratio"), "key")
    met = met.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= config.FUZZY_CANDIDATES)
    places = held.withColumnsRenamed({"term": "posted", "doc_id": "pd"}).drop("kind")
    first = Window.partitionBy("query_id", "doc_id", "at", "key").orderBy("page", "src", "image_id", "seq")
    taken = met.join(places, (F.col("key") == F.col("posted")) & (F.col("doc_id") == F.col("pd"))).withColumn("of", F.row_number().over(first)).filter(F.col("of") <= config.FUZZY_POSTINGS)
    told = _told(taken, texts).withColumns({"token_searched": F.col("raw"), "match_type": F.format_string("difuso (%d%%)", F.floor(F.col("ratio") * 100 + 1e-9).cast("int")), "stage": F.lit(3)})
    # what an earlier token found may begin with a later one
    earlier = told.select(F.col("query_id").alias("eq"), F.col("doc_id").alias("ed"), F.col("at").alias("ea"), F.lower("matched_term").alias("em")).distinct()
    return told.join(earlier, (F.col("query_id") == F.col("eq")) & (F.col("doc_id") == F.col("ed")) & (F.col("ea") < F.col("at")) & F.startswith("em", "term"), "left_anti").drop("ratio", "nth", "of", "pd")


def phrase(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """Sources that hold all tokens of a query of several, anywhere: one hit each, without a place.

    A batch of queries of bounded size goes to every executor; a larger one is joined on the first
    two characters of its longest token with the pairs of characters that a source has.
    """
    asked = parsed(queries).filter(F.size("terms") > 1)
    plain = texts.withColumn("normal", tx.normal(F.col("text")))
    all_in = F.forall("terms", lambda t: F.contains(F.col("normal"), t))
    if asked.limit(config.LIMITS.broadcast_queries + 1).count() <= config.LIMITS.broadcast_queries:
        met = plain.join(F.broadcast(asked), all_in)
    else:
        long = F.array_max(F.transform("terms", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
        led = asked.withColumn("lead", F.substring(long, 1, 3))
        grams = plain.withColumn("gram", F.explode(F.array_union(trigrams(F.col("normal")), F.transform(trigrams(F.col("normal")), lambda g: F.substring(g, 1, 2)))))
        met = grams.join(led, (F.col("gram") == F.col("lead")) & all_in).drop("gram", "lead")
    there = tx.located(F.col("text"), F.get("tokens", 0))
    none = F.lit(None).cast("double")
    return met.withColumn("there", there).select(
        "query_id", "doc_id", "page", F.col("src").alias("source"), F.col("label").alias("source_label"), F.col("raw").alias("token_searched"), F.lit("frase").alias("match_type"),
        F.col("there.snippet").alias("snippet"), F.col("there.matched").alias("matched_term"), "image_id", none.alias("x0"), none.alias("y0"), none.alias("x1"), none.alias("y1"), F.lit(4).alias("stage"), F.lit(0).alias("at"), F.lit("").alias("key"), F.lit(0).cast("long").alias("seq"),
    )


def rank(match_type: Column) -> Column:
    out = F.lit(4)
    for name in ("frase", "subcadena", "prefijo", "exacto"):
        out = F.when(match_type == name, config.STAGES[name]).otherwise(out)
    return out


def distinct_hits(hits: DataFrame) -> DataFrame:
    """The first of hits alike in page, source, matched term, place and the beginning of the snippet."""
    same = Window.partitionBy("query_id", "doc_id", "page", "source", "matched_term", "x0", "y0", F.substring("snippet", 1, config.SNIPPET_KEY)).orderBy("stage", "at", "key", "image_id", "seq")
    return hits.withColumn("nth", F.row_number().over(same)).filter("nth = 1").drop("nth")


def ranked(hits: DataFrame) -> DataFrame:
    """With position within query and document: by page, kind of match, source."""
    order = Window.partitionBy("query_id", "doc_id").orderBy("page", rank(F.col("match_type")), "source", "stage", "at", "key", "image_id", "seq")
    return hits.withColumn("position", F.row_number().over(order))


def search(pages: DataFrame, postings: DataFrame, queries: DataFrame, with_fuzzy: bool = True, vocabulary: DataFrame | None = None) -> DataFrame:
    """All hits of all queries (query_id, query) in all documents, without repeats, with their position.

    vocabulary: as stored beside the postings (store.vocabulary), made from them if it is left out.
    """
    texts, asked, words = sources(pages), terms(queries), vocabulary if vocabulary is not None else store.vocabulary(postings)
    matched = exact(asked, words).unionByName(prefix(asked, words)).unionByName(substring(asked, words))
    keep = [*HIT, "stage", "at", "key", "seq"]
    first = hits_of(matched, postings, texts)
    if with_fuzzy:  # which asks for what the other stages found
        first = stored(first, "hits")
    every = first.select(*keep).unionByName(phrase(queries, texts).select(*keep))
    if with_fuzzy:
        every = every.unionByName(fuzzy(asked, first, postings, words, texts).select(*keep))
    return ranked(distinct_hits(every)).select(*HIT, "position")


def summary(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """A row for each query: tokens, number of hits, and the (document, page) pairs they are on."""
    return summed(queries, hits.groupBy("query_id").agg(F.count("*").alias("total_matches"), F.count_distinct("doc_id", "page").alias("matched_pages")))


def summed(queries: DataFrame, counted: DataFrame) -> DataFrame:
    """The same from the numbers themselves: query_id, total_matches, matched_pages."""
    tokens = queries.select("query_id", "query", F.when(tx.stripped(F.coalesce("query", F.lit(""))) == "", F.array().cast("array<string>")).otherwise(tx.query_tokens(F.col("query"))).alias("tokens"))
    return tokens.join(counted, "query_id", "left").select("query_id", "query", "tokens", F.coalesce("total_matches", F.lit(0)).alias("total_matches"), F.coalesce("matched_pages", F.lit(0)).alias("matched_pages"))


def matched_pages(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_set("page")).alias("pages"), F.count("*").alias("total_matches"))


def highlight_terms(queries: DataFrame) -> DataFrame:
    """query_id and what a preview marks: the whole phrase, if it has several tokens, then each token once."""
    raw = tx.stripped(F.coalesce("query", F.lit("")))
    tokens = tx.query_tokens(F.col("query"))
    return queries.select("query_id", F.array_distinct(F.concat(F.when(F.size(tokens) > 1, F.array(raw)).otherwise(F.array().cast("array<string>")), tokens)).alias("terms"))


def highlight_rects(hits: DataFrame) -> DataFrame:
    """Places of hits that have one."""
    return hits.filter("x0 IS NOT NULL").select("query_id", "doc_id", "page", "x0", "y0", "x1", "y1").distinct()
