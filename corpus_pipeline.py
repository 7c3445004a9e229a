"""A corpus from documents: languages told, near copies out, repeats cut, personal data replaced, packed.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps, with their columns; the last
packs them. All read their whole input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexquarry.llm import langid, packing, repeats, simhash, surrogates
from lexquarry.llm.common import saved, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go (operator 8): null texts, texts without a letter, and unsure ones.

    Repeated rows stay or go together; long texts are read whole; all columns stay, whatever their names; an empty table stays empty.
    """
    return langid.accepted(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (operator 9, on shingles of five words): that with the smallest doc_id.

    Null and empty texts are alike, so one of them stays. Rows are told apart by doc_id and text: of repeated rows one
    stays, rows that share an id or have none are judged by their texts. Long texts are read whole; columns and an empty table stay as they are.
    """
    return simhash.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that occur before are cut out (operator 3): in a smaller doc_id, or earlier in the text.

    Every row stays, with null, empty or shortened text; repeated rows are one document, cut alike. A null doc_id comes first. Long texts are
    read whole; columns and an empty table stay as they are.
    """
    return repeats.removed(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets surrogates (operator 4), by the session's key: see surrogates.session_key().

    Every row stays; null and empty texts as they are, repeated rows alike. Columns and an empty table stay as they are.
    """
    return surrogates.replaced(docs, surrogates.session_key(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 1024 tokens (operator 10); a null or empty text is the end id alone.

    Repeated rows are packed each; long texts are cut into pieces; other columns are left out. An empty table gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("personal_data", personal_data), ("packed", packed)]

ORACLE_SQL = None  # a trained network, tokenizers and suffixes: tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
