"""Queries over the driver's tables: each applies one operator to its whole table."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers

from lexquarry.llm import bpe, exact_topk, hnsw, langid, licenses, packing, repeats, simhash, surrogates, warc
from lexquarry.llm.common import scratch, table


def op1_bpe(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_warc(spark, sf_dir):
    archive = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), archive)
    return warc.read(spark, archive).drop("uri")


def op3_repeats(spark, sf_dir):
    return repeats.report(table(spark, sf_dir, "documents"))


def op4_surrogates(spark, sf_dir):
    return surrogates.report(table(spark, sf_dir, "documents"), surrogates.session_key(spark))


def op5_hnsw(spark, sf_dir):
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op6_licenses(spark, sf_dir):
    return licenses.report(table(spark, sf_dir, "documents"))


def op7_exact_topk(spark, sf_dir):
    return exact_topk.topk(table(spark, sf_dir, "embeddings"))


def op8_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op9_simhash(spark, sf_dir):
    return simhash.groups(table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


OP7_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score, q.r, c.r AS cr
      FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, cr) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 10
"""


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return {"op2_warc": OP2_SQL, "op7_exact_topk": OP7_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
