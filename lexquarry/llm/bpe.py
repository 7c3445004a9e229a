"""Byte-level BPE: encoding by overlapping chunks, decoding by concatenation of raw bytes.

A text of at most ``chunk`` characters is encoded where it lies. A longer one is cut into chunks
that overlap; every chunk is pre-tokenised on its own, as its own row. The pattern has no
look-behind, so from a boundary that two chunks share on, both see the same boundaries: there the
chunks are stitched, and the pieces between the stitches are encoded in parallel. Chunks whose
overlap has no common boundary (one pre-token covers it) are joined and cut anew as one piece.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.common import bounded

CHUNK, OVERLAP = 32_768, 1_024
CACHE = 400_000


class Vocabulary(dict):
    """Pre-token -> its ids as little-endian uint32 bytes; filled on demand and emptied when large."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.split = regex.compile(pattern).findall
        self.spans = regex.compile(pattern).finditer
        self.space = regex.compile(r"\s").match
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.core.encode_single_piece(piece.encode()), "<u4").tobytes()
        if len(self) >= CACHE:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def bounds(self, text: str) -> list[int]:
        """Ends of the pre-tokens."""
        return [m.end() for m in self.spans(text)]


@lru_cache(2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def digests(v: Vocabulary, ids: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(v.decode(ids)).hexdigest()


def stitches(heads: list[set[int]], tails: list[set[int]]) -> list[int | None]:
    """For each chunk but the first, the first boundary that it and the one before share in their overlap."""
    return [min(common, default=None) for common in (tails[i - 1] & heads[i] for i in range(1, len(heads)))]


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and with ids=True the ids, as uint32 bytes) of every text.

    Null texts count as empty: no tokens, digests of nothing. Rows that repeat, or whose doc_id is
    null or repeats, each give a row. Other columns are left out. An empty table gives none.
    """
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids
    docs = bounded(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def done(v: Vocabulary, doc_ids, blobs: list[bytes]) -> dict:
        n, a, b = zip(*(digests(v, x) for x in blobs))
        return {"doc_id": doc_ids, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": a, "decoded_sha256": b} | ({"ids": blobs} if ids else {})

    def short(batches):
        v = vocabulary(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                yield pa.RecordBatch.from_pydict(done(v, s.column(0), [v.encode(t) for t in s.column(1).to_pylist()]))
        v.clear()  # the worker goes on to other tasks

    out = docs.filter(F.length("text") <= chunk).mapInArrow(short, f"doc_id {doc_type}, {kind}")

    def cut(batches):
        for b in batches:
            for at in range(b.num_rows):
                text = b.column(1)[at].as_py()
                key, starts = hashlib.sha256(text.encode()).digest(), range(0, len(text), chunk)
                for i, s in enumerate(starts):
                    yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(at, 1), "key": [key], "i": pa.array([i], pa.int32()), "last": [i == len(starts) - 1], "start": pa.array([s], pa.int64()), "text": [text[s : s + chunk + overlap]]})

    def pretokenise(batches):
        v = vocabulary(path, pattern)
        for b in batches:
            for at in range(b.num_rows):
                row = b.slice(at, 1)
                text, start, last = row["text"][0].as_py(), row["start"][0].as_py(), row["last"][0].as_py()
                # a cut piece is encoded alone: no stitch between white space and what follows it
                ends = [e for e in v.bounds(text)[: None if last else -1] if e == len(text) or v.space(text[e]) or not v.space(text[e - 1])]
                head = [start + e for e in ends if e < overlap]
                tail = [] if last else [start + e for e in ends if e > chunk]
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([head], pa.list_(pa.int64())), pa.array([tail], pa.list_(pa.int64()))], names=[*row.schema.names, "head", "tail"])

    keys = f"doc_id {doc_type}, key binary"
    cutting = f"{keys}, i int, last boolean, start long, text string"
    chunks = docs.filter(F.length("text") > chunk).mapInArrow(cut, cutting)
    chunks = chunks.groupBy("doc_id", "key", "i").agg(F.count("*").alias("copies"), F.first("last").alias("last"), F.first("start").alias("start"), F.first("text").alias("text"))
    chunks = chunks.mapInArrow(pretokenise, f"{keys}, i int, copies long, last boolean, start long, text string, head array<long>, tail array<long>")

    def stitch(rows: pd.DataFrame) -> pd.DataFrame:
        """By chunk: the piece it belongs to and where the piece begins and ends (-1: at the end of the text)."""
        rows = rows.sort_values("i")
        at = [0, *stitches([set(x) for x in rows["head"]], [set(x) for x in rows["tail"]])]
        first = [i for i, x in enumerate(at) if x is not None]
        leader = [max(f for f in first if f <= i) for i in range(len(at))]
        begin = [at[f] for f in leader]
        end = [next((at[f] for f in first if f > i), -1) for i in leader]
        # the chunk after a piece's last holds nothing of the piece: overlaps reach past every stitch
        return rows[["doc_id", "key", "i"]].assign(leader=leader, begin=begin, end=end)

    cuts = chunks.select("doc_id", "key", "i", "head", "tail").groupBy("doc_id", "key").applyInPandas(stitch, f"{keys}, i int, leader int, begin long, end long")
    pieces = chunks.drop("head", "tail").withColumnsRenamed({"doc_id": "d", "key": "k", "i": "j"}).join(cuts, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("key")) & (F.col("j") == F.col("i"))).select("doc_id", "key", "i", "copies", "start", "text", "leader", "begin", "end")

    def encode_piece(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        begin, end, at = int(rows["begin"].iloc[0]), int(rows["end"].iloc[0]), int(rows["start"].iloc[0])
        text = "".join(t[:chunk] for t in rows["text"].iloc[:-1]) + rows["text"].iloc[-1]
        piece = text[begin - at : None if end < 0 else end - at]
        return rows[["doc_id", "key", "leader", "copies"]].iloc[:1].assign(ids=[vocabulary(path, pattern).encode(piece)])

    def join_ids(rows: pd.DataFrame) -> pd.DataFrame:
        v, rows = vocabulary(path, pattern), rows.sort_values("leader")
        blob = b"".join(rows["ids"])
        n, a, b = digests(v, blob)
        one = rows[["doc_id"]].iloc[:1].assign(n_tokens=n, ids_sha256=a, decoded_sha256=b)
        if ids:
            one["ids"] = [blob]
        return pd.concat([one] * int(rows["copies"].iloc[0]))

    encoded = pieces.groupBy("doc_id", "key", "leader").applyInPandas(encode_piece, f"{keys}, leader int, copies long, ids binary")
    return out.unionByName(encoded.groupBy("doc_id", "key").applyInPandas(join_ids, f"doc_id {doc_type}, {kind}"))


def decode(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the raw bytes of ids (uint32 bytes; null: empty)."""

    def rows(batches):
        v = vocabulary(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.decode(x or b"") for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return ids.select("doc_id", "ids").mapInArrow(rows, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, bytes binary")
