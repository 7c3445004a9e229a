"""Suffix-array removal of repeated passages, by threshold-bounded interval expansion on a BWT.

Only equal strings of ``least`` bytes matter, so the suffixes are dealt out by content: every window of
``least`` bytes has a minimiser, the smallest hash of its ``GRAM``-byte strings, and equal windows
have the same one. Neighbouring windows with one minimiser form a phrase; a window is part of just
one phrase. As in prefix-free parsing, a phrase that occurs again byte for byte is kept once
(later ones are repeats as they stand), and the transform is built over the distinct phrases alone:
those that share a minimiser with another phrase meet in one shard. There the suffixes are sorted
as deep as the threshold, and breadth-first backward extension on the Burrows-Wheeler transform
derives the common prefixes by increasing length. It stops at ``least``; what is not separated
by then agrees for ``least`` bytes at least, and all but the first such window is a repeat.
A minimiser with more than ``crowd`` distinct phrases is not put into one shard: its windows are
compared one by one through sums that Spark aggregates.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.common import bounded, saved

LEAST, GRAM = 100, 40
SEGMENT = (1 << 20) - 256
SHARD, CROWD = 1 << 20, 10_000
PHRASES = 300_000  # held in memory by a task, and summed up before they are dealt out
BASE = np.uint64(0x9E3779B97F4A7C15)
NONE = -(2**63)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = np.random.default_rng(11).integers(1, 2**63, 256, dtype="uint64")
    power = np.full(SEGMENT + 512, BASE)
    power[0] = 1
    inverse = np.full(SEGMENT + 512, np.uint64(pow(int(BASE), -1, 2**64)))
    inverse[0] = 1
    return values, np.multiply.accumulate(power), np.multiply.accumulate(inverse)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def phrases(text: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser hash, hash of all bytes, first window and number of windows of every phrase of the text."""
    values, power, inverse = _tables()
    gram = min(gram, least)
    width = least - gram + 1
    out = []
    for at in range(0, len(text) - least + 1, SEGMENT):
        part = text[at : at + SEGMENT + least - 1]
        sums = np.zeros(len(part) + 1, "uint64")
        np.cumsum(values[part] * power[: len(part)], out=sums[1:])
        n = len(part) - gram + 1
        hashes = _mixed((sums[gram:] - sums[:n]) * inverse[:n])
        keys = np.full(-(-n // width) * width, ~np.uint64(0))
        keys[:n] = hashes & ~np.uint64(0xFFFFF) | np.arange(n, dtype="uint64")  # the place breaks ties: leftmost
        keys = keys.reshape(-1, width)
        to_right = np.minimum.accumulate(keys, axis=1).ravel()
        to_left = np.minimum.accumulate(keys[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - width + 1
        place = np.minimum(to_left[:windows], to_right[width - 1 : width - 1 + windows]) & np.uint64(0xFFFFF)
        begin = np.r_[0, np.flatnonzero(place[1:] != place[:-1]) + 1]
        many = np.diff(np.r_[begin, windows])
        whole = _mixed((sums[begin + many + least - 1] - sums[begin]) * inverse[begin] + many.astype("uint64"))
        out.append((hashes[place[begin].astype("int64")], whole | np.uint64(1), at + begin, many))
    if not out:
        return np.zeros(0, "uint64"), np.zeros(0, "uint64"), np.zeros(0, "int64"), np.zeros(0, "int64")
    return tuple(np.concatenate(x) for x in zip(*out))


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of byte ranges, as maximal runs."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    first = np.r_[True, begin[1:] > reach[:-1]] if len(begin) else np.zeros(0, bool)
    return begin[first], reach[np.r_[np.flatnonzero(first)[1:] - 1, len(reach) - 1]] if len(begin) else reach


def sorted_suffixes(t: np.ndarray, depth: int) -> np.ndarray:
    """Places of t in the order of the ``depth`` or more symbols that begin there (t read as a ring)."""
    n = len(t)
    key, done = np.zeros(n, "uint64"), 7  # nine bits a symbol
    for i in range(done):
        key = key << np.uint64(9) | np.roll(t, -i)
    while True:
        order = np.argsort(key)
        s = key[order]
        new = np.r_[False, s[1:] != s[:-1]]
        if done >= depth or new.sum() == n - 1:
            return order
        rank = np.empty(n, "uint64")
        rank[order] = np.cumsum(new).astype("uint64")
        key = rank << np.uint64(32) | np.roll(rank, -done)
        done *= 2


def separated(t: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place in the order, whether its suffix parts from the one before within ``depth`` symbols.

    t holds 0 between texts; common prefixes never reach over it. Backward extension finds the intervals of
    all strings by length: the extension of a string's interval by a symbol ends where the common
    prefix is as long as the string, unless a shorter one was found there before.
    """
    n = len(t)
    before = t[order - 1]  # the transform
    to = np.empty(n, "int64")
    to[np.argsort(before, kind="stable")] = np.arange(n)  # where the suffix one symbol longer stands
    texts = int((t == 0).sum())
    parts = np.zeros(n + 1, bool)
    low, high = np.array([0]), np.array([n])
    for _ in range(depth):
        if not len(low):
            break
        width = high - low
        parent = np.repeat(np.arange(len(low)), width)
        inside = np.arange(len(parent)) - np.repeat(np.cumsum(width) - width, width) + low[parent]
        packed = np.sort(to[inside].astype("uint64") << np.uint64(32) | parent.astype("uint64"))
        at, parent = (packed >> np.uint64(32)).astype("int64"), packed & np.uint64(0xFFFFFFFF)
        symbol = t[order[at]]
        cut = (at[1:] != at[:-1] + 1) | (parent[1:] != parent[:-1]) | (symbol[1:] != symbol[:-1])
        first = np.r_[0, np.flatnonzero(cut) + 1]
        last = np.r_[first[1:], len(at)] - 1
        low, high = at[first], at[last] + 1
        fresh = (low >= texts) & ~parts[high]
        low, high = low[fresh], high[fresh]
        parts[high] = True
    parts[0] = True
    return parts[:n]


def repeats_in(texts: list[bytes], least: int) -> list[np.ndarray]:
    """For texts in their order, the starts of windows that also start in an earlier text or before in the same."""
    lengths = np.array([len(x) for x in texts])
    joined = b"\0".join(texts) + b"\0"
    t = np.frombuffer(joined, "u1").astype("uint16") + 1
    ends = np.cumsum(lengths + 1) - 1
    t[ends] = 0
    begins = ends - lengths
    order = sorted_suffixes(t, least)
    starts = np.flatnonzero(separated(t, order, least))
    left = np.repeat(ends, lengths + 1) - np.arange(len(t))
    place = np.where(left[order] >= least, order, len(t))
    first = np.minimum.reduceat(place, starts)
    again = place > np.repeat(first, np.diff(np.r_[starts, len(t)]))
    hit = np.sort(order[again & (place < len(t))])
    cuts = np.searchsorted(hit, begins[1:])
    return [h - b for h, b in zip(np.split(hit, cuts), begins)]


def _ranges(starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    return merged(starts, starts + least)


def _found(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """Phrases and, with whole = 0, ranges that repeat near by in a task: h, whole, d, k, at (begin), many."""

    def summed(d: np.ndarray, k: np.ndarray, rows: list[tuple]) -> pa.RecordBatch | None:
        h, whole, doc, begin, many = (np.concatenate(c) for c in zip(*rows))
        if not len(h):
            return None
        both = h ^ _mixed(whole)
        # the first of each phrase stands for it; the rest are repeats, whatever else there is
        order = np.lexsort((begin, k[doc], d[doc], both))
        new = np.r_[True, both[order][1:] != both[order][:-1]]
        head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        same = (d[doc[order]] == d[doc[head]]) & (k[doc[order]] == k[doc[head]]) & (begin[order] == begin[head])
        keep, rest = order[new], np.sort(order[~new & ~same])
        found = []
        for at in np.split(rest, np.flatnonzero(np.diff(doc[rest])) + 1) if len(rest) else []:
            low, high = merged(begin[at], begin[at] + many[at] + least - 1)
            found.append((np.full(len(low), doc[at[0]]), low, high - low))
        more = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, "int64")] * 3
        of = np.r_[doc[keep], more[0]]
        spread = _mixed(more[1].astype("uint64") + np.uint64(1) + d[more[0]].view("uint64"))  # ranges go anywhere
        return pa.RecordBatch.from_arrays(
            [pa.array(np.r_[h[keep], spread].view("int64")), pa.array(np.r_[whole[keep].view("int64"), np.zeros(len(more[0]), "int64")]), pa.array(d[of]), pa.array(k[of]), pa.array(np.r_[begin[keep], more[1]]), pa.array(np.r_[many[keep], more[2]].astype("int32"))],
            names=["h", "whole", "d", "k", "at", "many"],
        )

    def run(batches):
        d, k, rows, held = [], [], [], 0
        for b in batches:
            for i, text in enumerate(b.column(2).cast(pa.binary())):
                h, whole, begin, many = phrases(np.frombuffer(text.as_buffer(), "u1"), least, gram)
                rows.append((h, whole, np.full(len(h), len(d)), begin, many))
                d.append(b.column(0)[i].as_py())
                k.append(b.column(1)[i].as_py())
                held += len(h)
                if held >= PHRASES:
                    if (out := summed(np.array(d), np.array(k), rows)) is not None:
                        yield out
                    d, k, rows, held = [], [], [], 0
        if rows and (out := summed(np.array(d), np.array(k), rows)) is not None:
            yield out

    return docs.select("d", "k", "text").mapInArrow(run, "h long, whole long, d long, k long, at long, many int")


def _crowded(cut: DataFrame, least: int) -> DataFrame:
    """Repeats among the windows of phrases d, k, begin, bytes, each window on its own."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                x = b["bytes"][i].as_py()
                n = len(x) - least + 1
                hashes = [hashlib.blake2b(x[s : s + least], digest_size=16).digest() for s in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), b["d"].take(pa.array([i] * n)), b["k"].take(pa.array([i] * n)), pa.array(b["begin"][i].as_py() + np.arange(n))], names=["window", "d", "k", "begin"])

    windows = cut.mapInArrow(run, "window binary, d long, k long, begin long").distinct()
    me = F.struct("d", "k", "begin")
    first = windows.groupBy("window").agg(F.min(me).alias("first")).withColumnRenamed("window", "of")
    return windows.join(first, F.col("window") == F.col("of")).filter(me > F.col("first")).select("d", "k", F.col("begin").alias("low"), (F.col("begin") + least).alias("high"))


def ranges(docs: DataFrame, least: int = LEAST, gram: int = GRAM, shard: int = SHARD, crowd: int = CROWD) -> DataFrame:
    """Byte ranges low..high of documents (d, k, text) that repeat earlier bytes: d, k, low, high."""
    found = _found(docs, least, gram)
    me = F.struct("d", "k", "at")
    by_phrase, by_hash = Window.partitionBy("h", "whole"), Window.partitionBy("h")
    # phrases are summed up in their tasks before: of a key there is one row for some thousand documents
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows are short, and sorted in memory
    told = found.repartition(parts, "h").withColumns({"first": F.min(me).over(by_phrase)}).withColumns({"a": F.min("whole").over(by_hash), "b": F.max("whole").over(by_hash)})
    told = told.select("h", "d", "k", F.col("at").alias("begin"), "many", F.when(F.col("whole") == 0, 0).when(me > F.col("first"), 1).when(F.col("a") != F.col("b"), 2).alias("what"))
    told = saved(told.filter("what IS NOT NULL"), "phrases")
    plain = told.filter("what < 2").select("d", "k", F.col("begin").alias("low"), (F.col("begin") + F.col("many") + F.when(F.col("what") == 0, 0).otherwise(least - 1)).cast("long").alias("high"))
    mixed = told.filter("what = 2").select("h", "d", "k", "begin", "many").distinct()
    wanted = mixed.groupBy("d", "k").agg(F.collect_list(F.struct("h", "begin", "many")).alias("want"))  # of one document

    def cut(batches):
        for b in batches:
            for i in range(b.num_rows):
                text, want = b["text"].slice(i, 1).cast(pa.binary())[0].as_py(), b["want"][i].as_py()
                n = len(want)
                yield pa.RecordBatch.from_arrays([pa.array([w["h"] for w in want], pa.int64()), b["d"].take(pa.array([i] * n)), b["k"].take(pa.array([i] * n)), pa.array([w["begin"] for w in want], pa.int64()), pa.array([text[w["begin"] : w["begin"] + w["many"] + least - 1] for w in want], pa.binary())], names=["h", "d", "k", "begin", "bytes"])

    cuts = saved(docs.join(wanted.withColumnsRenamed({"d": "d_", "k": "k_"}), (F.col("d") == F.col("d_")) & (F.col("k") == F.col("k_"))).select("d", "k", "text", "want").mapInArrow(cut, "h long, d long, k long, begin long, bytes binary"), "cuts")
    full = cuts.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select(F.col("h").alias("of"))
    shards = max(1, -(-(cuts.agg(F.sum(F.length("bytes") + 1)).first()[0] or 0) // shard))

    def expand(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["d", "k", "begin"]).drop_duplicates(["d", "k", "begin"])
        out = []
        for i, starts in enumerate(repeats_in(list(rows["bytes"]), least)):
            low, high = _ranges(starts, least)
            out += [(i, a, z) for a, z in zip(low.tolist(), high.tolist())]
        at, low, high = np.array(out, "int64").reshape(-1, 3).T
        begin = rows["begin"].to_numpy()[at]
        return pd.DataFrame({"d": rows["d"].to_numpy()[at], "k": rows["k"].to_numpy()[at], "low": begin + low, "high": begin + high})

    few = cuts.join(full, F.col("h") == F.col("of"), "left_anti").withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    expanded = few.groupBy("shard").applyInPandas(expand, "d long, k long, low long, high long")
    crowded = _crowded(cuts.join(full, F.col("h") == F.col("of"), "left_semi").select("d", "k", "begin", "bytes"), least)
    return plain.unionByName(expanded).unionByName(crowded)


def _keyed(docs: DataFrame) -> DataFrame:
    """d (doc_id, null the smallest), k (which tells apart texts that share one), text, and all columns as row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    return bounded(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("d"), F.xxhash64(text).alias("k"), "text", rest.alias("rest"))


def _with_ranges(keyed: DataFrame, least: int, **how) -> DataFrame:
    """text, rest and ranges: an array of low << 31 | high, null if there are none."""
    found = ranges(keyed.select("d", "k", F.coalesce("text", F.lit("")).alias("text")), least, **how)
    by_doc = found.groupBy("d", "k").agg(F.collect_list(F.shiftleft("low", 31).bitwiseOR(F.col("high"))).alias("ranges"))  # of one document
    return keyed.join(by_doc.withColumnsRenamed({"d": "d_", "k": "k_"}), (F.col("d") == F.col("d_")) & (F.col("k") == F.col("k_")), "left").select("text", "rest", "ranges")


def _kept(text: bytes, packed: list[int] | None) -> tuple[bytes, int]:
    """What is left of the text, and how many runs are gone."""
    if not packed:
        return text, 0
    x = np.array(packed)
    low, high = merged(x >> 31, x & (1 << 31) - 1)
    return b"".join(text[a:b] for a, b in zip([0, *high.tolist()], [*low.tolist(), len(text)])), len(low)


def report(docs: DataFrame, least: int = LEAST, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    A byte goes if a ``least``-byte string that covers it also starts earlier: in a smaller doc_id or
    before in the same document; all strings are those of the input. Null texts are empty. A
    null doc_id comes before all others. Rows that share a doc_id come in the order of a hash of their
    texts; rows alike in both are one document, and each gives its row. Other columns are left out.
    """
    joined = _with_ranges(_keyed(docs.select("doc_id", "text")), least, **how)

    def run(batches):
        for b in batches:
            out = []
            for text, packed in zip(b["text"].cast(pa.binary()).to_pylist(), b["ranges"].to_pylist()):
                text = text or b""
                kept, spans = _kept(text, packed)
                out.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            n, gone, spans, sha = zip(*out)
            yield pa.RecordBatch.from_arrays([b["rest"].field("doc_id"), *(pa.array(x, pa.int64()) for x in (n, gone, spans)), pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def removed(docs: DataFrame, least: int = LEAST, **how) -> DataFrame:
    """docs with the repeats cut out of text; a character that a cut splits goes. Null texts stay null."""
    joined = _with_ranges(_keyed(docs), least, **how)

    def run(batches):
        for b in batches:
            texts = [t if t is None else _kept(t, r)[0].decode("utf-8", "ignore") for t, r in zip(b["text"].cast(pa.binary()).to_pylist(), b["ranges"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["rest"], pa.array(texts, pa.string())], names=["rest", "text"])

    return joined.mapInArrow(run, joined.select("rest", "text").schema).select(*(F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns))
