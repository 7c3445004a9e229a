"""Bulk-synchronous best-fit packing of tokenised documents into sequences of bounded length.

Pieces over half a sequence open one each. The others go in bands of similar lengths, longest first,
one superstep a band: its pieces and the gaps of all open sequences are put in order of size, and a
successor sweep gives each piece the smallest gap that holds it and that no longer piece took. The sweep is
distributed: with gaps put on a stack and pieces taking from it, a piece takes the gap last put on the level it
takes from, and levels are running sums. Those are summed up over cells (size, kind, salt), whose number doesn't grow
with the corpus; within a cell the rank decides who takes which, so pieces that want the same gaps don't conflict.
Rows then meet by level, of which each holds two rows of a size at most. A gap that holds several pieces of
the band offers a place for each. Pieces for which nothing is left open new sequences by their rank, those
of one length together; gaps are updated, and the next band follows.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.common import bounded, released, saved

SIZE = 1024
NARROW, WIDE = 1.25, 1.5  # the lengths of a band: of those over an eighth of a sequence, of others
CELL, SALTS = 50_000, 1000  # rows of a size that are ranked in one task; parts of a size at most


def within(pattern: str, high: int) -> str | None:
    """The pattern with \\p{L} and \\p{N} as classes of characters up to ``high``, for re, which is faster than regex; None if it has other such parts."""
    import regex

    ranges = {}
    for kind in "LN":
        own = [c for c in range(high + 1) if regex.match(rf"\p{{{kind}}}", chr(c))]
        ends = [c for c in own if c + 1 not in own]
        ranges[kind] = "".join(rf"\u{a:04x}-\u{b:04x}" for a, b in zip([c for c in own if c - 1 not in own], ends))
    bare = lambda p: re.sub(r"\\p\{([LN])\}", lambda m: ranges[m[1]], p)
    out = re.sub(r"\[[^]]*\]|\\p\{[LN]\}", lambda m: bare(m[0]) if m[0][0] == "[" else f"[{bare(m[0])}]", pattern)
    return None if re.search(r"\\[^sSu]", out) else out


class Ids(dict):
    """Pre-token -> ids as uint32 bytes, as the tokenizers library gives them; other added tokens are kept apart.

    Where a merge's place in the file is its token's id (less the single bytes), ranks say the same
    as merges, and a core that works on ranks fills in pre-tokens several times as fast.
    """

    LATIN = 0x24F

    def __init__(self, path: str, pattern: str, limit: int = 600_000):
        import json

        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        own = within(pattern, self.LATIN)
        self.split = re.compile(own).findall if own else regex.compile(pattern).findall
        self.added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.exotic = regex.compile(rf"[^\x20-\x7e\n\r\t\xa1-\u{self.LATIN:04x}]").search

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        alphabet, vocab = ByteLevel.alphabet(), model["vocab"]
        self.core = None
        if len(alphabet) == 256 and all(vocab[c] < 256 for c in alphabet) and all(vocab.get(p) == 256 + i for i, p in enumerate(pairs)) and not model.get("dropout"):
            import tiktoken

            shown = ByteLevel(add_prefix_space=False, use_regex=False)
            byte = {shown.pre_tokenize_str(chr(b))[0][0]: b for b in range(128)}
            rest = [c for c in sorted(alphabet) if c not in byte]
            byte |= {c: ord(c) for c in rest if 0xA1 <= ord(c) <= 0xFF}
            left = [b for b in range(128, 256) if b not in byte.values()]
            byte |= dict(zip([c for c in rest if c not in byte], left, strict=True))
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if all(c in byte for c in t)}
            self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if self.core:
            own = self.core.encode_single_piece(piece.encode())
            ids = struct.pack(f"<{len(own)}I", *own)
        else:
            ids = self.whole(piece)
        if len(self) >= self.limit:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        # outside Latin the library's own tables of character classes decide
        if any(t in text for t in self.added) or self.exotic(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, self.split(text)))


@lru_cache(2)
def ids_of(path: str, pattern: str) -> Ids:
    return Ids(path, pattern)


def pieces(docs: DataFrame, path: str, pattern: str, end: int, size: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a document's ids, ``end`` after them, cut into ``size`` from the back."""
    docs = bounded(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    last = np.array([end], "<u4").tobytes()

    def rows(batches):
        enc = ids_of(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                take, out = [], []
                for k, text in enumerate(s.column(1).to_pylist()):
                    ids = enc.encode(text) + last
                    n, first = len(ids) // 4, (len(ids) // 4 - 1) % size + 1
                    for piece, stop in enumerate(range(first, n + 1, size)):
                        start = max(0, stop - size)
                        take.append(k)
                        out.append((piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([s.column(0).take(pa.array(take, pa.int32())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        enc.clear()  # the worker goes on to other tasks

    return docs.mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def bands(size: int) -> list[tuple[int, int]]:
    """Lengths over low, up to high, of each superstep."""
    edges = [size // 2]
    while edges[-1] > 0:
        edges.append(int(edges[-1] / (NARROW if edges[-1] * 8 > size else WIDE)))
    return list(zip(edges, edges[1:]))


def swept(rows: DataFrame, gaps: DataFrame, top: int, least: int, many: int, size: int, salts: int, first: int) -> DataFrame:
    """rows (many pieces of a band, of lengths least to top) with their sequence_id: of gaps (seq, gap), or new ones from ``first`` down."""
    places = F.greatest(F.lit(1), F.floor(F.col("gap") / top)).cast("int")
    wide = gaps.filter(F.col("gap") >= least)
    # more places than pieces aren't needed, the smallest gaps that hold any of them come first
    offered = wide.groupBy("gap").agg(F.sum(places).alias("n"))
    before = F.sum(F.when(F.col("gap") >= top, F.col("n")).otherwise(0)).over(Window.orderBy("gap").rowsBetween(Window.unboundedPreceding, -1))
    enough = offered.withColumn("before", before).filter((F.col("gap") < top) | (F.coalesce("before", F.lit(0)) < many)).select(F.col("gap").alias("g"))
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(salts)).cast("int").alias("salt")
    row = F.struct(*rows.columns)
    slots = wide.join(F.broadcast(enough), F.col("gap") == F.col("g")).select(F.col("gap").alias("key"), F.lit(0).alias("kind"), salt("seq"), F.col("seq").alias("of"), F.explode(F.sequence(F.lit(1), places)).alias("nth"))
    slots = slots.drop("nth").withColumn("row", F.lit(None).cast(rows.select(row.alias("r")).schema["r"].dataType))
    events = slots.unionByName(rows.select(F.col("length").cast("int").alias("key"), F.lit(1).alias("kind"), salt("id"), F.col("id").alias("of"), row.alias("row")))
    line = Window.orderBy(F.desc("key"), "kind", "salt")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    cells = events.groupBy("key", "kind", "salt").agg(F.count("*").alias("n"))
    cells = cells.withColumn("sum", F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(-F.col("n"))).over(so_far))
    cells = cells.withColumn("after", F.col("sum") - F.least(F.lit(0), F.min("sum").over(so_far))).withColumn("depth", F.lag("after", 1, 0).over(line))
    # those for which nothing is left: full sequences of one length, then what remains of all lengths by rank
    of_key = Window.partitionBy("key", "kind")
    each = F.floor(F.lit(size) / F.col("key"))
    cells = cells.withColumn("left", F.when(F.col("kind") == 1, F.greatest(F.lit(0), F.col("n") - F.col("depth"))).otherwise(0)).withColumn("lefts", F.sum("left").over(of_key))
    cells = cells.withColumn("over", F.sum("left").over(of_key.orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("left")).withColumn("rest", F.col("lefts") % each)
    once = F.when(F.row_number().over(of_key.orderBy("salt")) == 1, F.col("rest")).otherwise(0)
    cells = cells.withColumn("once", once).withColumn("rests", F.sum("once").over(so_far) - F.col("rest"))
    cells = cells.select(F.col("key").alias("k"), F.col("kind").alias("j"), F.col("salt").alias("s"), "depth", "over", (F.col("lefts") - F.col("rest")).alias("full"), "rests")
    rank = F.row_number().over(Window.partitionBy("key", "kind", "salt").orderBy("of"))
    placed = events.withColumn("rank", rank).join(cells, (F.col("key") == F.col("k")) & (F.col("kind") == F.col("j")) & (F.col("salt") == F.col("s")))
    level = F.when(F.col("kind") == 0, F.col("depth") + F.col("rank")).when(F.col("rank") <= F.col("depth"), F.col("depth") - F.col("rank") + 1).otherwise(-1 - F.col("of"))
    taken = F.lag("of").over(Window.partitionBy("level").orderBy(F.desc("key"), "kind"))
    nth = F.col("over") + F.col("rank") - F.col("depth") - 1
    alike = F.lit(1 << 47) + F.shiftleft(F.col("key").cast("long"), 36) + F.floor(nth / each)
    new = F.lit(first) - F.when(nth < F.col("full"), alike).otherwise(F.floor((F.col("rests") + nth - F.col("full")) / (size // top)))
    met = placed.withColumn("level", level).withColumn("taken", taken).filter("kind = 1")
    return met.select("row.*", F.when(F.col("level") > 0, F.col("taken")).otherwise(new).cast("long").alias("sequence_id"))


def arranged(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """cut (pieces with their length, up to size, and an id that tells them apart) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    alone = cut.filter(F.col("length") > size // 2).withColumn("sequence_id", F.col("id"))
    done, gaps = [alone], alone.select(F.col("sequence_id").alias("seq"), (size - F.col("length")).cast("int").alias("gap"))
    for nr, (high, low) in enumerate(bands(size)):
        some = [x for x in counts if low < x <= high]
        if not some:
            continue
        salts = min(SALTS, 1 + max(counts[x] for x in some) // CELL)
        rows = cut.filter((F.col("length") > low) & (F.col("length") <= high))
        done.append(saved(swept(rows, gaps, max(some), min(some), sum(counts[x] for x in some), size, salts, -1 - (nr << 48)), "placed", few="coalesce"))
        if left := [x for x in counts if x <= low]:
            used = gaps.select("seq", (size - F.col("gap")).cast("long").alias("used")).unionByName(done[-1].select(F.col("sequence_id").alias("seq"), F.col("length").alias("used")))
            gaps = used.groupBy("seq").agg((size - F.sum("used")).cast("int").alias("gap")).filter(F.col("gap") >= min(left))
            gaps = saved(gaps, "gaps", few="coalesce")
            if nr % 3 == 2:
                released(cut.sparkSession)
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy(F.desc("length"), "id").rowsBetween(Window.unboundedPreceding, -1))
    return every.withColumn("offset", F.coalesce(before, F.lit(0).cast("long")))


def pack(docs: DataFrame, path: str, pattern: str, end: int = 2, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    A null or empty text is the end id alone. Rows that repeat, and rows with a null doc_id, are
    packed like any other, pieces of one length in any order; other columns are left out, whatever their
    names. An empty table gives no rows. The first piece of a document of over ``size`` ids is the shorter one.
    """
    cut = saved(pieces(docs, path, pattern, end, size).withColumn("id", F.monotonically_increasing_id()), "pieces", few="repartition")
    return arranged(cut, size).drop("id")
