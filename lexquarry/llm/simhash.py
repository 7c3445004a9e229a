"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint becomes 32 counts, of the bits set in each segment of two. The Manhattan distance of
two such vectors is at most the Hamming distance of the fingerprints, in each half as well; and of
two fingerprints that differ in at most two bits, one half differs in at most one. So each half lays a grid
whose cells are its 16 counts; a fingerprint looks into its own cell and those one step up, and
what it meets is verified by the bits. Cells with more than ``dense`` fingerprints are met in blocks:
every block of a cell's fingerprints with every block of those that look into it, in a task of
their own, which gives a spanning forest of the verified links instead of all of them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.common import bounded, dropped, saved
from lexquarry.llm.components import components

SEED, DENSE, MET, BITS = 42, 64, 2048, 2
PART = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0d]")


def words_of(text: bytes, part: int = PART) -> Iterator[list[bytes]]:
    """The text's words, in lists of about ``part`` bytes."""
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + part)
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


def shingles_of(text: str, width: int, part: int = PART) -> Iterator[np.ndarray]:
    """XXH64 of the text's shingles, repeats included, part by part; fewer words than a shingle has make one."""
    from xxhash import xxh64_intdigest

    held, some = [], False
    for words in words_of(text.encode().lower(), part):
        held += words
        if len(held) >= width:
            line = b" ".join(held)
            ends = np.cumsum([len(w) + 1 for w in held]) - 1
            starts = [0, *(ends + 1).tolist()]
            yield np.array([xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist())], "<u8")
            held, some = held[1 - width :] if width > 1 else [], True
    if held and not some:
        yield np.array([xxh64_intdigest(b" ".join(held), SEED)], "<u8")


def fingerprint(text: str, width: int = 3, part: int = PART) -> int:
    return _majority(shingles_of(text, width, part))


def _majority(parts: Iterator[np.ndarray]) -> int:
    ones, total = np.zeros(64, "int64"), 0
    for h in parts:
        ones += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="int64")
        total += len(h)
    return sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist())


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every text."""
    docs = bounded(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], "uint64")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view("int64"))], names=["doc_id", "fp"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


PAIRS = 0x5555555555555555


def counts_of(fp: Column) -> Column:
    """The 32 counts of set bits, two bits each, packed as the fingerprint is."""
    low, high = fp.bitwiseAND(F.lit(PAIRS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(PAIRS))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))  # no sum: it could overflow


def _half(x: Column, half: int) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF)) if half == 0 else F.shiftrightunsigned(x, 32)


def links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """Pairs (a, b) of fingerprints (column fp, distinct) within two bits: all, or enough to join the same groups."""
    cells = fps.select("fp", counts_of(F.col("fp")).alias("v"))
    home = cells.select("fp", F.explode(F.array(*(F.struct(F.lit(h).alias("half"), _half(F.col("v"), h).alias("cell")) for h in (0, 1)))).alias("at")).select("fp", "at.*")
    up = home.select("fp", "half", "cell", F.explode(F.expr("concat(array(0L), transform(filter(sequence(0, 15), i -> (shiftrightunsigned(cell, 2 * i) & 3) < 2), i -> shiftleft(1L, 2 * i)))")).alias("step")).select(F.col("fp").alias("x"), F.col("half").alias("h"), (F.col("cell") + F.col("step")).alias("c"), "step")
    # a planner that takes an exploded table for as small as its source would broadcast it
    up = up.hint("merge")
    full = home.groupBy("half", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > dense).select(F.col("half").alias("fh"), F.col("cell").alias("fc"), F.ceil(F.col("n") / MET).cast("int").alias("parts"))
    at_full = (F.col("h") == F.col("fh")) & (F.col("c") == F.col("fc"))
    sparse = home.join(full, (F.col("half") == F.col("fh")) & (F.col("cell") == F.col("fc")), "left_anti")
    pairs = up.join(sparse, (F.col("h") == F.col("half")) & (F.col("c") == F.col("cell"))).filter((F.col("step") > 0) | (F.col("x") < F.col("fp")))
    near = pairs.filter(F.bit_count(F.col("x").bitwiseXOR(F.col("fp"))) <= BITS).select(F.col("x").alias("a"), F.col("fp").alias("b"))
    # crowded cells: blocks of their fingerprints against blocks of those that look in
    looked = up.join(full, at_full).groupBy("fh", "fc", "parts").agg(F.ceil(F.count("*") / MET).cast("int").alias("looks"))
    part = lambda of, n: F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at_home = home.join(looked, (F.col("half") == F.col("fh")) & (F.col("cell") == F.col("fc"))).select("fh", "fc", part("fp", "parts").alias("i"), every("looks").alias("j"), F.col("fp").alias("x"), F.lit(True).alias("lives"))
    looking = up.join(looked, at_full).select("fh", "fc", part("x", "looks").alias("j"), every("parts").alias("i"), "x", F.lit(False).alias("lives"))

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        lives = rows["lives"].to_numpy()
        x = rows["x"].to_numpy().view("uint64")
        return pd.DataFrame(forest(x[lives], x[~lives]).view("int64"), columns=["a", "b"])

    crowded = at_home.unionByName(looking).groupBy("fh", "fc", "i", "j").applyInPandas(link, "a long, b long")
    return near.unionByName(crowded).distinct()


def forest(here: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Edges between the two sets of fingerprints, within BITS and not equal, that join what all such edges join."""
    close = np.concatenate([np.bitwise_count(here[at : at + 256, None] ^ there[None]) <= BITS for at in range(0, len(here), 256)]) if len(here) and len(there) else np.zeros((len(here), len(there)), "bool")
    left, right, out = np.ones(len(here), "bool"), np.ones(len(there), "bool"), []
    for first in range(len(here)):
        queue = [(0, first)] if left[first] else []
        left[first] = False
        while queue:
            side, at = queue.pop()
            met = np.flatnonzero(close[at] & right) if side == 0 else np.flatnonzero(close[:, at] & left)
            (right if side == 0 else left)[met] = False
            out += [(here[at], there[m]) if side == 0 else (here[m], there[at]) for m in met.tolist()]
            queue += [(1 - side, m) for m in met.tolist()]
    edges = np.array(out, "uint64").reshape(-1, 2)
    return edges[edges[:, 0] != edges[:, 1]]


def groups(docs: DataFrame, width: int = 3, dense: int = DENSE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links reach.

    A null text is an empty one; texts without words have fingerprint zero and link like any other.
    Rows that repeat each give a row. A null doc_id counts for component_id only where its group
    has no other. Other columns are left out. An empty table gives no rows.
    """
    of_docs = saved(fingerprints(docs, width), "fingerprints", few="repartition")
    fps = saved(of_docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct", few="coalesce")
    roots = components(links(fps.select("fp"), dense))
    rooted = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = saved(rooted.select("fp", "root").join(least, "root").select(F.col("fp").alias("of"), "component_id"), "components", few="coalesce")
    return of_docs.join(ids, F.col("fp") == F.col("of")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SMALL, BLOCK, HELD = 32, 512, 1 << 25  # nodes of a key that are paired up; nodes and bytes of shingles of a sub-block
MIDDLE = 1000  # nodes of a key up to which what one shingle left is paired up as well
LOOKED, FREQUENT = 1 << 22, 200_000  # shingles a task holds; shingles told


def text_key(text: Column) -> Column:
    """Tells apart the texts of rows that share a doc_id or have none."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in many texts, and in how many: all texts are read, what is seen once among LOOKED shingles of a task isn't told.

    They only come last in the order in which shingles are looked at; no result depends on them.
    """

    def several(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if held:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[n > 1].view("int64")), pa.array(n[n > 1])], names=["h", "n"])

    def run(batches):
        held, many = [], 0
        for b in batches:
            for text in b.column(0).to_pylist():
                for h in shingles_of(text, width):
                    held.append(np.unique(h))
                    many += len(held[-1])
                    if many >= LOOKED:
                        yield from several(held)
                        held, many = [], 0
        yield from several(held)

    texts = bounded(docs).select(F.coalesce("text", F.lit("")).alias("text"))
    counted = saved(texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "frequent", few="coalesce")
    # as many as FREQUENT of the commonest, by steps of their numbers: no task sorts them all
    step = F.floor(8 * F.log2("n")).cast("int")
    steps = sorted(((r.s, r.many) for r in counted.groupBy(step.alias("s")).agg(F.count("*").alias("many")).collect()), reverse=True)
    least, many = 1 << 30, 0
    for s, more in steps:
        many += more
        if many > FREQUENT:
            break
        least = s
    told = counted.filter(step >= least).select("h", "n").toArrow()  # as columns: the driver makes no object for each
    dropped(docs.sparkSession, counted)
    known = told["h"].to_numpy().view("uint64")
    order = np.argsort(known)
    return known[order], told["n"].to_numpy()[order]


def prefix(own: np.ndarray, least: float, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first of a text's distinct shingles, rare ones first: two texts of similarity ``least`` share one of them.

    At a Jaccard similarity of t both share at least t of either's n shingles, so n - ceil(t n) + 1 are enough.
    """
    known, count = often
    n = np.zeros(len(own), "int64")
    if len(known):
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        n = np.where(known[at] == own, count[at], 0)
    return own[np.lexsort((own, n))][: len(own) - math.ceil(least * len(own) - 1e-6) + 1]


def sketches(docs: DataFrame, width: int, least: float) -> DataFrame:
    """doc_id, k (text_key), fp, node (a hash of all words), n (how many distinct shingles), keys (their prefix) and sig (parities)."""
    often = docs.sparkSession.sparkContext.broadcast(frequent(docs, width))
    docs = bounded(docs).select("doc_id", text_key(F.col("text")).alias("k"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        from xxhash import xxh64_intdigest

        for b in batches:
            out = []
            for text in b.column(2).to_pylist():
                parts = list(shingles_of(text, width))
                own = np.unique(np.concatenate(parts)) if parts else np.zeros(0, "uint64")
                words = [w for part in words_of(text.encode().lower()) for w in part]
                out.append((_majority(iter(parts)), xxh64_intdigest(b" ".join(words), 7), len(own), prefix(own, least, often.value).view("int64") if parts else own.view("int64"), parities(own)))
            fps, nodes, n, keys, sigs = zip(*out)
            signed = lambda x: pa.array(np.array(x, "uint64").view("int64"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), signed(fps), signed(nodes), pa.array(n, pa.int64()), pa.array(list(keys), pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["doc_id", "k", "fp", "node", "n", "keys", "sig"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k long, fp long, node long, n long, keys array<long>, sig binary")


def parities(own: np.ndarray) -> bytes:
    """Of the distinct shingles in each bin of hashes, whether their number is odd: as many bins as a power of two has, the next above their number."""
    bins = 1 << max(6, int(len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(bins - 1)).astype("int64"), minlength=bins) & 1
    return np.packbits(odd.astype("bool"), bitorder="little").tobytes()


def may_be_similar(x: bytes, y: bytes, n: int, m: int, least: float) -> bool:
    """True for all pairs of that similarity: where parities differ, a shingle is in one of both texts only."""
    x, y = sorted((np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")), key=len)
    while len(y) > len(x):  # bins are low bits: halves fold onto each other
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= (1 - least) / (1 + least) * (n + m) + 1e-6


def _pruned(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs without those whose parities alone show that they aren't similar."""
    end = lambda c, n, s: nodes.select(F.col("node").alias(c), F.col("n").alias(n), F.col("sig").alias(s))
    both = pairs.join(end("a", "n", "x"), "a").join(end("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")

    def run(batches):
        for b in batches:
            told = (b[c].to_pylist() for c in ("x", "y", "n", "m"))
            keep = pa.array([may_be_similar(*r, least) for r in zip(*told)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b["a"].filter(keep), b["b"].filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, set: the distinct shingles, sorted, of each wanted node; read from one text of each."""
    chosen = nodes.join(wanted, "node", "left_semi").select("node", F.col("least.k").alias("of"), F.col("least.doc_id").alias("id"))
    texts = docs.select("doc_id", text_key(F.col("text")).alias("k"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, (F.col("k") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")))

    def sets(batches):
        from xxhash import xxh64_intdigest

        for b in batches:
            for i in range(b.num_rows):
                text = b["text"][i].as_py()
                words = [w for part in words_of(text.encode().lower()) for w in part]
                node = np.array([xxh64_intdigest(b" ".join(words), 7)], "uint64").view("int64")
                if node[0] == b["node"][i].as_py():
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([np.unique(np.concatenate(list(shingles_of(text, width)))).tobytes()], pa.binary())], names=["node", "set"])

    return texts.select("node", "text").mapInArrow(sets, "node long, set binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")

    def compare(batches):
        for b in batches:
            a_s, b_s, keep = b["a"], b["b"], []
            for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(same >= least * (len(x) + len(y) - same))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a_s.filter(keep), b_s.filter(keep)], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def spanning(nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Verified pairs that join the same groups as all verified pairs do; nodes of one root are joined already.

    Groups are walked breadth first: a node is compared with all that no group has reached yet.
    """
    flat, starts = np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum([0, *map(len, sets)])
    sizes, mark = np.diff(starts), np.zeros(flat.max() + 1, "bool")
    open_, out = np.ones(len(nodes), "bool"), []
    while open_.any():
        queue = np.flatnonzero(roots == roots[open_.argmax()]).tolist()
        open_[queue] = False
        while queue and open_.any():
            x = queue.pop()
            own = flat[starts[x] : starts[x + 1]]
            mark[own] = True
            same = np.add.reduceat(mark[flat], starts[:-1], dtype="int64")
            mark[own] = False
            for y in np.flatnonzero(open_ & (same >= least * (sizes + sizes[x] - same))).tolist():
                if open_[y]:
                    out.append((int(nodes[x]), int(nodes[y])))
                    more = np.flatnonzero(open_ & (roots == roots[y]))
                    open_[more] = False
                    queue += more.tolist()
    return out


def _crowded(crowd: DataFrame, place: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Enough of the verified pairs (a, b) among the nodes of each crowded key to join the same groups as all of them.

    Keys whose nodes are all in one group already have nothing to add. A key of many nodes is split
    into sub-blocks, and every two of them meet in a task of their own.
    """
    members = crowd.join(place, "node").select("node", "key", "n", "root")
    blocks = members.groupBy("key").agg(F.count("*").alias("many"), F.sum("n").alias("held"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    blocks = blocks.select(F.col("key").alias("of"), F.greatest(F.ceil(F.col("many") / BLOCK), F.ceil(F.col("held") * 8 / HELD)).cast("int").alias("parts"))
    dealt = members.join(blocks, F.col("key") == F.col("of")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.expr("CASE WHEN parts = 1 THEN array(0) ELSE filter(sequence(0, parts - 1), i -> i <> own) END")))
    rows = met.select("node", "key", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(held, "node")

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, "<u8") for x in rows["set"]]
        return pd.DataFrame(spanning(rows["node"].to_numpy(), rows["root"].to_numpy(), sets, least), columns=["a", "b"], dtype="int64")

    return rows.groupBy("key", "i", "j").applyInPandas(link, "a long, b long").distinct()


def _joined(place: DataFrame, edges: DataFrame) -> DataFrame:
    """place (node, root) after the groups that edges (a, b: nodes) link have become one."""
    roots = edges.join(place.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(place.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    tops = components(roots).withColumnsRenamed({"node": "j", "root": "top"})
    return saved(place.join(tops, F.col("root") == F.col("j"), "left").select("node", F.coalesce("top", "root").alias("root")), "groups", few="coalesce")


def _candidates(met: DataFrame, least: float, also: Column | None = None) -> DataFrame:
    """Pairs (a, b) of nodes that share a key, if sizes and places in the order allow it to be the first they share.

    From its first shared shingle on a pair has at most what is left of the shorter; it needs t/(1+t) of both sizes.
    """
    other = met.select(F.col("key").alias("k_"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("at").alias("at_"), *([F.col("root").alias("r")] if also is not None else []))
    sized = F.least("n", "m") >= least * F.greatest("n", "m") - 1e-6
    placed = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("at_")) >= least / (1 + least) * (F.col("n") + F.col("m")) - 1e-6
    met = met.join(other, (F.col("key") == F.col("k_")) & (F.col("node") < F.col("b")) & sized & placed)
    return (met if also is None else met.filter(also)).select(F.col("node").alias("a"), "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def similar(docs: DataFrame, met: DataFrame, nodes: DataFrame, place: DataFrame, width: int, least: float) -> DataFrame:
    """place (node, root) joined further by all pairs of nodes with a Jaccard similarity of ``least`` or more.

    met: nodes by the shingles of their prefixes that others have as well, which loses no such pair. Up
    to SMALL nodes of a shingle are paired up, less the pairs that parities rule out. More are linked in sub-blocks
    (_crowded) by one shingle of each node first, so that most of a large group is joined before its other
    shingles are looked at: those of up to MIDDLE nodes in pairs of nodes not joined yet, the rest in sub-blocks.
    """
    few, crowd = met.filter(F.col("many") <= SMALL), met.filter(F.col("many") > SMALL)
    pairs = saved(_pruned(_candidates(few, least).distinct(), nodes, least), "candidates", few="coalesce")
    held = saved(_sets(docs, nodes, _ends(pairs).unionByName(crowd.select("node")).distinct(), width), "sets")
    place = _joined(place, _verified(pairs, held, least))
    if crowd.limit(1).count():
        place = _joined(place, _crowded(crowd.groupBy("node").agg(F.min("key").alias("key"), F.first("n").alias("n")), place, held, least))
        rooted = crowd.filter(F.col("many") <= MIDDLE).join(place, "node")
        pairs = saved(_pruned(_candidates(rooted, least, F.col("root") != F.col("r")).distinct(), nodes, least), "candidates", few="coalesce")
        place = _joined(place, _verified(pairs, held, least))
        place = _joined(place, _crowded(crowd.filter(F.col("many") > MIDDLE), place, held, least))
    dropped(docs.sparkSession, held)
    return place


def _near(docs: DataFrame, width: int, least: float, dense: int) -> DataFrame:
    """doc_id, k and top (its group) of every row."""
    spark = docs.sparkSession
    wide = saved(sketches(docs, width, least), "sketches")
    told = saved(wide.select("doc_id", "k", "fp", "node"), "told", few="repartition")
    keyed = wide.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys")).select("node", "n", F.posexplode("keys").alias("at", "key"))
    met = saved(keyed.withColumn("many", F.count("*").over(Window.partitionBy("key"))).filter("many > 1"), "met", few="coalesce")
    nodes = wide.groupBy("node").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min(F.struct("k", "doc_id")).alias("least"))
    nodes = saved(nodes.join(met.select("node").distinct(), "node", "left_semi"), "nodes", few="coalesce")
    dropped(spark, wide)
    roots = components(links(told.select("fp").distinct(), dense))
    rooted = told.select("fp", "node").distinct().join(roots.withColumnRenamed("node", "f"), F.col("fp") == F.col("f"), "left").select("node", F.coalesce("root", "fp").alias("root"))
    place = saved(rooted.groupBy("node").agg(F.min("root").alias("root")), "roots", few="coalesce")
    place = similar(docs, met, nodes, place, width, least)
    return told.select("doc_id", "k", F.col("node").alias("of")).join(place, F.col("of") == F.col("node")).select("doc_id", "k", F.col("root").alias("top"))


def near_groups(docs: DataFrame, width: int = 5, least: float = 0.8, dense: int = DENSE) -> DataFrame:
    """doc_id, component_id: groups by fingerprints of ``width`` words, joined further by verified similarity.

    Two bits of 64 are less than texts at a similarity of 0.8 differ in (4 to 14, mostly), so links of
    fingerprints alone would miss them: see similar(). Nulls, repeats and ties are as in groups().
    """
    members = _near(docs, width, least, dense)
    least_id = members.groupBy("top").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("top", "t")
    return members.join(least_id, F.col("top") == F.col("t")).select("doc_id", "component_id")


def representatives(docs: DataFrame, width: int = 5, least: float = 0.8, dense: int = DENSE) -> DataFrame:
    """docs without near copies: of each group the row with the smallest doc_id stays, whole.

    Rows are told apart by doc_id and text: one of each group stays whatever ids others have. A null
    doc_id comes last; of rows that share the doc_id the text with the smallest hash stays, and of
    rows alike in both one.
    """
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "k")
    stay = saved(_near(docs, width, least, dense).groupBy("top").agg(F.min(first).alias("s")).select(F.col("s.id").alias("_stay"), F.col("s.k").alias("_key")), "stay", few="coalesce")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("_doc"), F.col("doc_id").alias("_id"), text_key(F.col("text")).alias("_k"))
    same = lambda a, b: (F.col("_id").eqNullSafe(F.col(a))) & (F.col("_k") == F.col(b))
    kept = keyed.join(stay, same("_stay", "_key"), "left_semi")
    often = keyed.groupBy("_id", "_k").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("_id").alias("_often"), F.col("_k").alias("_key"))
    single = kept.join(often, same("_often", "_key"), "left_anti")
    several = kept.join(often, same("_often", "_key"), "left_semi").dropDuplicates(["_id", "_k"])
    return single.unionByName(several).select("_doc.*")
