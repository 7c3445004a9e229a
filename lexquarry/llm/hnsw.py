"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

A graph is a few flat arrays: for each level the nodes on it and, for each of these, its
neighbours in a row of fixed width, -1 where there are fewer. Nodes are inserted in batches, and
batches of nodes or queries walk the graph in lock step, so that every hop is a few numpy calls. Inner
products are turned into angles by one more component that fills every vector up to the same length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexquarry.llm import vectors
from lexquarry.llm.common import saved
from lexquarry.llm.vectors import Block

WIDTH, BUILD, BEAM = 24, 64, 160


def lifted(x: np.ndarray) -> np.ndarray:
    """Vectors of length one whose order by inner product with (q, 0) is that of the given ones."""
    with np.errstate(all="ignore"):
        x = x / np.abs(x).max()
        sq = (x * x).sum(1)
        return (np.c_[x, np.sqrt(np.maximum(0, sq.max() - sq))] / np.sqrt(sq.max())).astype("float32")


def walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int, hops: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The beam best nodes that each query reaches from its entries, with their products; best first."""
    m, rows = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((m, len(x) + 1), bool)  # the last column stands for no node
    ids = np.full((m, beam), -1)
    sims = np.full((m, beam), -np.inf, "float32")
    done = np.ones((m, beam), bool)
    e = entry.shape[1]
    ids[:, :e] = entry
    sims[:, :e] = np.where(entry >= 0, np.einsum("mkd,md->mk", x[entry], q), -np.inf)
    done[:, :e] = entry < 0
    seen[rows, entry] = True
    seen[:, -1] = True
    live = np.arange(m)
    while len(live):
        open_ = np.where(done[live], -np.inf, sims[live])
        pick = np.argpartition(-open_, min(hops, beam - 1), axis=1)[:, :hops]
        worth = np.isfinite(np.take_along_axis(open_, pick, 1))
        live, pick, worth = (a[worth.any(1)] for a in (live, pick, worth))
        if not len(live):
            break
        r = live[:, None]
        node = np.where(worth, ids[r, pick], -1)
        done[r, pick] = True
        near = np.where(node[:, :, None] >= 0, links[node], -1).reshape(len(live), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[r, near]] = -1
        seen[r, near] = True
        s = np.where(near >= 0, np.einsum("mkd,md->mk", x[near], q[live]), -np.inf)
        all_s = np.concatenate([sims[live], s], 1)
        order = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
        sims[live] = np.take_along_axis(all_s, order, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), order, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], near < 0], 1), order, 1)
    return ids, sims


def diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
    """Of candidates sorted by closeness, those closer to the node than to any chosen before; then the closest others."""
    m, c = ids.shape
    v = x[ids]
    between = np.einsum("mad,mbd->mab", v, v)
    chosen = np.zeros((m, c), bool)
    for j in range(c):
        chosen[:, j] = (ids[:, j] >= 0) & ~((between[:, j] > sims[:, j, None]) & chosen).any(1) & (chosen.sum(1) < width)
    order = np.argsort(np.where(chosen, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :width]
    return np.take_along_axis(ids, order, 1)


def connect(x: np.ndarray, links: np.ndarray, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
    """Links nodes to the candidates found for them, and those back; full rows keep a diverse choice."""
    width = links.shape[1]
    links[nodes] = -1
    own = diverse(x, ids, sims, width)
    links[nodes, : own.shape[1]] = own
    to, src = own.ravel(), np.repeat(nodes, own.shape[1])
    src, to = src[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    src, to = src[order], to[order]
    target, begin, count = np.unique(to, return_index=True, return_counts=True)
    fresh = np.full((len(target), min(int(count.max(initial=0)), 2 * width)), -1)
    place = np.arange(len(to)) - np.repeat(begin, count)
    fit = place < fresh.shape[1]
    fresh[np.repeat(np.arange(len(target)), count)[fit], place[fit]] = src[fit]
    both = np.concatenate([links[target], fresh], 1)
    both.sort(axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    s = np.where(both >= 0, np.einsum("mkd,md->mk", x[both], x[target]), -np.inf)
    order = np.argsort(-s, axis=1, kind="stable")
    both, s = np.take_along_axis(both, order, 1), np.take_along_axis(s, order, 1)
    full = (both >= 0).sum(1) > width
    links[target[~full]] = both[~full, :width]
    for at in np.array_split(np.flatnonzero(full), max(1, full.sum() // 512)):
        if len(at):
            links[target[at]] = diverse(x, both[at], s[at], width)


def build(x: np.ndarray, width: int = WIDTH, beam: int = BUILD, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the top: nodes on the level and their neighbours, as places in x."""
    n = len(x)
    level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(width)).astype(int), 6)
    top = int(level.max())
    graph = [np.full((n, width if h else 2 * width), -1) for h in range(top + 1)]
    entry = int(np.argmax(level))  # the highest node goes first
    order = np.r_[entry, np.delete(np.arange(n), entry)]
    at = 0
    while at < n:
        batch = order[at : at + (1 if at == 0 else max(16, min(512, at // 4)))]
        start = np.full((len(batch), 1), entry)
        for h in range(top, -1, -1):
            here = np.flatnonzero(level[batch] >= h)
            if at:
                ids, sims = walk(x, graph[h], x[batch], start, beam if len(here) else 1)
                start = ids[:, :1]
            else:
                ids, sims = np.full((1, 1), -1), np.full((1, 1), -np.inf, "float32")
            if len(here):
                group = batch[here]
                within = x[group] @ x[group].T
                np.fill_diagonal(within, -np.inf)
                near = np.argsort(-within, axis=1)[:, : min(len(group) - 1, width)]
                both = np.concatenate([ids[here], group[near]], 1)
                s = np.concatenate([sims[here], np.take_along_axis(within, near, 1)], 1)
                o = np.argsort(-s, axis=1, kind="stable")[:, : max(beam, width)]
                connect(x, graph[h], group, np.take_along_axis(both, o, 1), np.take_along_axis(s, o, 1))
        at += len(batch)
    return [(np.flatnonzero(level >= h), graph[h]) for h in range(top, -1, -1)]


def flat(levels: list[tuple[np.ndarray, np.ndarray]]) -> dict:
    """The graph as two flat arrays and their shapes."""
    return {"shape": np.array([(len(nodes), g.shape[1]) for nodes, g in levels], "int32").tobytes(), "nodes": np.concatenate([nodes for nodes, _ in levels]).astype("int32").tobytes(), "links": np.concatenate([g[nodes].ravel() for nodes, g in levels]).astype("int32").tobytes()}


def unflat(r: dict, n: int) -> list[np.ndarray]:
    shape, nodes, links = (np.frombuffer(r[k], "int32") for k in ("shape", "nodes", "links"))
    out, a, b = [], 0, 0
    for many, width in shape.reshape(-1, 2):
        g = np.full((n, width), -1)
        g[nodes[a : a + many]] = links[b : b + many * width].reshape(many, width)
        out.append(g)
        a, b = a + many, b + many * width
    return out


def index(df: DataFrame, size: int = vectors.BLOCK, width: int = WIDTH, beam: int = BUILD) -> DataFrame:
    """Every vector in shards of ``size`` rows, each with its graph; written to the shared folder."""
    shards = vectors.blocks(df, zeros=False, size=size)

    def grow(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                g = flat(build(lifted(Block.of(row.to_pylist()[0]).x), width, beam))
                yield pa.RecordBatch.from_arrays([*row.columns, *(pa.array([g[k]], pa.binary()) for k in ("shape", "nodes", "links"))], names=[*row.schema.names, "shape", "nodes", "links"])

    spread = shards.repartition(max(1, shards.count()), "block")  # one row per shard
    return saved(spread.mapInArrow(grow, f"block long, {vectors.COLUMNS}, shape binary, nodes binary, links binary"), "graphs")


def search(graphs: DataFrame, k: int = 20, every: int = 20, beam: int = BEAM) -> DataFrame:
    """The k nearest that walks of width ``beam`` find in each shard of index(), merged: rows, ties and nulls as in nearest()."""

    def find(r: dict, q: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        block = Block.of(r)
        x, levels = lifted(block.x), unflat(r, len(block.row))
        entry = np.frombuffer(r["nodes"], "int32")[0]
        out = []
        for a in range(0, len(q.row), 256):
            y = q.x[a : a + 256]
            y = y / np.abs(y).max(1, keepdims=True)
            y = np.c_[y / np.linalg.norm(y, axis=1, keepdims=True), np.zeros(len(y))].astype("float32")
            start = np.full((len(y), 1), int(entry))
            for g in levels[:-1]:
                start = walk(x, g, y, start, 4)[0][:, :1]
            ids = walk(x, levels[-1], y, start, max(beam, k + 1))[0]
            for i in range(len(y)):
                at = ids[i][ids[i] >= 0]
                at = at[block.row[at] != q.row[a + i]]
                with np.errstate(over="ignore"):
                    s = (block.x[at] * q.x[a + i]).sum(1)
                top = vectors.best(block, at, s, k)
                out.append((np.full(len(top), a + i), at[top], s[top]))
        return tuple(np.concatenate(c) for c in zip(*out))

    return vectors.search(graphs, every, k, find, "double")


def nearest(df: DataFrame, k: int = 20, every: int = 20, size: int = vectors.BLOCK, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: about the k largest inner products of each query, in doubles.

    Queries are the rows whose vec_id divides by ``every``; a row is no candidate of its own, but
    rows that repeat it are. Ties go to the smaller vec_id, null ids last. Null, empty and zero
    vectors and those with null or non-finite components take no part; vectors of other dimensions
    aren't compared. Fewer than k candidates give fewer rows. Scores are those of the vectors given.
    """
    return search(index(df, size), k, every, beam)
