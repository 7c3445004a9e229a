"""Exact top-k by columnar branch and bound.

A block lies in vertical layout, dimension by dimension. Inner products grow by one block of
dimensions at a time; after each, what the other dimensions can still add or take away is bounded
by the product of the two remainders' norms, and candidates whose upper bound lies under the k-th
best lower bound leave: the survivors are compacted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from lexquarry.llm import vectors
from lexquarry.llm.vectors import Block

DIMENSIONS = 16
LONG = 2**63 - 1


def _whole(x: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        y = np.floor(scale * x)
    return np.clip(y, -1.7e308, 1.7e308)


def _large(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores too large for exact doubles: in Python's integers, held to the range of long."""
    q = [int(v) for v in q]
    return np.array([max(-LONG - 1, min(LONG, sum(a * int(b) for a, b in zip(q, v)))) for v in x], "int64")


def branch_and_bound(block: Block, q: Block, k: int, scale: float, step: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y = _whole(block.x, scale), _whole(q.x, scale)
    n, dim = x.shape
    if dim * max(1.0, float(np.abs(x).max())) * max(1.0, float(np.abs(y).max())) >= 2.0**53:
        exact = [_large(v, x) for v in y]
        out = []
        for i, s in enumerate(exact):
            at = np.flatnonzero(block.row != q.row[i])
            # unsigned order: the lowest long has no negative
            top = np.lexsort((block.row[at], block.id[at], ~block.has_id[at], -s[at].astype(object)))[:k]
            out.append((np.full(len(top), i), at[top], s[at][top]))
        return tuple(np.concatenate(c) for c in zip(*out))
    vertical = np.ascontiguousarray(x.T)
    cuts = [*range(0, dim, step), dim]
    rest = lambda v: np.sqrt(np.stack([(v[:, c:] ** 2).sum(1) for c in cuts[1:]])) * (1 + 1e-9)
    rest_x, rest_y = rest(x), rest(y)
    out = []
    first = y[:, : cuts[1]] @ vertical[: cuts[1]]
    for i in range(len(y)):
        alive = np.flatnonzero(block.row != q.row[i])
        sums = first[i, alive]
        for j in range(1, len(cuts)):
            if j > 1:
                sums = sums + y[i, cuts[j - 1] : cuts[j]] @ vertical[cuts[j - 1] : cuts[j], alive]
            if len(alive) > k and j < len(cuts) - 1:
                slack = rest_y[j - 1, i] * rest_x[j - 1, alive] + 1e-6
                floor = np.partition(sums - slack, -k)[-k]
                keep = sums + slack >= floor
                alive, sums = alive[keep], sums[keep]
        top = vectors.best(block, alive, sums, k)
        out.append((np.full(len(top), i), alive[top], sums[top].astype("int64")))
    return tuple(np.concatenate(c) for c in zip(*out))


def topk(df: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0, size: int = vectors.BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of floor(scale * x), exactly.

    Queries are the rows whose vec_id divides by ``every``; a row is no candidate of its own, but
    rows that repeat it are. Ties go to the smaller vec_id, null ids last. Null or empty vectors
    and those with null or non-finite components take no part; vectors of other dimensions
    aren't compared. Scores beyond long are held to its range. Fewer than k candidates give fewer rows.
    """
    return vectors.search(vectors.blocks(df, zeros=True, size=size), every, k, lambda r, q: branch_and_bound(Block.of(r), q, k, scale), "long")
