"""Vectors in blocks: a table of blocks of bounded size, queries sent to every block, results merged."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.common import saved

BLOCK = 8192


@dataclass
class Block:
    """Rows of one dimension: number of each row, its id, whether it has one, and the vectors."""

    row: np.ndarray
    id: np.ndarray
    has_id: np.ndarray
    x: np.ndarray

    @staticmethod
    def of(r: dict) -> Block:
        return Block(np.frombuffer(r["row"], "int64"), np.frombuffer(r["id"], "int64"), np.frombuffer(r["has_id"], bool), np.frombuffer(r["x"], "float64").reshape(-1, r["dim"]))

    def take(self, at: np.ndarray) -> Block:
        return Block(self.row[at], self.id[at], self.has_id[at], self.x[at])

    def packed(self) -> dict:
        return {"dim": self.x.shape[1], "row": self.row.tobytes(), "id": self.id.tobytes(), "has_id": self.has_id.tobytes(), "x": np.ascontiguousarray(self.x).tobytes()}


COLUMNS = "dim int, row binary, id binary, has_id binary, x binary"


def _batch(rows: list[dict], more: dict[str, pa.DataType]) -> pa.RecordBatch:
    types = {"dim": pa.int32(), "row": pa.binary(), "id": pa.binary(), "has_id": pa.binary(), "x": pa.binary()}
    kinds = {k: (types | more)[k] for k in rows[0]}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))


def valid(df: DataFrame, zeros: bool) -> DataFrame:
    """vec_id and the vector in doubles: no null, empty or (unless zeros) zero vectors, no null or non-finite components."""
    x = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).filter("size(x) > 0")
    x = x.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return x if zeros else x.filter(F.exists("x", lambda v: v != 0))


def blocks(df: DataFrame, zeros: bool, size: int = BLOCK) -> DataFrame:
    """The valid vectors in blocks of about ``size`` rows each; written once, so rows keep their numbers."""
    rows = valid(df, zeros)
    many = max(1, -(-rows.count() // size))

    def pack(batches):
        seen, held = 0, []

        def out(pending: list[tuple[pa.Array, pa.Array, np.ndarray]]):
            found: dict[int, list] = {}
            for ids, xs, number in pending:
                lengths = np.diff(xs.offsets.to_numpy())
                flat, has = xs.flatten().to_numpy(), np.asarray(ids.is_valid())
                starts = np.r_[0, np.cumsum(lengths)[:-1]]
                for dim in np.unique(lengths):
                    at = np.flatnonzero(lengths == dim)
                    found.setdefault(int(dim), []).append(Block(number[at], np.asarray(ids.fill_null(0))[at], has[at], flat[starts[at][:, None] + np.arange(dim)]))
            for same in found.values():
                b = Block(*(np.concatenate([getattr(x, k) for x in same]) for k in ("row", "id", "has_id", "x")))
                yield _batch([{"block": int(b.row[0]), **b.packed()}], {"block": pa.int64()})

        from pyspark import TaskContext

        base, waiting = TaskContext.get().partitionId() << 40, 0
        for b in batches:
            held.append((b.column(0), b.column(1), base + seen + np.arange(b.num_rows)))
            seen, waiting = seen + b.num_rows, waiting + b.num_rows
            if waiting >= size:
                yield from out(held)
                held, waiting = [], 0
        if held:
            yield from out(held)

    return saved(rows.repartition(many).mapInArrow(pack, f"block long, {COLUMNS}"), "blocks")


def search(table: DataFrame, every: int, k: int, find: Callable[[dict, Block], tuple[np.ndarray, np.ndarray, np.ndarray]], score: str) -> DataFrame:
    """Queries (rows whose id divides by ``every``) against every block of their dimension; the k best of each.

    table: block, the columns of a block, and whatever else find() reads. find(block's row, queries)
    gives query's place, candidate's place in the block and score of what it found: the k best per
    query are enough. Queries travel in blocks; what they find in a block is merged by one window.
    """
    kind, typed = ("long", pa.int64()) if score == "long" else ("double", pa.float64())

    def queries(batches):
        for b in batches:
            for r in b.to_pylist():
                block = Block.of(r)
                at = np.flatnonzero(block.has_id & (block.id % every == 0))
                if len(at):
                    yield _batch([block.take(at).packed()], {})

    asked = table.select(*COLUMNS.replace(" int", "").replace(" binary", "").split(", ")).mapInArrow(queries, COLUMNS)
    asked = asked.select(F.col("dim").alias("of_dim"), F.struct("dim", "row", "id", "has_id", "x").alias("asked"))
    where = table.select(F.col("dim").alias("to_dim"), F.col("block").alias("to"))  # one small row per block
    routed = asked.join(where, F.col("of_dim") == F.col("to_dim")).select("to", "asked")
    pairs = routed.join(table, F.col("to") == F.col("block"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                q, block = Block.of(r["asked"]), Block.of(r)
                qi, ci, s = find(r, q)
                yield pa.RecordBatch.from_arrays([pa.array(q.row[qi]), pa.array(q.id[qi]), pa.array(block.row[ci]), pa.array(block.id[ci], mask=~block.has_id[ci]), pa.array(s, typed)], names=["q", "query_id", "c", "vec_id", "score"])

    found = pairs.mapInArrow(run, f"q long, query_id long, c long, vec_id long, score {kind}")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "c")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(block: Block, at: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places in ``at`` of the k highest scores, ties to the smaller id (rows without one last)."""
    return np.lexsort((block.row[at], block.id[at], ~block.has_id[at], -score))[:k]
