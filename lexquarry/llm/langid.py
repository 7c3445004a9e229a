"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers run over a text's bytes, one in each direction; a linear layer labels every
position with a probability for each language, and the document's probabilities are the mean
over its positions. The network is trained in numpy by backpropagation through time, on all words of all texts
to learn from: each distinct word once a pass, with its number as weight, by tasks whose networks are averaged.

Texts are run in spans of ``SPAN`` positions, all spans of a batch at once. Each direction begins ``CONTEXT``
bytes before a span, wherever the text has them: by then the state has forgotten where it began (a test holds
the labels against runs over whole texts). Every position of the whole text is labelled once.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.llm.common import bounded, dropped, saved
from lexquarry.llm.simhash import words_of

HIDDEN, SPAN, CONTEXT = 10, 256, 48
STEPS, BATCH, LENGTH, RATE = 300, 256, 48, 0.02
SHARD, ROUNDS, FEW = 4_000_000, 8, 2000  # bytes of distinct words learned from in one task; averagings; words of a language that every task has
KEPT, ROWS = 300_000, 20_000  # distinct words held while a task counts; told at once
UNKNOWN = "und"
VECTOR = 256  # no byte: before the beginning and after the end, where the state is zero


@dataclass
class Network:
    """w: for each direction the table of inputs (257, 3h), recurrent weights (h, 3h); out: (2h, k), (k,)."""

    labels: list[str]
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fresh(labels: list[str], hidden: int, seed: int) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *shape, s: (r.standard_normal(shape) * s).astype("float32")
        return Network(labels, [draw(257, 3 * hidden, s=0.3) for _ in range(2)], [draw(hidden, 3 * hidden, s=hidden**-0.5) for _ in range(2)], draw(2 * hidden, len(labels), s=0.3), np.zeros(len(labels), "float32"))

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recurrent, self.out, self.bias]

    def run(self, x: np.ndarray, way: int, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (time, h, batch) of one direction over bytes x (time, batch); kept: what the gradient needs, in the order of the run."""
        table, u = np.ascontiguousarray(self.inputs[way].T), self.recurrent[way]
        h, many, kind = u.shape[0], x.shape[1], table.dtype
        gates, rest = np.ascontiguousarray(u[:, : 2 * h].T), np.ascontiguousarray(u[:, 2 * h :].T)
        s, kept, states = np.zeros((h, many), kind), [], np.empty((len(x), h, many), kind)
        e, zr, n, rs = (np.empty((k * h, many), kind) for k in (3, 2, 1, 1))
        none = x == VECTOR
        some = none.any(1)
        for t in range(len(x)) if way == 0 else range(len(x) - 1, -1, -1):
            np.take(table, x[t], axis=1, out=e, mode="clip")
            np.matmul(gates, s, out=zr)
            zr += e[: 2 * h]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:h], zr[h:]
            np.matmul(rest, np.multiply(r, s, out=rs), out=n)
            n += e[2 * h :]
            np.tanh(n, out=n)
            if keep:
                kept.append((t, s, z.copy(), r.copy(), n.copy()))
            s = np.subtract(s, n, out=states[t])
            s *= z
            s += n
            if some[t]:
                s[:, none[t]] = 0
        return states, kept

    def _softmax(self, forth: np.ndarray, back: np.ndarray) -> np.ndarray:
        """(time, k, batch) from the states of both directions."""
        h = forth.shape[1]
        y = np.matmul(self.out[:h].T, forth)
        y += np.matmul(self.out[h:].T, back)
        y += self.bias[:, None]
        y -= y.max(1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(1, keepdims=True)
        return y

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(time, batch, k): of every position."""
        return self._softmax(self.run(x, 0)[0], self.run(x, 1)[0]).transpose(0, 2, 1)

    def between(self, x: np.ndarray, context: int) -> np.ndarray:
        """(time, k, batch): of every position but ``context`` at either end, where a direction begins."""
        end = len(x) - context
        return self._softmax(self.run(x[:end], 0)[0][context:], self.run(x[context:], 1)[0][: end - context])

    def gradients(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, list[np.ndarray]]:
        """Of the mean cross entropy over all positions that have a byte, by weight (time, batch) where there is one."""
        h = self.recurrent[0].shape[0]
        both = [self.run(x, way, keep=True) for way in (0, 1)]
        p = self._softmax(both[0][0], both[1][0])
        rows = np.arange(len(label))
        none = x == VECTOR
        w = np.where(none, 0, 1 if weight is None else weight).astype(p.dtype)
        w /= max(w.sum(), 1e-9)
        loss = -(np.log(p[:, label, rows] + 1e-9) * w).sum()
        p[:, label, rows] -= 1
        p *= w[:, None]
        grads_in, grads_u = [], []
        back, flat = np.matmul(self.out, p), x.ravel()
        for way in (0, 1):
            u = self.recurrent[way]
            gates, rest = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
            gu, ds, d = np.zeros_like(u), np.zeros((h, x.shape[1]), p.dtype), np.empty((3 * h, *x.shape), p.dtype)
            for t, s, z, r, n in reversed(both[way][1]):
                ds = ds + back[t, way * h : way * h + h]
                ds[:, none[t]] = 0
                dn = ds * (1 - z) * (1 - n * n)
                drs = rest @ dn
                dzr = np.concatenate([ds * (s - n) * z * (1 - z), drs * s * r * (1 - r)])
                gu[:, : 2 * h] += s @ dzr.T
                gu[:, 2 * h :] += (r * s) @ dn.T
                d[: 2 * h, t], d[2 * h :, t] = dzr, dn
                ds = ds * z + drs * r + gates @ dzr
            grads_in.append(np.stack([np.bincount(flat, one.ravel(), len(self.inputs[way])) for one in d], 1).astype(u.dtype))
            grads_u.append(gu)
        to_out = np.concatenate([np.matmul(states, p.transpose(0, 2, 1)).sum(0) for states, _ in both])
        return float(loss), [*grads_in, *grads_u, to_out, p.sum((0, 2))]


def learned(net: Network, words: list[bytes], label: np.ndarray, n: np.ndarray, steps: int = STEPS, batch: int = BATCH, length: int = LENGTH, rate: float = RATE, seed: int = 5, progress: tuple[float, float] = (0, 1)) -> Network:
    """net after passes over all words (with their label and number), by Adam: ``steps`` steps, or as many as one pass takes.

    Words of a label stand in a row in random order, as in a text, and are cut into spans of ``length``. A
    word weighs 1 + log2 of its number, and labels weigh the same; those of few words are passed several times, so that a batch is filled.
    """
    r, sizes, weight = np.random.default_rng(seed), np.array([len(w) + 1 for w in words], "int64"), 1 + np.log2(n)
    spans, weights, labels = [], [], []
    for k in np.unique(label):
        own = np.flatnonzero(label == k)
        again = max(1, round(max(sizes.sum() / 2, batch * length) / (len(net.labels) * sizes[own].sum())))
        order = np.concatenate([r.permutation(own) for _ in range(again)])
        many = sizes[order].sum()
        rows = -(-many // length)
        x, w = np.full(rows * length, VECTOR, "int16"), np.zeros(rows * length, "float32")
        x[:many] = np.frombuffer(b" ".join([words[i] for i in order]) + b" ", "u1")
        w[:many] = np.repeat(weight[order], sizes[order])
        spans.append(x.reshape(-1, length))
        weights.append(w.reshape(-1, length) / w.mean(dtype="float64") / rows)
        labels.append(np.full(rows, k))
    x, w, label = np.concatenate(spans), np.concatenate(weights), np.concatenate(labels)
    w *= len(x)
    once = -(-len(x) // batch)
    passes, step = max(1, -(-steps // once)), 0
    mean, square = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    for _ in range(passes):
        for rows in np.array_split(r.permutation(len(x)), once):
            _, grads = net.gradients(np.ascontiguousarray(x[rows].T).astype("intp"), label[rows], w[rows].T)
            done = progress[0] + (progress[1] - progress[0]) * step / (passes * once)
            step += 1
            for p, g, m, v in zip(net.parameters(), grads, mean, square):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * min(1, 2 * (1 - done)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype("float32")
    return net


def train(texts: list[str], langs: list[str], hidden: int = HIDDEN, seed: int = 5, **how) -> Network:
    """Learns from all words of the texts."""
    labels = sorted(set(langs))
    net, counts = Network.fresh(labels, hidden, seed), Counter((k, w) for t, k in zip(texts, langs) for w in t.encode().split())
    every = sorted(counts)
    if len(labels) > 1:
        learned(net, [w for _, w in every], np.array([labels.index(k) for k, _ in every]), np.array([counts[x] for x in every]), seed=seed, **how)
    return net


def _spans(text: np.ndarray, begin: int, end: int, span: int, context: int) -> np.ndarray:
    """Bytes begin to end of the text in rows of span positions with context on both sides, filled up with no byte."""
    rows = -(-(end - begin) // span)
    padded = np.full(rows * span + 2 * context, VECTOR, "int16")
    low, high = max(0, begin - context), min(len(text), end + context)
    own = text[low:high][: len(padded) - (low - begin + context)]
    padded[low - begin + context : low - begin + context + len(own)] = own
    return np.lib.stride_tricks.sliding_window_view(padded, span + 2 * context)[::span]


def pooled(net: Network, texts: list[bytes], span: int = SPAN, context: int = CONTEXT, rows: int = 1024) -> np.ndarray:
    """(texts, k): the mean of the probabilities of all positions of each text."""
    sums, sizes = np.zeros((len(texts), len(net.labels))), np.array([len(t) for t in texts])

    def flush(held: list[tuple[int, int, np.ndarray]]) -> None:
        x = np.concatenate([s for _, _, s in held])
        owner = np.repeat([i for i, _, _ in held], [len(s) for _, _, s in held])
        own = np.concatenate([np.minimum(span, n - span * np.arange(len(s))) for _, n, s in held])  # positions of the row
        for a in range(0, len(x), rows):
            part = np.ascontiguousarray(x[a : a + rows].T)
            p = net.between(part.astype("intp"), context)
            p *= (np.arange(span)[:, None] < own[a : a + rows])[:, None]
            np.add.at(sums, owner[a : a + rows], p.sum(0, dtype="float64").T)

    held, many = [], 0
    for i, t in enumerate(texts):
        for a in range(0, len(t), span * rows):  # a very long text doesn't stand in memory whole
            end = min(len(t), a + span * rows)
            s = _spans(np.frombuffer(t, "u1"), a, end, span, context)
            held.append((i, end - a, s))
            many += len(s)
            if many >= rows:
                flush(held)
                held, many = [], 0
    if held:
        flush(held)
    return sums / np.maximum(sizes, 1)[:, None]


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def learnable(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("lang").isNotNull() & (F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1)) % 5 != 0))


def counted(docs: DataFrame) -> DataFrame:
    """lang, word, n: how often each word occurs in the learnable texts of each language; all words of all of them, whole."""
    rows = bounded(learnable(docs).filter(F.col("text").rlike(r"\p{L}"))).select("lang", "text")

    def run(batches):
        held: dict[str, Counter] = defaultdict(Counter)

        def told():
            for lang, own in held.items():
                for at in range(0, len(own), ROWS):
                    some = list(islice(own.items(), at, at + ROWS)) if len(own) > ROWS else list(own.items())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([w for w, _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64())], names=["lang", "word", "n"])

        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"].cast(pa.binary()).to_pylist()):
                for words in words_of(text):
                    held[lang].update(words)
                    if sum(map(len, held.values())) >= KEPT:
                        yield from told()
                        held.clear()
        yield from told()

    return rows.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, hidden: int = HIDDEN, steps: int = STEPS, seed: int = 5, shard: int = SHARD, **how) -> Network:
    """A network learned from all words of all learnable texts, each with its number in each language.

    The words of all languages are dealt into shards of about ``shard`` bytes. In each of ROUNDS rounds every
    shard goes on from the same network over its part of that round, and the networks are averaged. One shard
    takes one round, of ``steps`` steps at least. A language of fewer words than FEW is in every shard.
    """
    words = saved(counted(docs), "words")
    told = words.groupBy("lang").agg(F.count("*").alias("many"), F.sum(F.length("word") + 1).alias("size")).collect()
    net = Network.fresh(sorted(r.lang for r in told), hidden, seed)
    if len(told) < 2:
        return net
    shards = -(-sum(r.size for r in told) // shard)
    rounds = ROUNDS if shards > 1 else 1
    h = F.xxhash64("lang", "word")
    few = F.col("lang").isin([r.lang for r in told if r.many < FEW])
    at = F.when(few, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(F.pmod(F.floor(h / rounds), F.lit(shards)).cast("int")))
    dealt = words.withColumn("round", F.pmod(h, F.lit(rounds))).withColumn("shard", F.explode(at))
    for nr in range(rounds):

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["lang", "word"])
            label = np.searchsorted(net.labels, rows["lang"].to_numpy(dtype=str))
            own = Network(net.labels, [p.copy() for p in net.inputs], [p.copy() for p in net.recurrent], net.out.copy(), net.bias.copy())
            own = learned(own, rows["word"].tolist(), label, rows["n"].to_numpy(), steps if rounds == 1 else 1, seed=seed + nr + rounds * int(rows["shard"].iloc[0]), progress=(nr / rounds, (nr + 1) / rounds), **how)
            return pd.DataFrame({"shard": rows["shard"].iloc[:1], "parameters": [np.concatenate([p.ravel() for p in own.parameters()]).astype("float32").tobytes()]})

        parts = dealt.filter(F.col("round") == nr).groupBy("shard").applyInPandas(run, "shard int, parameters binary").collect()
        parts = [np.frombuffer(r.parameters, "float32") for r in sorted(parts)]
        if parts:
            flat, at = np.mean(parts, 0, dtype="float64").astype("float32"), 0
            for p in net.parameters():
                p[...] = flat[at : at + p.size].reshape(p.shape)
                at += p.size
    dropped(docs.sparkSession, words)
    return net


def _told(docs: DataFrame, net: Network) -> DataFrame:
    """doc (a struct of all columns of docs), held_out, lang_pred, score."""
    own = bounded(docs).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").cast("string").alias("id"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                s = b.slice(at, 512)
                has = np.asarray(s["letters"]) & bool(net.labels)
                texts = [t if ok else b"" for t, ok in zip(s["doc"].field("text").cast(pa.binary()).to_pylist(), has)]
                p = pooled(net, texts) if has.any() else np.zeros((len(texts), 1))
                best = p.argmax(1)
                lang = [net.labels[k] if ok else UNKNOWN for k, ok in zip(best, has)]
                score = np.where(has, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
                out = [held_out(i) for i in s["id"].to_pylist()]
                yield pa.RecordBatch.from_arrays([s["doc"], pa.array(out), pa.array(lang), pa.array(score)], names=["doc", "held_out", "lang_pred", "score"])

    return own.mapInArrow(run, T.StructType([own.schema["doc"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every text, by its bytes alone.

    ``und`` with score 0: the text is null or has no letter (an empty one hasn't), or there was nothing to learn from.
    Other texts, however long, get the language of the highest mean probability over all positions, and that as score;
    of equal ones the first by name. Rows that repeat each give a row; a null doc_id isn't held out. Other columns
    are left out, whatever their names. An empty table gives no rows.
    """
    # the text is all that is read of a document, so nothing else travels
    return _told(docs.select("doc_id", "text"), net).select("doc.doc_id", "held_out", "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.4, **how) -> DataFrame:
    """The rows of docs in a language that the network tells with a probability of ``least`` or more, as predict() says.

    It learns from docs themselves. Texts that are null or have no letter go. Rows that repeat stay or go together;
    all columns are kept, whatever their names. Of an empty table nothing stays.
    """
    return _told(docs, fit(docs, **how)).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("doc.*")
