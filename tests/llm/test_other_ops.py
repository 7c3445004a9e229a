"""Archives, vectors and the pipeline against brute force."""

import hashlib
import random
import uuid

import numpy as np
import pytest

from lexquarry.llm import exact_topk, hnsw, warc
from lexquarry.llm.common import scratch


# ---------------------------------------------------------------- 2: archives
def test_archive_round_trip(spark):
    long = "<p>" + "é" * 100
    rows = [(5, "http://a/1", long), (3, "http://a/2", long), (9, None, long), (1, "http://b c\r\nX: y", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (None, "n", long), (3, "dup", "z" * 100), (3, "dup", "z" * 100), (8, "big", "q" * 300_000)]
    pages = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "page_id long, url string, html string, digest string, payload string, n string")
    path = scratch(spark, "test-warc")
    warc.write(pages, path)
    got = sorted((tuple(r) for r in warc.read(spark, path).drop("uri").collect()), key=str)
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        first = min((q for q, _, g in rows if (g or "") == (h or "") and q is not None), default=None) if len(b) >= 100 else p
        want.append((p, len(b), hashlib.sha256(b).hexdigest(), "response" if p == first else "revisit", None if p == first else first))
    assert got == sorted(want, key=str)
    assert spark.read.parquet(f"{path}/payloads").count() == len({(h or "") for _, _, h in rows})
    one = warc.records(spark, path).first()
    fields = warc.parsed(bytes(one.warc))
    assert fields[b"WARC-Type"] in (b"response", b"revisit") and b"X" not in fields


def test_damage_is_noticed(spark):
    path, other = scratch(spark, "test-warc"), scratch(spark, "test-warc")
    warc.write(spark.createDataFrame([(1, "u", "hello")], "page_id long, url string, html string"), path)
    p = spark.read.parquet(f"{path}/payloads").toPandas()
    import zstandard

    p["packed"] = [zstandard.ZstdCompressor().compress(b"jello")]
    spark.createDataFrame(p).write.parquet(f"{other}/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{other}/headers")
    with pytest.raises(Exception, match="match its header"):
        warc.read(spark, other).collect()


def test_empty_archive(spark):
    path = scratch(spark, "test-warc")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).collect() == []


# ---------------------------------------------------------------- 5 and 7: vectors
def vector_rows(n=400, dim=12, seed=1):
    r = np.random.default_rng(seed)
    rows = [(i, r.standard_normal(dim).astype("float32").tolist()) for i in range(n)]
    rows[37] = (37, rows[40][1])  # ties
    rows += [(40, rows[40][1]), (100, rows[3][1])]  # ids that repeat
    rows += [(1500, None), (1520, [0.0] * dim), (1540, [None] * dim), (1560, [float("nan")] + [0.0] * (dim - 1)), (1580, [float("inf")] * dim), (1600, []), (None, rows[5][1]), (620, [1.0, 2.0])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "b", "q", 2.0) for r in rows], "vec_id long, embedding array<float>, label int, block string, x string, score double")


def usable(rows, zeros):
    out = []
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and (zeros or any(v)):
            out.append((i, np.array(v, "float32").astype(float)))
    return out


def brute_top(rows, every, k, transform, zeros):
    own, out = usable(rows, zeros), []
    for a, (q, x) in enumerate(own):
        if q is None or q % every:
            continue
        scored = sorted(((-float(transform(x) @ transform(y)), c is None, c or 0, b) for b, (c, y) in enumerate(own) if b != a and len(y) == len(x)))[:k]
        out += [(q, i, None if none else c, -s) for i, (s, none, c, _) in enumerate(scored, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [8192, 64])
def test_exact_search(spark, size):
    rows = vector_rows()
    got = sorted(((r.query_id, r["rank"], r.vec_id, float(r.score)) for r in exact_topk.topk(frame(spark, rows), size=size).collect()), key=str)
    assert got == brute_top(rows, 100, 10, lambda v: np.floor(1024 * v), True)


def test_exact_search_of_few_and_large(spark):
    assert exact_topk.topk(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    few = spark.createDataFrame([(0, [1.0, 2.0]), (7, [3.0, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in exact_topk.topk(few).collect()] == [(0, 1, 7, 1024 * 3072 + 2048 * 512)]
    large = spark.createDataFrame([(0, [1e9, 1.0]), (7, [1e5, 0.5]), (8, [-1e300, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in exact_topk.topk(large).collect()] == [(0, 1, 7, 1024 * 10**9 * 1024 * 10**5 + 1024 * 512 if 1024 * 10**9 * 1024 * 10**5 < 2**63 else 2**63 - 1), (0, 2, 8, -(2**63))]


def test_bounds_drop_candidates_only():
    from lexquarry.llm.vectors import Block

    r = np.random.default_rng(3)
    x = r.standard_normal((300, 32))
    block = Block(np.arange(300), np.arange(300), np.ones(300, bool), x)
    for step in (1, 5, 16, 32):
        qi, ci, s = exact_topk.branch_and_bound(block, block.take(np.arange(10)), 5, 1024.0, step)
        y = np.floor(1024 * x)
        for i in range(10):
            want = [j for j in np.lexsort((np.arange(300), -(y @ y[i]))) if j != i][:5]
            assert ci[qi == i].tolist() == want and s[qi == i].tolist() == (y[want] @ y[i]).astype(int).tolist()


@pytest.mark.parametrize("size", [8192, 150])
def test_graph_search_recall_and_scores(spark, size):
    rows = vector_rows(1500, 16)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in hnsw.nearest(frame(spark, rows), size=size).collect()]
    want = brute_top(rows, 20, 20, lambda v: v, False)
    near = lambda a: {(q, c) for q, _, c, _ in a}
    assert len(near(got) & near(want)) / len(near(want)) >= 0.95 and len(got) == len(want)
    vec = {}
    for i, v in usable(rows, False):
        vec.setdefault(i, []).append(v)
    for q, _, c, s in got[:300]:
        assert any(len(a) == len(b) and abs(s - float(a @ b)) < 1e-12 for a in vec[q] for b in vec[c])
    assert not {c for _, _, c, _ in got} & {1520, 1540, 1560, 1580, 1600}


def test_graph_of_few_and_varied_lengths(spark):
    assert hnsw.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    r = np.random.default_rng(2)
    rows = [(i, (r.standard_normal(8) * 10 ** r.uniform(-2, 2)).tolist()) for i in range(300)]
    got = {(x.query_id, x.vec_id) for x in hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()}
    want = {(q, c) for q, _, c, _ in brute_top([(i, v) for i, v in rows], 20, 5, lambda v: v, False)}
    assert len(got & want) / len(want) >= 0.9


# ---------------------------------------------------------------- the pipeline
def test_pipeline(spark, tmp_path):
    import corpus_pipeline as c

    r = random.Random(6)
    sets = {"en": ["the", "ing", "tion", "ous", "wh"], "de": ["sch", "ung", "ein", "cht", "ü"]}
    text = lambda g, n: " ".join("".join(r.choice(sets[g]) for _ in range(r.randint(1, 4))) for _ in range(n))
    shared = text("en", 60)
    rows = [(i, text(g, 90), g, "s", 1) for i in range(60) for g in [r.choice(sorted(sets))]]
    rows += [(100, rows[0][1], rows[0][2], "s", 1), (101, "12345 ---", None, "s", 1), (102, None, None, None, None), (103, text("en", 50) + " " + shared, "en", "s", 1), (104, text("en", 50) + " " + shared, "en", "s", 1), (105, text("en", 40) + " mail bob.x@mail.example.com now", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in c.STAGES:
        path = f"{tmp_path}/{uuid.uuid4().hex}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {x.doc_id: x for x in docs.collect()}
        assert name == "packed" or docs.columns == columns
    assert set(seen["language"]) == {*range(60), 100, 103, 104, 105}
    assert set(seen["near_copies"]) == {*range(60), 103, 104, 105}
    assert shared not in seen["repeated_passages"][104].text and shared in seen["repeated_passages"][103].text
    assert all(seen["repeated_passages"][i].text == seen["language"][i].text for i in range(60))
    assert "bob.x@" not in seen["personal_data"][105].text and "@" in seen["personal_data"][105].text
    assert set(seen["packed"]) == set(seen["near_copies"])
    run = c.run(spark, str(tmp_path))
    assert {x.doc_id for x in run.collect()} == set(seen["packed"])


def test_queries_are_registered():
    from lexquarry.llm import queries

    names = list(queries.queries())
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=names.index) and {f"op{i}" for i in range(1, 11)} == {n.split("_")[0] for n in names if n != "pipeline"} and "pipeline" in names
