"""Batch search without an index: every document is read once, by one task, and leaves its hits or their number.

For a batch that is asked once this costs less than an index: texts are dealt out by document, and no word,
posting or hit is shuffled. Hits, their order and their places are those of search.search() over index.postings()
of the same pages. A word's keys and matches are told once and kept while a task runs.
"""

from __future__ import annotations

import difflib
import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry import config
from lexquarry.functions import text as tx
from lexquarry.operators import search as indexed
from lexquarry.sources.text import sources

WORDS_KEPT, ROWS = 100_000, 4096
SPACE = re.compile(r"[ \t\n\x0b\f\r]")
WIDE_SPACE = re.compile(r"[ \t\n\x0b\f\r\x1c-\x1f\x85\xa0]+")
EDGES, PARTS = re.compile(r"^\W+|\W+$"), re.compile(tx.PART_BREAK)
RUNS = re.compile("[0-9]{%d,%d}" % config.RUN)
KINDS = ("exacto", "prefijo", "subcadena")


@functools.lru_cache(1)
def _table() -> dict[int, str]:
    source, target, several = tx._folding()
    own = {ord(c): several[c] for c in ("ﬀ", "ﬁ", "ﬂ", "ﬃ", "ﬄ", "…", "½", "¼", "¾") if c in several}
    whole = {k: "".join(target[source.index(c)] if c in source[: len(target)] else c for c in v) for k, v in own.items()}
    return dict(zip(map(ord, source), target)) | dict.fromkeys(map(ord, source[len(target) :]), "") | whole


def normal(text: str) -> str:
    """As functions.text.normal()."""
    return (text if text.isascii() else text.translate(_table())).lower()


@functools.lru_cache(WORDS_KEPT)
def keys(word: str) -> tuple[str, ...]:
    """Terms of a word in the order of index.keys()."""
    base = normal(word)
    if len(base) < config.LEAST_TERM:
        return ()
    if base.isalpha() or base.isalnum() and not RUNS.search(base):
        return (base,)
    clean, out = EDGES.sub("", base), [base]
    if clean != base and len(clean) >= config.LEAST_TERM:
        out.append(clean)
    parts = PARTS.split(clean)
    if len(parts) > 1:
        out += [t for t in parts if t != clean and len(t) >= config.LEAST_TERM]
    number = clean.replace(".", "").replace(",", "")
    if number != clean and len(number) >= config.LEAST_NUMBER and number.isnumeric() and not any(map(str.isalpha, number)):
        out.append(number)
    return (*out, *(t for t in RUNS.findall(clean) if t not in (clean, number)))


def located(text: str, lower: str, word: str) -> tuple[str, str]:
    """As functions.text.located(): what was found first, and what stands around it. lower: of the text."""
    at = lower.find(word.lower())
    matched, place = (text[at : at + len(word)] or word, at) if at >= 0 else (word, normal(text).find(normal(word)))
    if place < 0:
        return matched, ""
    low, high = max(place - config.SNIPPET, 0), min(place + len(word) + config.SNIPPET, len(text))
    body = WIDE_SPACE.sub(" ", text[low : max(low, high)]).strip(" ")
    return matched, ("..." if low > 0 else "") + body + ("..." if high < len(text) else "")


class Text:
    """One text of a page: its words, and where they are found in it."""

    def __init__(self, page: int, src: str, image_id: str | None, label: str, text: str):
        self.page, self.src, self.image_id, self.label, self.text = page, src, image_id, label, text
        self.words, self._found = SPACE.split(text), {}

    @functools.cached_property
    def lower(self) -> str:
        return self.text.lower()

    @functools.cached_property
    def normal(self) -> str:
        return normal(self.text)

    @functools.cached_property
    def starts(self) -> list[int]:
        return [n + i for i, n in enumerate(accumulate(map(len, self.words), initial=0))]

    def found(self, word: str) -> tuple[str, str]:
        if word not in self._found:
            self._found[word] = located(self.text, self.lower, word)
        return self._found[word]


class Matches(dict):
    """word: its best match for each query, (query, stage, at, key, place among the keys)."""

    def __init__(self, asked: Asked):
        self.asked = asked

    def __missing__(self, word: str) -> tuple:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = out = self.asked.matches(word) if word else ()
        return out


@dataclass
class Asked:
    """A batch: (raw, tokens, terms) of each query, queries by number."""

    queries: list[tuple[int, str, list[str], list[str]]]
    fuzzy: bool

    def __post_init__(self):
        self.by_term: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.by_first: dict[str, set[str]] = defaultdict(set)
        self.wanted: dict[str, list[tuple[int, int, str]]] = defaultdict(list)
        for q, raw, _, terms in self.queries:
            for at, t in enumerate(terms):
                self.by_term[t].append((q, at))
                if self.fuzzy and len(t) >= config.FUZZY_LENGTH:
                    self.by_first[t[0]].add(t)
                    self.wanted[t].append((q, at, raw))
        self.by_term = dict(self.by_term)
        self.phrases = [(q, raw, tokens, terms) for q, raw, tokens, terms in self.queries if len(terms) > 1]
        self.by_size: dict[int, set[str]] = defaultdict(set)
        for t in self.by_term:
            if len(t) >= config.LEAST_TERM:
                self.by_size[len(t)].add(t)
        self.sizes = sorted(self.by_size)
        # all keys but numbers stand in the word as it is, so a word without any term has no match; with many terms the search for one costs more than it saves
        few = 0 < len(self.by_term) <= 32 and not any(t.isnumeric() for t in self.by_term)
        self.some = re.compile("|".join(map(re.escape, self.by_term))) if few else None
        self.near_kept: dict[str, list[tuple[str, float]]] = {}

    def matches(self, word: str) -> tuple:
        if self.some is not None and self.some.search(normal(word)) is None:
            return ()
        best: dict[int, tuple] = {}

        def put(term: str, stage: int, key: str, nth: int) -> None:
            for q, at in self.by_term[term]:
                if q not in best or (stage, at, key, nth) < best[q]:
                    best[q] = (stage, at, key, nth)

        for nth, key in enumerate(keys(word)):
            bare = key if key.isalnum() else EDGES.sub("", key)
            if key in self.by_term:
                put(key, 0, key, nth)
            for n in self.sizes:
                if n >= len(bare):
                    break
                if bare[:n] in self.by_term:
                    put(bare[:n], 1, key, nth)
                if n >= config.LEAST_SUBSTRING:
                    for t in self.by_size[n].intersection([bare[i : i + n] for i in range(1, len(bare) - n + 1)]):
                        if not bare.startswith(t):
                            put(t, 2, key, nth)
        return tuple((q, *m) for q, m in best.items())

    def near(self, key: str) -> list[tuple[str, float]]:
        """Terms like the key, with their similarity."""
        out = self.near_kept.get(key)
        if out is None:
            if len(self.near_kept) >= WORDS_KEPT:
                self.near_kept.clear()
            out, like = [], None
            for t in self.by_first.get(key[0], ()):
                if t != key and 2 * min(len(t), len(key)) >= config.FUZZY_RATIO * (len(t) + len(key)):
                    if like is None:
                        like = difflib.SequenceMatcher(None, t, key)
                    like.set_seq1(t)
                    if like.quick_ratio() >= config.FUZZY_RATIO and (r := like.ratio()) >= config.FUZZY_RATIO:
                        out.append((t, r))
            self.near_kept[key] = out
        return out

    def similar(self, texts: list[Text], told: Matches) -> list[tuple]:
        """Hits of the fuzzy stage in a document: (query, at, key, raw, ratio, text, number of the word, place among its keys)."""
        own = {w for t in texts for w in t.words if w}
        own = {k for w in own for k in keys(w)}
        near: dict[str, list[tuple[float, str]]] = defaultdict(list)
        for k in own:
            for t, r in self.near(k):
                if t not in own:
                    near[t].append((-r, k))
        if not near:
            return []
        chosen = {t: sorted(ks)[: config.FUZZY_CANDIDATES] for t, ks in near.items()}
        needed, posted = {k for ks in chosen.values() for _, k in ks}, defaultdict(list)
        begun: set[tuple[int, str]] = set()
        queries = defaultdict(list)
        for t in chosen:
            for q in {q for q, _, _ in self.wanted[t]}:
                queries[q].append(t)
        for x in texts:
            some = set(x.words) - {""}
            for w in some:
                for m in told[w]:
                    for t in queries.get(m[0], ()):
                        if (m[0], t) not in begun and x.found(w)[0].lower().startswith(t):
                            begun.add((m[0], t))
            some = {w for w in some if not needed.isdisjoint(keys(w))}
            for nr, w in enumerate(x.words) if some else ():
                for nth, k in enumerate(keys(w)) if w in some else ():
                    if k in needed and len(posted[k]) < config.FUZZY_POSTINGS:
                        posted[k].append((x, nr, nth))
        out = [
            (q, at, k, raw, -r, x, nr, nth)
            for t, ks in chosen.items() for q, at, raw in self.wanted[t] if (q, t) not in begun for r, k in ks for x, nr, nth in posted[k]
        ]
        # what an earlier token found may begin with a later one
        found = defaultdict(set)
        for q, at, _, _, _, x, nr, _ in out:
            found[q].add((at, x.found(x.words[nr])[0].lower()))
        term = {(q, at): t for t in chosen for q, at, _ in self.wanted[t]}
        gone = {(q, at) for (q, at), t in term.items() if any(a < at and m.startswith(t) for a, m in found[q])}
        return [h for h in out if h[:2] not in gone]

    def hits(self, texts: list[Text], told: Matches) -> Iterator[tuple]:
        """Hits of a document, page by page: without repeats, with their position."""
        fuzzy = defaultdict(list)
        for h in self.similar(texts, told) if self.fuzzy else ():
            fuzzy[h[5].page].append(h)
        positions = Counter()
        for page, group in groupby(texts, lambda t: t.page):
            own, rows = list(group), []  # rows: query, what decides between alike hits, rank, text, number of its word, what it says
            for x in own:
                for nr, ms in [(nr, ms) for nr, ms in enumerate(map(told.__getitem__, x.words)) if ms]:
                    w = x.words[nr]
                    place = x.found(w)
                    for q, stage, at, key, nth in ms:
                        rows.append((q, stage, x.src, (stage, at, key, x.image_id or "", nr * 64 + nth), x, nr, w, KINDS[stage], place))
                for q, raw, tokens, terms in self.phrases:
                    if all(t in x.normal for t in terms):
                        rows.append((q, config.STAGES["frase"], x.src, (4, 0, "", x.image_id or "", 0), x, None, raw, "frase", x.found(tokens[0])))
            for q, at, key, raw, ratio, x, nr, nth in fuzzy.get(page, ()):
                rows.append((q, config.STAGES["difuso"], x.src, (3, at, key, x.image_id or "", nr * 64 + nth), x, nr, raw, f"difuso ({int(ratio * 100 + 1e-9)}%)", x.found(x.words[nr])))
            if page in fuzzy or len({x.src for x in own}) < len(own):  # else no two have a place in common
                one: dict[tuple, tuple] = {}
                for r in sorted(rows, key=lambda r: r[3]):
                    one.setdefault((r[0], r[2], r[8][0], None if r[5] is None else r[4].starts[r[5]], r[8][1][: config.SNIPPET_KEY]), r)
                rows = list(one.values())
            rows.sort(key=lambda r: r[:4])
            y0, y1 = float(page), float(page + 1)
            for q, _, src, order, x, nr, searched, kind, (matched, snippet) in rows:
                positions[q] += 1
                if nr is None:
                    yield q, page, src, x.label, searched, kind, snippet, matched, x.image_id, None, None, None, None, positions[q]
                else:
                    x0 = x.starts[nr]
                    yield q, page, src, x.label, searched, kind, snippet, matched, x.image_id, float(x0), y0, float(x0 + len(x.words[nr])), y1, positions[q]

    def count(self, texts: list[Text], told: Matches, total: Counter, pages: Counter) -> None:
        """Adds the hits of a document, and the pages they are on, to total and pages. The same as counting hits()."""
        if len({(t.page, t.src) for t in texts}) < len(texts):
            met = defaultdict(set)  # texts of one source may repeat each other's hits
            for h in self.hits(texts, told):
                total[h[0]] += 1
                met[h[1]].add(h[0])
            for own in met.values():
                pages.update(own)
            return
        met = defaultdict(set)
        for x in texts:
            many, at_page = Counter(x.words), met[x.page]
            for w, n in many.items():
                for m in told[w]:
                    total[m[0]] += n
                    at_page.add(m[0])
            for q, _, _, terms in self.phrases:
                if all(t in x.normal for t in terms):
                    total[q] += 1
                    at_page.add(q)
        seen = set()
        for q, _, _, _, _, x, nr, _ in self.similar(texts, told) if self.fuzzy else ():
            if (q, id(x), nr) not in seen and all(m[0] != q for m in told[x.words[nr]]):
                seen.add((q, id(x), nr))
                total[q] += 1
                met[x.page].add(q)
        for own in met.values():
            pages.update(own)


def _documents(batches) -> Iterator[tuple]:
    """(doc_id, its texts in order of page, source and image), documents in a row."""
    rows = (r for b in batches for at in range(0, b.num_rows, 256) for r in zip(*(c.to_pylist() for c in b.slice(at, 256).columns)))
    for doc_id, own in groupby(rows, lambda r: r[0]):
        yield doc_id, [Text(*r[1:]) for r in own]


def _dealt(pages: DataFrame) -> DataFrame:
    texts = sources(pages).select("doc_id", "page", "src", "image_id", "label", "text")
    return texts.repartition("doc_id").sortWithinPartitions("doc_id", "page", "src", "image_id")


def _batches(queries: DataFrame, fuzzy: bool) -> Iterator[tuple[list, Asked]]:
    """Ids and queries in blocks of as many as may go to every executor; queries of one id stay together."""
    rows = sorted(((r["query_id"], r["raw"], r["tokens"], r["terms"]) for r in indexed.parsed(queries).collect()), key=lambda r: str(r[0]))
    ids = list(dict.fromkeys(r[0] for r in rows))
    for at in range(0, max(1, len(ids)), max(1, config.LIMITS.broadcast_queries)):
        own = {k: n for n, k in enumerate(ids[at : at + max(1, config.LIMITS.broadcast_queries)])}
        yield list(own), Asked([(own[q], raw, tokens, terms) for q, raw, tokens, terms in rows if q in own], fuzzy)


def search(pages: DataFrame, queries: DataFrame, with_fuzzy: bool = True) -> DataFrame:
    """All hits of all queries (query_id, query) in all documents, as search.search() gives them."""
    texts, kinds = _dealt(pages), {"page": "int", "position": "int"} | dict.fromkeys(("x0", "y0", "x1", "y1"), "double")
    named = {c: T._parse_datatype_string(kinds.get(c, "string")) for c in (*indexed.HIT, "position")}
    named |= {"query_id": queries.schema["query_id"].dataType, "doc_id": texts.schema["doc_id"].dataType}
    schema = T.StructType([T.StructField(c, t) for c, t in named.items()])
    out = None
    for ids, asked in _batches(queries, with_fuzzy):

        def run(batches, ids=ids, asked=asked):
            from pyspark.sql.pandas.types import to_arrow_schema

            told, rows, arrow = Matches(asked), [], to_arrow_schema(schema)
            as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
            for doc_id, own in _documents(batches):
                for q, *h in asked.hits(own, told):
                    rows.append((ids[q], doc_id, *h))
                    if len(rows) >= ROWS:
                        yield as_batch(rows)
                        rows = []
            if rows:
                yield as_batch(rows)

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def counts(pages: DataFrame, queries: DataFrame, with_fuzzy: bool = True) -> DataFrame:
    """query_id, total_matches, matched_pages: hits of search(), and the (document, page) pairs they are on, without writing hits down."""
    texts, out = _dealt(pages), None
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("total_matches", T.LongType()), T.StructField("matched_pages", T.LongType())])
    for ids, asked in _batches(queries, with_fuzzy):

        def run(batches, ids=ids, asked=asked):
            from pyspark.sql.pandas.types import to_arrow_schema

            told, total, on = Matches(asked), Counter(), Counter()
            for _, own in _documents(batches):
                asked.count(own, told, total, on)
            found, arrow = sorted(total), to_arrow_schema(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([ids[q] for q in found], [total[q] for q in found], [on[q] for q in found]), arrow)], schema=arrow)

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("query_id").agg(F.sum("total_matches").alias("total_matches"), F.sum("matched_pages").alias("matched_pages"))


def places(pages: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, page, x0, x1: where on a page search() without its fuzzy stage finds words; repeats of a place may be told.

    That depends on each text alone, so texts are read where they lie and none is shuffled or sorted.
    """
    texts, out = sources(pages).select("doc_id", "page", "text"), None
    schema = T.StructType([queries.schema["query_id"], texts.schema["doc_id"], T.StructField("page", T.IntegerType()), T.StructField("x0", T.DoubleType()), T.StructField("x1", T.DoubleType())])
    for ids, asked in _batches(queries, False):

        def run(batches, ids=ids, asked=asked):
            from pyspark.sql.pandas.types import to_arrow_schema

            told, rows, arrow = Matches(asked), [], to_arrow_schema(schema)
            as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    for doc_id, page, text in zip(*(c.to_pylist() for c in b.slice(at, 256).columns)):
                        x0 = 0
                        for w in SPACE.split(text):
                            x1 = x0 + len(w)
                            rows += [(ids[m[0]], doc_id, page, float(x0), float(x1)) for m in told[w]]
                            x0 = x1 + 1
                    if len(rows) >= ROWS:
                        yield as_batch(rows)
                        rows = []
            if rows:
                yield as_batch(rows)

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def exported(pages: DataFrame) -> DataFrame:
    """doc_id, term, n, first_page: how many postings the index has of each term of a document, and on which page the first is."""
    texts = _dealt(pages)
    schema = T.StructType([T.StructField("doc_id", texts.schema["doc_id"].dataType), T.StructField("term", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("first_page", T.IntegerType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, held = to_arrow_schema(schema), ([], [], [], [])
        for doc_id, own in _documents(batches):
            n: dict[str, int] = {}
            first: dict[str, int] = {}  # of the same terms in the same order, as pages are
            for x in own:
                for w, many in Counter(x.words).items():
                    for k in keys(w):
                        if k in n:
                            n[k] += many
                        else:
                            n[k], first[k] = many, x.page
            for to, values in zip(held, ([doc_id] * len(n), n, n.values(), first.values())):
                to.extend(values)
            if len(held[0]) >= 4 * ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, arrow)], schema=arrow)
                held = ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, arrow)], schema=arrow)

    return texts.mapInArrow(run, schema)
