"""Text functions as column expressions: normal forms, tokens, snippets, line cleaning."""

from __future__ import annotations

import difflib
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry import config

NONWORD_EDGES = r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$"
STRIP = r"^[\s\x1c-\x1f\x85\xa0]+|[\s\x1c-\x1f\x85\xa0]+$"
TOKEN_BREAK = r"[\s,\-_:\.;/]+"
PART_BREAK = r"[-/_.:]+"
PLAIN_WORD = r"[A-Za-zÁ-ÿ0-9-]{2,}"


def plain_form(text: str | None) -> str:
    """Compatibility decomposition without combining marks, in lower case."""
    return "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()


@lru_cache(1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """For translate(): characters with one-character forms, then those that vanish; and those that need more."""
    single, gone, several = {}, [], {}
    for c in map(chr, [*range(0x80, 0xAC00), *range(0xF900, 0x10000)]):
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if d != c:
            if len(d) == 1:
                single[c] = d
            elif d:
                several[c] = d
            else:
                gone.append(c)
    return "".join(single) + "".join(gone), "".join(single.values()), several


@lru_cache(1)
def several() -> str:
    """A pattern for characters whose normal form has several characters: ligatures, fractions, squared words, syllables."""
    places = sorted({*map(ord, _folding()[2]), *range(0xAC00, 0xD7A4), 0x1D15E, *range(0x1F100, 0x1F200)})
    runs = [[places[0], places[0]]]
    for p in places[1:]:
        if p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "[" + "".join(f"\\x{{{x:x}}}-\\x{{{y:x}}}" for x, y in runs) + "]"


@F.pandas_udf(T.StringType())
def _normal_udf(text: pd.Series) -> pd.Series:
    return text.map(plain_form)


def normal(text: Column) -> Column:
    """Lower case without accents, null as empty, inside the JVM: exact for texts that several() doesn't match.

    What it matches (rare outside Hangul and typographic ligatures) needs normal_exact().
    """
    out = F.coalesce(text, F.lit(""))
    source, target, spelled_out = _folding()
    ligatures = [c for c in ("ﬀ", "ﬁ", "ﬂ", "ﬃ", "ﬄ", "…", "½", "¼", "¾") if c in spelled_out]
    spelled = out
    for c in ligatures:
        spelled = F.replace(spelled, F.lit(c), F.lit(spelled_out[c]))
    out = F.when(out.rlike(f"[{''.join(ligatures)}]"), spelled).otherwise(out)
    # most words are plain: translate() works character by character
    return F.lower(F.when(out.rlike(r"[^\x00-\x7f]"), F.translate(out, source, target)).otherwise(out))


def normal_exact(text: Column) -> Column:
    """The same for every character, by way of an Arrow batch: for corpora where several() matches."""
    return _normal_udf(text)


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends (trim() knows spaces only)."""
    return F.regexp_replace(text, STRIP, "")


def trimmed_word(word: Column) -> Column:
    """Without characters at the ends that are no letters, digits or underscores."""
    return F.regexp_replace(word, NONWORD_EDGES, "")


def query_tokens(query: Column) -> Column:
    """A query's raw tokens of two characters or more."""
    return F.filter(F.split(stripped(F.coalesce(query, F.lit(""))), TOKEN_BREAK), lambda t: F.length(t) >= config.LEAST_TOKEN)


def word_parts(word: Column) -> Column:
    return F.split(word, PART_BREAK)


def plain_words(text: Column) -> Column:
    """Words of the fallback index: runs of two or more letters, digits and hyphens."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PLAIN_WORD), 0)


def digits_only(word: Column) -> Column:
    return F.translate(word, ".,", "")


def digit_runs(word: Column) -> Column:
    low, high = config.RUN
    return F.regexp_extract_all(word, F.lit(f"[0-9]{{{low},{high}}}"), 0)


def is_numeric(x: Column) -> Column:
    return x.rlike(r"^\p{N}+$")


def is_alphabetic(x: Column) -> Column:
    return x.rlike(r"^\p{L}+$")


def is_upper(x: Column) -> Column:
    return (x == F.upper(x)) & (x != F.lower(x))


def cased_like(token: Column, form: Column) -> Column:
    """form in capitals after a token in capitals, as it is after a capitalised one, else in lower case."""
    return F.when(is_upper(token), F.upper(form)).when(is_upper(F.substring(token, 1, 1)), form).otherwise(F.lower(form))


def snippet(text: Column, start: Column, end: Column, window: int = config.SNIPPET) -> Column:
    """What stands around text[start:end] (from 0), white space squeezed, with dots where it is cut."""
    low, high = F.greatest(start - window, F.lit(0)), F.least(end + window, F.length(text))
    body = stripped(F.regexp_replace(F.substring(text, low + 1, high - low), r"[\s\x1c-\x1f\x85\xa0]+", " "))
    return F.concat(F.when(low > 0, "...").otherwise(""), body, F.when(high < F.length(text), "...").otherwise(""))


def located(text: Column, word: Column) -> Column:
    """struct(matched, snippet): the first place of word in text whatever its case, else whatever its accents."""
    at = F.instr(F.lower(text), F.lower(word)) - 1
    folded = F.instr(normal(text), normal(word)) - 1
    empty = (F.coalesce(text, F.lit("")) == "") | (F.coalesce(word, F.lit("")) == "")
    matched = F.when(~empty & (at >= 0), F.substring(text, at + 1, F.length(word))).otherwise(F.coalesce(word, F.lit("")))
    place = F.when(at >= 0, at).otherwise(folded)
    return F.struct(matched.alias("matched"), F.when(empty | (place < 0), "").otherwise(snippet(text, place, place + F.length(word))).alias("snippet"))


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"\s{2,}", " ")


def without_noise(line: Column) -> Column:
    """A line of recognised text without runs of rules and borders."""
    return stripped(F.regexp_replace(stripped(line), r"[=|><_~]{2,}", " "))


def alphanumerics(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def kept_lines(text: Column) -> Column:
    """Lines that aren't blank, and have two letters or digits or are one character long; noise taken out."""
    lines = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"), lambda x: stripped(x) != ""), without_noise)
    return F.filter(lines, lambda x: ~((alphanumerics(x) < 2) & (F.length(x) > 1)))


def with_separators(line: Column) -> Column:
    """Words and what stands between them, in turn: joining gives the line again."""
    between = r"\s.,;:()\[\]{}\"'\-"
    return F.regexp_extract_all(line, F.lit(rf"[^{between}]+|[{between}]+"), 0)


def highlighted(text: Column, term: Column, opening: str = "<mark>", closing: str = "</mark>") -> Column:
    """text with every occurrence of term, whatever its case, between marks."""
    quoted = F.concat(F.lit(r"(?i)(\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    return F.when(F.coalesce(term, F.lit("")) == "", text).otherwise(F.regexp_replace(text, quoted, F.lit(f"{opening}$1{closing}")))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks over all characters (longest block first, then on both sides)."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def may_be_similar(a: Column, b: Column, ratio: float = config.FUZZY_RATIO) -> Column:
    """True for all pairs of that similarity: blocks in order are a common subsequence, which bounds the edits."""
    la, lb = F.length(a), F.length(b)
    most = F.floor((1 - ratio) * (la + lb) + 1e-9).cast("int")
    return (2 * F.least(la, lb) >= ratio * (la + lb)) & (F.levenshtein(a, b) <= most)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(?<=[^.])(\.[^.]*)$", 1))
