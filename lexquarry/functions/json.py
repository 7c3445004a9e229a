"""JSON that models return: salvage, typed answers, boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexquarry import config

ANSWER = "answer string, unit string, page int, evidence string, confidence string"
FENCE = "```"


def unfenced(raw: Column) -> Column:
    """Without the fence of a code block: its first line and what follows its last fence."""
    text = F.regexp_replace(raw, r"^\s+|\s+$", "")
    body = F.regexp_replace(F.regexp_replace(text, r"^[^\n]*\n", ""), rf"(?s){FENCE}(?!.*{FENCE}).*$", "")
    return F.when(text.startswith(FENCE) & F.contains(text, F.lit("\n")), body).otherwise(text)


def braces(raw: Column) -> Column:
    """From the first opening brace to the last closing one."""
    return F.regexp_extract(raw, r"(?s)\{.*\}", 0)


def salvaged(raw: Column) -> Column:
    """The first of these that is an object: the whole, what the fence holds, what the braces hold; else null.

    An array or a bare value isn't an answer and counts as null as well.
    """
    tries = [raw, unfenced(raw), braces(unfenced(raw))]
    whole = lambda t: F.when(t.rlike(r"(?s)^\s*\{.*\}\s*$") & F.try_parse_json(t).isNotNull(), t)
    return F.coalesce(*map(whole, tries))


def entries(raw: Column) -> Column:
    """map<string,string> of the salvaged object's fields."""
    return F.from_json(salvaged(raw), "map<string,string>")


def guarded(raw: Column) -> Column:
    """struct(answer, unit, page, evidence, confidence): no confidence without an answer."""
    r = F.from_json(salvaged(raw), ANSWER)
    sure = F.when(r["answer"].isNull(), F.lit(0.0)).otherwise(F.coalesce(F.round(r["confidence"].try_cast("double"), 3), F.lit(0.0)))
    return F.struct(r["answer"].alias("answer"), r["unit"].alias("unit"), r["page"].alias("page"), r["evidence"].alias("evidence"), sure.alias("confidence"))


def boxes(raw: Column) -> Column:
    """Rectangles of a JSON list, those of four numbers; none where it can't be read."""
    return F.coalesce(F.filter(F.from_json(raw, "array<array<double>>"), lambda b: (F.size(b) == 4) & F.forall(b, lambda x: x.isNotNull())), F.array().cast("array<array<double>>"))


def found(value: Column) -> Column:
    """Whether an extracted value is one."""
    return F.coalesce((value != "") & (value != config.NOT_FOUND) & ~F.contains(value, F.lit("Error")), F.lit(False))
