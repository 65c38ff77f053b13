"""Replies of engines: JSON objects with translations by id, read as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import let

# What a reply looks like.
THINKING = r"(?s)<think>.*?</think>\s*"
ROWS = "array<struct<id:string,text:string>>"
SCHEMA = f"struct<translations:{ROWS}>"
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'  # possessive: a long text takes no stack
_PAIR = rf'"(?:id|text)"\s*:\s*{_STRING}'
ENTRY = rf"(?s)\{{\s*{_PAIR}\s*,\s*{_PAIR}\s*\}}"


def cleaned(reply: Column) -> Column:
    """A reply without what the engine thought aloud."""
    return F.regexp_replace(F.regexp_replace(reply, THINKING, ""), r"(?U)^\s+|\s+$", "")


def answers(reply: Column, ids: Column, salvage: bool = True) -> Column:
    """Array of (id, text), one for each of the ids asked for, in their order; text is null where the reply has none.

    A reply that isn't JSON as a whole has no answers or, with salvage, those of its entries that are whole: a reply that
    was cut keeps what came before the cut. Of several entries of an id the last counts; ids not asked for are left out;
    an empty text is none.
    """

    def read(text: Column) -> Column:
        whole = F.try_parse_json(text)
        strict = F.from_json(text, SCHEMA)["translations"]
        entries = F.transform(F.regexp_extract_all(text, F.lit(ENTRY), F.lit(0)), lambda e: F.from_json(e, "struct<id:string,text:string>")) if salvage else F.array().cast(ROWS)
        return F.coalesce(F.when(whole.isNotNull(), F.coalesce(strict, F.array().cast(ROWS))), entries, F.array().cast(ROWS))

    def chosen(rows: Column) -> Column:
        own = lambda i: F.filter(rows, lambda r: r["id"] == i)
        return F.transform(ids, lambda i: F.struct(i.alias("id"), F.nullif(F.try_element_at(own(i), F.lit(-1))["text"], F.lit("")).alias("text")))

    return let(let(cleaned(reply), read), chosen)


def unanswered(found: Column) -> Column:
    """The ids of answers() without a text."""
    return F.transform(F.filter(found, lambda a: a["text"].isNull()), lambda a: a["id"])
