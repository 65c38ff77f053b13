"""The inline format <gN>…</gN>: reading, comparing, showing and putting back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TAG, OPENING = r"</?g(\d+)>", r"<g(\d+)>"


def strip_tags(text: Column) -> Column:
    """Most texts have none."""
    return F.when(text.contains("<"), F.regexp_replace(text, TAG, "")).otherwise(text)


def tag_ids(text: Column) -> Column:
    """Distinct ids, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(1)), lambda x: x.cast("int"))))


def openings(text: Column) -> Column:
    """The ids opened, sorted, as often as they are: equal arrays mean equal counts."""
    return F.array_sort(F.transform(F.regexp_extract_all(text, F.lit(OPENING), F.lit(1)), lambda x: x.cast("int")))


def is_well_formed(text: Column) -> Column:
    """Balanced and not nested. State: the open id, -1 for none, -2 for broken."""
    step = lambda at, tag: (
        F.when(at == -2, -2)
        .when(~tag.startswith("</"), F.when(at == -1, F.regexp_extract(tag, TAG, 1).cast("int")).otherwise(-2))
        .when(at == F.regexp_extract(tag, TAG, 1).cast("int"), -1)
        .otherwise(-2)
    )
    return F.aggregate(F.regexp_extract_all(text, F.lit(TAG), F.lit(0)), F.lit(-1), step) == -1


def spans(text: Column) -> Column:
    """Array of (tid, text), tid null outside tags; empty spans dropped. For well-formed text."""
    parts = F.split(F.regexp_replace(text, r"(?s)<g(\d+)>(.*?)</g\1>", "\x01$1\x02$2\x01"), "\x01")
    told = F.transform(
        parts,
        lambda p: F.when(p.contains("\x02"), F.struct(F.substring_index(p, "\x02", 1).cast("int").alias("tid"), F.substring_index(p, "\x02", -1).alias("text"))).otherwise(
            F.struct(F.lit(None).cast("int").alias("tid"), p.alias("text"))
        ),
    )
    return F.filter(told, lambda s: s["text"] != "")


def to_display(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<g(\d+)>", "[$1]"), r"</g(\d+)>", "[/$1]")


def from_display(text: Column, allowed: Column) -> Column:
    """[N] and [/N] back to tags for the ids of the array allowed."""
    back = lambda t, i: F.replace(F.replace(t, F.concat(F.lit("["), i, F.lit("]")), F.concat(F.lit("<g"), i, F.lit(">"))), F.concat(F.lit("[/"), i, F.lit("]")), F.concat(F.lit("</g"), i, F.lit(">")))
    return F.aggregate(F.transform(allowed, lambda i: i.cast("string")), text, back)


def retag(source: Column, output: Column, known: Column) -> Column:
    """output with source's tags around what its tagged spans must read there; known maps texts to that.

    Null if a span isn't known or isn't found, or the result isn't well formed.
    """
    tagged = F.filter(spans(source), lambda s: s["tid"].isNotNull())

    def step(at, s):
        name = F.trim(s["text"])
        target = F.coalesce(F.nullif(F.try_element_at(known, name), F.lit("")), F.nullif(F.try_element_at(known, F.lower(name)), F.lit("")))
        place = F.instr(at, target)
        found = target.isNotNull() & strip_tags(at).contains(target) & (place > 0)
        put = F.concat(F.substr(at, F.lit(1), place - 1), F.lit("<g"), s["tid"].cast("string"), F.lit(">"), target, F.lit("</g"), s["tid"].cast("string"), F.lit(">"), F.substr(at, place + F.length(target)))
        return F.when(found, put).when(target.isNotNull() & strip_tags(at).contains(target), at)

    out = F.aggregate(tagged, output.cast(StringType()), step)
    return F.when(is_well_formed(out), out)
