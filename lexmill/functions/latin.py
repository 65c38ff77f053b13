"""A pair of texts measured in one pass, where both are Latin: what each pattern of functions.text, tokens and
operators.checks would read them for again.

Latin is what Latin-1 has, and dashes, quotation marks and the euro sign besides, of which no pattern here takes any for
a letter, a digit or white space. Other texts get null, and the patterns tell of them.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

SPACE = "\t\n\x0b\x0c\r \x85\xa0"
OTHER = re.compile("[^\x00-\xff‐-‧€]")
NO_LETTER = bytes(i for i in range(256) if not chr(i).isalpha())
END = re.compile(r"[.!?](?=[ \t\n\x0b\f\r]|$)")
WORD = re.compile("[a-z]+")
CONTROL = re.compile("[\x1c-\x1f]")  # white space to Python only
MEASURES = {"size": pa.int32(), "target_size": pa.int32(), "bare": pa.bool_(), "cut": pa.bool_(), "counts": pa.bool_(), "fewer": pa.bool_(), "left": pa.list_(pa.string())}


def letters(text: str) -> int | None:
    """How many letters a text has, null if it isn't Latin."""
    try:
        return len(text.encode("latin-1").translate(None, NO_LETTER))
    except UnicodeEncodeError:
        return None if OTHER.search(text) else len(text.encode("latin-1", "ignore").translate(None, NO_LETTER))


def without(text: str, tokens: list[str], instead: str) -> str:
    for t in sorted(tokens, key=len, reverse=True):
        if t:
            text = text.replace(t, instead)
    return text


def sentences(text: str) -> int:
    t = text.strip(SPACE)
    return 0 if not t else len(END.findall(t)) + (t[-1] not in ".!?")


def same(a: str, b: str) -> bool | None:
    """Whether two texts read alike in any case and spacing; null where it takes the pattern for white space to tell."""
    if a == b:
        return True
    alike = " ".join(a.split()).lower().replace("ß", "ss") == " ".join(b.split()).lower().replace("ß", "ss")
    return None if alike and (CONTROL.search(a) or CONTROL.search(b)) else alike


def dangles(text: str, words: tuple[str, ...]) -> bool:
    """Whether a text ends in one of the words."""
    low = text[-16:].lower()
    if not low.endswith(words):
        return False
    before = (low[len(low) - len(w) - 1 : len(low) - len(w)] for w in words if low.endswith(w))
    return any(not (c.isalpha() or c.isdecimal() or c == "_") for c in before)


def stops(plain: str, target: str, words: tuple[str, ...], closing: str) -> bool:
    """Whether a translation ends mid-sentence."""
    source, full = plain.rstrip(SPACE)[-1:], target.rstrip(SPACE)
    if words and dangles(full, words) and not dangles(plain.rstrip(SPACE), words):
        return True
    if not source or source not in ".!?":
        return False
    end = full.rstrip(closing)[-1:]
    return not end or end not in ".!?"


def measures(words: tuple[str, ...], closing: str, left_of: frozenset[str], rated: int):
    """A function of columns (plain, target, protected, rest) to a struct of MEASURES, null where a text isn't Latin. target
    may be null; rest is the translation without identifiers and terms that stay, null where there are no such terms; words are
    what no sentence ends in, left_of the words of the source language, rated from how many letters sentences count."""

    none = (None,) * len(MEASURES)

    def told(plain, target, protected, rest):
        if plain is None or protected is None or None in protected:
            return none
        size = letters(without(plain, protected, "") if protected else plain)
        if size is None or (protected and letters(plain) is None):
            return none
        if target is None:
            return size, None, True, None, False, None, []
        n = letters(without(target, protected, "") if protected else target)
        if n is None or (protected and letters(target) is None):
            return none
        counts = bool(target.strip(SPACE))
        bare = same(target, plain) if counts else True
        if bare is None:
            return none
        cut, fewer, left = stops(plain, target, words, closing), None, []
        if not bare and not cut and size >= rated:
            said = sentences(plain)
            fewer = said >= 2 and sentences(target) < said
        if not bare and left_of:
            found = [w for w in WORD.findall((without(target, protected, " ") if rest is None else rest).lower()) if w in left_of]
            left = list(dict.fromkeys(found)) if len(found) >= 2 else []
        return size, n, bare, cut, counts, fewer, left

    @F.arrow_udf("struct<size:int,target_size:int,bare:boolean,cut:boolean,counts:boolean,fewer:boolean,left:array<string>>")
    def measured(plain: pa.Array, target: pa.Array, protected: pa.Array, rest: pa.Array) -> pa.Array:
        rows = [told(*row) for row in zip(*(c.to_pylist() for c in (plain, target, protected, rest)))]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(MEASURES.values())]
        return pa.StructArray.from_arrays(columns, list(MEASURES), mask=pa.array([r[0] is None for r in rows], pa.bool_()))

    return measured


SHED = " .。:：;；,，、!！?？"  # what a text that is compared with others may end in
UNSURE = re.compile("[꜠-ꟿ\U00010000-\U0010ffff]")  # letters of which Unicode's versions have other small ones


@F.arrow_udf(IntegerType())
def repeat_hash(texts: pa.Array) -> pa.Array:
    """Equal for texts of one text.repeat_key() with Latin letters in small ones; of others seldom. Null for null."""

    def told(t):
        if t is None:
            return None
        if not t.isascii():
            t = UNSURE.sub("", t)
        low = " ".join(t.split()).rstrip(SHED).lower().replace("ß", "ss").replace("ς", "σ")
        return zlib.crc32(low.encode("utf-8", "surrogatepass")) - (1 << 31)

    return pa.array([told(t) for t in texts.to_pylist()], pa.int32())
