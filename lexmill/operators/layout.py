"""Text in boxes: filling lines over a table of character widths, and the scale at which a text fits.

Widths are plain data: a table (font, character, width), widths in shares of the font's size. A character that a font has
no row for is half as wide as it is high, in East Asian languages as wide.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from uuid import uuid4

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.languages import EAST_ASIAN, SCRIPT

# Fixed values.
LINE_FACTOR, TOLERANCE, STEP, LEAST_WIDTH = 1.2, 2.0, 0.05, 0.3
PIECE = re.compile(r"[A-Za-z0-9À-ɏ\-./:@_%°±+#()]+\s*|\s+|.", re.S)
SPACED = re.compile(r"\S+\s*|\s+")
AT_SPACES = ("my",)  # languages whose lines end at blanks only
OTHER_WIDTH = {True: 1.0, False: 0.5}  # East Asian or not
MOST_WIDTHS = 1_000_000  # rows of a table of widths; it goes to every task

SPACING = "struct<lines:boolean,value:double>"
PARAGRAPHS = f"array<struct<text:string,size:double,margin:double,before:{SPACING},after:{SPACING},line:{SPACING}>>"
FIT = "needed double, height double, scale double, overflow boolean, grows boolean, inherited boolean"


class Measure:
    """Widths of pieces of text in one language: words in its own script in one font, all else in the other."""

    def __init__(self, rows: list[tuple[str, str, float]], lang: str, latin: str, native: str):
        self.fonts: dict[str, dict[str, float]] = {latin: {}, native: {}}
        for font, character, width in rows:
            if font in self.fonts:
                self.fonts[font][character] = width
        self.latin, self.native, self.other = self.fonts[latin], self.fonts[native], OTHER_WIDTH[lang in EAST_ASIAN]
        self.script = None if lang == "en" else re.compile(SCRIPT[lang])
        self.pieces = SPACED if lang in AT_SPACES else PIECE
        self.width = lru_cache(100_000)(self._width)

    def _width(self, piece: str) -> float:
        own = self.script is not None and not piece.isascii() and self.script.search(piece)
        font = self.native if own else self.latin
        return sum(font.get(c, self.other) for c in piece)


def filled(text: str, size: float, width: float, measure: Measure, wrap: bool = True) -> tuple[int, float]:
    """(lines, width of the widest): pieces go on a line as long as they fit; one that is wider than a line is broken."""
    count, widest = 0, 0.0
    for hard in text.split("\n"):
        count, at = count + 1, 0.0
        for piece in measure.pieces.findall(hard):
            wide = measure.width(piece) * size
            if wrap and 0 < at and at + wide > width:
                count, widest, at = count + 1, max(widest, at), measure.width(piece.lstrip()) * size
            else:
                at += wide
            if wrap and 0 < width < at:
                whole = int(at // width)
                count, at = count + whole, at - whole * width
        widest = max(widest, at)
    return count, widest


def _height(box: dict, measure: Measure, scale: float, exact: Callable[[float], float] = float) -> float:
    """How high a box's text is with its sizes scaled."""
    total, last = 0.0, len(box["paragraphs"]) - 1
    gap = lambda s, line: s["value"] * line if s["lines"] else s["value"]
    for i, p in enumerate(box["paragraphs"]):
        size = exact(p["size"]) * scale
        n, widest = filled(p["text"] or "", size, max(box["width"] - p["margin"], box["width"] * LEAST_WIDTH), measure, box["wrap"])
        total += n * gap(p["line"], size * LINE_FACTOR)
        total += gap(p["before"], size * LINE_FACTOR) if i else 0.0
        total += gap(p["after"], size * LINE_FACTOR) if i < last else 0.0
        if not box["wrap"] and widest > box["width"]:
            total = max(total, box["height"] * widest / box["width"])
    return total


def fit(box: dict, measure: Measure, least: float) -> tuple:
    """FIT of one box: what its text needs, the largest of the scales by steps that fits (least, if none does), and what
    comes of it. A box that grows keeps its sizes; a text that was too high before, up to allowed, isn't made to fit."""
    needed, high = _height(box, measure, 1.0), box["height"]
    limit = max(high, box["allowed"] or 0.0) + TOLERANCE
    if box["grows"]:
        return needed, high, 1.0, False, needed > high + TOLERANCE, False
    if needed <= limit:
        return needed, high, 1.0, False, False, needed > high + TOLERANCE
    scale = 1.0
    while scale - STEP >= least - 1e-9:
        scale = round(scale - STEP, 2)
        if _height(box, measure, scale) <= limit:
            break
    after = _height(box, measure, 1.0, lambda size: int(round(size * scale * 100)) / 100)
    return needed, high, scale, after > limit, False, high + TOLERANCE < after <= limit


_held: dict[str, Measure] = {}


def _measure(name: str, sent: Broadcast, *how) -> Measure:
    if name not in _held:
        _held.clear()
        _held[name] = Measure(sent.value, *how)
    return _held[name]


def _sent(widths: DataFrame) -> tuple[str, Broadcast]:
    rows = widths.select("font", "character", "width").limit(MOST_WIDTHS + 1).collect()
    if len(rows) > MOST_WIDTHS:
        raise ValueError(f"a table of widths has {MOST_WIDTHS} rows at most")
    return uuid4().hex, widths.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])


def line_count(text: Column, size: Column, width: Column, widths: DataFrame, lang: str, latin: str = "latin", native: str = "native", wrap: bool = True) -> Column:
    """Struct (lines, widest) of a text filled into lines of a width."""
    name, sent = _sent(widths)
    kind = pa.struct([("lines", pa.int32()), ("widest", pa.float64())])

    @F.arrow_udf("lines int, widest double")
    def count(texts: pa.Array, sizes: pa.Array, limits: pa.Array) -> pa.Array:
        m = _measure(name, sent, lang, latin, native)
        rows = zip(texts.to_pylist(), sizes.to_pylist(), limits.to_pylist())
        return pa.array([dict(zip(("lines", "widest"), filled(t or "", s, w, m, wrap))) for t, s, w in rows], kind)

    return count(text, size.cast("double"), width.cast("double"))


def fitted(boxes: DataFrame, widths: DataFrame, lang: str, least: float = 0.8, latin: str = "latin", native: str = "native") -> DataFrame:
    """boxes (paragraphs as of PARAGRAPHS, width, height, wrap, grows, allowed) with fit, a struct as of FIT."""
    name, sent = _sent(widths)
    fields = [x.split() for x in FIT.split(", ")]
    kind = pa.struct([(n, pa.bool_() if t == "boolean" else pa.float64()) for n, t in fields])

    @F.arrow_udf(FIT)
    def each(rows: pa.Array) -> pa.Array:
        m = _measure(name, sent, lang, latin, native)
        return pa.array([dict(zip((n for n, _ in fields), fit(b, m, least))) for b in rows.to_pylist()], kind)

    box = F.struct(F.col("paragraphs").cast(PARAGRAPHS).alias("paragraphs"), *(F.col(c).cast(t).alias(c) for c, t in (("width", "double"), ("height", "double"), ("wrap", "boolean"), ("grows", "boolean"), ("allowed", "double"))))
    return boxes.withColumn("fit", each(box))
