"""Fill-in-middle by run-length class encoding.

A text's units are runs of letters A-Z, a-z and single other characters. A task stores a text as its maximal runs of
either class: where each starts and how many units lie before it (a run of letters is one unit, any other run has one a
character). A cut after so many units is then a binary search for the run that holds it, and its place is that run's
start plus the units left over; no list of units is made. Cutting and joining the text is Spark's own work.

Defined results: a null text counts as empty, an empty one is plain; a null doc_id counts as the empty string in the hash;
repeated rows come out alike, one for each; two equal cuts give an empty middle; an empty table gives an empty result;
extra columns of any name are kept by rewritten() and ignored by transformed(). Texts are read a MB at a time, and the
runs take nine bytes each, so a text of n bytes needs at most 9 n more, three on ordinary prose.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, quoted, text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
REWRITTEN, SPM = 90, 20  # per cent of texts, and of these
_STEP = 1 << 20
_OTHER, _LETTER, _INSIDE = 0, 1, 2
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = _LETTER
_CLASS[0x80:0xC0] = _INSIDE  # bytes that go on with a character


class Runs:
    """A text's runs: start (characters before each), before (units before each), both with the totals at their end."""

    def __init__(self, text: bytes):
        buf, chars, last = np.frombuffer(text, np.uint8), 0, _INSIDE
        starts, kinds = [], []
        for at in range(0, len(buf), _STEP):
            kind = _CLASS[buf[at : at + _STEP]]
            kind = kind[kind != _INSIDE]
            turn = np.flatnonzero(kind != np.concatenate([[last], kind[:-1]])) if len(kind) else np.zeros(0, np.int64)
            starts.append((chars + turn).astype(np.uint32))
            kinds.append(kind[turn])
            chars, last = chars + len(kind), kind[-1] if len(kind) else last
        self.start = np.append(np.concatenate([np.zeros(0, np.uint32), *starts]), np.uint32(chars))
        letters = np.concatenate([np.zeros(0, np.uint8), *kinds]) == _LETTER
        units = np.where(letters, np.uint32(1), np.diff(self.start))
        self.before = np.append(np.uint32(0), np.cumsum(units, dtype=np.uint32))

    @property
    def n(self) -> int:
        return int(self.before[-1])

    def place(self, units: int) -> int:
        """Characters before the cut after so many units."""
        run = np.searchsorted(self.before, np.uint32(units), "right") - 1
        return int(self.start[run]) + units - int(self.before[run])


def _cuts(texts: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
    out = []
    for text, a, b in zip(texts.cast(pa.binary()), one.to_pylist(), other.to_pylist()):
        runs = Runs(text.as_py())
        a, b = sorted((a % (runs.n + 1), b % (runs.n + 1)))
        out.append((runs.n, runs.place(a), runs.place(b)))
    n, first, second = zip(*out) if out else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, first, second)], ["n", "first", "second"])


def cuts(text: Column, one: Column, other: Column) -> Column:
    """Struct of n units and the characters before the smaller and before the larger cut, from two whole numbers."""

    def run(texts: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        return _cuts(texts, a, b)

    return F.arrow_udf(run, "n long, first long, second long")(text, one, other)


def _transformed(text: Column, doc_id: Column, seed: str, rewritten: int, spm: int, rows: DataFrame) -> DataFrame:
    """rows with the columns text, h, cut, form, prefix, middle, suffix and output."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    rows = rows.withColumns({"text": text_or_empty(text), "h": F.transform(F.array(*[F.substring(key, 8 * i + 1, 8) for i in range(4)]), lambda x: F.conv(x, 16, 10).cast("long"))})
    rows = rows.withColumn("cut", cuts(F.col("text"), F.col("h")[0], F.col("h")[1]))
    t, n = F.col("text"), lambda c: F.col(c).cast("int")
    marked = F.contains(t, F.lit(PREFIX)) | F.contains(t, F.lit(SUFFIX)) | F.contains(t, F.lit(MIDDLE))
    plain = (t == "") | marked | (F.col("h")[2] % 100 >= rewritten)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h")[3] % 100 < spm, "spm").otherwise("psm"))
    prefix = t.substr(F.lit(1), n("cut.first"))
    middle = t.substr(n("cut.first") + 1, n("cut.second") - n("cut.first"))
    suffix = t.substr(n("cut.second") + 1, F.length(t) - n("cut.second"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm_ = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return rows.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(t))


def transformed(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", seed: str = SEED, rewritten: int = REWRITTEN, spm: int = SPM) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output."""
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    rows = _transformed(F.col("text"), F.col("doc_id"), seed, rewritten, spm, rows)
    chars = lambda c: F.when(F.col("form") != "plain", c)
    return rows.select("doc_id", F.col("cut.n").alias("n"), "form", chars(F.col("cut.first")).alias("prefix_chars"), chars(F.col("cut.second") - F.col("cut.first")).alias("middle_chars"), "output")


def rewritten(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", seed: str = SEED, rewritten: int = REWRITTEN, spm: int = SPM) -> DataFrame:
    """docs, with the output in place of each text."""
    rows = _transformed(F.col("doc")[text], F.col("doc")[doc_id], seed, rewritten, spm, boxed(docs))
    return rows.select(*[(F.col("output") if c == text else F.col("doc")[c]).alias(c) for c in docs.columns])


def restored(output: Column, form: Column) -> Column:
    """The text that transformed() made output from. No part holds a mark, and a mark begins with what occurs nowhere
    else in it, so the first of each mark is the mark."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        one = F.substring_index(output, second, 1)
        rest = output.substr(F.length(one) + len(second) + 1, F.length(output))
        two = F.substring_index(rest, MIDDLE, 1)
        return one.substr(F.lit(len(first) + 1), F.length(one)), two, rest.substr(F.length(two) + len(MIDDLE) + 1, F.length(rest))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
