"""Language identification by compression.

For each language a zstandard raw-content dictionary is cut from a bounded sample of its documents: at most SAMPLED of
them by smallest hash, of each a stretch from a place of its text that the hash says, equal shares of DICTIONARY bytes;
with so many languages that all would exceed ALL_DICTIONARIES, of an equal share of that. Stretches end between characters.
Whole texts, lower-cased and reduced to letters, are compressed piece by piece under every dictionary; the language of
the smallest total wins, ties by name. Where the runner-up is within MARGIN bytes or its share of the total, the
document is rejected: lang is null, while lang_pred still names the nearest.

Letters are Unicode's categories L*; marks, digits and other numbers aren't. Defined results: null texts and texts
without a letter are UNKNOWN with score 0; without anything to learn from, all are; languages of next to no text have a
dictionary of blanks; repeated rows get the same result; an empty table gives an empty result; extra columns, whatever
their names, are ignored. Very long texts are compressed a piece after the other, all at one level.
"""

from __future__ import annotations

import math
import re
import zlib

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import quoted

UNKNOWN = "und"
SAMPLED, DICTIONARY = 150, 30_000  # documents and bytes of each language that are learned from at most
ALL_DICTIONARIES = 24_000_000  # bytes, which every worker holds
LEAST_DICTIONARY = 8  # bytes that zstandard asks for
PIECE = 4096  # bytes compressed at once
LEVEL = 11  # 6 to 10 take half the time and make twice the errors on texts under a thousand letters
MARGIN, SHARE = 3, 0.01
SPREAD = 4.0  # bytes by which a total loses to another for odds of e
FAR = 200  # bytes: odds of e ** 50, which a double beside 1 doesn't hold
_MARKS, _OTHER = re.compile(r"[\W\d_]+"), regex.compile(r"\P{L}+")


def letters(text: str | None) -> bytes:
    """The runs of letters, lower-cased; the slower pattern only where numbers that aren't digits are left."""
    out = _MARKS.sub(" ", (text or "").lower())
    if not out.replace(" ", "").isalpha():
        out = _OTHER.sub(" ", out)
    return out.strip().encode("utf-8", "surrogatepass")


def _cut(data: bytes, most: int) -> bytes:
    """The first bytes, up to the end of a character."""
    return data[:most].decode("utf-8", "ignore").encode() if len(data) > most else data


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(quoted(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def dictionaries(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> dict[str, bytes]:
    """By language; about as many characters come to the driver as the dictionaries have bytes, ALL_DICTIONARIES at most."""
    docs = docs.select(quoted(doc_id).alias("doc_id"), quoted(lang).alias("lang"), quoted(text).cast("string").alias("text"))
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id") & F.col("text").rlike(r"\p{L}"))
    known = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    size = max(LEAST_DICTIONARY, min(DICTIONARY, ALL_DICTIONARIES // max(1, known.select("lang").distinct().count())))
    chosen = known.distinct().withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("n") <= SAMPLED)
    chosen = chosen.withColumn("share", F.ceil(F.lit(size) / F.count(F.lit(1)).over(W.partitionBy("lang"))).cast("int"))
    rows = docs.join(F.broadcast(chosen), ["lang", "doc_id"])
    place = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - F.col("share"), F.lit(0)) + 1).cast("int") + 1
    rows = rows.select("lang", "h", "share", F.substr("text", place, F.col("share")).alias("text")).distinct()
    found: dict[str, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r.lang, r.h, r.text)):
        found.setdefault(r.lang, []).append(_cut(letters(r.text), r.share))
    return {k: _cut(b"\n".join(v), size).ljust(LEAST_DICTIONARY) for k, v in sorted(found.items())}


class Classifier:
    def __init__(self, dicts: dict[str, bytes]):
        self.compressors = {k: self._compressor(d) for k, d in dicts.items()}

    @staticmethod
    def _compressor(content: bytes):
        import zstandard

        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=PIECE, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=how)

    def sizes(self, data: bytes) -> dict[str, int]:
        """The compressed size under each language, nearest by the first piece first. A language is left where it is once
        it is FAR or its margin behind the best, since no more of it can change the choice, the margin or the score."""
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        found = {k: len(c.compress(pieces[0])) for k, c in self.compressors.items()}
        best, most = None, math.inf
        for k in sorted(found, key=lambda k: (found[k], k)):
            for p in pieces[1:]:
                if found[k] > most:
                    break
                found[k] += len(self.compressors[k].compress(p))
            best = found[k] if best is None else min(best, found[k])
            most = best + max(FAR, SHARE * best + 1)
        return found

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, whether the margin is wide enough)."""
        data = letters(text)
        if not data or not self.compressors:
            return UNKNOWN, 0.0, False
        sizes = sorted((s, k) for k, s in self.sizes(data).items())
        (best, name), rest = sizes[0], sizes[1:]
        score = 1 / sum(math.exp(max(-700.0, (best - s) / SPREAD)) for s, _ in sizes)
        return name, score, not rest or rest[0][0] - best >= max(MARGIN, SHARE * best)


_made: dict[int, Classifier] = {}  # a worker's, from task to task


def _predict(dicts):
    def predict(batches):
        key = zlib.crc32(repr(dicts.value).encode())
        classify = _made.get(key) or _made.setdefault(key, Classifier(dicts.value))
        for b in batches:
            found = [classify(t.as_py()) for t in b.column(2)]
            if found:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, zip(*found))], ["doc_id", "held_out", "lang_pred", "score", "confident"])

    return predict


def identify(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, lang (null where rejected)."""
    dicts = docs.sparkSession.sparkContext.broadcast(dictionaries(docs, text=text, lang=lang, doc_id=doc_id))
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), quoted(text).cast("string").alias("text"))
    out = rows.mapInArrow(_predict(dicts), "doc_id long, held_out boolean, lang_pred string, score double, confident boolean")
    return out.select("doc_id", "held_out", "lang_pred", "score", F.when(F.col("confident"), F.col("lang_pred")).alias("lang"))
