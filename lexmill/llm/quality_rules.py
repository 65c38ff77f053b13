"""Quality rules: base rules, then the log-likelihood ratio of hashed n-grams between trusted and raw text.

Words and word pairs are hashed to buckets; two smoothed multinomials are counted, one over every document, the other
over trusted documents (labels with quality 1, at most TRUSTED of them by smallest hash: the documented bound of what
is fitted). The number of buckets grows with the square root of the corpus, up to MOST_BUCKETS, the bound of what is
broadcast; smoothing is a share of the mean bucket, so that a score means the same at every size. A document's score is
the mean over its n-grams of log trusted/raw, so length doesn't tell, and every document is held against the same
threshold.

Defined results: null text has no words; texts without n-grams score 0; without any trusted document all scores are 0;
repeated rows are judged alike; an empty table gives an empty result; extra columns, whatever their names, are kept by
accepted() and ignored by judge(). Labels of null doc_ids are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, materialize, quoted, unboxed
from .kernels import Words, pairs, repeated_lines, repeated_words, steps

LEAST_BUCKETS, MOST_BUCKETS, GROWTH = 1 << 16, 1 << 25, 8  # buckets: GROWTH times the square root of the n-grams
BYTES_A_GRAM = 3  # of text, about
TRUSTED = 20_000
THRESHOLD = -0.08  # mean log ratio per n-gram
SMOOTHING = 0.25  # of the mean raw n-grams of a bucket, that each is taken to have had before
LEAST_WORDS, MOST_REPEATED = 20, 30  # words; per cent of words in repeated windows
SYMBOLS = b"#*$%&|<>"
SLICE = 16  # bits of a bucket's place in a slice; counts and weights travel by slices
LOTS = 64  # tasks' counts are merged in so many lots at first

_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def n_buckets(n_bytes: int) -> int:
    """A power of two for a corpus of so many bytes of text."""
    wanted = GROWTH * int(np.sqrt(n_bytes / BYTES_A_GRAM))
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << wanted.bit_length()))


def grams(words: Words, h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of pairs of neighbours, and the text that each is of."""
    both = pairs(h)
    inside = words.doc[1:] == words.doc[:-1]
    at = np.concatenate([h, both[inside]]) >> np.uint64(65 - buckets.bit_length())
    return at.astype(np.int64), np.concatenate([words.doc, words.doc[1:][inside]])


def _count(buckets: int):
    def count(batches):
        counts = np.zeros((2, buckets), np.int32)
        for b in batches:
            trusted, k = b.column(1).to_numpy(zero_copy_only=False).astype(bool), 0
            for texts in steps(b.column(0).to_pylist()):
                words = Words(texts)
                at, doc = grams(words, words.hashes(), buckets)
                for row, some in ((0, at), (1, at[trusted[k + doc]])):
                    found, n = np.unique(some, return_counts=True)
                    counts[row, found] += n.astype(np.int32)
                k += len(texts)
        for k in range(buckets >> SLICE):
            if (part := _packed(k, *counts[:, k << SLICE : (k + 1) << SLICE])) is not None:
                yield part

    return count


COUNTED = "slice int, at binary, raw binary, trusted binary, n_raw long, n_trusted long"


def _packed(k: int, raw: np.ndarray, trusted: np.ndarray) -> pa.RecordBatch | None:
    """One row: the counts of a slice's buckets that have any."""
    at = np.flatnonzero(raw)
    if not len(at):
        return None
    parts = [at.astype(np.uint16), raw[at].astype(np.int64), trusted[at].astype(np.int64)]
    row = [pa.array([k], pa.int32()), *(pa.array([x.tobytes()]) for x in parts), pa.array([int(parts[1].sum())]), pa.array([int(parts[2].sum())])]
    return pa.RecordBatch.from_arrays(row, [c.split()[0] for c in COUNTED.split(", ")])


def _merge(batches):
    """Rows of COUNTED come sorted by slice; one of each goes on."""
    now, counts = None, None
    for b in batches:
        for k, at, raw, trusted, *_ in zip(*(c.to_pylist() for c in b.columns)):
            if k != now:
                if now is not None:
                    yield _packed(now, *counts)
                now, counts = k, np.zeros((2, 1 << SLICE), np.int64)
            places = np.frombuffer(at, np.uint16)
            counts[0, places] += np.frombuffer(raw, np.int64)
            counts[1, places] += np.frombuffer(trusted, np.int64)
    if now is not None:
        yield _packed(now, *counts)


def _weights(share: float, smoothing: float):
    def weigh(batches):
        for b in batches:
            for k, at, raw, trusted, *_ in zip(*(c.to_pylist() for c in b.columns)):
                out = np.zeros(1 << SLICE, np.float32)
                found = np.log((np.frombuffer(trusted, np.int64) + smoothing * share) / (share * (np.frombuffer(raw, np.int64) + smoothing)))
                out[np.frombuffer(at, np.uint16)] = found
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([out.tobytes()])], ["slice", "weights"])

    return weigh


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    return good.orderBy(F.xxhash64("id"), "id").limit(most)


def ratios(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> np.ndarray:
    """log trusted/raw of each bucket, in slices; MOST_BUCKETS small floats at most come to the driver."""
    texts = docs.select(quoted(text).cast("string").alias("text"), quoted(doc_id).alias("id"))
    buckets = n_buckets(texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    marked = texts.join(F.broadcast(trusted_ids(labels).withColumn("trusted", F.lit(True))), "id", "left")
    counted = marked.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted")).mapInArrow(_count(buckets), COUNTED)
    # A slice's rows, one of each task, come together in lots first, so that no task merges those of all.
    lots = counted.withColumn("lot", F.pmod(F.spark_partition_id(), F.lit(LOTS)))
    lots = lots.repartition("slice", "lot").sortWithinPartitions("slice").drop("lot").mapInArrow(_merge, COUNTED)
    sums = materialize(lots.repartition("slice").sortWithinPartitions("slice").mapInArrow(_merge, COUNTED), "quality-counts")
    raw, trusted = sums.agg(F.sum("n_raw"), F.sum("n_trusted")).first()
    out = np.zeros(buckets, np.float32)
    if not trusted:
        return out
    for r in sums.mapInArrow(_weights(trusted / raw, SMOOTHING * raw / buckets), "slice int, weights binary").collect():
        out[r.slice << SLICE : (r.slice + 1) << SLICE] = np.frombuffer(r.weights, np.float32)
    return out


def measures(texts: list[bytes], weights: np.ndarray | None) -> list[np.ndarray]:
    """The columns of BASE, and the score if there are weights."""
    words = Words(texts)
    h = words.hashes()
    out = [words.n, words.chars(), words.per_text(_SYMBOL[words.buf]), np.fromiter(map(repeated_lines, texts), np.int64, len(texts)), repeated_words(words, h)]
    if weights is not None:
        at, doc = grams(words, h, len(weights))
        n = np.bincount(doc, minlength=len(texts))
        out.append(np.bincount(doc, weights[at], minlength=len(texts)) / np.maximum(n, 1))
    return out


VERDICT = f"{BASE}, base_failed boolean, kept boolean, score double"


def _judge(weights, threshold: float):
    """The columns before the last (the text) as they are, then those of VERDICT."""
    names = [c.split()[0] for c in VERDICT.split(", ")]

    def judge(batches):
        for b in batches:
            if b.num_rows:
                *base, score = (np.concatenate(c) for c in zip(*(measures(t, weights.value) for t in steps(b.column(b.num_columns - 1).to_pylist()))))
                n, chars, symbols, lines, repeats = (c.astype(np.int64) for c in base)
                failed = (n < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * n)
                told = (n, chars, symbols, lines, repeats, failed, ~failed & (score >= threshold), score)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, told)], [*b.schema.names[:-1], *names])

    return judge


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, the base measures, base_failed, kept, score."""
    weights = docs.sparkSession.sparkContext.broadcast(ratios(docs, labels, text=text, doc_id=doc_id))
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text"))
    return rows.mapInArrow(_judge(weights, threshold), f"doc_id long, {VERDICT}")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without those rejected; rows don't move and, but for the text, don't leave the JVM."""
    weights = docs.sparkSession.sparkContext.broadcast(ratios(docs, labels, text=text, doc_id=doc_id))

    @F.pandas_udf("boolean")
    def kept(texts):
        import pandas as pd

        if not len(texts):
            return pd.Series([], dtype=bool)
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], ["text"])
        return pd.concat([b.column("kept").to_pandas() for b in _judge(weights, threshold)([batch])])

    return unboxed(boxed(docs, text=quoted(text).cast("string")).where(kept("text")), docs)
