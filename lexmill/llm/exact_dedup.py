"""Exact deduplication by two-pass Bloom filtering.

Texts are equal when they are so after deleting the six blanks. Pass one deals the hashes of all texts, eight bytes
each, to the parts of a counting filter whose cells stop at two; a part is some MB in one task, and there are as many as
the table needs, so no task holds or sends a filter of the whole. A hash with a cell below two occurs once; the others,
the repeated and a few false alarms, go into a Bloom filter of bounded size that is broadcast. Pass two looks every row
up in it: rows that it doesn't have pass straight through, and only the rest are shuffled and compared by SHA-256.

Of equal texts the one with the most code points stays, then the smallest doc_id (null: last), then the first row
read. Defined results: null text counts as empty; empty texts equal each other; of repeated rows one stays; an empty
table gives an empty result; extra columns, whatever their names, are kept by survivors() and ignored by assignments().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, bloom, boxed, in_bloom, join_groups, materialize, quoted, text_or_empty, unboxed

CELLS_A_ROW, PROBES = 16, 3
PART = 1 << 22  # cells of a part of the counting filter
BLOCK = 512  # cells among which all probes of a hash fall
HELD = 1 << 17  # hashes that a task deals at once


def normalized(text: Column) -> Column:
    return F.translate(text_or_empty(text), BLANKS, "")


def cells(h: np.ndarray, part: int = PART) -> np.ndarray:
    """PROBES cells of each unsigned hash in its part, by rows."""
    h = h * np.uint64(0x9E3779B97F4A7C15)
    block = (h >> np.uint64(40)) % np.uint64(max(part // BLOCK, 1)) * np.uint64(BLOCK)
    return np.stack([block + ((h >> np.uint64(9 * i)) & np.uint64(BLOCK - 1)) for i in range(PROBES)]).astype(np.int64)


def _deal(parts: int):
    """Hashes by part, each twice at most from one lot."""

    def deal(batches):
        held, size = [], 0

        def lots():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            h = np.concatenate([h, h[n > 1]])
            part = (h % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) > 0, [True]]))
            found = [(part[order[a]], h[order[a:b]].tobytes()) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["part", "hashes"])

        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += b.num_rows
            if size >= HELD:
                yield from lots()
                held, size = [], 0
        if size:
            yield from lots()

    return deal


def _flag(batches):
    """Rows (part, hashes) come sorted by part: of each, the hashes with no cell below two."""
    now, seen, known = None, None, []

    def flagged():
        h = np.unique(np.concatenate(known))
        h = h[(seen[cells(h)] > 1).all(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    for b in batches:
        for part, lot in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if part != now:
                if known:
                    yield from flagged()
                now, seen, known = part, np.zeros(PART, np.uint8), []
            h = np.frombuffer(lot, np.uint64)
            at, n = np.unique(cells(h), return_counts=True)
            seen[at] = np.minimum(seen[at] + np.minimum(n, 2), 2)
            known.append(h)
            if len(known) > 64:
                known = [np.unique(np.concatenate(known))]
    if known:
        yield from flagged()


def possibly_repeated(hashes: DataFrame, n: int) -> DataFrame:
    """(h): of the one column of n hashes, all that are repeated and a few that aren't."""
    parts = max(1, -(-n * CELLS_A_ROW // PART))
    dealt = hashes.mapInArrow(_deal(parts), "part long, hashes binary").repartition("part").sortWithinPartitions("part")
    return materialize(dealt.mapInArrow(_flag, "h long"), "dedup-flagged")


def repeat_filter(hashes: DataFrame, n: int):
    """A broadcast Bloom filter of the hashes that may be repeated."""
    flagged = possibly_repeated(hashes, n)
    return hashes.sparkSession.sparkContext.broadcast(bloom(flagged, flagged.count()))


def maybe_repeated(filt):
    """A function of a hash column: False only for hashes that occur once."""

    @F.pandas_udf("boolean")
    def test(h):
        import pandas as pd

        return pd.Series(in_bloom(h.to_numpy().view(np.uint64), filt.value))

    return test


def assignments(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    said = quoted(text)
    sig = docs.select(F.monotonically_increasing_id().alias("row"), quoted(doc_id).cast("long").alias("doc_id"), F.length(text_or_empty(said)).cast("long").alias("n_points"), F.sha2(normalized(said).cast("binary"), 256).alias("sha"))
    sig = materialize(sig.withColumn("h", F.xxhash64("sha")), "dedup-hashes", pack=True)
    filt = repeat_filter(sig.select("h"), sig.count())
    marked = sig.withColumn("maybe", maybe_repeated(filt)(F.col("h")))
    alone, rows = marked.where(~F.col("maybe")), marked.where("maybe")
    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("least"), F.bitwise_not("row").alias("first"))).alias("best")
    groups = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("size"), best).where("size > 1")
    groups = materialize(groups.select("sha", "size", F.bitwise_not("best.least").alias("keep"), F.bitwise_not("best.first").alias("keep_row")), "dedup-groups")
    out = join_groups(rows, groups, "sha", "size")
    lone = F.col("size").isNull()
    out = out.select(
        "doc_id",
        F.when(lone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (lone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    return out.unionByName(alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")))


def survivors(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without all but one of each group of equal texts; rows that occur once don't move.

    Rows of a group are reduced where they are read before one of each task and group is sent on.
    """
    said = quoted(text)
    sha = F.sha2(normalized(said).cast("binary"), 256)
    saved = materialize(docs.select(F.xxhash64(sha).alias("h")), "dedup-hashes", pack=True)
    filt = repeat_filter(saved, saved.count())
    order = F.struct(F.length(text_or_empty(said)).alias("n"), F.bitwise_not(quoted(doc_id).cast("long")).alias("least"), F.bitwise_not(F.monotonically_increasing_id()).alias("first"))
    rows = boxed(docs, sha=sha, order=order).withColumn("maybe", maybe_repeated(filt)(F.xxhash64("sha")))
    chosen = rows.where("maybe").groupBy("sha").agg(F.max_by("doc", "order").alias("doc"))
    return unboxed(rows.where(~F.col("maybe")).select("doc").unionByName(chosen.select("doc")), docs)
