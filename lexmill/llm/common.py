"""Helpers shared by the corpus operators: scratch tables, bounded broadcasts, distributed ranks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize, release, scratch_path, shared_dir  # noqa: F401
from ..sources.tables import read_table  # noqa: F401

#: Words are maximal runs of anything but these six blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def quoted(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """The columns more, and each row of docs whole in the one column doc: whatever docs' columns are called, they meet
    none of an operator's own."""
    return docs.select(*[c.alias(k) for k, c in more.items()], F.struct(*[quoted(c) for c in docs.columns]).alias("doc"))


def unboxed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def numbered(docs: DataFrame, stored: bool) -> DataFrame:
    """docs boxed, with row, which names each row the same however often it is read.

    stored says that docs is a table of files as it was read: row is then a row's file, by 64-bit hash of its path, and
    its place in that. Any other frame is written with numbers first.
    """
    if stored and docs.inputFiles():
        place = docs.metadataColumn("_metadata")
        return boxed(docs, row=F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("place")))
    return materialize(boxed(docs, row=F.monotonically_increasing_id()), "numbered")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "left") -> DataFrame:
    """Join rows to facts on their group, where one group may hold a large share of the rows.

    groups has one row for each key, with the group's number of rows in the column size. Groups of over a thousandth
    of all these rows are fewer than a thousand by counting, so those are broadcast and their rows don't move; the
    rest join by a shuffle in which no key has more than a thousandth. groups should be a written table.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    heavy = groups.where(F.col(size) * 1000 > total)
    light = groups.where(F.col(size) * 1000 <= total)
    near = rows.join(F.broadcast(heavy), key, "inner")
    far = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, how)
    return near.unionByName(far)


SLICE = 20  # bits of a place in a slice of a Bloom filter
BITS_A_HASH, MOST_BITS = 16, 1 << 28


def bloom_places(h: np.ndarray, size: int) -> list[np.ndarray]:
    """The two bits of unsigned 64-bit hashes in a filter of so many bits, a power of two."""
    last = np.uint64(size - 1)
    return [h & last, (h >> np.uint64(32)) & last]


def in_bloom(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes may be among those of the filter; all that are among them may."""
    hit = np.ones(len(h), bool)
    for at in bloom_places(h, len(bits) * 8):
        hit &= ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    return hit


def bloom(hashes: DataFrame, n: int) -> np.ndarray:
    """Bytes of a filter of the n hashes in the column h, made in slices. It has BITS_A_HASH bits a hash and MOST_BITS at
    most, so it may be broadcast; one that is fuller than that only passes more that a later, exact step turns away."""
    size = 1 << min(MOST_BITS.bit_length() - 1, max(SLICE, (BITS_A_HASH * n - 1).bit_length()))

    def slice_of(table):
        bits = np.zeros(1 << SLICE, bool)
        bits[table.column("place").to_numpy() & ((1 << SLICE) - 1)] = True
        return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()])})

    last = F.lit(size - 1)
    places = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(last), F.shiftrightunsigned("h", 32).bitwiseAND(last))).alias("place")).distinct()
    slices = places.withColumn("slice", F.shiftright("place", SLICE)).groupBy("slice").applyInArrow(slice_of, "slice long, bits binary")
    out = np.zeros(size // 8, np.uint8)
    for r in slices.toLocalIterator():
        out[r.slice << (SLICE - 3) : (r.slice + 1) << (SLICE - 3)] = np.frombuffer(r.bits, np.uint8)
    return out


def with_ranks(rows: DataFrame, order: list[str], within: list[str], rank: str = "rank") -> tuple[DataFrame, DataFrame]:
    """Rank narrow rows by the columns order (nulls last) within groups, without a group in one task.

    Rows are dealt out by range and written with the number of their partition; ranks inside a partition are added to
    the counts of the partitions before it. Returns (rows with __part and __inside, facts per __part and group with
    __before); rank = __before + __inside. within must be the leading columns of order, none of them null; the last of
    order should tell all rows apart, since rows equal in all of it go to one task.
    """
    cols = [F.col(c).asc_nulls_last() for c in order]
    dealt = materialize(rows.repartitionByRange(*cols).withColumn("__part", F.spark_partition_id()), "ranks")
    counts = dealt.groupBy("__part", *within).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*within).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    facts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inside = dealt.withColumn("__inside", F.row_number().over(W.partitionBy("__part", *within).orderBy(*cols)))
    return inside, facts
