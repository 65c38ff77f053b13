"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint's 64 bits are 32 segments of two; the vector of their bit counts is the embedding, and its Manhattan
distance never exceeds the Hamming distance. Counts are held in unary, two bits each, so that distance is the number of
differing bits of two longs.

The grid: counts run from 0 to 2, so a range of 4 covers every single axis and a cell of adjoining values would hold all;
what a Manhattan range of 4 does restrict is on how many axes two vectors differ, which is 4 at most. So axes fall into G
groups, vectors in range agree on at least G - 4 whole groups, and the grid's cells are the agreements on every choice of
G - 4 groups; any pair in range shares a cell. In a cell, pairs are held against the Manhattan bound and then exactly,
and only links that connect something are returned: what is already connected isn't compared again, so a cell full of
near copies costs little more than its size. Cells too full for one task are dealt out as pairs of blocks. G follows the
number of fingerprints, for cost alone. All pairs within RADIUS are connected, but near copies by shingles may lie beyond
it: README has the recall. Equal fingerprints are one vertex; components come from contraction rounds over written tables.

Defined results: null text counts as empty; texts without a word have fingerprint zero and link like any other; a null
doc_id is never a component's id unless all its ids are null; repeated rows are in one component; an empty table gives
an empty result; extra columns, whatever their names, are kept by survivors() and ignored by components_of().
"""

from __future__ import annotations

import re
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialize, numbered, quoted, release, unboxed

RADIUS = 4
SHINGLE = 4
SEED = 42
BLOCK = 40_000  # members of a cell that meet in one task at most
FEW = 200_000  # row numbers broadcast at most
SMALL_RUN = 48
_CUT = 1 << 21
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
ODD = 0x5555555555555555


def _parts(text: bytes):
    """A text in lists of words, some MB at a time; each but the first starts with the three words before it."""
    at, tail = 0, []
    while at < len(text):
        stop = _BLANK.search(text, at + _CUT)
        end = stop.start() if stop else len(text)
        words = text[at:end].split()
        yield tail + words
        tail = (tail + words)[-(SHINGLE - 1) :]
        at = end


def fingerprint(text: str | None) -> int:
    counts, n, words = np.zeros(64, np.int64), 0, []
    for words in _parts((text or "").encode("utf-8", "surrogatepass").lower()):
        if len(words) < SHINGLE:
            continue
        line = b" ".join(words)
        ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
        starts = [0, *(e + 1 for e in ends)]
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])), ">u8", len(words) - SHINGLE + 1)
        for k in range(0, len(h), 4096):
            counts += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
        n += len(h)
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(batches):
    for b in batches:
        fp = np.fromiter(map(fingerprint, (x.as_py() for x in b.column(2))), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["row", "doc_id", "fp"])


def unary(fp: Column) -> Column:
    """The embedding: of each two bits the count, as 00, 01 or 11."""
    up = F.shiftrightunsigned(fp, 1)
    odd = F.lit(ODD)
    return fp.bitwiseOR(up).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(up).bitwiseAND(odd), 1))


def grid(groups: int) -> list[int]:
    """Masks over the embedding, one for each choice of groups - RADIUS groups."""
    edges = [round(32 * i / groups) for i in range(groups + 1)]
    masks = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [int(np.uint64(sum(c)).astype(np.int64)) for c in combinations(masks, groups - RADIUS)]


def groups_for(n: int) -> int:
    """The G of least cost: a cell's row costs about as much as 300 comparisons; two bits agree in 3 of 8 cases."""
    return min(range(6, 10), key=lambda g: comb(g, RADIUS) * (300 + n * 0.375 ** (32 * (g - RADIUS) / g)))


def spanning(u: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links between members of one cell that connect all it connects, as indices."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(u[left] ^ u[i]) <= radius
            near[near] = np.bitwise_count(fp[left[near]] ^ fp[i]) <= radius
            if near.any():
                hit, left = left[near], left[~near]
                a.append(np.full(len(hit), i))
                b.append(hit)
                queue.extend(hit)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def _linked(key: np.ndarray, u: np.ndarray, fp: np.ndarray):
    """Links (a, b) within runs of equal key."""
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(edges)
    run = np.repeat(size, size)
    small = (run > 1) & (run <= SMALL_RUN)
    place = np.flatnonzero(small)
    found = []
    for d in range(1, SMALL_RUN):
        place = place[place + d < len(key)]
        place = place[key[place] == key[place + d]]
        if not len(place):
            break
        near = place[np.bitwise_count(u[place] ^ u[place + d]) <= RADIUS]
        near = near[np.bitwise_count(fp[near] ^ fp[near + d]) <= RADIUS]
        found.append((fp[near], fp[near + d]))
    for k in np.flatnonzero(size > SMALL_RUN):
        s = slice(edges[k], edges[k + 1])
        a, b = spanning(u[s], fp[s])
        found.append((fp[s][a], fp[s][b]))
    return found


def _links(batches):
    """Rows (key, u, fp) come sorted by key; a run may go on in the next batch."""
    held = None
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        cols = [x.view(np.uint64) for x in cols]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        if not len(cols[0]):
            continue
        cut = np.searchsorted(cols[0].view(np.int64), cols[0].view(np.int64)[-1], "left")
        held = [x[cut:] for x in cols]
        yield from _batch(_linked(*(x[:cut] for x in cols)) if cut else [])
    if held is not None:
        yield from _batch(_linked(*held))


def _batch(found):
    if found and (a := np.concatenate([x for x, _ in found])).size:
        b = np.concatenate([y for _, y in found])
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def links(fps: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """(a, b) of distinct fingerprints (column fp) within RADIUS, enough to connect all that are connected."""
    masks = grid(groups_for(n))
    cells = fps.withColumn("u", unary(F.col("fp"))).select(F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("choice", "mask"), "u", "fp")
    cells = cells.select(F.xxhash64("choice", F.col("u").bitwiseAND(F.col("mask"))).alias("key"), "u", "fp")
    full = materialize(cells.groupBy("key").count().where(F.col("count") > block), "simhash-full")
    if n_full := full.count():
        full = full.select("key", F.ceil(2 * F.col("count") / block).cast("int").alias("parts"))
        full = F.broadcast(full) if n_full <= FEW else full
        dealt = cells.join(full, "key", "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        cells = dealt.select(F.when(F.col("parts").isNull(), F.col("key")).otherwise(pair).alias("key"), "u", "fp")
    met = cells.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of the edges (a, b); root is the same for all of a component.

    In each round every vertex takes the neighbour, or itself, of least hash, and edges are drawn between what their
    ends took; what is left of a component halves or better as a rule. Each round is written; no vertex leaves Spark.
    """
    edges = materialize(edges, "links")
    roots = None
    while not edges.isEmpty():
        before = [edges] if roots is None else [edges, roots]
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
        least = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))
        took = both.groupBy("v").agg(F.min(least("w")).alias("m")).select("v", F.least("m", least("v"))["x"].alias("to"))
        took = materialize(took, "link-round")
        ends = edges.join(took.select(F.col("v").alias("a"), F.col("to").alias("ta")), "a").join(took.select(F.col("v").alias("b"), F.col("to").alias("tb")), "b")
        edges = materialize(ends.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
        if roots is None:
            roots = took.withColumnRenamed("to", "root")
        else:
            step = took.select(F.col("v").alias("root"), "to")
            roots = materialize(roots.join(step, "root", "left").select("v", F.coalesce("to", "root").alias("root")), "link-roots")
            before.append(took)
        release(*before)
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")) if roots is None else roots


def components_of(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", row: Column | None = None, block: int = BLOCK) -> DataFrame:
    """One row per document: row, doc_id, fingerprint, component_id, group_size, first (row that stays)."""
    row = F.monotonically_increasing_id() if row is None else row
    rows = docs.select(row.alias("row"), quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    marked = materialize(rows.mapInArrow(_fingerprints, f"row {kind}, doc_id long, fp long"), "simhash-fingerprints", pack=True)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kinds = materialize(marked.groupBy("fp").agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("first")), "simhash-kinds")
    roots = connected(links(kinds.select("fp"), kinds.count(), block))
    kinds = kinds.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kinds = materialize(kinds, "simhash-roots")
    groups = materialize(kinds.groupBy("root").agg(F.min("first").alias("best"), F.sum("size").alias("group_size"), F.count(F.lit(1)).alias("n_kinds")), "simhash-groups")
    told = join_groups(kinds, groups, "root", "n_kinds", "inner")
    told = materialize(told.select("fp", "size", "group_size", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("first")), "simhash-told")
    out = join_groups(marked, told, "fp", "size", "inner")
    return out.select("row", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size", "first")


def survivors(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", stored: bool = False) -> DataFrame:
    """docs with one document, that of the smallest doc_id, of each component. stored: see common.numbered()."""
    rows = numbered(docs, stored)
    found = components_of(rows.select("row", F.col("doc")[doc_id].alias("doc_id"), F.col("doc")[text].alias("text")), row=F.col("row"))
    gone = materialize(found.where("group_size > 1 and row <> first").select("row"), "simhash-gone")
    gone = F.broadcast(gone) if gone.count() <= FEW else gone
    return unboxed(rows.join(gone, "row", "left_anti"), docs)
