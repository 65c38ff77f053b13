"""Vector compression: product codes from integer k-means, whose nearest entries a vantage-point tree finds.

Components become whole numbers, vectors are cut into equal parts, and each part position has a codebook. A tree over a
codebook's entries holds, at each node, an entry (the vantage point) and two shells of the rest by distance from it.
Distances are square roots, so a shell's radii are kept as whole numbers rounded outwards; for a part at distance d from
the vantage point the triangle inequality bounds its distance to all in a shell from below, again rounded so that the
bound is never too high. A shell is left out only if its bound is above the best so far; one that may hold an equal
distance is visited (ties go to the lower index), and what decides are squared distances in whole numbers.

A round assigns in tasks, each of which returns counts and sums per entry; Spark adds these up and the driver gets one
row per codebook component, entries times dimension in all. Codebooks are that small too where tasks get them.

Defined results: vectors that are null or hold null or non-finite components are dropped; so are those that can't be cut
into equal parts, and those of another length than most of the kept (of equally many, the shorter). Whole numbers over
LARGEST over the root of their vector's length count as that (components of 32,768 where there are 64), so that a vector's
squared distance fits a long. A null vec_id sorts last; rows of one vec_id are ordered by their vectors; repeated rows are entries and count as often as they are there; fewer kept rows
than entries give smaller codebooks; labels may be null and are then one group; an empty table gives an empty result;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialize, quoted

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LARGEST = 1 << 30  # of a whole-number component, over the root of how many there are: squared distances fit a long


def roots(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of whole numbers, rounded down and up to whole numbers."""
    down = np.sqrt(x.astype(np.float64)).astype(np.int64)
    down -= down * down > x
    down += (down + 1) * (down + 1) <= x
    return down, down + (down * down < x)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


@dataclass(frozen=True)
class Shell:
    """Entries at distances from low to high of a vantage point."""

    low: int
    high: int
    node: Node


@dataclass(frozen=True)
class Node:
    entry: int
    shells: tuple[Shell, ...]


class Tree:
    """A vantage-point tree over the entries of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        self.root = self._grow(np.arange(len(entries)))

    def _grow(self, ids: np.ndarray) -> Node:
        # An entry at the edge parts the rest best: the farthest from their mean.
        away = squared(self.entries[ids] * len(ids), self.entries[ids].sum(0)[None, :]) if len(ids) < 1024 else -ids
        at = int(np.argmax(away))
        vantage, rest = int(ids[at]), np.delete(ids, at)
        d = squared(self.entries[rest], self.entries[vantage][None, :])
        order = np.argsort(d, kind="stable")
        half = (len(rest) + 1) // 2
        shells = []
        for side in (order[:half], order[half:]):
            if len(side):
                down, up = roots(np.array([d[side].min(), d[side].max()]))
                shells.append(Shell(int(down[0]), int(up[1]), self._grow(rest[side])))
        return Node(vantage, tuple(shells))

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) of the nearest entry to each row, ties to the lower index; and the comparisons made."""
        index, best = np.full(len(q), len(self.entries)), np.full(len(q), np.iinfo(np.int64).max)
        return index, best, self._visit(self.root, q.astype(np.int64), np.arange(len(q)), index, best)

    def _visit(self, node: Node, q: np.ndarray, who: np.ndarray, index: np.ndarray, best: np.ndarray) -> int:
        d, made = squared(q[who], self.entries[node.entry][None, :]), len(who)
        better = (d < best[who]) | ((d == best[who]) & (node.entry < index[who]))
        best[who[better]], index[who[better]] = d[better], node.entry
        if not node.shells:
            return made
        down, up = roots(d)
        inner = down <= node.shells[0].high
        for these, order in ((inner, node.shells), (~inner, node.shells[::-1])):
            at = np.flatnonzero(these)
            for shell in order if len(at) else ():
                gap = np.maximum(np.maximum(down[at] - shell.high, shell.low - up[at]), 0)
                go = who[at[gap * gap <= best[who[at]]]]
                if len(go):
                    made += self._visit(shell.node, q, go, index, best)
        return made


def _parts(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """rows x parts x width"""
    return batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, parts, -1)


def whole_numbers(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """The kept vectors as a written table: vec_id, label, q (whole-number components, all of one length)."""
    x = F.col("x")
    rows = vectors.select(quoted(vec_id).alias("vec_id"), quoted(label).alias("label"), quoted(embedding).cast("array<double>").alias("x"))
    rows = rows.where(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size(x) % parts == 0))
    most = F.floor(LARGEST / F.sqrt(F.greatest(F.size(x), F.lit(1)))).cast("double")
    # Held between the bounds before it is made whole, as a double may be too large for a long.
    number = lambda v: F.floor(F.greatest(F.least(v * scale, most), -most)).cast("int")
    rows = materialize(rows.select("vec_id", "label", F.transform(x, number).alias("q")), "codes-vectors")
    usual = rows.groupBy(F.size("q").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("q") == (usual.size if usual else 0))


def _sums(books: list[np.ndarray]):
    trees = [Tree(b) for b in books]

    def run(batches):
        n = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            q = _parts(batch, len(books))
            for p, tree in enumerate(trees):
                index, _, _ = tree.nearest(q[:, p])
                n[p] += np.bincount(index, minlength=len(n[p]))
                np.add.at(sums[p], index, q[:, p])
        rows = [(p, e, int(n[p][e]), sums[p][e].tolist()) for p in range(len(books)) for e in np.flatnonzero(n[p]).tolist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["part", "entry", "n", "sums"])

    return run


def train(q: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook (entries x width) of each part position, from a table of whole_numbers()."""
    if not 1 <= entries <= 256:
        raise ValueError("an index is one byte: from 1 to 256 entries")
    first = q.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    start = np.array([r.q for r in first], np.int64)
    books = [start.reshape(len(first), parts, -1)[:, p] for p in range(parts)] if len(first) else []
    for _ in range(rounds if books else 0):
        sums = q.select("q").mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
        sums = sums.select("part", "entry", "n", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        moved = [b.copy() for b in books]
        for r in sums.toLocalIterator():
            moved[r.part][r.entry, r.at] = r.x // r.n
        if all(np.array_equal(a, b) for a, b in zip(books, moved)):
            break  # nothing would move in any later round
        books = moved
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encoded(q: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (binary, a byte for each part), error (summed squared distances to the chosen entries)."""
    trees = [Tree(b) for b in books]

    def run(batches):
        for batch in batches:
            parts = _parts(batch, len(trees))
            found = [t.nearest(parts[:, p]) for p, t in enumerate(trees)]
            code = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            error = np.sum([f[1] for f in found], axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], ["vec_id", "label", "code", "error"])

    kinds = [f"{c} {q.schema[c].dataType.simpleString()}" for c in ("vec_id", "label")]
    return q.select("vec_id", "label", "q").mapInArrow(run, f"{', '.join(kinds)}, code binary, error long")


def decoded(code: bytes, books: list[np.ndarray]) -> np.ndarray:
    """The whole-number vector that a code stands for."""
    return np.concatenate([b[i] for i, b in zip(code, books)])


def compressed(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per kept vector: vec_id, label, code, error, label_error (error over all rows of its label), codebooks_sha256."""
    q = whole_numbers(vectors, vec_id=vec_id, embedding=embedding, label=label, parts=parts, scale=scale)
    books = train(q, parts=parts, entries=entries, rounds=rounds)
    found = encoded(q, books) if books else q.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
    # One string for each label, and one for none, so that null labels meet.
    found = materialize(found.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "codes-found")
    groups = materialize(found.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("size")), "codes-labels")
    return join_groups(found, groups, "key", "size", "inner").select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
