"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Whether pieces fit depends on lengths alone, and there are at most CAPACITY of those; so Spark counts pieces by length,
and the plan is made on that histogram: classes of bins that hold the same lengths, with how many bins each stands for.
Best-fit decreasing fills the classes; then local search takes the emptiest bins and moves a document, or exchanges one
for one, two for one or one for two, with a fuller bin that has room for the difference. Every step adds to the sum of
squared fills, for as many bins of both classes at once as there are, until bins are empty or no step is left. Where
best fit leaves no bin to empty, the steps only gather room in few bins; README has the numbers of bins. The plan
has a few thousand rows at any size of the corpus; pieces find their places in it by their rank among the pieces of
their length, so nothing of the corpus itself leaves the executors.

Tokens: the vocabulary file's ids, each document ended by id END. Only documents over CAPACITY are cut; the first piece
takes the rest, the others are full. Defined results: null and empty texts are a single END; repeated rows and null
doc_ids are packed like others; an empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, quoted, with_ranks

CAPACITY = 1024
END = 2
BEYOND = re.compile("[^\t\n\r -~\u00a1-\u00ac\u00ae-\u017f]")
SPECIAL = "<|endoftext|>"
PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers.

    vocabulary is a file of tokenizers; ranks, if given, the same vocabulary for tiktoken, which is about three times as
    fast. The two part texts by the same pattern, but each by its own Unicode tables; so texts with anything beyond
    printable Latin letters and white space go to tokenizers.
    """

    def __init__(self, vocabulary: str, ranks: str | None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=found, special_tokens={})

    def slow(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or BEYOND.search(text) or SPECIAL in text:
            return self.slow(text)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


_encoders: dict[tuple, Encoder] = {}  # a worker's, from task to task


def cut(ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids."""
    n = len(ids)
    first = (n - 1) % capacity + 1
    edges = [0, *range(first, n + 1, capacity)]
    return [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def _pieces(files: tuple, capacity: int):
    def pieces(batches):
        encoder = _encoders.get(files) or _encoders.setdefault(files, Encoder(*files))
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for k, text in enumerate(b.column(1)):
                rows += [(ids[k], *p) for p in cut(np.append(encoder(text.as_py() or ""), np.uint32(END)).astype("<u4"), capacity)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PIECE.types)], names=PIECE.names)

    return pieces


def pieces_of(docs: DataFrame, files: tuple[str, str | None], capacity: int = CAPACITY, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text"))
    return rows.mapInArrow(_pieces(files, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


def best_fit(histogram: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing, for all pieces of a length together: patterns and how many bins each has."""
    by_room: dict[int, Counter] = defaultdict(Counter)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = min((r for r, bins in by_room.items() if r >= length and bins), default=None)
            if room is None:
                room, pattern, bins = capacity, (), left
            else:
                pattern, bins = next(iter(by_room[room].items()))
            each = min(room // length, left)
            n = min(bins, left // each)
            if pattern:
                by_room[room][pattern] -= n
                if not by_room[room][pattern]:
                    del by_room[room][pattern]
            by_room[room - each * length][(*pattern, (length, each))] += n
            left -= n * each
    return sum((Counter(bins) for bins in by_room.values()), Counter())


def _fill(pattern: Pattern) -> int:
    return sum(a * n for a, n in pattern)


def _changed(pattern: Pattern, out: tuple[int, ...], into: tuple[int, ...]) -> Pattern:
    c = Counter(dict(pattern))
    c.subtract(out)
    c.update(into)
    return tuple(sorted(((a, n) for a, n in c.items() if n), reverse=True))


def _subsets(pattern: Pattern) -> dict[int, tuple[int, ...]]:
    """Choices of one or two documents by their sum; one rather than two."""
    ones = {a: (a,) for a, _ in pattern}
    twos = {a + b: (a, b) for i, (a, n) in enumerate(pattern) for b, _ in pattern[i + (n < 2) :]}
    return twos | ones


class _Under:
    """The underfull classes as rows of arrays: fill, when the class was made, and from each number on the least sum of
    documents that a class could give back, of one document at most and of two."""

    def __init__(self, capacity: int):
        self.capacity, self.now, self.row, self.patterns, self.free = capacity, 0, {}, [], []
        self.fill, self.born = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.back = np.zeros((2, 0, capacity + 2), np.int32)

    def add(self, pattern: Pattern) -> None:
        if pattern in self.row or _fill(pattern) >= self.capacity:
            return
        if not self.free:
            more = max(64, len(self.fill))
            self.free = list(range(len(self.fill) + more - 1, len(self.fill) - 1, -1))
            self.fill = np.concatenate([self.fill, np.full(more, -1)])
            self.born = np.concatenate([self.born, np.zeros(more, np.int64)])
            self.back = np.concatenate([self.back, np.zeros((2, more, self.capacity + 2), np.int32)], axis=1)
            self.patterns += [None] * more
        i = self.free.pop()
        self.now += 1
        self.row[pattern], self.patterns[i], self.fill[i], self.born[i] = i, pattern, _fill(pattern), self.now
        for k, sums in enumerate(([0, *(a for a, _ in pattern)], [0, *_subsets(pattern)])):
            least = np.full(self.capacity + 2, 2 * self.capacity, np.int32)
            least[sums] = sums
            self.back[k, i] = np.minimum.accumulate(least[::-1])[::-1]

    def drop(self, pattern: Pattern) -> None:
        i = self.row.pop(pattern)
        self.fill[i], self.patterns[i] = -1, None
        self.free.append(i)

    def best(self, source: Pattern, many: bool, since: int) -> tuple[int, Pattern, tuple, tuple] | None:
        """The step that takes most from source: how much, to which class, what goes, what comes back. Only classes made
        after since are looked at, none emptier than source; source itself if there are many of it."""
        fill = _fill(source)
        fits = (self.fill >= max(fill, 0)) & (self.born > since)
        if not many:
            fits[self.row[source]] = False
        rows = np.flatnonzero(fits)
        if not len(rows):
            return None
        room, found = self.capacity - self.fill[rows], None
        for a, gone in _subsets(source).items():
            back = self.back[2 - len(gone), rows, np.maximum(a - room, 0)]
            k = int(np.argmin(back))
            if back[k] < a and (found is None or a - back[k] > found[0]):
                found = int(a - back[k]), self.patterns[rows[k]], gone, int(back[k])
        if found is None:
            return None
        much, target, gone, back = found
        sums = {0: ()} | ({a: (a,) for a, _ in target} if len(gone) == 2 else _subsets(target))
        return much, target, gone, sums[back]


def local_search(bins: Counter, capacity: int) -> Counter:
    """Moves and swaps between underfull bins, each adding to the sum of squared fills, until there is none.

    The emptiest class gives first. A class that found no step is tried again only against classes made since.
    """
    bins, under = Counter(bins), _Under(capacity)
    for p in bins:
        under.add(p)
    tried: dict[Pattern, int] = {}
    queue = [(_fill(p), p) for p in under.row]
    heapq.heapify(queue)
    while queue:
        _, source = heapq.heappop(queue)
        while source in under.row:
            step = under.best(source, bins[source] > 1, tried.get(source, 0))
            if step is None:
                tried[source] = under.now
                break
            _, target, gone, back = step
            n = min(bins[source], bins[target]) if target != source else bins[source] // 2
            for old in (source, target):
                bins[old] -= n
                if not bins[old]:
                    del bins[old]
                    under.drop(old)
                    tried.pop(old, None)
            for new in (_changed(source, gone, back), _changed(target, back, gone)):
                if new:
                    bins[new] += n
                    under.add(new)
        if not queue:
            queue = [(_fill(p), p) for p in under.row if tried.get(p, 0) < under.now]
            heapq.heapify(queue)
    return bins


def slots(bins: Counter) -> np.ndarray:
    """Rows (length, first rank, bins' first number, how many in a bin, offset): where the pieces of a length go."""
    taken: dict[int, int] = defaultdict(int)
    out, base = [], 0
    for pattern, n in bins.items():
        offset = 0
        for length, each in pattern:
            out.append((length, taken[length], base, each, offset))
            taken[length] += n * each
            offset += length * each
        base += n
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Counter:
    return local_search(best_fit(histogram, capacity), capacity)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pack-pieces", pack=True)
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    table = pieces.sparkSession.sparkContext.broadcast(slots(plan(histogram, capacity)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        rows, spread = table.value, np.int64(1) << np.int64(48)
        at = np.searchsorted(rows[:, 0] * spread + rows[:, 1], length.to_numpy() * spread + rank.to_numpy(), "right") - 1
        _, first, base, each, offset = rows[at].T
        k = rank.to_numpy() - first
        return pd.DataFrame({"sequence_id": base + k // each, "offset": offset + k % each * length.to_numpy()})

    rows, facts = with_ranks(pieces, ["length", "doc_id", "piece", "row"], ["length"])
    placed = rows.join(facts, ["__part", "length"]).withColumn("at", place("length", F.col("__before") + F.col("__inside") - 1))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pack_documents(docs: DataFrame, files: tuple[str, str | None] | None = None, capacity: int = CAPACITY, **names: str) -> DataFrame:
    """files: the vocabulary for tokenizers, and the same one's ranks for tiktoken or None."""
    return pack(pieces_of(docs, files or default_files(), capacity, **names), capacity)
